import random
import re

from pyspark.sql import functions as F

from pairsight.functions.values import instruments
from pairsight.plans.rules import missing_instruments


def test_names_are_missing_where_a_search_of_the_text_misses_them(spark):
    r = random.Random(2)
    names, gaps, numbers = ["Lloyd", "Zwick", "XLloyd", "Abc"], [" ", "  ", "\n", "\u00a0"], ["3300", "330", "33001", "555"]
    piece = lambda: r.choice(names + ["lloyd", "LLOYD", "é", "9"]) + r.choice(["", *gaps]) + r.choice([*numbers, "", "x"])
    texts = {f"p{i}": " ; ".join(piece() for _ in range(r.randint(0, 6))) for i in range(60)} | {"long": "word " * 20000 + "Zwick 3300 at the end", "none": ""}
    methods = [(p, f"T{k}", k, f"by {r.choice(names)}{r.choice(gaps)}{r.choice(numbers)} or Zwick 3300; ISO 10993") for p in [*texts, "no report"] for k in range(4)]
    protocol = spark.createDataFrame(methods, "pair_id string, test_id string, row_ord int, method string").withColumn("spans", F.lit(None).cast("string"))
    reports = spark.createDataFrame(list(texts.items()), "pair_id string, report_text string")
    found = protocol.select("pair_id", "test_id", F.explode(instruments(F.col("method"))).alias("token")).collect()
    wanted = sorted((x.pair_id, x.test_id, x.token) for x in found if x.pair_id in texts and x.token.lower() not in texts[x.pair_id].lower())
    got = missing_instruments(protocol, reports)
    assert sorted((x.pair_id, x.test_id, x.token) for x in got.collect()) == wanted and 20 < len(wanted) < len(found) - 20
    assert any(re.search(r"\u00a0|\n|  ", t) for *_, t in wanted)


def test_no_text_goes_to_each_test(spark):
    protocol = spark.createDataFrame([("p", "T1", 1, "Lloyd 3300", "s")], "pair_id string, test_id string, row_ord int, method string, spans string")
    texts = spark.createDataFrame([("p", "x")], "pair_id string, report_text string")
    plan = missing_instruments(protocol, texts)._jdf.queryExecution().optimizedPlan().toString()
    for join in re.findall(r"Join .*\n((?:.*\n)*)", plan):
        assert "Contains" not in join
    assert "Contains(" not in plan and plan.count("regexp_extract_all(lower(report_text") == 1
