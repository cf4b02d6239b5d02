"""Sides of joins that grow with the input don't go through the driver, however small Spark takes them to be."""

from pyspark.sql import functions as F

from pairsight.operators.locate import locate, parse_with_model
from pairsight.operators.repair import repaired
from pairsight.operators.structure import tables
from pairsight.sources.documents import lines


def joins(df) -> str:
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    return plan


def pages(spark, text):
    return lines(spark.range(4).select(F.col("id").cast("string").alias("pair_id"), F.lit("report").alias("doc_key"), F.lit("").alias("name"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text")))


def test_tables_are_joined_by_shuffle(spark):
    rows, errors = tables(pages(spark, "Test ID   Acceptance criterion   n tested\nT1        >= 5                   "))
    assert "Broadcast" not in joins(rows) and "Broadcast" not in joins(errors)
    assert sorted((r.pair_id, r.test_id, r.sample_size) for r in rows.collect()) == [(str(i), "T1", str(i)) for i in range(4)]


def test_quotations_and_replies_are_joined_by_shuffle(spark):
    text = pages(spark, "a word and ")
    quotes = text.select("pair_id", "doc_key", F.lit("1").alias("quote_id"), F.lit("word and").alias("quote"), F.lit(1).alias("hint"))
    found = locate(quotes, text)
    assert "Broadcast" not in joins(found) and [r.start for r in found.collect()] == [2] * 4
    reply = F.lit('{"tests": [{"test_id": {"value": "word", "line": 1}}], "fields": [{"key": "Title", "value": "and", "line": 1}], "sections": [{"title": "a", "line": 1}]}')
    made = parse_with_model(text.select("pair_id", "doc_key", reply.alias("reply")), text)
    assert [df.count() for df in made] == [4, 4, 4, 4]
    assert all("Broadcast" not in joins(df) for df in made[1:])


def test_quotations_that_repeat_are_looked_for_once(spark, monkeypatch):
    from pairsight.operators import locate as module

    made = []
    monkeypatch.setattr(module, "stored", lambda df, folder, keep=module.stored: made.append(keep(df, folder)) or made[-1])
    text = pages(spark, "a word and ")
    quotes = text.select("pair_id", "doc_key", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("quote_id"), F.lit("word and").alias("quote"), F.lit(1).alias("hint"))
    assert locate(quotes, text).where("start = 2").count() == 200
    # what was written last is what was found, a row for each question
    assert made[-1].count() == 4


def test_repairs_are_joined_by_shuffle(spark):
    page = spark.range(4).select(F.col("id").cast("string").alias("pair_id"), F.lit("report").alias("doc"), F.lit(1).alias("page"), F.concat(F.lit("cart ridge "), "id").alias("shown"), F.concat(F.lit("cartridge "), "id").alias("flat"))
    done = repaired(page, page)
    assert "Broadcast" not in joins(done) and sorted(r.display for r in done.collect()) == [f"cartridge {i}" for i in range(4)]
