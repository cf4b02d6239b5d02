import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairsight.functions import text as T
from pairsight.functions import values as V
from pairsight.operators import locate
from pairsight.operators.structure import cell_text, gutters
from pairsight.sources.documents import lines, uploads


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


CRITERIA = [
    ("≥ 640 kPa", ("threshold", ">=", 640.0, None, None, "kpa", "")), ("≤ 8 fibres ≥40 µm per litre", ("threshold", "<=", 8.0, None, None, "fibres >=40 um per litre", "")), ("2.1 – 3.4 L", ("range", "", None, 2.1, 3.4, "l", "")),
    ("Panel score ≤ 3", ("threshold", "<=", 3.0, None, None, "", "panel score")), ("No visible bleaching at 72 h", ("qualitative", "", None, None, None, "", "")), ("Per ISO 2859-1", ("range", "", None, 2859.0, 1.0, "", "")), ("< 9 L", ("qualitative", "", None, None, None, "", "")),
]


def test_criteria(spark):
    rows = spark.createDataFrame([(t,) for t, _ in CRITERIA], "t string").select("t", V.criterion(F.col("t"), T.nfkc("t")).alias("c")).collect()
    for (text, wanted), r in zip(CRITERIA, rows, strict=True):
        assert (r.c.kind, r.c.op, r.c.value, r.c.low, r.c.high, r.c.unit, r.c.prefix) == wanted, text
    assert one(spark, V.criterion(F.col("t")), t="  ") is None
    said = V.describe(V.criterion(F.col("t")))
    assert [one(spark, said, t=t) for t in ("≥ 640 kPa", "2.1 – 3.4 L", "≤ 3", "by eye")] == [">= 640 kpa", "2.1 - 3.4 l", "<= 3", "by eye"]


def test_bounds_belong_to_a_criterion(spark):
    c = V.criterion(F.col("t"))
    for text, value, out in (("≥ 640 kPa", 639.9, True), ("≥ 640 kPa", 640.0, False), ("2.1 – 3.4 L", 3.41, True), ("2.1 – 3.4 L", 2.0, True), ("2.1 – 3.4 L", 3.4, False)):
        assert one(spark, V.outside(c, F.lit(value)), t=text) is out


def test_measurements(spark):
    got = lambda t, prefix="": [(m.label, m.value) for m in one(spark, V.measurements(F.col("t"), F.lit(prefix)), t=t)]
    assert got("Min 610 kPa, mean 688 kPa. Filled at room temperature.") == [("min", 610.0), ("mean", 688.0)]
    assert got("Range 2.3 – 3.9 L (a single one at 3.9 L), mean 2.9 L.") == [("min", 2.3), ("max", 3.9), ("mean", 2.9)]
    assert got("Panel score 2.") == [] and got("Panel score 2.", "panel score") == [("observation", 2.0)]
    assert got("") == []


def test_small_values(spark):
    assert one(spark, V.integer(F.col("t")), t=" 24 ") == 24 and one(spark, V.integer(F.col("t")), t="Per ISO 2859-1") is None
    assert one(spark, V.date(F.col("t")), t="Date: 19 April 2024") == datetime.date(2024, 4, 19)
    assert one(spark, V.date(F.col("t")), t="31 February 2026") is None and one(spark, V.date(F.col("t")), t="none") is None
    assert one(spark, V.temperatures(F.col("t")), t="Fill with water at 45°C") == [45.0]
    assert one(spark, V.qualifiers(F.col("t")), t="No bleaching at 72 h") == ["72 h"]
    assert one(spark, V.instruments(F.col("t")), t="Lloyd 3300 per ISO 2859") == ["Lloyd 3300"]
    assert [one(spark, T.number(F.lit(x))) for x in (5.0, 0.45, 30.0, -1.5)] == ["5", "0.45", "30", "-1.5"]
    assert one(spark, T.mask(F.col("t")), t="abcdefghijkl") == "abcdef...ijkl" and one(spark, T.mask(F.col("t")), t="abc") == "***"


@settings(max_examples=25, deadline=None)
@given(st.text("ab  \t", max_size=30))
def test_squash(spark, t):
    assert one(spark, T.squash("t"), t=t) == " ".join(t.split())


@settings(max_examples=25, deadline=None)
@given(st.text("ab cé", max_size=12), st.integers(0, 12), st.integers(0, 8))
def test_slices_go_on_with_spaces(spark, raw, start, size):
    assert one(spark, T.padded_slice("t", F.lit(start), F.lit(start + size)), t=raw) == raw.ljust(start + size)[start : start + size]


def test_places_are_counted_in_characters(spark):
    for raw, pattern, at in (("😀é b", "b", 3), ("ab", "b", 1), ("ab", "c", -1), ("😀", "c", -1), ("😀😀a a", "(?i)^A|A$", 4), (None, "a", None)):
        assert one(spark, T.found_at("t", F.lit(pattern)), t=raw) == at


@pytest.mark.parametrize(("rows", "wanted"), [(["ab  cd", "a   c"], [(0, 2), (4, 6)]), (["  ab c", "  a  c"], [(2, 6)]), ([" ab", " a"], [(0, 3)]), (["ab", ""], [(0, 2)])])
def test_gutters(spark, rows, wanted):
    assert [(c.start, c.end) for c in one(spark, gutters(F.array(*map(F.lit, rows))))] == wanted


def test_cells_and_quotes(spark):
    assert one(spark, cell_text(F.array(F.lit("Per ISO 2859-"), F.lit("1")))) == "Per ISO 2859-1"
    assert one(spark, cell_text(F.array(F.lit("a -"), F.lit("b")))) == "a - b"


def test_locate(spark):
    docs = spark.createDataFrame([("p", "report", "", "Grade:  2.0\nno bleaching was\nseen on any part here\nGrade:  2.0")], "pair_id string, doc_key string, name string, text string")
    quotes = [("a", "Grade: 2.0", 99), ("b", "Grade: 2.0", 4), ("c", "bleaching was seen on any part", 0), ("d", "invented", 1), ("e", None, 1)]
    q = spark.createDataFrame([("p", "report", *x) for x in quotes], "pair_id string, doc_key string, quote_id string, quote string, hint int")
    got = {r.quote_id: r for r in locate.locate(q, lines(docs)).collect()}
    assert (got["a"].line, got["a"].text, got["b"].line) == (1, "Grade:  2.0", 4)
    assert (got["c"].line, got["c"].text, got["c"].rest) == (2, "bleaching was", "seen on any part")
    assert got["d"].line is None and got["e"].line is None


def test_a_word_that_a_hyphen_breaks_is_found_in_its_column_only(spark):
    text = "x   model ABC-\n    4711 and 7\nmodel ABD-\n          4711\nmodel ABE-5\n4711"
    docs = spark.createDataFrame([("p", "report", "", text)], "pair_id string, doc_key string, name string, text string")
    q = spark.createDataFrame([("p", "report", f"model {x}-4711", f"model {x}-4711", None) for x in ("ABC", "ABD", "ABE")], "pair_id string, doc_key string, quote_id string, quote string, hint int")
    found = locate.locate(q, lines(docs)).withColumn("spans", locate.spans_of(F.col("doc_key")))
    got = {r.quote_id: [(s.line, s.start, s.text) for s in r.spans] for r in found.collect()}
    assert got == {"model ABC-4711": [(1, 4, "model ABC-"), (2, 4, "4711")], "model ABD-4711": [], "model ABE-4711": []}


def test_suggestions(spark):
    docs = spark.createDataFrame([("p", k, "", "one line\ntwo line") for k in ("protocol", "report")], "pair_id string, doc_key string, name string, text string")
    item = lambda i, said="look", q="one line": f'{{"scope":"t{i}","observation":"{said}","reviewer_action":"check","protocol_quote":"{q}","protocol_line":1,"report_quote":"two line","report_line":2}}'
    reply = 'Here:\n```json\n{"suggestions":[' + ",".join([item(0, "this passes"), item(1, q="nowhere"), *(item(i) for i in range(2, 22))]) + "]}\n```"
    kept, notes = locate.suggestions(spark.createDataFrame([("p", reply)], "pair_id string, reply string"), lines(docs))
    rows = kept.orderBy("id").collect()
    assert [r.id for r in rows] == [f"AI-{i:03d}" for i in range(1, 7)] and [r.scope for r in rows[:2]] == ["T1", "T2"]
    # of the second one quotation is there; after the sixth that is kept nothing is looked at
    assert [[c.doc for c in r.citations] for r in rows] == [["report"]] + [["protocol", "report"]] * 5
    assert {(r.ord, r.note) for r in notes.collect()} == {(0, "verdict language"), (1, "protocol quotation not found")}
    lost = spark.createDataFrame([("p", '{"suggestions":[' + ",".join([item(3, q="nowhere").replace("two line", "never"), '{"observation":" "}', item(4, said="look", q=" ").replace('"check"', '" "')]) + "]}"), ("q", "no JSON"), ("r", None)], "pair_id string, reply string")
    kept, notes = locate.suggestions(lost, lines(docs))
    assert [(r.id, r.scope, r.action) for r in kept.collect()] == [("AI-001", "T4", locate.LOOK)]
    assert {(r.pair_id, r.ord, r.note) for r in notes.collect()} == {("p", 0, "quotation not found"), ("q", -1, "the reply can't be read")}


def test_a_model_that_raises_fails_only_its_row(spark):
    prompts = spark.createDataFrame([("a", "x"), ("b", "y")], "pair_id string, prompt string")

    def model(p):
        if p == "y":
            raise ValueError("no")
        return p.upper()

    got = locate.ask(prompts, model, wait=0)
    assert {(r.pair_id, r.reply, r.error, r.attempts) for r in got.collect()} == {("a", "X", None, 1), ("b", None, "ValueError: no", 2)}

    def refuses(p):
        if p == "y":
            raise locate.ModelRefused("key")
        return {"content": "Z", "usage": {"prompt_tokens": 3, "completion_tokens": 4}}

    got = locate.ask(prompts, refuses, retries=5).persist()
    assert {(r.pair_id, r.reply, r.attempts) for r in got.collect()} == {("a", "Z", 1), ("b", None, 1)}
    assert tuple(locate.usage(got).first()) == (1, 3, 4)


def test_uploads(spark):
    import base64

    ok = base64.b64encode(b"%PDF-1.4").decode()
    rows = spark.createDataFrame([("dir/a.pdf", ok), ("b", "###"), ("c", ""), ("d", base64.b64encode(b"hello").decode())], "name string, data string")
    got = {r.name: r.error for r in uploads(rows).collect()}
    assert got == {"a.pdf": None, "b": "not base64", "c": "empty", "d": "not a PDF"}
