"""Structure of documents from their lines: header fields, sections, and the test table of a fixed-width layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squash, trimmed
from ..sources.shared import by_shuffle

DOC = ["pair_id", "doc_key"]
#: What a heading, a header field and a bullet look like.
SECTION = r"(?U)^\s{0,3}(\d+)\.\s+(\S.*)$"
FIELD = r"(?U)^\s*([A-Za-z][A-Za-z /]{2,30}):\s+(\S.*)$"
BULLET = r"(?U)^\s*[●•▪·o]\s+"
#: Header labels of test tables and what they are called here.
LABELS = {
    "test id": "test_id", "test": "test_name", "acceptance criterion": "criterion", "acceptance criteria": "criterion",
    "sample size": "sample_size", "n tested": "sample_size", "n": "sample_size",
    "method / conditions": "method", "method/conditions": "method", "method": "method",
    "result and disposition": "result", "result": "result",
}
CELLS = ("test_id", "test_name", "criterion", "sample_size", "method", "result")
REQUIRED = ("test_id", "criterion", "sample_size")
SPANS = "array<struct<doc:string,page:int,line:int,start:int,end:int,text:string>>"


@dataclass
class Structure:
    """What another source than the parser has found in documents (pair_id, doc_key): rows as tables(), fields() and sections() give them."""

    documents: DataFrame
    tests: DataFrame
    fields: DataFrame
    sections: DataFrame


def sections(lines: DataFrame) -> DataFrame:
    """pair_id, doc_key, number, title, page, start, end: numbered headings; a section ends at the next heading or its page's end."""
    last = F.max("line").over(Window.partitionBy(*DOC, "page"))
    heads = lines.withColumn("last", last).where(F.col("raw").rlike(SECTION))
    w = Window.partitionBy(*DOC).orderBy("page", "line")
    end = F.when(F.lead("page").over(w) == F.col("page"), F.lead("line").over(w)).otherwise(F.col("last") + 1)
    return heads.select(*DOC, F.regexp_extract("raw", SECTION, 1).cast("int").alias("number"), squash(F.regexp_extract("raw", SECTION, 2)).alias("title"), "page", F.col("line").alias("start"), end.alias("end"))


def section_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Every line with the section that it lies in."""
    return lines.join(found, [*DOC, "page"]).where((F.col("line") >= F.col("start")) & (F.col("line") < F.col("end")))


def fields(lines: DataFrame) -> DataFrame:
    """pair_id, doc_key, key, value, page, line, span: ``Key: value`` lines above the first section. A key that comes again has its last value."""
    place = F.struct("page", "line")
    first = F.min(F.when(F.col("raw").rlike(SECTION), place)).over(Window.partitionBy(*DOC))
    kv = lines.withColumn("first", first).where(F.col("raw").rlike(FIELD) & F.coalesce(place < F.col("first"), F.lit(True)))
    kv = kv.withColumn("key", squash(F.regexp_extract("raw", FIELD, 1))).withColumn("value", squash(F.regexp_extract("raw", FIELD, 2)))
    span = F.struct(F.col("doc_key").alias("doc"), F.col("page").cast("int").alias("page"), F.col("line").cast("int").alias("line"), *(trimmed(F.col("raw"), F.lit(0), F.length("raw"))[c].alias(c) for c in ("start", "end", "text")))
    latest = F.row_number().over(Window.partitionBy(*DOC, "key").orderBy(F.desc("page"), F.desc("line")))
    return kv.withColumn("n", latest).where("n = 1").select(*DOC, "key", "value", "page", "line", span.alias("span"))


def bullets(lines: DataFrame, found: DataFrame) -> DataFrame:
    """pair_id, doc_key, number of the section, page, line and text of each bullet line within a section."""
    each = section_lines(lines, found).where(F.col("raw").rlike(BULLET))
    return each.select(*DOC, "number", "page", "line", squash(F.regexp_replace("raw", BULLET, "")).alias("text")).where("text <> ''")


def field(found: DataFrame, doc_key: str, *names: str, prefix: str) -> DataFrame:
    """pair_id and the value and span of the first of several names, in any case, that a document has."""
    rank = F.array_position(F.array(*(F.lit(n.lower()) for n in names)), F.lower("key"))
    best = found.where((F.col("doc_key") == doc_key) & (rank > 0)).groupBy("pair_id").agg(F.min_by(F.struct("value", "span"), F.struct(rank, "page", "line")).alias("b"))
    return best.select("pair_id", F.col("b.value").alias(prefix), F.col("b.span").alias(f"{prefix}_span"))


def phrase(lines: DataFrame, doc_key: str, pattern: str, name: str) -> DataFrame:
    """pair_id and the spans of the first line of a document with a phrase, and of the next where the sentence goes on there."""
    w = Window.partitionBy(*DOC, "page").orderBy("line")
    with_next = lines.where(F.col("doc_key") == doc_key).withColumn("after", F.lead("raw").over(w))
    hit = with_next.where(F.col("raw").rlike(f"(?iU){pattern}")).groupBy("pair_id").agg(F.min(F.struct("page", "line", "raw", "after")).alias("h"))
    goes_on = ~F.rtrim(F.col("h.raw")).endswith(".") & (F.trim(F.col("h.after")) != "") & ~F.col("h.after").rlike(SECTION) & ~F.col("h.after").rlike(BULLET)

    def span(raw: Column, line: Column) -> Column:
        t = trimmed(raw, F.lit(0), F.length(raw))
        return F.struct(F.lit(doc_key).alias("doc"), F.col("h.page").cast("int").alias("page"), line.cast("int").alias("line"), *(t[c].alias(c) for c in ("start", "end", "text")))

    one = span(F.col("h.raw"), F.col("h.line"))
    two = F.when(F.coalesce(goes_on, F.lit(False)), F.array(one, span(F.col("h.after"), F.col("h.line") + 1))).otherwise(F.array(one))
    return hit.select("pair_id", two.cast(SPANS).alias(name))


INTERVALS = "array<struct<start:int,end:int>>"


def _words_of(raw: Column) -> Column:
    """INTERVALS of what stands between runs of two or more spaces in a line."""
    runs = F.regexp_extract_all(raw, F.lit(r" {2,}|(?:[^ ]| (?! ))+"), F.lit(0))
    none = F.expr(f"named_struct('at', 0, 'spans', cast(array() AS {INTERVALS}))")

    def step(acc: Column, run: Column) -> Column:
        end = acc["at"] + F.length(run)
        # a space at an end of a run counts for a gap, which other lines may make wider
        first, last = acc["at"] + F.when(run.startswith(" "), 1).otherwise(0), end - F.when(run.endswith(" "), 1).otherwise(0)
        span = F.struct(first.alias("start"), last.alias("end"))
        return F.struct(end.alias("at"), F.when(F.trim(run) == "", acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    return F.aggregate(runs, none, step, lambda acc: acc["spans"])


def gutters(raws: Column) -> Column:
    """INTERVALS, the columns of a block of lines: what lies between runs of two or more places that are spaces in every line that isn't blank.

    What a line has between such runs is an interval; those of all lines that touch, or are one place apart, are one column.
    """
    body = F.filter(raws, lambda r: F.trim(r) != "")
    width = F.array_max(F.transform(body, lambda r: F.length(r)))
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform(body, _words_of))))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] <= last["end"] + 1, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    # a single space at the very start or end is no gutter
    edge = lambda x: F.struct(F.when(x["start"] == 1, 0).otherwise(x["start"]).alias("start"), F.when(x["end"] == width - 1, width).otherwise(x["end"]).alias("end"))
    return F.transform(F.aggregate(spans, F.array().cast(INTERVALS), merge), edge)


def cell_text(parts: Column) -> Column:
    """The lines of a cell put together; without a space where a line ends in a hyphen within a word."""
    joins = lambda a, b: a.rlike("[A-Za-z0-9]-$") & b.rlike("^[A-Za-z0-9]")
    return squash(F.aggregate(parts, F.lit(""), lambda acc, p: F.when(acc == "", p).when(joins(acc, p), F.concat(acc, p)).otherwise(F.concat(acc, F.lit(" "), p))))


def table_lines(lines: DataFrame, keyword: str) -> DataFrame:
    """The lines of each document's table: from the first line with the keyword to the next section of the page, without blank lines at the end."""
    head = lines.where(F.lower("raw").contains(keyword.lower())).groupBy(*DOC).agg(F.min(F.struct("page", "line")).alias("head"))
    page = lines.join(by_shuffle(head), DOC).where((F.col("page") == F.col("head.page")) & (F.col("line") >= F.col("head.line")))
    w = Window.partitionBy(*DOC)
    stop = F.min(F.when((F.col("line") > F.col("head.line")) & F.col("raw").rlike(r"(?U)^\s{0,3}\d+\.\s+\S"), F.col("line"))).over(w)
    page = page.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("line") < F.col("stop")))
    last = F.max(F.when(F.trim("raw") != "", F.col("line"))).over(w)
    return page.withColumn("last", last).where("line <= last")


def tables(lines: DataFrame, keyword: str = "Test ID") -> tuple[DataFrame, DataFrame]:
    """Test rows and parse errors.

    Rows: pair_id, doc_key, row_ord, each of CELLS as text, and ``spans``, a map from cell to the places of its lines. A
    document whose table isn't recognised beyond doubt has no rows but an error: pair_id, doc_key, message.
    """
    blocks = table_lines(lines, keyword).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("rows"), F.first("page").alias("page"))
    known = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))))
    raws = F.transform("rows", lambda r: r["raw"])
    # exploded on their own, columns are found once; as an expression they would be found again by each filter over them
    blocks = blocks.select("*", F.inline(F.array(F.struct(gutters(raws).alias("gutters")))))
    label = lambda g: squash(F.substring(raws[0], g["start"] + 1, g["end"] - g["start"]))
    columns = F.transform("gutters", lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), label(g).alias("label")))
    columns = F.transform(columns, lambda c: F.struct(c["start"], c["end"], c["label"], F.try_element_at(known, F.lower(c["label"])).alias("cell")))
    blocks = blocks.select(*DOC, "rows", "page", F.inline(F.array(F.struct(columns.alias("columns")))))
    unknown = F.filter("columns", lambda c: c["cell"].isNull())
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.transform("columns", lambda c: c["cell"]))
    at_id = F.filter("columns", lambda c: c["cell"] == "test_id")[0]
    is_row = lambda raw: squash(F.substring(raw, at_id["start"] + 1, at_id["end"] - at_id["start"])).rlike(r"(?i)^T\d+$")
    message = (
        F.when(F.size("rows") < 2, "the table has no data rows")
        .when(F.size(unknown) > 0, F.concat(F.lit("unrecognised column header: "), unknown[0]["label"]))
        .when(F.size(missing) > 0, F.concat(F.lit("missing column: "), F.array_join(missing, ", ")))
        .when(~F.exists(F.slice(raws, F.lit(2), F.size(raws)), is_row), "the table has no numbered rows")
    )
    blocks = blocks.select("*", F.inline(F.array(F.struct(message.alias("message")))))
    none = lines.select(*DOC).distinct().join(by_shuffle(blocks.select(*DOC)), DOC, "left_anti").withColumn("message", F.lit("no table header was found"))
    errors = blocks.where("message IS NOT NULL").select(*DOC, "message").unionByName(none)

    body = blocks.where("message IS NULL").select(*DOC, "page", "columns", at_id.alias("at"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("r")).select(*DOC, "page", "columns", "at", "r.line", "r.raw")
    starts = squash(F.substring(F.col("raw"), F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))).rlike(r"(?i)^T\d+$")
    body = body.withColumn("row_ord", F.count(F.when(starts, 1)).over(Window.partitionBy(*DOC).orderBy("line"))).where("row_ord > 0")
    cells = body.select(*DOC, "page", "line", "raw", "row_ord", F.posexplode("columns").alias("ord", "c"))
    cells = cells.withColumn("t", trimmed(F.col("raw"), F.col("c.start"), F.col("c.end"))).where("t IS NOT NULL")
    span = F.struct(F.col("doc_key").alias("doc"), F.col("page").cast("int").alias("page"), F.col("line").cast("int").alias("line"), "t.start", "t.end", "t.text")
    cells = cells.groupBy(*DOC, "row_ord", F.col("c.cell").alias("cell")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "ord", span.alias("span")))), lambda x: x["span"]).cast(SPANS).alias("spans"))
    cells = cells.withColumn("text", cell_text(F.transform("spans", lambda s: s["text"])))
    wide = cells.groupBy(*DOC, "row_ord").agg(*(F.coalesce(F.max(F.when(F.col("cell") == c, F.col("text"))), F.lit("")).alias(c) for c in CELLS), F.map_from_entries(F.collect_list(F.struct("cell", "spans"))).alias("spans"))
    return wide.withColumn("test_id", F.upper("test_id")), errors
