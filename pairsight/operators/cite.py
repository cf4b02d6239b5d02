"""Citations: addresses in documents, how they read, and the gate that reads every one of them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_slice
from .structure import SPANS

CITATIONS = f"array<struct<doc:string,note:string,spans:{SPANS}>>"


def citation(doc: str, note: str, spans: Column) -> Column:
    return F.struct(F.lit(doc).alias("doc"), F.lit(note).alias("note"), F.coalesce(spans, F.array().cast(SPANS)).cast(SPANS).alias("spans"))


def citations(*each: Column) -> Column:
    """CITATIONS in order, without those that have no place."""
    return F.filter(F.array(*each).cast(CITATIONS), lambda c: F.size(c["spans"]) > 0)


def quote(spans: Column) -> Column:
    """The quoted text, a line for each line; parts of the same line with a space between."""
    start = F.expr("named_struct('page', 0, 'line', 0, 'text', '')")

    def step(acc: Column, s: Column) -> Column:
        same = (acc["page"] == s["page"]) & (acc["line"] == s["line"])
        text = F.when(acc["line"] == 0, s["text"]).when(same, F.concat(acc["text"], F.lit(" "), s["text"])).otherwise(F.concat(acc["text"], F.lit("\n"), s["text"]))
        return F.struct(s["page"].alias("page"), s["line"].alias("line"), text.alias("text"))

    return F.aggregate(spans, start, step, lambda acc: acc["text"])


def locator(spans: Column) -> Column:
    line = lambda f: f(F.transform(spans, lambda s: s["line"])).cast("string")
    low, high = line(F.array_min), line(F.array_max)
    return F.concat(F.lit("p."), F.get(spans, F.lit(0))["page"].cast("string"), F.when(low == high, F.concat(F.lit(" line "), low)).otherwise(F.concat(F.lit(" lines "), low, F.lit("-"), high)))


def check_spans(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each span of each citation, one for a citation without any: pair_id, key, cite, ord, doc, span and failure, null where it holds.

    findings: pair_id, key and citations. A span holds if its document and line exist and the line has the span's text at
    its place. Then the page has the text as well, with any white space, as the line is on it.
    """
    each = findings.select("pair_id", "key", F.posexplode("citations").alias("cite", "c"))
    each = each.select("pair_id", "key", "cite", "c.doc", F.posexplode_outer("c.spans").alias("ord", "span"))
    docs = lines.select("pair_id", F.col("doc_key").alias("doc")).distinct().withColumn("known", F.lit(True))
    at = lines.select("pair_id", F.col("doc_key").alias("doc"), F.col("page").alias("_page"), F.col("line").alias("_line"), "raw")
    each = each.withColumn("_page", F.col("span.page")).withColumn("_line", F.col("span.line"))
    each = each.join(at, ["pair_id", "doc", "_page", "_line"], "left").join(docs, ["pair_id", "doc"], "left")
    failure = (
        F.when(F.col("known").isNull(), "unknown document")
        .when(F.col("span").isNull(), "no spans")
        .when(F.col("span.doc") != F.col("doc"), "span of another document")
        .when(F.col("raw").isNull(), "no such line")
        .when(~padded_slice("raw", F.col("span.start"), F.col("span.end")).eqNullSafe(F.col("span.text")), "text differs")
    )
    return each.select("pair_id", "key", "cite", F.coalesce("ord", F.lit(0)).alias("ord"), "doc", "span", failure.alias("failure"))


def gate_totals(checked: DataFrame) -> DataFrame:
    """pair_id, spans_checked, citations_checked, failures."""
    return checked.groupBy("pair_id").agg(F.count("span").alias("spans_checked"), F.count_if(F.col("ord") == 0).alias("citations_checked"), F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.concat_ws(": ", "key", "failure")))).alias("failures"))


def protocol_first(cites: Column) -> Column:
    """Citations for display: those of the protocol, then the others, each in their order."""
    of = lambda mine: F.filter(cites, lambda c: (c["doc"] == "protocol") == mine)
    return F.concat(of(F.lit(True)), of(F.lit(False)))


class CitationError(RuntimeError):
    """A quotation isn't where it is said to be; nothing is written."""


def require_verified(checked: DataFrame) -> DataFrame:
    """gate_totals(), after making sure that nothing failed."""
    failed = checked.where("failure IS NOT NULL").select("pair_id", "key", "failure").limit(20).collect()
    if failed:
        raise CitationError("; ".join(f"{r['pair_id']} {r['key']}: {r['failure']}" for r in failed))
    return gate_totals(checked)
