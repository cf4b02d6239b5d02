"""A review of many pairs at once: documents to facts and tests, rules, blind spots, and the gate before anything is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, trimmed
from ..functions.values import criterion, date, external_references
from ..operators.cite import CITATIONS, check_spans, citation, gate_totals
from ..operators.locate import suggestions
from ..operators.prompts import suggestion_prompts
from ..operators.repair import flat_pages, quoted_lines, repaired
from ..operators.structure import SPANS, Structure, field, fields, phrase, section_lines, sections, tables
from ..sources.documents import contains, lines
from ..sources.shared import settle
from .rules import Relations, by_id, run_rules, share_tests, with_counts

#: Fixed value: what a document number looks like.
DOC_ID = r"[A-Z]{2,4}-\d{2,}-[A-Z]{2,3}-\d{2,}"


@dataclass
class Review:
    findings: DataFrame
    outcomes: DataFrame
    not_checked: DataFrame
    parse_errors: DataFrame
    checked_spans: DataFrame
    gate: DataFrame
    documents: DataFrame
    #: Suggestions in the columns of findings, what was dropped of them, and quoted lines that are displayed otherwise; None where there was nothing to make them from.
    suggestions: DataFrame | None = None
    notes: DataFrame | None = None
    repairs: DataFrame | None = None


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def version(text: Column) -> Column:
    return F.coalesce(_first(text, r"(?iU)version\s*([\d.]+)", 1), _first(text, r"[\d.]+"))


def document_id(text: Column) -> Column:
    return F.coalesce(_first(text, DOC_ID), text)


def header_facts(all_lines: DataFrame, documents: DataFrame, found_fields: DataFrame, found_sections: DataFrame) -> DataFrame:
    """A row for each pair with both documents: what headers and texts say, and where."""
    texts = documents.groupBy("pair_id").agg(F.max(F.when(F.col("doc_key") == "protocol", F.col("text"))).alias("protocol_text"), F.max(F.when(F.col("doc_key") == "report", F.col("text"))).alias("report_text")).where("protocol_text IS NOT NULL AND report_text IS NOT NULL")
    get = lambda key, prefix, *names: field(found_fields, key, *names, prefix=prefix)
    parts = [
        get("protocol", "protocol_field", "Document"), get("report", "report_field", "Document"), get("protocol", "version_field", "Version"), get("protocol", "effective_field", "Effective", "Effective date"),
        get("report", "cited", "Verifies protocol", "Protocol", "Reference protocol"), get("report", "report_date_field", "Date", "Report date"), get("report", "equipment", "Test equipment", "Equipment"),
        phrase(all_lines, "protocol", "must reference this", "must_reference"), phrase(all_lines, "protocol", "within current calibration", "calibration_phrase"), phrase(all_lines, "protocol", "shall be recorded", "recorded_phrase"),
        phrase(all_lines, "protocol", "any deviation", "deviation_phrase"), phrase(all_lines, "report", "all tests", "all_tests_phrase"), phrase(all_lines, "protocol", "sampling plan", "sampling_phrase"),
    ]
    t = trimmed(F.col("raw"), F.lit(0), F.length("raw"))
    span = F.struct(F.col("doc_key").alias("doc"), F.col("page").cast("int").alias("page"), F.col("line").cast("int").alias("line"), *(t[c].alias(c) for c in ("start", "end", "text")))
    ordered = lambda x, when=None: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("page", "line", x.alias("x"))) if when is not None else F.struct("page", "line", x.alias("x")))), lambda y: y["x"])

    def whole_section(key: str, title: str, spans: str) -> DataFrame:
        s = found_sections.where((F.col("doc_key") == key) & F.lower("title").contains(title))
        s = s.groupBy("pair_id", "doc_key").agg(F.min(F.struct("page", "start", "end", "title", "number")).alias("s")).select("pair_id", "doc_key", "s.*")
        body = section_lines(all_lines, s)
        ids = F.flatten(ordered(F.regexp_extract_all("raw", F.lit(DOC_ID), F.lit(0))))
        return body.groupBy("pair_id").agg(ordered(span, F.trim("raw") != "").cast(SPANS).alias(spans), ids.alias(f"{spans}_ids"))

    heads = found_sections.where("doc_key = 'report'").join(all_lines, ["pair_id", "doc_key", "page"]).where("line = start")
    heads = heads.groupBy("pair_id").agg(ordered(span).cast(SPANS).alias("heading_spans"), ordered(F.col("title")).alias("report_titles"))
    parts += [whole_section("protocol", "reporting", "reporting_spans"), whole_section("report", "conclusion", "conclusion_spans"), heads]
    pairs = reduce(lambda a, b: a.join(b, "pair_id", "left"), parts, texts)
    equipment_due = _first(F.col("equipment"), r"(?iU)calibration\s+due\s+(.+?)(?:;|$)", 1)
    return pairs.withColumns({
        "protocol_id": document_id(F.col("protocol_field")), "report_id": document_id(F.col("report_field")), "version": version(F.col("version_field")),
        "cited_id": _first(F.col("cited"), DOC_ID), "cited_version": _first(F.col("cited"), r"(?iU)version\s*([\d.]+)", 1),
        "effective": date(F.col("effective_field")), "report_date": date(F.col("report_date_field")), "calibration_due": date(equipment_due),
        "says_test_dates": contains(F.col("report_text"), r"test(?:ing|ed)?\s+(?:date|dates|performed|carried out)\s*[:\-]"), "says_deviation": contains(F.col("report_text"), "deviation"),
        "named_ids": F.coalesce("reporting_spans_ids", F.array().cast("array<string>")), "report_titles": F.coalesce("report_titles", F.array().cast("array<string>")),
    })


def not_checked(protocol: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, scope, item, reason, citation: what the rules leave to a reader."""
    at = lambda cell: citation("protocol", cell, F.try_element_at("spans", F.lit(cell)))
    row = lambda df, scope, item, reason, cite: df.select("pair_id", scope.alias("scope"), item.alias("item"), F.lit(reason).alias("reason"), F.array(cite).cast(CITATIONS)[0].alias("citation"))
    test, whole, none = F.col("test_id"), F.lit("document"), F.lit(None)
    quoted = lambda what, c: F.concat(F.lit(f'{what}: "'), F.col(c), F.lit('"'))
    refs = protocol.withColumn("ref", F.explode(external_references(F.concat_ws(" ", "method", "sample_size", "criterion"))))
    return reduce(DataFrame.unionByName, [
        row(protocol.where("method <> ''"), test, quoted("Method and conditions", "method"), "Only temperatures and named instruments are compared; the rest is for a reader.", at("method")),
        row(refs, test, F.concat(F.lit("External reference: "), F.col("ref")), "It isn't at hand, so conformity to it can't be checked.", at("method")),
        row(protocol.where(criterion(F.col("criterion"), F.col("criterion_form"))["kind"] == "qualitative"), test, quoted("Qualitative criterion", "criterion"), "There is no number to compare; only times that it sets are looked for.", at("criterion")),
        row(pairs.where("sampling_phrase IS NOT NULL"), whole, F.lit("The sampling plan that the protocol refers to"), "It isn't at hand, so how units were drawn can't be checked.", citation("protocol", "sampling plan", F.col("sampling_phrase"))),
        row(pairs, whole, F.lit("Raw data, records and signatures"), "Two documents are compared; what lies behind them isn't seen.", none),
        row(pairs, whole, F.lit("What neither document states"), "Only text that is there can be compared.", none),
    ])


#: What a suggestion rests on, and what isn't known about it, as the record says.
SUGGESTED = "Raised by a language model, not by a check: the rules don't cover differences of this kind."
UNSURE = "A model's words, which may be wrong or matter little. The quotations were found in the documents; what is said about them was not verified."


def _as_findings(kept: DataFrame) -> DataFrame:
    """Suggestions in the columns of findings, under keys of their own."""
    said = {"rule_id": "AI", "priority": "low", "basis": SUGGESTED, "uncertainty": UNSURE}
    return kept.select("pair_id", "id", *(F.lit(v).alias(k) for k, v in said.items()), "scope", F.col("observation").alias("statement"), "action", "citations")


def prefer(first: DataFrame, second: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of a structure, from the second source for the documents named (pair_id, doc_key) and from the first for all others."""
    keys = ["pair_id", "doc_key"]
    return first.join(documents, keys, "left_anti").unionByName(second.join(documents, keys, "left_semi"))


def review(documents: DataFrame, fallback: Callable[[DataFrame], DataFrame | Structure] | None = None, suggest: Callable[[DataFrame], DataFrame] | None = None) -> Review:
    """Reviews all pairs of a DOCUMENTS relation.

    A pair whose table isn't recognised on either side goes to parse_errors and has no findings; so does one of which a
    document could not be read, where documents has a column error. fallback: for documents with parse errors (pair_id,
    doc_key, message and the columns of documents), rows of tests as tables() gives them, or a Structure with fields and
    sections as well, from a model or elsewhere (model_structure() makes one of a model); such documents are reviewed after
    all, a Structure's with nothing but what it has. suggest: from prompts (pair_id and prompt) to replies (pair_id and
    reply), for suggestions that stand beside the findings and go through the same gate. Where documents has flat_pages,
    quotations are repaired for display. The gate is only counted here; require_verified(review.checked_spans) stops what
    must not be written.
    """
    keys = ["pair_id", "doc_key"]
    unread = documents.where("error IS NOT NULL").select(*keys, F.concat(F.lit("the document can't be read: "), "error").alias("message")) if "error" in documents.columns else None
    if unread is not None:
        documents = documents.where("error IS NULL")
    all_lines = settle(lines(documents))
    tests, errors = tables(all_lines)
    found_sections, found_fields = sections(all_lines), fields(all_lines)
    if fallback is not None:
        more = fallback(errors.join(documents, keys))
        if isinstance(more, Structure):
            which = settle(more.documents.select(*keys).distinct())
            tests, found_fields, found_sections = prefer(tests, more.tests, which), prefer(found_fields, more.fields, which), prefer(found_sections, more.sections, which)
        else:
            which = settle(more.select(*keys).distinct())
            tests = tests.unionByName(more)
        errors = errors.join(which, keys, "left_anti")
    errors = settle(errors if unread is None else errors.unionByName(unread))
    tests = settle(tests.withColumn("criterion_form", nfkc("criterion")).join(errors.select("pair_id").distinct(), "pair_id", "left_anti"))
    side = lambda key: tests.where(F.col("doc_key") == key).drop("doc_key")
    found_sections = settle(found_sections)
    pairs = header_facts(all_lines, documents, settle(found_fields), found_sections).join(errors.select("pair_id").distinct(), "pair_id", "left_anti")
    shared = settle(share_tests(side("protocol"), side("report")))
    protocol = by_id(side("protocol"))
    pairs = settle(with_counts(pairs, protocol, side("report"), shared))
    findings, outcomes = run_rules(Relations(pairs, protocol, side("report"), shared))
    findings = settle(findings)
    suggested = notes = None
    cited = findings.select("pair_id", F.col("id").alias("key"), "citations")
    if suggest is not None:
        reviewed = all_lines.join(pairs.select("pair_id"), "pair_id", "left_semi")
        kept, notes = suggestions(settle(suggest(suggestion_prompts(reviewed)).select("pair_id", "reply")), reviewed)
        suggested, notes = settle(_as_findings(kept)), settle(notes)
        cited = cited.unionByName(suggested.select("pair_id", F.col("id").alias("key"), "citations"))
    checked = settle(check_spans(cited, all_lines))
    open_points = not_checked(protocol, pairs)
    repairs = None
    if "flat_pages" in documents.columns:
        quoted = cited.select("pair_id", F.explode("citations").alias("citation")).unionByName(open_points.where("citation IS NOT NULL").select("pair_id", "citation"))
        repairs = settle(repaired(quoted_lines(quoted), flat_pages(documents)))
    return Review(findings, outcomes, open_points, errors, checked, gate_totals(checked), documents, suggested, notes, repairs)
