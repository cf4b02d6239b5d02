"""What a review hands on: the audit record as JSON, counts, a sheet with filters and decisions, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators.cite import locator, quote, require_verified
from ..plans.review import Review
from .pairfiles import write_pair_files
from .shared import settle

DECISIONS = ("open", "confirmed", "not-an-issue", "more-info")


#: Quoted lines that are displayed otherwise than they stand, by document, page and line.
FIXES = "map<struct<doc:string,page:int,shown:string>,string>"


def _citation(c: Column, fixes: Column) -> Column:
    """A citation as the record has it: the quotation as it stands, and as it is displayed."""
    said = quote(c["spans"])
    key = lambda t: F.struct(c["doc"].alias("doc"), F.get(c["spans"], F.lit(0))["page"].alias("page"), t.alias("shown"))
    shown = F.array_join(F.transform(F.split(said, "\n"), lambda t: F.coalesce(F.try_element_at(fixes, key(t)), t)), "\n")
    return F.struct(c["doc"].alias("document"), c["note"].alias("note"), locator(c["spans"]).alias("locator"), said.alias("quote"), shown.alias("quote_display"), (shown != said).alias("display_differs_from_source"), c["spans"].alias("spans"))


def _findings(df: DataFrame, name: str, source: str) -> DataFrame:
    finding = F.struct("id", "rule_id", F.col("priority").alias("review_priority"), "scope", F.col("statement").alias("observation"), "basis", "action", "uncertainty", F.lit(source).alias("source"), "citations")
    return df.groupBy("pair_id").agg(F.array_sort(F.collect_list(finding)).alias(name))


def payload(review: Review, run_at: Column | None = None) -> DataFrame:
    """pair_id and payload, the record of a pair as JSON: manifest, findings, ai_suggestions, rules_run and not_checked. Nulls are kept.

    A suggestion is never among the findings, so that nothing can take one for a check's result.
    """
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda y: y["row"])
    found = _findings(review.findings, "findings", "rule")
    none = review.findings.where("false")
    suggested = _findings(none if review.suggestions is None else review.suggestions, "ai_suggestions", "model")
    ran = review.outcomes.groupBy("pair_id").agg(ordered(F.struct("ord", F.struct("rule_id", "title", "category", "question", "fired", "status", "detail").alias("row"))).alias("rules_run"))
    open_points = review.not_checked.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("scope", "item", "reason", "citation"))).alias("not_checked"))
    file_hash = F.col("file_sha256") if "file_sha256" in review.documents.columns else F.lit(None).cast("string")
    hashes = review.documents.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("doc_key", "name", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), file_hash.alias("file_sha256")))).alias("documents"))
    at = F.date_format(F.current_timestamp() if run_at is None else run_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    all_parts = ran.join(found, "pair_id", "left").join(suggested, "pair_id", "left").join(open_points, "pair_id", "left").join(hashes, "pair_id", "left").join(review.gate, "pair_id", "left")
    if review.notes is not None:
        all_parts = all_parts.join(review.notes.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", "note"))).alias("notes")), "pair_id", "left")
    if review.repairs is not None:
        fix = F.struct(F.struct("doc", F.col("page").cast("int").alias("page"), "shown"), "display")
        all_parts = all_parts.join(review.repairs.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(fix)).cast(FIXES).alias("fixes")), "pair_id", "left")
    fixes = F.coalesce("fixes", F.map_from_arrays(F.array(), F.array()).cast(FIXES)) if review.repairs is not None else F.map_from_arrays(F.array(), F.array()).cast(FIXES)
    cited = lambda name: F.transform(name, lambda f: f.withField("citations", F.transform(f["citations"], lambda c: _citation(c, F.col("_fixes")))))
    all_parts = all_parts.withColumn("_fixes", fixes)
    ai = F.struct(F.lit(review.suggestions is not None).alias("suggestions_requested"), F.coalesce(F.size("ai_suggestions"), F.lit(0)).alias("suggestions_kept"), (F.col("notes") if review.notes is not None else F.lit(None).cast("array<struct<ord:int,note:string>>")).alias("notes"))
    manifest = F.struct(at.alias("run_at_utc"), F.lit(__version__).alias("version"), "documents", F.coalesce("spans_checked", F.lit(0)).alias("spans_checked"), F.coalesce("citations_checked", F.lit(0)).alias("citations_checked"), ai.alias("ai"))
    limits = F.transform("not_checked", lambda x: F.struct(x["scope"].alias("scope"), x["item"].alias("item"), x["reason"].alias("reason"), F.when(x["citation"].isNotNull(), _citation(x["citation"], F.col("_fixes"))).alias("citation")))
    some = lambda name: F.coalesce(cited(name), F.from_json(F.lit("[]"), cited_type)).alias(name)
    cited_type = all_parts.select(cited("findings").alias("x")).schema["x"].dataType
    record = F.struct(manifest.alias("manifest"), some("findings"), some("ai_suggestions"), "rules_run", limits.alias("not_checked"))
    return all_parts.select("pair_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("payload"))


def embedded(json: Column) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def html(payloads: DataFrame) -> DataFrame:
    """pair_id and page: a self-contained page for each pair, with the record in it."""
    head, tail = '<!doctype html><meta charset="utf-8"><title>Review</title><pre id="out"></pre><script id="record" type="application/json">', '</script><script>document.getElementById("out").textContent=JSON.stringify(JSON.parse(document.getElementById("record").textContent),null,2)</script>'
    return payloads.select("pair_id", F.concat(F.lit(head), embedded(F.col("payload")), F.lit(tail)).alias("page"))


def write(review: Review, path: str) -> None:
    """Writes findings, outcomes, blind spots, parse errors, records and pages under a path; nothing if a quotation doesn't hold."""
    require_verified(review.checked_spans)
    for name, df in (("findings", review.findings), ("outcomes", review.outcomes), ("not_checked", review.not_checked), ("parse_errors", review.parse_errors)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if review.suggestions is not None:
        review.suggestions.write.mode("overwrite").parquet(f"{path}/suggestions")
    records = payload(review)
    records.write.mode("overwrite").parquet(f"{path}/records")
    html(records).write.mode("overwrite").parquet(f"{path}/pages")


def write_pairs(review: Review, path: str, mode: str = "append") -> None:
    """Writes each pair's record and page as files under ``<path>/<pair_id>/``, together or not at all; nothing if a quotation doesn't hold."""
    require_verified(review.checked_spans)
    records = settle(payload(review))  # made once, so that record and page are of the same moment
    write_pair_files(records.join(html(records), "pair_id").withColumnRenamed("payload", "record"), path, mode)


def counts(findings: DataFrame) -> DataFrame:
    """pair_id, total, high, medium, low, scopes."""
    n = lambda p: F.count_if(F.col("priority") == p).alias(p)
    return findings.groupBy("pair_id").agg(F.count("*").alias("total"), n("high"), n("medium"), n("low"), F.array_sort(F.collect_set("scope")).alias("scopes"))


def with_decisions(findings: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """findings with decision and note; open where there is none."""
    return findings.join(decisions.select(*key, "decision", "note"), key, "left").withColumn("decision", F.coalesce("decision", F.lit("open"))).withColumn("note", F.coalesce("note", F.lit("")))


def sheet(findings: DataFrame, priority: str | None = None, scope: str | None = None, decision: str | None = None, search: str = "", columns: tuple[str, ...] = ("statement", "basis", "action")) -> DataFrame:
    """The findings that a reviewer asks for; every condition given has to hold."""
    for name, value in (("priority", priority), ("scope", scope), ("decision", decision)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return findings.where(F.lower(F.concat_ws(" ", *columns)).contains(search.strip().lower())) if search.strip() else findings


def export_decisions(findings: DataFrame, payloads: DataFrame, exported_at: Column | None = None) -> DataFrame:
    """pair_id and export, JSON of the run, the documents, the time and one decision for each finding. findings: with_decisions() of them; payloads: the records of the same run."""
    at = F.date_format(F.current_timestamp() if exported_at is None else exported_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    manifest = F.from_json("payload", "manifest struct<run_at_utc:string,version:string,documents:array<struct<doc_key:string,name:string,text_sha256:string>>>")["manifest"]
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("decision", "note")))))
    decided = findings.groupBy("pair_id").agg(each.alias("decisions"))
    runs = payloads.select("pair_id", manifest.alias("m")).join(decided, "pair_id", "left")
    record = F.struct(F.col("m.run_at_utc").alias("run"), F.concat(F.lit("pairsight "), F.col("m.version")).alias("tool"), F.col("m.documents").alias("documents"), at.alias("exported_at"), F.coalesce("decisions", F.expr("cast(map() AS map<string,struct<decision:string,note:string>>)")).alias("decisions"))
    return runs.select("pair_id", F.to_json(record).alias("export"))


def read_decisions(exports: DataFrame, export: str = "export") -> DataFrame:
    """pair_id, id, decision and note of exported decisions; what isn't one of DECISIONS is open."""
    known = F.from_json(export, "decisions map<string,struct<decision:string,note:string>>")["decisions"]
    each = exports.select("pair_id", F.explode(known).alias("id", "d"))
    return each.select("pair_id", "id", F.when(F.col("d.decision").isin(*DECISIONS), F.col("d.decision")).otherwise("open").alias("decision"), F.coalesce("d.note", F.lit("")).alias("note"))


FINDINGS = "array<struct<id:string,rule_id:string,review_priority:string,scope:string,observation:string,basis:string,action:string,uncertainty:string>>"


def read_payloads(payloads: DataFrame) -> DataFrame:
    """pair_id and the findings of records, a row for each; a record that can't be read has none."""
    found = payloads.select("pair_id", F.inline(F.from_json("payload", f"findings {FINDINGS}")["findings"]))
    return found.withColumnRenamed("review_priority", "priority")
