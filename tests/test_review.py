import json

import pytest
from pairs import EXPECTED, clean, flawed
from pyspark.sql import functions as F

from pairsight.operators.cite import CitationError, check_spans, require_verified
from pairsight.plans.review import review
from pairsight.sources.outputs import counts, embedded, export_decisions, html, payload, read_decisions, read_payloads, sheet, with_decisions, write


def documents(spark, pairs):
    return spark.createDataFrame([(k, side, f"{side}.txt", text) for k, both in pairs.items() for side, text in zip(("protocol", "report"), both, strict=True)], "pair_id string, doc_key string, name string, text string")


def edit(text, old, new):
    """Replaces once, and pads or cuts the space after it, so that columns stay where they are."""
    assert old in text, old
    at = text.index(old)
    rest = text[at + len(old) :]
    gap = len(new) - len(old)
    if gap > 0 and rest.startswith("  "):
        rest = rest[min(gap, len(rest) - len(rest.lstrip(" ")) - 2) :]
    elif gap < 0 and rest.startswith("  "):
        rest = " " * -gap + rest
    return text[:at] + new + rest


def without(text, *starts):
    return "\n".join(x for x in text.split("\n") if not x.startswith(starts))


def mutated():
    """name: pair, what has to be found and what must not."""
    p, r = flawed()
    cp, cr = clean()
    return {
        "version": (p, edit(r, "Version 1.7", "Version 2.2"), set(), {("R-01", "document")}),
        "calibration": (p, edit(r, "30 November 2023", "30 November 2027"), set(), {("R-04", "document")}),
        "days": (p, edit(r, "Date:", "Testing performed:  2 April 2024\nDate:"), set(), {("R-06", "document")}),
        "deviation": (p, r + "\nA deviation is on file.", {("R-13", "T1")}, {("R-17", "document")}),
        "ambient": (p, edit(r, "Filled at room temperature", "Filled at 45°C"), {("R-14", "T1")}, {("R-16", "T1")}),
        "units": (p, edit(r, "  18", "  24"), set(), {("R-13", "T1")}),
        "criterion": (edit(p, "≥ 640 kPa", "≥ 600 kPa"), r, {("R-13", "T1")}, {("R-12", "T1"), ("R-14", "T1"), ("R-15", "T1")}),
        "maximum": (p, edit(r, "Max 5", "Max 15"), {("R-14", "T2"), ("R-15", "T2")}, set()),
        "renamed test": (edit(p, "\nT4", "\nT9"), r, {("R-11", "T4"), ("R-10", "T9")}, set()),
        "other protocol": (p, edit(r, "QX-310-TP-002", "QX-311-TP-002"), {("R-02", "document")}, set()),
        "instrument": (p, edit(r, "Lloyd 3300", "a lever"), {("R-19", "T1")}, set()),
        "early": (p, edit(r, "19 April 2024", "19 January 2024"), {("R-05", "document")}, set()),
        "other report": (p, edit(r, "QX-310-VR-002", "QX-310-VR-003"), {("R-03", "document")}, set()),
        "clean minimum": (cp, edit(cr, "Min 655", "Min 555"), {("R-14", "T1"), ("R-15", "T1")}, set()),
        "clean grade": (cp, edit(cr, "Panel score 2", "Panel score 5"), {("R-14", "T5")}, set()),
    }


@pytest.fixture(scope="module")
def reviewed(spark):
    pairs = {"clean": clean(), "flawed": flawed(), "no table": ("nothing", "here"), "bad label": (edit(flawed()[0], "Sample size", "Sample mood"), flawed()[1])}
    pairs |= {f"m:{k}": v[:2] for k, v in mutated().items()}
    result = review(documents(spark, pairs))
    return result


def found(result, pair):
    return {(r.rule_id, r.scope, r.priority) for r in result.findings.where(F.col("pair_id") == pair).collect()}


def test_flawed_pair_has_its_sixteen_findings(reviewed):
    assert found(reviewed, "flawed") == EXPECTED


def test_numbers_follow_priority_rule_and_scope(reviewed):
    rows = reviewed.findings.where("pair_id = 'flawed'").orderBy("id").collect()
    assert [r.id for r in rows] == [f"F-{i:03d}" for i in range(1, 17)]
    keys = [(("high", "medium", "low").index(r.priority), r.rule_id, r.scope) for r in rows]
    assert keys == sorted(keys)


def test_silent_rules_of_the_flawed_pair(reviewed):
    out = {r.rule_id: r.status for r in reviewed.outcomes.where("pair_id = 'flawed'").collect()}
    assert len(out) == 19
    assert {k for k, v in out.items() if v == "no-finding"} == {"R-02", "R-03", "R-05", "R-11", "R-19"}


def test_clean_pair_has_none_and_only_deviations_dont_apply(reviewed):
    assert found(reviewed, "clean") == set()
    out = {r.rule_id: r.status for r in reviewed.outcomes.where("pair_id = 'clean'").collect()}
    assert {k for k, v in out.items() if v == "not-applicable"} == {"R-17"} and len(out) == 19


@pytest.mark.parametrize("name", list(mutated()))
def test_mutation(reviewed, name):
    _, _, there, gone = mutated()[name]
    got = {x[:2] for x in found(reviewed, f"m:{name}")}
    assert there <= got and not gone & got


def test_unrecognised_tables_are_set_aside(reviewed):
    errors = {(r.pair_id, r.doc_key): r.message for r in reviewed.parse_errors.collect()}
    assert set(errors) == {("no table", "protocol"), ("no table", "report"), ("bad label", "protocol")}
    assert "Sample mood" in errors["bad label", "protocol"]
    assert found(reviewed, "bad label") == set() and reviewed.outcomes.where("pair_id = 'bad label'").isEmpty()


def test_every_quotation_holds_and_forgeries_dont(spark, reviewed):
    totals = {r.pair_id: r for r in require_verified(reviewed.checked_spans).collect()}
    assert totals["flawed"].spans_checked > 40 and totals["flawed"].failures == []
    one = reviewed.findings.where("pair_id = 'flawed' AND rule_id = 'R-01'").select("pair_id", F.col("id").alias("key"), "citations")
    forge = lambda **new: one.withColumn("citations", F.transform("citations", lambda c: c.withField("spans", F.transform(c["spans"], lambda s: _with(s, new)))))
    from pairsight.sources.documents import lines

    for new, why in (({"text": F.lit("forged")}, "text differs"), ({"line": F.lit(9999)}, "no such line"), ({"doc": F.lit("letter")}, "span of another document")):
        checked = check_spans(forge(**new), lines(reviewed.documents))
        assert {r.failure for r in checked.collect()} == {why}
        with pytest.raises(CitationError):
            require_verified(checked)


def _with(s, new):
    for k, v in new.items():
        s = s.withField(k, v)
    return s


def test_wrapped_cells_are_put_together(reviewed):
    r = reviewed.findings.where("pair_id = 'flawed' AND rule_id = 'R-18'").first()
    assert "Per ISO 2859-1" in r.statement
    assert [s.text for s in r.citations[0].spans] == ["Per ISO 2859-", "1"]


def test_blind_spots(reviewed):
    items = {(r.scope, r.item) for r in reviewed.not_checked.where("pair_id = 'flawed'").collect()}
    assert ("T5", "External reference: QX-FL310-07") in items and ("T2", "External reference: ISO 4020") in items
    assert ("T4", 'Qualitative criterion: "No visible bleaching at 72 h"') in items
    assert sum(s == "document" for s, _ in items) == 3


def test_record_page_and_files(spark, reviewed, tmp_path):
    records = payload(reviewed)
    record = json.loads(records.where("pair_id = 'flawed'").first().payload)
    assert len(record["findings"]) == 16 and len(record["rules_run"]) == 19
    assert any(x["citation"] is None for x in record["not_checked"])
    assert "p.1 line" in record["findings"][0]["citations"][0]["locator"]
    assert spark.range(1).select(embedded(F.lit('{"a":"</script>"}')).alias("x")).first().x == '{"a":"\\u003c/script>"}'
    assert html(records).first().page.count("</script>") == 2
    write(reviewed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == reviewed.findings.count()


def test_sheet_and_decisions(spark, reviewed):
    one = reviewed.findings.where("pair_id = 'flawed'")
    total = counts(one).first()
    assert (total.total, total.high, total.medium, total.low) == (16, 9, 4, 3)
    decided = with_decisions(one, spark.createDataFrame([("flawed", "F-001", "confirmed", "seen")], "pair_id string, id string, decision string, note string"), ["pair_id", "id"])
    assert sheet(decided, decision="confirmed").count() == 1 and sheet(decided, decision="open").count() == 15
    assert sheet(decided, search=" CALIBRATION ").count() >= 1 and sheet(decided, priority="low", scope="T4").first().rule_id == "R-22"
    records = payload(reviewed)
    exports = export_decisions(decided, records)
    export = json.loads(exports.where("pair_id = 'flawed'").first().export)
    assert export["decisions"]["F-001"] == {"decision": "confirmed", "note": "seen"} and export["decisions"]["F-002"]["decision"] == "open"
    assert export["tool"].startswith("pairsight ") and {d["doc_key"] for d in export["documents"]} == {"protocol", "report"} and export["run"] and export["exported_at"]
    assert {(r.id, r.decision, r.note) for r in read_decisions(exports).collect()} == {(r.id, r.decision, r.note) for r in decided.select("id", "decision", "note").collect()}
    assert {(r.id, r.scope, r.priority) for r in read_payloads(records).where("pair_id = 'flawed'").collect()} == {(r.id, r.scope, r.priority) for r in one.collect()}


def test_outcomes_say_what_was_judged(reviewed):
    said = {r.rule_id: r.detail for r in reviewed.outcomes.where("pair_id = 'clean'").collect()}
    assert said["R-14"] == "Judged: 4 tests with values to compare; nothing to raise." and said["R-10"] == "Judged: 5 tests of the protocol; nothing to raise."
    assert said["R-01"] == "Judged: 1 pair of documents; nothing to raise." and "nothing" in said["R-17"].lower()
    said = {r.rule_id: r.detail for r in reviewed.outcomes.where("pair_id = 'flawed'").collect()}
    assert said["R-14"] == "Judged: 3 tests with values to compare; 2 findings."


def test_record_has_five_parts_and_no_suggestions_by_default(reviewed):
    record = json.loads(payload(reviewed).where("pair_id = 'flawed'").first().payload)
    assert list(record) == ["manifest", "findings", "ai_suggestions", "rules_run", "not_checked"] and record["ai_suggestions"] == []
    clean_one = json.loads(payload(reviewed).where("pair_id = 'clean'").first().payload)
    assert clean_one["findings"] == [] and clean_one["manifest"]["ai"] == {"suggestions_requested": False, "suggestions_kept": 0, "notes": None}
    c = record["findings"][0]["citations"][0]
    assert c["quote"] == c["quote_display"] and c["display_differs_from_source"] is False and record["findings"][0]["source"] == "rule"


def suggested(prompts):
    said = [{"scope": "t1", "observation": "The filling is worded differently.", "protocol_quote": "Fill with water", "protocol_line": 1, "report_quote": "Filled at room temperature", "report_line": 99}, {"scope": "T2", "observation": "T2 fails.", "protocol_quote": "Fibre release"}, {"scope": "T9", "observation": "Nothing of it.", "protocol_quote": "never said"}]
    return prompts.select("pair_id", F.lit("```json\n" + json.dumps({"suggestions": said}) + "\n```").alias("reply"))


def test_suggestions_go_through_the_gate_into_the_record(spark, tmp_path):
    from pairsight.sources.outputs import write_pairs

    result = review(documents(spark, {"flawed": flawed()}), suggest=suggested)
    assert {(r.id, r.scope, r.rule_id) for r in result.suggestions.collect()} == {("AI-001", "T1", "AI")}
    assert result.findings.where("rule_id = 'AI'").isEmpty()
    gate = result.gate.first()
    assert gate.failures == [] and result.checked_spans.where("key = 'AI-001'").count() == 2
    record = json.loads(payload(result).first().payload)
    assert len(record["findings"]) == 16 and [x["id"] for x in record["ai_suggestions"]] == ["AI-001"] and record["ai_suggestions"][0]["source"] == "model"
    assert {c["document"] for c in record["ai_suggestions"][0]["citations"]} == {"protocol", "report"}
    assert record["manifest"]["ai"]["suggestions_kept"] == 1 and {n["note"] for n in record["manifest"]["ai"]["notes"]} == {"verdict language", "quotation not found"}
    assert record["manifest"]["spans_checked"] == gate.spans_checked
    write_pairs(result, str(tmp_path / "out"))
    assert len(json.loads((tmp_path / "out/flawed/findings.json").read_text())["findings"]) == 16 and "AI-001" in (tmp_path / "out/flawed/review-sheet.html").read_text()
    # a forged suggestion stops everything
    forged = result.suggestions.withColumn("citations", F.transform("citations", lambda c: c.withField("spans", F.transform(c["spans"], lambda s: s.withField("text", F.lit("forged"))))))
    from pairsight.sources.documents import lines

    result.checked_spans = check_spans(result.findings.unionByName(forged, allowMissingColumns=True).select("pair_id", F.col("id").alias("key"), "citations"), lines(result.documents))
    for out in (write, write_pairs):
        with pytest.raises(CitationError, match="AI-001"):
            out(result, str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_quotations_are_shown_as_the_flat_text_has_them(spark):
    p, r = flawed()
    split = lambda t: t.replace("Every gauge", "Every ga uge").replace("What each", "Wh at each")
    rows = [("x", "protocol", "p", split(p), p.split("\f")), ("x", "report", "r", r, None)]
    result = review(spark.createDataFrame(rows, "pair_id string, doc_key string, name string, text string, flat_pages array<string>"))
    record = json.loads(payload(result).first().payload)
    cites = [c for f in record["findings"] for c in f["citations"]]
    shown = {c["quote_display"] for c in cites if c["display_differs_from_source"]}
    assert any("Every gauge has" in t for t in shown) and any(t.startswith("What each") for t in shown)
    assert all("ga uge" in c["quote"] or "Wh at" in c["quote"] for c in cites if c["display_differs_from_source"]) and not any("ga uge" in c["quote_display"] for c in cites)
    assert {s["text"] for c in cites for s in c["spans"] if "ga uge" in s["text"]}
    assert result.gate.first().failures == []


def unknown_layout():
    """The flawed protocol and report in a layout that no parser knows, and what a model would say of them."""
    rows = {"protocol": [("T1", "Burst pressure", "≥ 640 kPa", "24")], "report": [("T1", "Burst pressure", "≥ 600 kPa", "18")]}
    heads = {"protocol": [("Document", "QX-310-TP-002"), ("Version", "2.2"), ("Effective", "5 February 2024")], "report": [("Document", "QX-310-VR-003"), ("Verifies protocol", "QX-311-TP-002, Version 1.7"), ("Date", "19 January 2024"), ("Test equipment", "Lloyd 3300; calibration due 30 November 2023")]}
    texts, replies = {}, {}
    for key in rows:
        body = [f"{k} is {v}." for k, v in heads[key]] + ["", "Part the first"] + ["Results go into QX-310-VR-002 by the reporting rules."] * (key == "protocol")
        body += [f"check {' / '.join(r)}" for r in rows[key]]
        texts[key] = "\n".join(body)
        said = {"fields": [{"key": k.lower(), "value": v, "line": 1} for k, v in heads[key]], "sections": [{"number": 1, "title": "Reporting" if key == "protocol" else "Part the first", "line": 5}, {"title": "reporting", "line": 1}]}
        said["tests"] = [dict(zip(("test_id", "test_name", "criterion", "sample_size"), ({"value": c, "line": 2} for c in r), strict=True)) for r in rows[key]]
        replies[key] = json.dumps(said)
    return texts, replies


def test_a_document_that_only_a_model_can_read_is_reviewed(spark):
    from pairsight.operators.prompts import model_structure

    texts, replies = unknown_layout()

    def model(prompt):
        if "unreadable" in prompt:
            return "no idea"
        return replies["report" if "verification report" in prompt else "protocol"]

    docs = documents(spark, {"x": (texts["protocol"], texts["report"]), "y": ("unreadable", texts["report"]), "z": flawed(), "mixed": (flawed()[0], texts["report"])})
    result = review(docs, fallback=model_structure(model, wait=0))
    got = {x[:2] for x in found(result, "x")}
    assert {("R-01", "document"), ("R-02", "document"), ("R-04", "document"), ("R-05", "document"), ("R-12", "T1"), ("R-13", "T1")} <= got
    assert found(result, "z") == EXPECTED and {r.pair_id for r in result.parse_errors.collect()} == {"y"}
    assert {("R-10", f"T{i}") for i in range(2, 6)} <= {x[:2] for x in found(result, "mixed")}
    assert result.checked_spans.where("failure IS NOT NULL").isEmpty()


def test_documents_of_any_length_are_asked_about_in_pieces(spark):
    from pairsight.operators.locate import ask, parse_with_model
    from pairsight.operators.prompts import pieces, structure_prompts, suggestion_prompts
    from pairsight.sources.documents import lines

    body = "\n".join(f"line {i} T{i} wants ≥ {i} N" for i in range(1, 301)) + "\n" + "x" * 900
    table = lines(documents(spark, {"p": (body, body), "q": ("", "T1")}))
    cut = pieces(table.where("doc_key = 'protocol'"), 600, 2).where("pair_id = 'p'").orderBy("piece").collect()
    assert len(cut) > 15 and cut[0].first_line == 1 and cut[-1].last_line == 301 and all(b.first_line <= a.last_line + 1 for a, b in zip(cut, cut[1:]))
    assert all(b.first_line >= a.last_line - 1 for a, b in zip(cut, cut[1:])) and any(b.first_line < a.last_line for a, b in zip(cut, cut[1:]))
    assert all(len(c.body) < 800 for c in cut[:-1]) and "   1| line 1 T1" in cut[0].body

    def model(prompt):
        import re

        rows = re.findall(r"(?m)^ *(\d+)\| line \d+ (T\d+) wants (≥ \d+ N)", prompt)
        return json.dumps({"tests": [{"test_id": {"value": t, "line": int(n)}, "criterion": {"value": c, "line": int(n)}} for n, t, c in rows], "fields": [], "sections": []})

    asked = ask(structure_prompts(table, 600), model, keys=("pair_id", "doc_key", "page", "piece"), per_second=500)
    rows, *_ = parse_with_model(asked, table)
    got = rows.where("pair_id = 'p' AND doc_key = 'report'").orderBy("row_ord").collect()
    assert [(r.row_ord, r.test_id, r.criterion) for r in got] == [(i, f"T{i}", f"≥ {i} N") for i in range(1, 301)]
    both = suggestion_prompts(table, 600).where("pair_id = 'p'").collect()
    assert len(both) < 4 * len(cut) and all(set(__import__("re").findall(r"T\d+", b.prompt)) for b in both)
    assert suggestion_prompts(table).where("pair_id = 'p'").count() == 1 and suggestion_prompts(table).where("pair_id = 'q'").count() == 1
