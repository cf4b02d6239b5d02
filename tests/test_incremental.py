import json

from pairs import clean, flawed

from pairsight.plans.incremental import changes, read_records, review_changes
from pairsight.plans.review import review
from pairsight.sources.documents import DOCUMENTS
from pairsight.sources.outputs import payload
from pairsight.sources.pairfiles import document_files


def table(spark, pairs):
    return spark.createDataFrame([(k, side, f"{side}.txt", text) for k, both in pairs.items() for side, text in zip(("protocol", "report"), both, strict=True)], DOCUMENTS)


def records(df):
    out = {r.pair_id: json.loads(r.payload) for r in df.collect()}
    for x in out.values():
        del x["manifest"]["run_at_utc"]
    return out


def test_only_changed_pairs_are_reviewed_and_all_records_are_those_of_a_full_review(spark):
    before = {"same": flawed(), "edited": clean(), "gone": clean(), "broken": ("no", "table")}
    after = {"same": flawed(), "edited": (clean()[0], clean()[1].replace("Min 655", "Min 555")), "new": flawed(), "broken": ("no", "table")}
    old = payload(review(table(spark, before))).persist()
    assert {(r.pair_id, r.change) for r in changes(table(spark, after), old).collect()} == {("edited", "changed"), ("gone", "gone"), ("new", "new"), ("broken", "new")}
    assert changes(table(spark, {k: before[k] for k in ("same", "edited", "gone")}), old).isEmpty()
    stale = old.selectExpr("pair_id", "replace(payload, '\"version\":\"', '\"version\":\"0.') AS payload")
    assert {(r.pair_id, r.change) for r in changes(table(spark, {"same": before["same"]}), stale).collect()} == {("same", "changed"), ("edited", "gone"), ("gone", "gone")}
    result, every, changed = review_changes(table(spark, after), old)
    assert {r.pair_id for r in result.outcomes.select("pair_id").distinct().collect()} == {"edited", "new"} and changed.count() == 4
    assert records(every) == records(payload(review(table(spark, after))))


def test_files_are_read_again(spark, tmp_path):
    from pairsight.cli import main

    def put(pair, texts):
        (tmp_path / "docs" / pair).mkdir(parents=True, exist_ok=True)
        for side, text in zip(("protocol", "report"), texts, strict=True):
            (tmp_path / "docs" / pair / f"{side}.txt").write_text(text)

    put("a", flawed())
    put("b", clean())
    run = lambda *more: main(["--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--quiet", *more])
    assert run("--changed") == 0 and set(records(read_records(spark, str(tmp_path / "out/pairs")))) == {"a", "b"}
    sheet = tmp_path / "out/pairs/a/review-sheet.html"
    stamp = sheet.stat().st_mtime_ns
    put("b", flawed())
    put("c", clean())
    assert run("--changed") == 0 and sheet.stat().st_mtime_ns == stamp
    got = records(read_records(spark, str(tmp_path / "out/pairs")))
    assert {k: len(v["findings"]) for k, v in got.items()} == {"a": 16, "b": 16, "c": 0}
    for f in (tmp_path / "docs/c").iterdir():
        f.unlink()
    assert run("--changed") == 0 and set(records(read_records(spark, str(tmp_path / "out/pairs")))) == {"a", "b"}
    assert document_files(spark, str(tmp_path / "docs")).count() == 4 and read_records(spark, str(tmp_path / "never")).count() == 0
