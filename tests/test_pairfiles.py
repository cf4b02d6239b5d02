import json
import os

import pytest
from pyspark.sql import functions as F

from pairsight.sources.pairfiles import PAGE_NAME, PAIR_FILES, RECORD_NAME, document_files, folder_name, write_pair_files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def test_documents_of_many_pages_with_both_texts(spark, tmp_path):
    pages = [{"layout": f"page {i}\n con sidered", "flat": None if i == 1 else f"page {i} considered"} for i in range(40)]
    put(tmp_path / "p1/protocol.json", json.dumps(pages))
    put(tmp_path / "p1/report.json", "[]")
    put(tmp_path / "p2/protocol.json", "{broken")
    put(tmp_path / "p2/report.json", b"")
    put(tmp_path / "a%2Fb/report.json", json.dumps([{"layout": None, "flat": None}]))
    put(tmp_path / "p1/notes.txt", "no document")
    got = {(r.pair_id, r.doc_key): r for r in document_files(spark, str(tmp_path), "json", maxPartitionBytes="1", openCostInBytes="1").collect()}
    assert set(got) == {("p1", "protocol"), ("p1", "report"), ("p2", "protocol"), ("p2", "report"), ("a/b", "report")}
    whole = got["p1", "protocol"]
    assert whole.text.count("\f") == 39 and len(whole.flat_pages) == 40 and whole.flat_pages[1] == "" and whole.flat_pages[39] == "page 39 considered"
    assert whole.error is None and len(whole.file_sha256) == 64 and whole.name == "protocol.json"
    assert (got["p1", "report"].text, got["p1", "report"].flat_pages) == ("", None) and got["a/b", "report"].text == ""
    for key in (("p2", "protocol"), ("p2", "report")):
        assert got[key].text is None and "JSONDecodeError" in got[key].error and got[key].file_sha256
    assert document_files(spark, f"file://{tmp_path}", "json", maxPartitionBytes="1", openCostInBytes="1").rdd.getNumPartitions() == 5
    assert document_files(spark, str(tmp_path), "json").rdd.getNumPartitions() == 1


def test_readers_by_name_and_missing_ones(spark, tmp_path):
    put(tmp_path / "p/report.txt", "one\ftwo")
    put(tmp_path / "p/report.pdf", b"%PDF-1.4")
    row = document_files(spark, str(tmp_path)).first()
    assert (row.text, row.flat_pages) == ("one\ftwo", None)
    row = document_files(spark, str(tmp_path), "pairsight.sources.pairfiles:text_pages", glob="*.txt").first()
    assert row.text == "one\ftwo"
    row = document_files(spark, str(tmp_path), "pdf").first()
    assert row.text is None and row.error
    empty = tmp_path / "none"
    empty.mkdir()
    assert document_files(spark, str(empty)).count() == 0


def test_pairs_are_pruned(spark, tmp_path):
    for p in ("p1", "p2", "x/y"):
        for k in ("protocol", "report"):
            put(tmp_path / folder_name(p) / f"{k}.txt", f"{p} {k}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = document_files(spark, str(tmp_path), maxPartitionBytes="1", openCostInBytes="1")
        one = read.where("pair_id = 'x/y' AND doc_key IN ('report', 'letter')")
        assert [r.text for r in one.collect()] == ["x/y report"] and one.rdd.getNumPartitions() == 1
        assert read.where("pair_id IN ('p1', 'p2', 'gone') AND length(text) > 0").count() == 4
        assert read.where("pair_id = 'gone'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR_FILES)


def there(path):
    return {p: {n: (path / p / n).read_text() for n in os.listdir(path / p)} for p in os.listdir(path)}


def test_record_and_page_come_together(spark, tmp_path):
    out = tmp_path / "out"
    write_pair_files(pairs(spark, [("a", "{}", "<p>"), ("b/c", "{1}", "é"), ("..", "{2}", "x")]).repartition(3), str(out))
    assert there(out) == {"a": {RECORD_NAME: "{}", PAGE_NAME: "<p>"}, "b%2Fc": {RECORD_NAME: "{1}", PAGE_NAME: "é"}, "%2E%2E": {RECORD_NAME: "{2}", PAGE_NAME: "x"}}
    write_pair_files(pairs(spark, [("a", "{new}", "<q>"), ("d", "{}", "")]), str(out))
    assert set(there(out)) == {"a", "b%2Fc", "%2E%2E", "d"} and there(out)["a"] == {RECORD_NAME: "{new}", PAGE_NAME: "<q>"}
    write_pair_files(pairs(spark, [("d", "{}", "only")]), str(out), "overwrite")
    assert there(out) == {"d": {RECORD_NAME: "{}", PAGE_NAME: "only"}}


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    write_pair_files(pairs(spark, [("a", "{}", "old")]), str(out))
    bad = spark.range(0, 6, 1, 6).select(F.concat(F.lit("n"), "id").alias("pair_id"), F.lit("{}").alias("record"), F.when(F.col("id") == 5, F.raise_error(F.lit("broken page"))).otherwise("p").alias("page"))
    with pytest.raises(Exception, match="broken page"):
        write_pair_files(bad, str(out))
    assert there(out) == {"a": {RECORD_NAME: "{}", PAGE_NAME: "old"}}
    with pytest.raises(Exception, match="more than once"):
        write_pair_files(pairs(spark, [("x", "{}", ""), ("x", "{}", ""), ("y", "{}", "")]).repartition(3, "page"), str(out))
    with pytest.raises(Exception, match="more than once"):
        write_pair_files(pairs(spark, [("x", "{}", "1")]).unionByName(pairs(spark, [("x", "{}", "2")])), str(out))
    assert there(out) == {"a": {RECORD_NAME: "{}", PAGE_NAME: "old"}}


def test_attempts_that_were_lost_are_not_moved(tmp_path):
    from pairsight.sources.pairfiles import Staged, _PairWriter

    w = _PairWriter(str(tmp_path), False)
    for attempt, text in (("1-lost", "half"), ("2-won", "whole")):
        put(tmp_path / f".staged-{w.run}" / attempt / "p" / RECORD_NAME, text)
    w.commit([Staged("2-won"), None])
    assert there(tmp_path) == {"p": {RECORD_NAME: "whole"}}
    put(tmp_path / f".staged-{w.run}" / "3" / "q" / RECORD_NAME, "x")
    w.abort([])
    w.abort([])
    assert set(there(tmp_path)) == {"p"}
