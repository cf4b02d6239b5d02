import os

from pairs import EXPECTED, flawed
from pyspark.sql import functions as F

from pairsight.cli import main
from pairsight.sources.documents import DOCUMENTS, binary_files
from pairsight.streaming.arrivals import each_batch, pair_up, review_arrivals


def arrive(spark, folder, number, *rows):
    """A file of documents whose time of change grows with its number."""
    one = folder / f"made-{number}"
    spark.createDataFrame(list(rows), DOCUMENTS).coalesce(1).write.parquet(str(one))
    (part,) = one.glob("*.parquet")
    (folder / "in").mkdir(exist_ok=True)
    to = part.rename(folder / "in" / f"{number}.parquet")
    os.utime(to, (1_700_000_000 + number, 1_700_000_000 + number))


def test_documents_of_a_pair_meet_whenever_they_arrive(spark, tmp_path):
    def step(wait=1):
        got = []
        arrived = spark.readStream.schema(DOCUMENTS).parquet(str(tmp_path / "in")).select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.lit(1).alias("text2"))
        q = each_batch(pair_up(arrived, wait), str(tmp_path / "state"), lambda df, n: got.extend(map(tuple, df.collect())))
        assert q.awaitTermination(60) and q.exception() is None
        return sorted(got, key=str)

    pair = lambda i, p, r: [(i, "protocol", "p", p, "paired"), (i, "report", "r", r, "paired")]
    arrive(spark, tmp_path, 5, ("a", "protocol", "p", "A1"), ("b", "protocol", "p", "B1"), ("b", "report", "r", None), ("b", "appendix", "x", "-"), (None, "report", "r", "-"), ("c", "report", "r", "C1"))
    assert step() == pair("b", "B1", None)
    # started again from its checkpoint: the other side of a, and c has waited
    arrive(spark, tmp_path, 6, ("a", "report", "r", "A2"))
    assert step() == sorted([*pair("a", "A1", "A2"), ("c", "report", "r", "C1", "half")], key=str)
    # a is replaced; what repeats b says nothing new; c is told only once and is completed late
    arrive(spark, tmp_path, 7, ("a", "protocol", "p", "A3"), ("b", "protocol", "p", "B1"))
    assert step() == pair("a", "A3", "A2")
    # older than what is known of a; two of one file: the greater text counts
    arrive(spark, tmp_path, 1, ("a", "protocol", "p", "A0"))
    arrive(spark, tmp_path, 8, ("c", "protocol", "p", "C2"), ("c", "protocol", "p", "C3"), ("c", "protocol", "p", "C2"))
    assert step() == pair("c", "C3", "C1")


def test_pairs_are_reviewed_as_they_arrive(spark, tmp_path):
    p, r = flawed()
    arrive(spark, tmp_path, 1, ("x", "protocol", "p", p))
    arrive(spark, tmp_path, 2, ("x", "report", "r", r), ("y", "report", "r", r))
    seen, halves = [], []

    def sink(result, half, number):
        seen.extend((x.rule_id, x.scope, x.priority) for x in result.findings.collect())
        halves.extend(half.collect())

    q = review_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "state"), sink)
    assert q.awaitTermination(300) and q.exception() is None
    assert set(seen) == EXPECTED and halves == []


def test_command_line_and_binary_source(spark, tmp_path):
    p, r = flawed()
    (tmp_path / "docs/pair1").mkdir(parents=True)
    (tmp_path / "docs/pair1/protocol.txt").write_text(p)
    (tmp_path / "docs/pair1/report.txt").write_text(r)
    got = binary_files(spark, str(tmp_path / "docs"), lambda b: b.decode(), "*.txt").collect()
    assert {(x.pair_id, x.doc_key) for x in got} == {("pair1", "protocol"), ("pair1", "report")} and len(got[0].file_sha256) == 64
    assert main(["--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--quiet"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 16
