"""Reviews of pairs as their documents arrive, in whatever order and files: a stateful stream keyed by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.review import Review, review
from ..sources.documents import DOCUMENTS
from ..sources.shared import settle

SIDES = ("protocol", "report")
#: What is known of a pair: each side's name and text and when it arrived, in microseconds (null: not yet), and whether it was told that a side is missing.
STATE = ", ".join(f"{k}_name string, {k}_text string, {k}_at long" for k in SIDES) + ", told boolean"
#: DOCUMENTS and status: ``paired`` rows come two by two, ``half`` ones alone.
PAIRED = f"{DOCUMENTS}, status string"


def _pair(wait_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get) if state.exists else [None] * 6 + [False]

        def rows(status: str) -> pd.DataFrame:
            held = [(key[0], k, known[3 * i], known[3 * i + 1], status) for i, k in enumerate(SIDES) if known[3 * i + 2] is not None]
            return pd.DataFrame(held, columns=["pair_id", "doc_key", "name", "text", "status"])

        if state.hasTimedOut:
            known[6] = True
            state.update(tuple(known))
            yield rows("half")
            return
        changed = False
        for pdf in parts:
            for side, name, text, at in pdf[["doc_key", "name", "text", "arrived"]].itertuples(index=False):
                i = 3 * SIDES.index(side)
                new = (at, name or "", text or "")
                if known[i + 2] is None or new > (known[i + 2], known[i] or "", known[i + 1] or ""):
                    changed |= known[i + 2] is None or (name, text) != (known[i], known[i + 1])
                    known[i : i + 3] = name, text, at
        whole = known[2] is not None and known[5] is not None
        state.update(tuple(known))
        if not whole and not known[6]:
            state.setTimeoutDuration(wait_ms)
        if whole and changed:
            yield rows("paired")

    return step


def pair_up(documents: DataFrame, wait_ms: int) -> DataFrame:
    """PAIRED rows of a stream of DOCUMENTS and ``arrived``, a timestamp.

    Both documents of a pair come out together once both have arrived, and again each time that one is replaced by another
    name or text. Of several documents of one side the latest counts (ties: the greater name, then text); one that
    came late, older than what is known, changes nothing, and neither does one that repeats it. A document whose other side
    has not arrived after wait_ms comes out once, as half; the pair is still completed when the other arrives. Null texts
    and names stay null; rows without pair_id or arrived, and sides of other names, are left out; further columns are dropped.

    State has the latest two texts of each pair, in the checkpoint folder of the query: it grows with the pairs, not with
    what arrives for them.
    """
    known = documents.where(F.col("doc_key").isin(*SIDES) & F.col("pair_id").isNotNull() & F.col("arrived").isNotNull())
    grouped = known.select("pair_id", "doc_key", "name", "text", F.unix_micros("arrived").alias("arrived")).groupBy("pair_id")
    return grouped.applyInPandasWithState(_pair(wait_ms), PAIRED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def each_batch(paired: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], continuous: str | None = None) -> StreamingQuery:
    """Starts a stream of pair_up(). Spark makes batches for timers without end, so a query that is to end once it has read what is there makes none without documents: its timers are looked at with the next ones."""
    spark = paired.sparkSession
    trigger, name = {"processingTime": continuous} if continuous else {"availableNow": True}, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "true" if continuous else "false")  # read at the start only
        return paired.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(name, before)


def review_arrivals(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[Review, DataFrame, int], None], wait_ms: int = 7 * 24 * 3600 * 1000, continuous: str | None = None, **options) -> StreamingQuery:
    """Reviews pairs from Parquet files of DOCUMENTS that appear under a path.

    sink gets the review of the pairs that a micro-batch completes or replaces, the documents that have waited for wait_ms
    (see pair_up()), and the batch's number, by which it can tell a batch that is done again after a failure. A file's time
    of change says when its documents arrived. continuous: how often to look for files, such as "1 minute";
    without it the query ends when it has read what is there, and goes on from its checkpoint when it is started again.
    checkpoint has to be a folder that all executors share. options: review()'s.
    """
    arrived = spark.readStream.schema(DOCUMENTS).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))

    def batch(df: DataFrame, number: int) -> None:
        rows = settle(df)  # state must be stepped once a batch
        complete, half = rows.where("status = 'paired'").drop("status"), rows.where("status = 'half'").drop("status")
        sink(review(complete, **options), half, number)

    return each_batch(pair_up(arrived, wait_ms), checkpoint, batch, continuous)
