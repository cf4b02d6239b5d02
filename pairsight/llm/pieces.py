"""SentencePiece encoding and decoding over a relational lattice.

Text is cut where no piece of the vocabulary can cross, so the best segmentation of a text is that of its segments end
to end. All different segments of the corpus are looked at once: their substrings, no longer than the longest piece, are
exploded and joined to the piece table; the matches are the edges of a segment's lattice, grouped by segment; and a
higher-order fold keeps the best score for each place and the edge that reached it, as the unigram algorithm does.
A character without a piece of its own is an edge worth less than any piece, and is written as its bytes. A segment may
have any length: its substrings are taken from stretches that overlap by a piece, and the fold grows in blocks.

Texts are cut and coded in batches. A batch takes the ids of frequent segments from a table of bounded size; what isn't in
it is joined, once a batch for each different segment, and goes back to the batch.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import bounded_batches, shared_folder

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose ids every task holds in memory, at most: those that occur most often.
TABLE_ROWS = 1 << 19
#: Counts from which segments aren't told apart when those to hold are chosen.
OFTEN = 1 << 16
#: Characters of the stretches that a segment's substrings are taken from.
STRETCH = 64
#: Elements of the blocks in which a fold's result grows.
FOLD_BLOCK = 128
#: Words of a task's batches, each counted once a batch, before it cuts them.
COUNTED = 300_000
#: Different segments that a task counts before it hands the counts on.
SEGMENTS = 300_000
#: Words that are cut at a time.
CUT = 50_000
#: The column that decoding looks pieces up in.
HEX_TABLE = "_hex_of_each_piece"
#: Texts, and bytes of them, in a batch.
DOCS, DOC_BYTES = 1000, 3_000_000
#: Exchanges' partitions are so many times finer where segments are about to be exploded.
FINER = 3
#: Frees the files of a query's exchanges when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Vocabulary:
    """Pieces that text can match with ids and scores, ids of the 256 bytes, and whether a space is put before a text."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    prefix: bool
    longest: int
    unknown: float
    #: Adjacent characters within pieces, as pairs of places in ``chars``.
    chars: dict[str, int]
    joined: np.ndarray

    def __post_init__(self) -> None:
        self.cutter = Cutter(self.chars, self.joined, self.prefix)


class Cutter:
    """Cuts texts into words and words into segments, at places that no piece crosses."""

    def __init__(self, chars: dict[str, int], joined: np.ndarray, prefix: bool) -> None:
        self.joined, self.prefix = joined, prefix
        self.place = np.zeros(max(map(ord, chars), default=0) + 2, np.int32)
        for c, k in chars.items():
            self.place[ord(c)] = k
        space, line = chars.get(SPACE, 0), chars.get("\n", 0)
        #: Pieces have spaces at their start only, and every text starts with one; line ends are apart from what is before them.
        self.by_word = prefix and int(joined[:, space].sum()) == int(joined[space, space]) and not joined[:, line].any()

    def words(self, text: str | None) -> list[str]:
        """The words of a text as keys: a word that starts with a line end is its own key, any other starts with a space that its key leaves out."""
        if not text:
            return []
        if not self.by_word:
            return [self.prepared(text)]
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            found = re.findall(f"{SPACE}+(?=\n)|{SPACE}*[^{SPACE}\n]+|\n[^{SPACE}\n]*|{SPACE}+", self.prepared(text))
            return [w if w[0] == "\n" else w[1:] for w in found]
        return text.replace("\n", " \n").split(" ")

    def prepared(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def coded_words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The words of all texts end to end as places in an array of different keys, that array, and how many words each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        some = pc.not_equal(texts, "")
        plain = pc.and_(some, pc.invert(pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.match_substring(texts, SPACE)))) if self.by_word else pa.array(np.zeros(len(texts), bool))
        counts = np.zeros(len(texts), np.int64)
        found = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), " ")
        plain_at, other_at = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (plain, pc.and_(some, pc.invert(plain))))
        counts[plain_at] = pc.list_value_length(found).to_numpy(zero_copy_only=False)
        words = found.flatten()
        if len(other_at):
            others = [self.words(t) for t in texts.take(pa.array(other_at)).to_pylist()]
            counts[other_at] = list(map(len, others))
            words = pa.concat_arrays([words, pa.array([w for own in others for w in own], pa.string())])
        coded = words.dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False)
        if len(other_at):
            order = np.concatenate([plain_at, other_at])
            starts = np.empty(len(texts), np.int64)
            starts[np.concatenate([order, np.flatnonzero(counts == 0)])] = np.concatenate([np.cumsum(counts[order]) - counts[order], np.zeros(int((counts == 0).sum()), np.int64)])
            places = places[ranges(starts, counts)]
        return places, coded.dictionary, counts

    def segments(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all words end to end, and how many each has. They don't depend on what stands around a word."""
        parts = [self._cut(keys[at : at + CUT]) for at in range(0, len(keys), CUT)]
        if not parts:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        return pa.concat_arrays([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _cut(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        words = pc.binary_join_element_wise(pc.if_else(pc.starts_with(keys, "\n"), "", SPACE), keys, "") if self.by_word else keys
        raw = b"".join(words.cast(pa.binary()).to_pylist())
        points = np.frombuffer(raw.decode(errors="surrogatepass").encode("utf-32-le", errors="surrogatepass"), np.uint32)
        places = self.place[np.minimum(points, len(self.place) - 1)]
        ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        apart = np.append(~self.joined.ravel().take(places[:-1] * np.int32(len(self.joined)) + places[1:]), True)
        apart[ends - 1] = True
        at = np.flatnonzero(apart) + 1
        counts = np.diff(np.searchsorted(at, ends, "right"), prepend=0)
        after = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        offsets = np.concatenate([[0], after[at - 1]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)), counts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length says, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model file. Scores are taken as they are."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, byte = 1, 6
    pieces = {p.piece: (i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == normal}
    values = [i for i, p in enumerate(model.pieces) if p.type == byte]
    if len(values) != 256:
        raise ValueError("the vocabulary has no piece for each byte")
    chars = {c: k for k, c in enumerate(sorted({c for p in pieces if len(p) > 1 for c in p}), 1)}
    joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for p in pieces:
        for a, b in zip(p, p[1:], strict=False):
            joined[chars[a], chars[b]] = True
    return Vocabulary(pieces, values, model.normalizer_spec.add_dummy_prefix, max(map(len, pieces)), min(s for _, s in pieces.values()) - 10, chars, joined)


def _cutter(spark: SparkSession, v: Vocabulary):
    return spark.sparkContext.broadcast((v.chars, v.joined, v.prefix))


def _batches(it: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of DOCS rows and about DOC_BYTES bytes of a column at most; a longer text is a batch of its own."""
    parts: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in it:
        start = 0
        for at, n in enumerate(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()):
            if rows and (rows >= DOCS or size + n > DOC_BYTES):
                yield from pa.Table.from_batches([*parts, batch.slice(start, at - start)]).combine_chunks().to_batches()
                parts, rows, size, start = [], 0, 0, at
            rows, size = rows + 1, size + n
        parts.append(batch.slice(start))
    if rows:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _release() -> None:
    """Gives memory that a worker doesn't use any more back, since workers stay while others' tasks run."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def segment_key(segment: str) -> str:
    """What a segment is known by: one of up to STRETCH characters by itself, a longer one by a digest that is longer than STRETCH."""
    return segment if len(segment) <= STRETCH else f"{SPACE}{SPACE}\n{hashlib.sha256(segment.encode(errors='surrogatepass')).hexdigest()}"


def any_long(segments: pa.Array) -> bool:
    return bool(pc.any(pc.greater(pc.utf8_length(segments), STRETCH)).as_py())


def count_segments(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """key, whole and n, how often it occurs, for all different segments of the texts. Null and empty texts have none.

    A segment of up to STRETCH characters is its own key and whole is null; a longer one has a digest as its key.
    """
    shared = _cutter(docs.sparkSession, vocabulary)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(*shared.value)

        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("s", use_threads=False).aggregate([("n", "sum")]).rename_columns(["s", "n"]).combine_chunks()

        def cut_words(words: list[pa.Table], seen: list[pa.Table]) -> list[pa.Table]:
            if not words:
                return seen
            all_words = summed(words)
            found, counts = cutter.segments(pa.concat_arrays(all_words["s"].chunks) if all_words.num_rows else pa.array([], pa.string()))
            return [summed([*seen, pa.table({"s": found, "n": np.repeat(all_words["n"].to_numpy(), counts)})])]

        def hand_on(seen: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            for batch in pa.concat_tables(seen).to_batches(max_chunksize=20_000) if seen else ():
                keys, whole = batch.column("s"), pa.nulls(batch.num_rows, pa.string())
                if any_long(keys):
                    own = keys.to_pylist()
                    keys, whole = pa.array(map(segment_key, own), pa.string()), pa.array([s if len(s) > STRETCH else None for s in own], pa.string())
                yield pa.RecordBatch.from_arrays([keys, whole, batch.column("n")], names=["key", "whole", "n"])

        words: list[pa.Table] = []
        seen: list[pa.Table] = []
        for part in _batches(it, "text"):
            places, keys, _ = cutter.coded_words(part.column("text"))
            words.append(pa.table({"s": keys, "n": np.bincount(places, minlength=len(keys))}))
            if sum(t.num_rows for t in words) >= COUNTED:
                words, seen = [], cut_words(words, seen)
                if seen[0].num_rows >= SEGMENTS:
                    yield from hand_on(seen)
                    seen = []
        yield from hand_on(cut_words(words, seen))
        words, seen = [], []
        _release()

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "key string, whole string, n long")
    finer = FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(finer, "key").groupBy("key", "whole").agg(F.sum("n").alias("n"))


#: An edge is one long: where it ends, LONG_CHARS less its length, so that longer ones come first, and its piece.
END_BITS, LONG_CHARS, CHAR_BITS = 34, 256, 26
#: Set in the piece of an edge that is an unknown character, below it its code point.
UNKNOWN = 1 << 25


def _shift(x: Column, bits: int) -> Column:
    return F.call_function("shiftleft", x.cast("long"), F.lit(bits))


#: How much better a piece's own pieces have to be, so that no rounding makes it the best again.
CLEARLY = 1e-3
#: Characters of a piece's start by which the longest one is looked up.
START = 3


def useful_pieces(vocabulary: Vocabulary) -> dict[str, int]:
    """The pieces, with their ids, that can be part of a best segmentation: any other is worth less than shorter pieces that make it up, wherever it stands."""
    useful: dict[str, float] = {}
    for p, (_, score) in sorted(vocabulary.pieces.items(), key=lambda x: len(x[0])):
        best = [0.0]
        for end in range(1, len(p) + 1):
            own = (best[start] + useful.get(p[start:end], vocabulary.unknown if end - start == 1 else -np.inf) for start in range(end) if (start, end) != (0, len(p)))
            best.append(max(own, default=-np.inf))
        if len(p) == 1 or best[-1] <= score + CLEARLY:
            useful[p] = score
    return {p: vocabulary.pieces[p][0] for p in useful}


def lattice(segments: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, n, segment and sorted edges of each segment. segments: as count_segments gives them."""
    spark = segments.sparkSession
    if vocabulary.longest >= LONG_CHARS or max(i for i, _ in vocabulary.pieces.values()) >= UNKNOWN:
        raise ValueError("pieces are too long or too many to pack an edge")
    useful = useful_pieces(vocabulary)
    table = spark.createDataFrame(pd.DataFrame(list(useful.items()), columns=["piece", "id"]), "piece string, id int")
    longest: dict[str, int] = {}
    for p in useful:
        if len(p) > START:
            longest[p[:START]] = max(len(p), longest.get(p[:START], 0))
    by_start = spark.createDataFrame(pd.DataFrame(list(longest.items()), columns=["piece_start", "longest"]), "piece_start string, longest int")
    keyed = segments.select("key", "n", F.coalesce("whole", "key").alias("segment")).where("segment <> ''")
    stretch = F.transform(F.sequence(F.lit(0), F.length("segment") - 1, F.lit(STRETCH)), lambda k: F.struct(k.alias("at"), F.substring(F.col("segment"), k + 1, F.lit(STRETCH + vocabulary.longest - 1)).alias("part"), F.when(k == 0, F.col("segment")).alias("first")))
    parts = keyed.select("key", "n", F.inline(stretch)).withColumn("chars_in", F.length("part"))
    starts = parts.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(STRETCH), F.col("chars_in")) - 1)).alias("in_part"))
    # no piece that starts like this is longer
    starts = starts.join(F.broadcast(by_start), F.substring(F.col("part"), F.col("in_part") + 1, F.lit(START)) == F.col("piece_start"), "left")
    subs = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("longest", F.lit(START)), F.col("chars_in") - F.col("in_part")))).alias("chars"))
    start = F.col("at") + F.col("in_part")
    subs = subs.select("key", "n", start.alias("start"), "chars", F.substring("part", F.col("in_part") + 1, F.col("chars")).alias("piece"), F.when((start == 0) & (F.col("chars") == 1), F.col("first")).alias("segment"))
    edges = subs.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR chars = 1")
    known = F.coalesce("id", F.lit(UNKNOWN).bitwiseOR(F.ascii("piece"))).cast("long")
    packed = _shift(F.col("start") + F.col("chars"), END_BITS).bitwiseOR(_shift(F.lit(LONG_CHARS) - F.col("chars"), CHAR_BITS)).bitwiseOR(known)
    return edges.groupBy("key").agg(F.max("n").alias("n"), F.max("segment").alias("segment"), F.sort_array(F.collect_list(packed)).alias("edges"))


def _end(e: Column) -> Column:
    return F.shiftright(e, END_BITS).cast("int")


def _chars(e: Column) -> Column:
    return F.lit(LONG_CHARS) - F.shiftright(e, CHAR_BITS).bitwiseAND(F.lit(LONG_CHARS - 1)).cast("int")


def best_edges(edges: Column, scores: Column, vocabulary: Vocabulary) -> Column:
    """The edge that reaches each place of a segment with the best sum of scores, the longer one where sums are equal. scores: of each piece, by id."""
    longest = vocabulary.longest

    def step(acc: Column, e: Column) -> Column:
        best, size = acc["best"], F.size(acc["best"])
        own = F.coalesce(F.get(scores, e.bitwiseAND(F.lit((1 << CHAR_BITS) - 1)).cast("int")), F.lit(vocabulary.unknown))
        # scores up to the place before ``end`` are in ``best``; that of ``end`` itself is still ``top``
        here = own + F.get(best, size - _chars(e))
        beyond = own + F.when(_chars(e) == 1, acc["top"]).otherwise(F.get(best, size + 1 - _chars(e)))
        full = F.size(acc["block"]) >= FOLD_BLOCK
        ahead = F.struct(
            F.array_append(F.when(size >= 2 * longest, F.slice(best, size - longest + 1, F.lit(longest))).otherwise(best), acc["top"]).alias("best"),
            F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(full, F.array(acc["via"])).otherwise(F.array_append(acc["block"], acc["via"])).alias("block"),
            beyond.alias("top"), e.alias("via"), _end(e).alias("end"),
        )
        better = F.struct(best.alias("best"), acc["blocks"].alias("blocks"), acc["block"].alias("block"), here.alias("top"), e.alias("via"), acc["end"].alias("end"))
        return F.when(_end(e) > acc["end"], ahead).when(here > acc["top"], better).otherwise(acc)

    first = F.expr("named_struct('best', array(0D), 'blocks', cast(array() AS array<array<bigint>>), 'block', cast(array() AS array<bigint>), 'top', cast('-Infinity' AS double), 'via', 0L, 'end', 1)")
    return F.aggregate(edges, first, step, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["block"], F.array(acc["via"])))


def path_ids(back: Column, codes: list[int]) -> Column:
    """The ids along the best path, walked from its end; an unknown character is the ids of its UTF-8 bytes."""
    code = F.array(*map(F.lit, codes))

    def utf8(c: Column) -> Column:
        more = lambda shift: F.shiftright(c, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
        head = lambda shift, mark: F.shiftright(c, shift).bitwiseOR(F.lit(mark))
        return F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(more(0), head(6, 192))).when(c < 0x10000, F.array(more(0), more(6), head(12, 224))).otherwise(F.array(more(0), more(6), more(12), head(18, 240)))

    def step(acc: Column, e: Column) -> Column:
        piece = e.bitwiseAND(F.lit((1 << CHAR_BITS) - 1)).cast("int")
        ids = F.when(piece < UNKNOWN, F.array(piece)).otherwise(F.transform(utf8(piece.bitwiseAND(F.lit(UNKNOWN - 1))), lambda b: F.get(code, b)))
        full = F.size(acc["block"]) >= FOLD_BLOCK
        on = F.struct(
            (acc["at"] - _chars(e)).alias("at"),
            F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"),
            F.when(full, ids).otherwise(F.concat(acc["block"], ids)).alias("block"),
        )
        return F.when(_end(e) == acc["at"], on).otherwise(acc)

    first = F.struct(F.size(back).alias("at"), F.array().cast("array<array<int>>").alias("blocks"), F.array().cast("array<int>").alias("block"))
    return F.aggregate(F.reverse(back), first, step, lambda acc: F.reverse(F.concat(F.flatten(acc["blocks"]), acc["block"])))


def encode_segments(segments: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, segment, n and ids of each segment. segments: as count_segments gives them."""
    by_id = dict(vocabulary.pieces.values())
    scores = segments.sparkSession.createDataFrame([([by_id.get(i) for i in range(max(by_id) + 1)],)], "scores array<double>").scalar()
    folded = lattice(segments, vocabulary).withColumn("scores", scores).select("key", "n", "segment", best_edges(F.col("edges"), F.col("scores"), vocabulary).alias("back"))
    return folded.select("key", "segment", "n", path_ids(F.col("back"), vocabulary.bytes).alias("ids"))


def _hold(coded: DataFrame, most: int, n_ids: int) -> tuple[int, np.ndarray, tuple[pa.Array, np.ndarray, np.ndarray]]:
    """How often a segment occurs at least that is held, so that at most ``most`` are; all ids by how often they occur; and the segments held, with the ends and the ranks of their ids. None is longer than STRETCH."""
    often = coded.select(F.least("n", F.lit(OFTEN)).alias("n")).groupBy("n").agg(F.count("*").alias("segments")).collect()  # OFTEN rows at most
    least, taken = OFTEN + 1, 0
    for n, segments in sorted(((r["n"], r["segments"]) for r in often), reverse=True):
        if taken + segments > most:
            break
        least, taken = n, taken + segments
    top = coded.where(held(least)).select("key", "n", "ids").toArrow().combine_chunks()
    ids = pa.concat_arrays(top["ids"].chunks) if top.num_rows else pa.array([], pa.list_(pa.int32()))
    keys = pa.concat_arrays(top["key"].chunks) if top.num_rows else pa.array([], pa.string())
    sizes, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    by_rank = np.argsort(-np.bincount(flat, weights=np.repeat(top["n"].to_numpy(), sizes), minlength=n_ids), kind="stable").astype(np.int32)
    rank = np.empty(n_ids, np.int32)
    rank[by_rank] = np.arange(n_ids)
    return least, by_rank, (keys, np.cumsum(sizes), rank[flat].astype(np.int32))


def held(least: int) -> Column:
    """Whether tasks hold a segment that is held if it occurs ``least`` times."""
    return (F.least("n", F.lit(OFTEN)) >= least) & (F.length("key") <= STRETCH)


def _packed(columns: dict) -> bytes:
    """Columns as a compressed Arrow stream."""
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3), use_threads=False)) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False)).read_all().combine_chunks()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if column.num_chunks else np.zeros(0, column.type.to_pandas_dtype())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """docs, or those of its columns that ``keep`` names, and a column with the ids of each text. Null and empty texts have none; rows that repeat are encoded alike.

    Ids are those that maximise the sum of the model's scores, the longer last piece where sums are equal. Texts may have
    any length and other columns any names but ``name``.

    A task codes a batch of texts with the segments that it holds and leaves marks for the others; those are joined by
    segment, go back to their batch, and take the places of the marks. A batch is known by its task, its place there and a
    digest of what is in it, so that one that is made again otherwise is never filled with another's ids: it fails.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        encode_segments(count_segments(docs, vocabulary, text), vocabulary).drop("segment").write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    coded = spark.read.parquet(folder)
    n_ids = max(*vocabulary.bytes, *(i for i, _ in vocabulary.pieces.values())) + 1
    least, by_rank, table = _hold(coded, TABLE_ROWS, n_ids)
    cutter_of, table_of, id_of = _cutter(spark, vocabulary), spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(by_rank)
    kept = docs.columns if keep is None else keep
    columns = [f"c{i}" for i in range(len(kept))]
    types = [docs.schema[c].dataType for c in kept]
    rows = docs.select(F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in zip(kept, columns, strict=True)))
    batch_of = ["batch", "content"]

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter, (segments, ends, ranks) = Cutter(*cutter_of.value), table_of.value
        sizes = np.diff(ends, prepend=0)
        task = TaskContext.get().partitionId() << 32
        for n, part in enumerate(_batches(it, "text")):
            places, words, counts = cutter.coded_words(part.column("text"))
            found, per_word = cutter.segments(words)
            at = pc.fill_null(pc.index_in(found, value_set=segments), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rare = np.flatnonzero(at < 0)
            missing = found.take(pa.array(rare)).dictionary_encode()
            # the ids of different words end to end, a mark for a segment that isn't held
            width = np.ones(len(at), np.int64)
            width[at >= 0] = sizes[at[at >= 0]]
            ids = np.empty(int(width.sum()), np.int32)
            begin = np.cumsum(width) - width
            ids[begin[rare]] = n_ids + missing.indices.to_numpy(zero_copy_only=False)
            known = np.flatnonzero(at >= 0)
            ids[ranges(begin[known], width[known])] = ranks[ranges((ends - sizes)[at[known]], width[known])]
            total = np.concatenate([[0], np.cumsum(width)])
            last = np.cumsum(per_word)
            length = total[last] - total[last - per_word]
            stream = ids[ranges((np.cumsum(length) - length)[places], length[places])]
            done = np.concatenate([[0], np.cumsum(length[places])])
            last = np.cumsum(counts)
            # the bytes of one place after those of another: frequent ids have small ranks, so most of them are alike
            planes = stream.view(np.uint8).reshape(-1, 4).T
            own = _packed({k: np.ascontiguousarray(p) for k, p in zip("abcd", planes, strict=True)})
            names = missing.dictionary
            gaps = _packed({"key": pa.array(map(segment_key, names.to_pylist()), pa.string()) if any_long(names) else names})
            others = _packed({"size": done[last] - done[last - counts]} | {k: part.column(k) for k in columns})
            content = int.from_bytes(hashlib.blake2b(own + gaps + others, digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_pydict({"batch": pa.array([task + n], pa.int64()), "content": pa.array([content], pa.int64()), "own": pa.array([own], pa.binary()), "gaps": pa.array([gaps], pa.binary()), "others": pa.array([others], pa.binary())})
            _release()

    # both uses below read the one exchange
    started = rows.mapInArrow(code, "batch long, content long, own binary, gaps binary, others binary").repartition(*batch_of)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            for row in part.select(["batch", "content", "gaps"]).to_pylist():
                table = _unpacked(row["gaps"])
                for keys in table.to_batches(max_chunksize=20_000):
                    yield pa.RecordBatch.from_pydict({"batch": np.full(len(keys), row["batch"]), "content": np.full(len(keys), row["content"]), "key": keys.column("key")})

    rare = started.mapInArrow(spread, "batch long, content long, key string").join(coded.where(~held(least)).select("key", "ids"), "key")
    out = StructType([*(StructField(k, t) for k, t in zip(columns, types, strict=True)), StructField("ids", ArrayType(IntegerType()))])

    def finish(key: tuple, own: pa.Table, fill: pa.Table) -> pa.Table:
        _release()
        if own.num_rows != 1:
            raise RuntimeError("a batch was made again with other rows")
        gaps, others = (_unpacked(own[k][0].as_py()) for k in ("gaps", "others"))
        where = pc.index_in(gaps["key"], value_set=fill["key"].combine_chunks())
        if where.null_count or fill.num_rows != gaps.num_rows:
            raise RuntimeError("a batch lacks segments")
        where = where.to_numpy().astype(np.int64) if gaps.num_rows else np.zeros(0, np.int64)
        lists = fill["ids"].combine_chunks()
        given, lengths = _numbers(pa.chunked_array(_flat(lists), pa.int32())), np.nan_to_num(pc.list_value_length(fill["ids"]).to_numpy()).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        planes = _unpacked(own["own"][0].as_py())
        stream = np.ascontiguousarray(np.stack([_numbers(planes[k]) for k in "abcd"], 1)).view(np.int32).reshape(-1)
        plain, marks = np.flatnonzero(stream < n_ids), np.flatnonzero(stream >= n_ids)
        which = where[stream[marks] - n_ids]
        width = np.ones(len(stream), np.int64)
        width[marks] = lengths[which]
        ends = np.concatenate([[0], np.cumsum(width)])
        ids = np.empty(int(ends[-1]), np.int32)
        ids[ends[plain]] = id_of.value[stream[plain]]
        ids[ranges(ends[marks], lengths[which])] = given[ranges(starts[which], lengths[which])]
        cuts = ends[np.concatenate([[0], np.cumsum(_numbers(others["size"]))])].astype(np.int32)
        return pa.table({k: others[k] for k in columns} | {"ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))})

    # all columns of ``started`` go on, so that the exchange is the same
    return started.groupBy(*batch_of).cogroup(rare.groupBy(*batch_of)).applyInArrow(finish, out).toDF(*kept, name)


def _flat(lists: pa.ChunkedArray | pa.Array) -> list[pa.Array]:
    """The values of lists, end to end."""
    return [x.flatten() for x in (lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists])]


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """docs and a column with the text of the ids: pieces end to end, bytes put together as UTF-8, SPACE as a space, the first one dropped.

    Unknown ids and null have no text, bytes that are no UTF-8 become replacement characters, rows that repeat are decoded alike.
    """
    back = {i: p.replace(SPACE, " ").encode() for p, (i, _) in vocabulary.pieces.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.bytes)}
    table = docs.sparkSession.createDataFrame([([back[i].hex() if i in back else None for i in range(max(back) + 1)],)], "hex array<string>").scalar()
    hexed = F.array_join(F.transform(F.col(ids), lambda i: F.get(F.col(HEX_TABLE), i)), "")
    if vocabulary.prefix:
        hexed = F.regexp_replace(hexed, "^20", "")
    text = F.make_valid_utf8(F.unhex(hexed).cast("string"))
    return docs.withColumn(HEX_TABLE, table).withColumn(name, F.coalesce(text, F.lit(""))).drop(HEX_TABLE)


def piece_digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids, and whether decoding gives the text again (SPACE itself is read as a space)."""
    v = load_vocabulary(path)
    sha = lambda t: F.sha2(t.cast("binary"), 256)
    docs = docs.select("doc_id", "text", sha(F.translate(F.coalesce("text", F.lit("")), SPACE, " ")).alias("sha"))
    coded = decode(encode(docs, v, keep=["doc_id", "sha"]), v).withColumn("decoded_sha256", sha(F.col("decoded")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha")).alias("round_trip"))
