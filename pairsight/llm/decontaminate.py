"""Benchmark decontamination by winnowed word n-grams.

Of each text's hashed k-grams the smallest in every run of ``window - k + 1`` neighbours is kept, so whatever
``window`` words two texts share, they share a kept k-gram at the same place in them. Kept k-grams of documents
and items are joined, and each hit is extended word by word on both sides: a run of ``window`` words or more is
a shared passage. An item of fewer words is one gram of its own length and is looked up at every position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 13, 5
#: A kept gram is one long: a hash in the high bits and its position in the low ones. No text that fits in a row has more words.
POSITION_BITS = 28
#: Bytes of item texts for each file that fingerprints are written to, some 50 MB of fingerprints.
FILE_BYTES = 8 << 20
#: Fingerprint rows of a benchmark, some 250 bytes each, that are broadcast at most; more are joined by shuffling.
BROADCAST_ROWS = 100_000
#: Bits of the table that tells which document grams can match at all, at most. A fuller table lets more through to the join, no fewer.
MOST_BITS = 1 << 23


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _packed(hashes: Column, i: Column, n: int) -> Column:
    high = -(1 << POSITION_BITS)
    return F.xxhash64(F.slice(hashes, i + 1, F.lit(n))).bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long"))


def _positions(last: Column) -> Column:
    return F.sequence(F.lit(0), last)


def winnow(hashes: Column, window: int, k: int) -> Column:
    """The kept grams of a text of ``window`` words or more: the smallest of every window - k + 1, the leftmost of equal ones."""
    grams = F.transform(_positions(F.size(hashes) - k), lambda i: _packed(hashes, i, k))
    w = window - k + 1
    smallest = lambda g: F.transform(_positions(F.size(g) - w), lambda j: F.array_min(F.slice(g, j + 1, F.lit(w))))
    return F.array_distinct(F.element_at(F.transform(F.array(grams), smallest), 1))


def _grams(hashes: Column, window: int, k: int, short: list[int] | None) -> Column:
    """key, pos and k of all grams to look up. short: the lengths of short items; None: the text is an item itself."""
    size = F.size(hashes)
    low = (1 << POSITION_BITS) - 1

    def keyed(packed: Column, n: int, length: int) -> Column:
        return F.transform(packed, lambda p: F.struct(p.bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(n).cast("long")).alias("key"), p.bitwiseAND(F.lit(low)).cast("int").alias("pos"), F.lit(length).alias("k"), F.lit(n).alias("need")))

    def every(n: int) -> Column:
        return F.transform(_positions(size - n), lambda i: _packed(hashes, i, n))

    none = F.array().cast("array<struct<key:bigint,pos:int,k:int,need:int>>")
    parts = [F.when(size >= window, keyed(winnow(hashes, window, k), window, k)).otherwise(none)]
    for n in range(1, window) if short is None else short:
        whole = size == n if short is None else size >= n
        parts.append(F.when(whole, keyed(every(n), n, n)).otherwise(none))
    return F.concat(*parts)


def _with_context(hashes: Column, g: Column, reach: int, *fields: Column) -> Column:
    """A gram with its own words and up to ``reach`` words on either side, the nearest first."""
    before = F.least(g["pos"], F.lit(reach))
    left = F.reverse(F.slice(hashes, g["pos"] - before + 1, before))
    return F.struct(*fields, g["key"].alias("key"), g["pos"].alias("pos"), g["k"].alias("k"), g["need"].alias("need"), left.alias("left"), F.slice(hashes, g["pos"] + 1, g["k"]).alias("middle"), F.slice(hashes, g["pos"] + g["k"] + 1, F.lit(reach)).alias("right"))


def _common(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def benchmark_fingerprints(items: DataFrame, window: int = WINDOW, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, key, need, left, middle, right of each kept gram of each item, without repeats. Items without words have none."""
    hashed = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("w"))
    grams = hashed.select("item_id", F.explode(F.transform(_grams(F.col("w"), window, k, None), lambda g: _with_context(F.col("w"), g, window - k))).alias("g"))
    return grams.select("item_id", "g.key", "g.need", "g.left", "g.middle", "g.right").distinct()


def _bit_table(prints: DataFrame, bits: int) -> Column:
    """An array of bits / 64 longs with the bit of each key set, as a scalar of the plan."""
    slot = F.shiftright("key", POSITION_BITS).bitwiseAND(F.lit(bits - 1))
    have = prints.select((slot / 64).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = prints.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("b"))
    return have.unionByName(every).groupBy("i").agg(F.bit_or("b").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("table")).scalar()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, doc_id: str = "doc_id", text: str = "text", share: int = 20) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, item_ids, contaminated, spans.

    A word is hit if it lies in an occurrence of ``window`` consecutive item words, or of a whole shorter item.
    item_ids are those of such occurrences, as strings in order; spans are the hit runs, as word positions, end
    exclusive. contaminated: some word is hit, and share * n_hit >= n_words.

    Null and empty texts have no words. An item id that repeats is one item with several texts. Rows of docs
    that repeat, or have null ids, are rows of their own. Other columns are ignored.
    """
    n_bytes = items.select(F.sum(F.octet_length(text))).first()[0] or 0
    # as many files as there are fingerprints for, not one for each shuffle partition: on local disks each file has its mode set by forked processes
    prints = cut(benchmark_fingerprints(items, window, k, text=text).coalesce(1 + n_bytes // FILE_BYTES))
    n = prints.count()
    short = sorted(r["need"] for r in prints.select("need").where(F.col("need") < window).distinct().collect())  # window - 1 at most
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    hashed = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(text)).alias("row"), word_hashes(F.col(text)).alias("w")).withColumn("bits", _bit_table(prints, bits))

    def can_match(g: Column) -> Column:
        slot = F.shiftright(g["key"], POSITION_BITS).bitwiseAND(F.lit(bits - 1))
        return F.call_function("shiftright", F.get("bits", (slot / 64).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    grams = F.filter(_grams(F.col("w"), window, k, short), can_match)
    own = F.struct(F.lit(None).cast("bigint").alias("key"), F.lit(0).alias("pos"), F.lit(0).alias("k"), F.lit(0).alias("need"), *(F.array().cast("array<bigint>").alias(c) for c in ("left", "middle", "right")))
    rows = hashed.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(own), F.transform(grams, lambda g: _with_context(F.col("w"), g, window - k)))).alias("g"))
    rows = rows.select("doc_id", "row", F.when(F.col("g.key").isNull(), F.col("n_words")).alias("n_words"), "g.key", "g.pos", "g.k", "g.left", "g.middle", "g.right")
    prints = prints.select("item_id", "key", "need", F.col("left").alias("item_left"), F.col("middle").alias("item_middle"), F.col("right").alias("item_right"))
    hits = rows.join(F.broadcast(prints) if n <= BROADCAST_ROWS else prints, "key", "left")
    left, right = _common(F.col("left"), F.col("item_left")), _common(F.col("right"), F.col("item_right"))
    hits = hits.withColumn("l", F.when(F.col("middle") == F.col("item_middle"), left)).withColumn("r", F.when(F.col("middle") == F.col("item_middle"), right))
    hit = F.coalesce(F.col("l") + F.col("k") + F.col("r") >= F.col("need"), F.lit(False))
    run = F.struct((F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("k") + F.col("r")).alias("end"))
    # rows that repeat come here together, each with one row that has no gram
    per = hits.groupBy("doc_id", "row").agg(F.count_if(F.col("n_words").isNotNull()).alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(hit, run))).alias("runs"), F.collect_set(F.when(hit, F.col("item_id").cast("string"))).alias("items"))

    def merge(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(r)).when(r["start"] <= last["end"], joined).otherwise(F.concat(acc, F.array(r)))

    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("spans", F.aggregate("runs", F.array().cast("array<struct<start:int,end:int>>"), merge))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    per = per.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("item_ids"), "spans")
    return per.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
