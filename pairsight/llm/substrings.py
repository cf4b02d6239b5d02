"""Exact removal of repeated byte strings with suffix arrays over shards of the corpus.

Wherever the same LENGTH bytes start twice, both places have the same smallest GRAM-byte hash within them. So starts
whose strings have the same smallest gram, at the same place, are one context; contexts with the same gram are one
group, and equal strings are always in one group. Contexts are counted by hash first, without their bytes, which only
tells groups that occur once and groups of a single context from the rest. Contexts of all groups that occur twice are
then counted by their bytes: one whose bytes occur twice repeats whole. In groups of two or more different contexts,
these are cut to what they can share with any other, put end to end and suffix-sorted: starts that are neighbours in
that order and agree in LENGTH bytes are repeats. A place finds what was decided of its context by 107 bits of hash.

A group of more than GROUP different contexts is split by longer strings around its gram, which equal strings share as
well, until its parts are small enough to sort. Tables of bits of bounded size tell which grams can matter, so that
fewer contexts are shuffled; they decide nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import bounded_batches, cut, shared_folder
from .suffixes import suffix_array

LENGTH, GRAM = 200, 64
#: Bytes hashed at a time; longer texts go on with the next block.
BLOCK = 1 << 20
#: Bits of a table of grams, as powers of two, at least and at most. A fuller table lets more through, no fewer.
LEAST_BITS, MOST_BITS = 18, 28
#: Different contexts of a group that one task sorts at most.
GROUP = 20_000
#: Places of the gram within a string that a larger group's parts have in common, level by level. Strings with the gram at one place differ in nothing.
WIDTHS = (35, 9, 1)
#: Rows of the list of larger groups that are broadcast at most.
BROADCAST_ROWS = 1_000_000
RANGES = "array<struct<s:int,e:int>>"


def _numbers(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(a))) * np.uint64(b)
        return x ^ (x >> np.uint64(31))


def _rolling(b: np.ndarray, k: int, made: dict = {}) -> np.ndarray:  # noqa: B006  kept for the next call of the same task
    """Hashes of all k-byte strings: differences of running sums of byte numbers times powers, brought to the same power."""
    if not made:
        base = 0x9E3779B97F4A7C15
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(BLOCK + LENGTH, x, np.uint64)
            p[0] = 1
            made[name] = np.multiply.accumulate(p)
        made["byte"] = _numbers(256, 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(made["byte"][b] * made["up"][: len(b)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * made["down"][: len(b) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def contexts(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, at, first and last of a text's contexts, block by block: starts from first to last have their smallest gram at ``at``; key is its hash, of 43 bits."""
    w = length - gram + 1
    low = np.uint64((1 << 21) - 1)
    for base in range(0, max(len(data) - length + 1, 0), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - base), base)
        h = _rolling(b, gram)
        h = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        m = len(h) - w + 1
        runs = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        from_left, from_right = np.minimum.accumulate(runs, 1).ravel(), np.minimum.accumulate(runs[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(from_right[:m], from_left[w - 1 : w - 1 + m])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        key, at = (least[first] >> np.uint64(21)).astype(np.int64), (least[first] & low).astype(np.int64) + base
        yield key, at, first + base, np.append(first[1:], m) - 1 + base


def _shared(sorted_parts: list[tuple[bytes, int]], out: list[int]) -> None:
    """out[i]: the longest start that a part shares with any other; parts are sorted, so with a neighbour."""
    for (a, i), (b, j) in zip(sorted_parts, sorted_parts[1:], strict=False):
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        same = n - (x.bit_length() + 7) // 8
        out[i], out[j] = max(out[i], same), max(out[j], same)


def repeats_in_group(group: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context (bytes, place of the gram, times it occurs), the ranges of starts, end exclusive, whose strings occur again."""
    found: list[list[tuple[int, int]]] = [[(0, len(c) - length + 1)] if n > 1 else [] for c, _, n in group]
    if len(group) < 2:
        return found
    right, left = [0] * len(group), [0] * len(group)
    _shared(sorted((c[at:], i) for i, (c, at, _) in enumerate(group)), right)
    _shared(sorted((c[:at][::-1], i) for i, (c, at, _) in enumerate(group)), left)
    kept = [i for i in range(len(group)) if left[i] + right[i] >= length]
    if len(kept) < 2:
        return found
    text, owner, offset = bytearray(), [], []
    for i in kept:
        c, at, _ = group[i]
        low, high = at - left[i], at + right[i]
        text += c[low:high] + b"\0"
        starts = high - low - length + 1
        owner += [i] * starts + [-1] * length
        offset += list(range(low, low + starts)) + [0] * length
    data = bytes(text)
    again: dict[int, set[int]] = {}
    previous = -1
    for i in suffix_array(data):
        if owner[i] >= 0:
            if previous >= 0 and data[previous : previous + length] == data[i : i + length]:
                for x in (previous, i):
                    again.setdefault(owner[x], set()).add(offset[x])
            previous = i
    for i, starts in again.items():
        if not found[i]:
            s = np.array(sorted(starts))
            edges = np.flatnonzero(np.diff(s) > 1)
            found[i] = list(zip(s[np.append(0, edges + 1)].tolist(), (s[np.append(edges, len(s) - 1)] + 1).tolist(), strict=True))
    return found


def _groups(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of repeated starts for contexts that come sorted by key. A context without bytes is alone in its group and repeats whole."""
    key, ids, group, out = None, [], [], []

    def close() -> None:
        for h, ranges in zip(ids, repeats_in_group(group), strict=True):
            if ranges:
                out.append((key, h, [{"s": s, "e": e} for s, e in ranges]))

    for pdf in it:
        for k, h, c, at, n, starts in zip(*(pdf[x].tolist() for x in ("key", "ctx", "bytes", "at", "n", "starts")), strict=True):
            if c is None:
                out.append((k, h, [{"s": 0, "e": starts}]))
                continue
            if k != key:
                if group:
                    close()
                key, ids, group = k, [], []
            ids.append(h)
            group.append((bytes(c), at, n))
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=["key", "ctx", "ranges"])
            out = []
    if group:
        close()
    yield pd.DataFrame(out, columns=["key", "ctx", "ranges"])


def _bits(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A table with the bit of each key set, folded in Spark to pages of 4 KB, and its size as a power of two."""
    power = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit((1 << power) - 1)) + 1
    pages = keys.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()  # bounded by the table
    table = np.zeros(1 << (power - 3), np.uint8)
    for page, bits in zip(pages["page"].to_pylist(), pages["bits"], strict=True):
        table[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits.as_buffer(), np.uint8)
    return table, power


def _contexts_of(texts: DataFrame, columns: str, bits=None, carried: bool = False, mixed=None) -> DataFrame:
    """A row for each context of each text, or of those whose bit is set: key, ctx and starts; carried: where it occurs; mixed: its bytes as well, and whether its bit is set in this table.

    ctx is the hash of a context's bytes and of the place of its gram in them; starts is how many strings start in it.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, names = xxhash.xxh64_intdigest, [c.split()[0] for c in columns.split(", ")]
        table, power = bits.value if bits is not None else (None, 0)
        table2, power2 = mixed.value if mixed is not None else (None, 0)
        rows: dict[str, list] = {c: [] for c in names}

        def batch() -> pa.RecordBatch:
            kinds = {"bytes": pa.binary(), "at": pa.int32(), "starts": pa.int16(), "mixed": pa.bool_()}
            arrays = [pa.array(np.concatenate(v) if v and isinstance(v[0], np.ndarray) else v, kinds.get(c, pa.int64())) for c, v in rows.items()]
            for v in rows.values():
                v.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        held = 0
        for part in it:
            for row, text in enumerate(part.column("text")):
                data = text.as_py().encode(errors="surrogatepass")
                for key, at, first, last in contexts(data):
                    if table is not None:
                        slot = key & ((1 << power) - 1)
                        mine = np.flatnonzero(table[slot >> 3] >> (slot & 7) & 1)
                        key, at, first, last = key[mine], at[mine], first[mine], last[mine]
                    if not len(key):
                        continue
                    parts = [data[f : e + LENGTH] for f, e in zip(first.tolist(), last.tolist(), strict=True)]
                    ctx = np.fromiter((digest(c, i) for c, i in zip(parts, (at - first).tolist(), strict=True)), np.uint64, len(parts)).view(np.int64)
                    rows["key"].append(key)
                    rows["ctx"].append(ctx)
                    if carried:
                        for c in ("row_a", "row_b"):
                            rows[c].append(np.full(len(key), part.column(c)[row].as_py(), np.int64))
                        rows["first"].append(first)
                    else:
                        rows["starts"].append((last - first + 1).astype(np.int16))
                    if table2 is not None:
                        slot = key & ((1 << power2) - 1)
                        rows["mixed"].append((table2[slot >> 3] >> (slot & 7) & 1).astype(bool))
                        rows["at"].append((at - first).astype(np.int32))
                        rows["bytes"] += parts
                    held += len(key) * (1 if table2 is None else 10)
                    if held >= 200_000:
                        held = 0
                        yield batch()
        if held:
            yield batch()

    return texts.mapInArrow(run, columns)


def _sorted(groups: DataFrame) -> DataFrame:
    """key, ctx and the ranges of repeated starts of contexts in groups that one task can sort. groups: key, ctx, at, starts, bytes, n."""
    return groups.repartition("key").sortWithinPartitions("key", "ctx").mapInPandas(_groups, f"key long, ctx long, ranges {RANGES}")


def split_context(c: bytes, at: int, width: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, bytes, bytes, int]]:
    """base, anchor, bytes and at of a context's parts: starts that have the gram at places of one class of ``width``, and what all their strings hold for sure."""
    span = length - gram
    for least in range(0, span + 1, width):
        most = min(least + width - 1, span)
        first, last = max(0, at - most), min(at - least, len(c) - length)
        if first <= last:
            yield first, b"%d:" % least + c[at - least : at + length - most], c[first : last + length], at - first


def _split(large: DataFrame) -> DataFrame:
    """Ranges of repeated starts in groups too large for one task. large: key, ctx, at, bytes, n of all their contexts."""
    rows, ranges = large.withColumn("base", F.lit(0)), None
    schema = "key long, ctx long, base int, key2 long, ctx2 long, at int, bytes binary, n long"
    for width in WIDTHS:

        def parts(it: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            import xxhash

            for pdf in it:
                for from_ in range(0, len(pdf), 500):
                    out = []
                    for k, h, b, at, c, n in pdf.iloc[from_ : from_ + 500][["key", "ctx", "base", "at", "bytes", "n"]].itertuples(index=False):
                        for base, anchor, part, place in split_context(bytes(c), at, width):
                            out.append((k, h, b + base, xxhash.xxh64_intdigest(anchor, k) - (1 << 63), xxhash.xxh64_intdigest(part, place) - (1 << 63), place, part, n))
                    yield pd.DataFrame(out, columns=["key", "ctx", "base", "key2", "ctx2", "at", "bytes", "n"])

        split = cut(rows.mapInPandas(parts, schema))
        different = split.groupBy("key2", "ctx2", "at", "bytes").agg(F.sum("n").alias("n")).withColumnsRenamed({"key2": "key", "ctx2": "ctx"}).withColumn("starts", F.octet_length("bytes") - (LENGTH - 1))
        if width > 1:
            still = cut(split.select("key2", "ctx2").distinct().groupBy("key2").agg(F.count("*").alias("kinds")).where(F.col("kinds") > GROUP).select("key2"))
            different = different.join(still.withColumnRenamed("key2", "key"), "key", "left_anti")
        found = _sorted(different).withColumnsRenamed({"key": "key2", "ctx": "ctx2"})
        moved = F.transform("ranges", lambda r: F.struct((r["s"] + F.col("base")).alias("s"), (r["e"] + F.col("base")).alias("e")))
        found = split.select("key", "ctx", "base", "key2", "ctx2").join(found, ["key2", "ctx2"]).select("key", "ctx", moved.alias("ranges"))
        ranges = found if ranges is None else ranges.unionByName(found)
        if width > 1:
            rows = split.join(still, "key2", "left_semi").select("key", "ctx", "base", "at", "bytes", "n")
            if rows.isEmpty():
                break
    return ranges


def repeated_strings(texts: DataFrame) -> DataFrame:
    """row_a, row_b and spans, byte ranges covered by a repeated string, for each row with any. texts: row_a, row_b, a key of the row, and text, without nulls."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark)}/contexts-{uuid.uuid4().hex}"
    seen = _contexts_of(texts.select("text"), "key long, ctx long, starts short")
    seen.groupBy("key", "ctx", "starts").agg(F.count("*").alias("n")).write.parquet(folder)
    seen = spark.read.parquet(folder)
    keys = cut(seen.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where("n > 1"))
    n_keys, n_mixed, n_large = keys.agg(F.count("*"), F.count_if(F.col("kinds") > 1), F.count_if(F.col("kinds") > GROUP)).first()
    share = lambda x: spark.sparkContext.broadcast(x)

    all_bits = share(_bits(keys, n_keys))
    compared = _contexts_of(texts.select("text"), "key long, ctx long, starts short, mixed boolean, at int, bytes binary", all_bits, mixed=share(_bits(keys.where("kinds > 1"), n_mixed)))
    compared = compared.groupBy("key", "ctx", "at", "starts", "mixed", "bytes").agg(F.count("*").alias("n")).where("mixed OR n > 1")
    compared = compared.select("key", "ctx", "at", "starts", "n", F.when(F.col("mixed"), F.col("bytes")).alias("bytes"))
    if n_large:
        large = keys.where(F.col("kinds") > GROUP).select("key")
        part = lambda how: compared.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "key", how)
        ranges = _split(cut(part("left_semi"))).unionByName(_sorted(part("left_anti")))
    else:
        ranges = _sorted(compared)
    places = _contexts_of(texts, "key long, ctx long, row_a long, row_b long, first long", all_bits, carried=True)
    spans = places.join(ranges, ["key", "ctx"]).select("row_a", "row_b", F.explode(F.transform("ranges", lambda r: F.struct((F.col("first") + r["s"]).alias("s"), (F.col("first") + r["e"] - 1 + LENGTH).alias("e")))).alias("r"))
    return spans.groupBy("row_a", "row_b").agg(F.array_sort(F.collect_set("r")).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``kept``, the bytes of a text that no repeated string of LENGTH bytes covers, ``n_bytes``, and ``removed``, the runs that go.

    Every string is judged on the input: copies don't spare each other, and a string may start again in the same text
    or overlap itself. A null text is empty; a text shorter than LENGTH stays whole, and texts may have any length. Rows of
    docs that repeat are copies. Columns of docs that have one of the three names are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = ("n_bytes", "removed", "kept")
    names = [c for c in docs.columns if c not in new]
    atoms = [f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, AtomicType)]
    # rows are told apart by 128 bits of a hash, which is the same each time that docs are computed
    keyed = docs.select(F.xxhash64(*atoms).alias("row_a"), F.xxhash64(F.lit(LENGTH), *atoms).alias("row_b"), F.struct(*(f"`{c}`" for c in names)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spans = repeated_strings(keyed.where(F.octet_length("text") >= LENGTH).select("row_a", "row_b", "text"))
    if text in names:  # once is enough on the way through the shuffle
        keyed, value = keyed.drop("text"), F.coalesce(F.col("row")[text], F.lit(""))
    else:
        value = F.col("text")
    joined = keyed.join(spans, ["row_a", "row_b"], "left")

    @F.pandas_udf(f"n_bytes long, removed {RANGES}, kept binary")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, found in zip(texts, spans, strict=True):
            data, runs = t.encode(errors="surrogatepass"), []
            for r in found if found is not None else ():
                if runs and r["s"] <= runs[-1]["e"]:
                    runs[-1]["e"] = max(runs[-1]["e"], r["e"])
                else:
                    runs.append({"s": int(r["s"]), "e": int(r["e"])})
            at, left = 0, []
            for r in runs:
                left.append(data[at : r["s"]])
                at = r["e"]
            out.append((len(data), runs, b"".join([*left, data[at:]])))
        return pd.DataFrame(out, columns=["n_bytes", "removed", "kept"])

    return joined.withColumn("_k", keep(value, "spans")).select(*(F.col("row")[c].alias(c) for c in names), "_k.n_bytes", "_k.removed", "_k.kept")


def substring_digest(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    found = remove_repeats(docs.select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
