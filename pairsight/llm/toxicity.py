"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised log-likelihood.

Each class has an interpolated model of word pairs. Counts are continuation counts on both levels: a pair counts the
different words that it has been seen after, a word the different words before it, so that copies of a text and phrases
that come again don't add up. Every place of every text counts. A pair's count less an absolute
discount is its own share of its first word; what discounts leave goes to the class's word probabilities, which are
discounted in the same way in favour of counts that both classes share. So a rare expression is about as likely under
either class, and what only one of them uses is not.

A text is as toxic as its most toxic expression: of each WINDOW words in a row the ratio of the two likelihoods is taken
and divided by their number, and the largest counts, so a few words decide in a text of any length. A shorter text is one
expression.

Counts cover all labelled rows that aren't held out and grow with them; discounts are the same for every number of rows. Words
are told apart by their 64-bit hash; one that isn't in the model falls back to the shared counts. What is seen most, of words,
of words that begin pairs and of pairs, is looked up in broadcast arrays of bounded size, all else by a join that adds up in the
same order, so a score is the same to the bit wherever its words are found. The logistic curve from the ratio to a
probability comes from half of these rows, scored by what the other half gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, held_out
from .ngrams import flat, hashed, with_labels

WORD = r"[\p{L}\p{N}]+"
#: Words in a row whose mean ratio is taken.
WINDOW = 3
#: What is taken from a word's count: words with no more contexts than this in a class have no weight of their own there.
DISCOUNT = 3
#: The same for a pair.
PAIR_DISCOUNT = 20
#: Words, of a hash and a ratio each, that are broadcast at most; the others are joined. The same for pairs, and for words that begin them.
BROADCAST_WORDS = 1 << 20
#: Bits of the table that tells which lookups of what isn't broadcast can find anything, as a power of two. A fuller table lets more through, no fewer.
TABLE_BITS = 26
#: Counts from which words aren't told apart when those to broadcast are chosen.
OFTEN = 1 << 16
#: The key of a text while its words are joined.
TEXT_KEY = "_toxicity_text"
BINS, BIN_WIDTH = 400, 0.02
#: Texts of a batch that are looked at together.
TEXTS = 512
#: Words of labelled texts whose pairs a task holds before it hands on what is different among them.
PLACES = 1 << 21
#: Parts that the pairs of one word are dealt to, or one for so many of the labelled rows where that is more. Pairs of a word are written in one row, which keeps what is shuffled small.
SALTS, SALT_ROWS = 8, 1 << 17
CLASSES = ("t", "o", "t0", "o0")


@dataclass
class KneserNey:
    """Log-likelihood ratios: of words with weight in a class, in two parts, and of all other words; what is added after a word; of pairs with weight."""

    words: np.ndarray  # hashes of the words seen most, in order
    ratios: np.ndarray
    rest: DataFrame | None  # _kind, _key and _value of what isn't in the arrays: words, words that begin pairs, pairs; None for none
    bits: np.ndarray | None  # the table of what is in rest
    other: float
    contexts: np.ndarray  # hashes of words that begin pairs with weight, in order
    shifts: np.ndarray
    pairs: np.ndarray  # as pair_key gives them, in order
    pair_ratios: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0
    tables: tuple = field(init=False)

    def __post_init__(self) -> None:
        self.tables = (self.words, self.ratios, self.contexts, self.shifts, self.pairs, self.pair_ratios, self.other, self.bits)

    def curve(self, ratio: Column) -> Column:
        z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), ratio * self.slope + self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for a pair of hashes."""
    x = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64)


def _slot(key: np.ndarray, kind: int) -> np.ndarray:
    """The bit of a key in the table."""
    return pair_key(key, np.full(len(key), kind + 1)) & ((1 << TABLE_BITS) - 1)


def _bits(rest: DataFrame) -> np.ndarray:
    """The table with the bit of each key set, folded in Spark to pages of 4 KB."""

    @F.pandas_udf("long")
    def slot(kind: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(np.choose(kind.to_numpy(), [_slot(key.to_numpy(), k) for k in range(3)]) + 1)

    slots = rest.select(slot("_kind", "_key").alias("slot"))
    pages = slots.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).toArrow()  # bounded by the table
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for page, bits in zip(pages["page"].to_pylist(), pages["bits"], strict=True):
        table[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits.as_buffer(), np.uint8)
    return table


def _may_be(bits: np.ndarray | None, key: np.ndarray, kind: int) -> np.ndarray:
    """Whether each key can be in what the table is of."""
    if bits is None:
        return np.zeros(len(key), bool)
    slot = _slot(key, kind)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _before(h: np.ndarray, sizes: np.ndarray, n: int = 1) -> np.ndarray:
    """The hash n places before each, 0 where a row has none."""
    out = np.roll(h, n)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    for i in range(n):
        out[np.minimum(starts + i, len(h) - 1)[sizes[sizes > 0] > i]] = 0
    return out


def _triples(it: Iterator[pa.RecordBatch], salts: int) -> Iterator[pa.RecordBatch]:
    """All words of labelled rows with the two words before each, w, v and u, and the marks of the rows; of what is alike among some rows one with the marks of all. A row for each w and salt of its v, with all of these in ``packed``: the upper halves of v, the lower, u, and eight marks a number.

    u only tells the contexts of one pair apart and has 32 bits: of n contexts some n * n / 2^33 are taken for others, one of 100,000.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> pa.RecordBatch:
        w, v, u, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        u = u.astype(np.int32)  # the low half
        salt = (pair_key(v, v) & 0x7FFFFFFF).astype(np.int32) % np.int32(salts)
        order = np.lexsort((u, v, salt, w))
        w, v, u, mark, salt = w[order], v[order], u[order], mark[order], salt[order]
        new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (u[1:] != u[:-1])))
        w, v, u, salt, mark = w[new], v[new], u[new], salt[new], np.bitwise_or.reduceat(mark, new)
        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (salt[1:] != salt[:-1])))
        n = np.diff(first, append=len(w))
        ends = np.cumsum(3 * n + (n + 7) // 8)
        at = np.repeat(ends - 3 * n - (n + 7) // 8, n)
        size, i = np.repeat(n, n), np.arange(len(w)) - np.repeat(first, n)
        packed = np.zeros(ends[-1], np.int32)
        packed[at + i], packed[at + size + i], packed[at + 2 * size + i] = v >> 32, v.astype(np.int32), u
        eighth = np.flatnonzero(i % 8 == 0)
        packed[(at + 3 * size + i // 8)[eighth]] = np.bitwise_or.reduceat(mark.astype(np.uint32) << (i % 8 * 4).astype(np.uint32), eighth).view(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(salt[first]), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(packed))], names=["w", "salt", "packed"])

    for batch in it:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            h, sizes = part.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(part.column("w")).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(h):
                held.append((h, _before(h, sizes), _before(h, sizes, 2), np.repeat(part.column("mark").to_numpy(zero_copy_only=False).astype(np.int32), sizes)))
            if sum(len(x[0]) for x in held) >= PLACES:
                yield merged()
    if held:
        yield merged()


def _unpacked(rows: DataFrame) -> DataFrame:
    """w, salt, v, u and mark, as _triples packs them."""
    n = F.floor(F.size("packed") * 8 / 25).cast("int")
    rows = rows.select("w", "salt", "packed", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    get = lambda at: F.get("packed", at)
    v = F.shiftleft(get(F.col("i")).cast("long"), 32).bitwiseOR(get(F.col("n") + F.col("i")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    mark = F.call_function("shiftright", get((3 * F.col("n") + F.shiftright("i", 3))), (F.col("i").bitwiseAND(F.lit(7)) * 4)).bitwiseAND(F.lit(15))
    return rows.select("w", "salt", v.alias("v"), get(2 * F.col("n") + F.col("i")).alias("u"), mark.alias("mark"))


def _count(rows: DataFrame, pair_discount: int, salts: int = SALTS) -> DataFrame:
    """Continuation counts by class: t and o, and t0 and o0 over the rows of the first half alone. rows: label, half (0 or 1) and hashes ``w``.

    kind 0: of each word a. kind 1: of words a that begin pairs with weight, the sum over their pairs, and as ``kept`` of
    what discounts leave of them. kind 2: of the pairs of a word b and a word a after it with weight.
    """
    mark = F.when(F.col("label") == 1, 1).otherwise(2) * F.when(F.col("half") == 0, 1).otherwise(4)
    seen = rows.select(mark.alias("mark"), "w").mapInArrow(lambda it: _triples(it, salts), "w long, salt int, packed array<int>")
    # all that is alike is in one partition, and the rest of a word's pairs in few others
    seen = _unpacked(seen.repartition("w", "salt")).groupBy("w", "salt", "v", "u").agg(F.bit_or("mark").alias("m"))
    has = lambda bits: F.count_if(F.col("m").bitwiseAND(F.lit(bits)) != 0)
    pairs = seen.groupBy("w", "salt", "v").agg(*(has(b).alias(c) for c, b in zip(CLASSES, (5, 10, 1, 2), strict=True)))
    left = lambda c: F.greatest(F.col(c) - pair_discount, F.lit(0))
    row = lambda df, kind, a, b, value, kept: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), *(value(c).cast("long").alias(c) for c in CLASSES), *(kept(c).cast("long").alias(f"{c}_kept") for c in CLASSES))
    none = lambda c: F.lit(0)
    words = pairs.groupBy("w").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in CLASSES))
    contexts = pairs.groupBy("v").agg(*(F.sum(c).alias(c) for c in CLASSES), *(F.sum(left(c)).alias(f"{c}_kept") for c in CLASSES)).where(F.greatest(*(f"{c}_kept" for c in CLASSES)) > 0)
    heavy = pairs.where(F.greatest(*CLASSES) > pair_discount)
    zero, kept = F.lit(0).cast("long"), lambda c: F.col(f"{c}_kept")
    return row(words, 0, F.col("w"), zero, F.col, none).unionByName(row(contexts, 1, F.col("v"), zero, F.col, kept)).unionByName(row(heavy, 2, F.col("w"), F.col("v"), F.col, left))


def _model(counts: DataFrame, sums: dict, toxic: str, ordinary: str, most: int, most_pairs: int, discount: int) -> KneserNey:
    """The model that two of the counts give. sums: over all words, of each count c, of what its discount leaves as c_kept, and the words with a count as n."""
    both = (toxic, ordinary)
    total = {c: max(sums[c] or 0, 1) for c in both}
    left = {c: 1 - (sums[f"{c}_kept"] or 0) / total[c] for c in both}
    shared = (F.col(toxic) + F.col(ordinary) + 1) / F.lit(float((sums[toxic] or 0) + (sums[ordinary] or 0) + sums[f"{toxic}_n"] + 1))
    own = lambda c: F.greatest(F.col(c) - discount, F.lit(0)) / F.lit(float(total[c])) + F.lit(left[c]) * shared
    words = counts.where("kind = 0").select("a", *both, *(own(c).alias(f"p_{c}") for c in both))
    # what the discount takes whole in both classes has the ratio of all other words
    weighed = words.where((F.col(toxic) > discount) | (F.col(ordinary) > discount)).select(F.col("a").alias("w"), F.log(F.col(f"p_{toxic}") / F.col(f"p_{ordinary}")).alias("ratio"), F.least(F.col(toxic) + F.col(ordinary), F.lit(OFTEN)).alias("n"))
    # what a word's pairs with weight leave to others after it
    backoff = lambda c: F.when(F.col(c) > 0, 1 - F.col(f"{c}_kept") / F.col(c)).otherwise(1.0)
    contexts = counts.where("kind = 1").select(F.col("a").alias("b"), *(F.col(c).alias(f"of_{c}") for c in both), *(backoff(c).alias(f"b_{c}") for c in both))
    heavy = counts.where("kind = 2").select("a", "b", *(F.col(f"{c}_kept").alias(f"k_{c}") for c in both)).where((F.col(f"k_{toxic}") > 0) | (F.col(f"k_{ordinary}") > 0)).join(words, "a").join(contexts, "b")
    p = lambda c: F.coalesce(F.try_divide(f"k_{c}", f"of_{c}"), F.lit(0.0)) + F.col(f"b_{c}") * F.col(f"p_{c}")
    often = lambda cs: F.least(sum((F.col(c) for c in cs[1:]), F.col(cs[0])), F.lit(OFTEN)).cast("int").alias("n")

    @F.pandas_udf("long")
    def as_key(before: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series(pair_key(before.to_numpy(), word.to_numpy()))

    parts = [
        (weighed.select(F.col("w").alias("_key"), F.col("ratio").alias("_value"), "n"), most),
        (contexts.select(F.col("b").alias("_key"), F.log(F.col(f"b_{toxic}") / F.col(f"b_{ordinary}")).alias("_value"), often([f"of_{c}" for c in both])), most_pairs),
        (heavy.select(as_key("b", "a").alias("_key"), F.log(p(toxic) / p(ordinary)).alias("_value"), often([f"k_{c}" for c in both])), most_pairs),
    ]
    arrays, rest = [], []
    for kind, (df, bound) in enumerate(parts):
        by_count = sorted(((r["n"], r["rows"]) for r in df.groupBy("n").agg(F.count("*").alias("rows")).collect()), reverse=True)  # OFTEN rows at most
        least, taken = OFTEN + 1, 0
        for n, of in by_count:
            if taken + of > bound:
                break
            least, taken = n, taken + of
        if taken < sum(of for _, of in by_count):
            rest.append(df.where(F.col("n") < least).select(F.lit(kind).alias("_kind"), "_key", "_value"))
        keys, values = (c.to_numpy() for c in df.where(F.col("n") >= least).select("_key", "_value").toArrow().columns)
        order = np.argsort(keys)
        arrays += [keys[order].astype(np.int64), values[order].astype(np.float64)]
    joined = cut(reduce(DataFrame.unionByName, rest)) if rest else None
    return KneserNey(*arrays[:2], joined, _bits(joined) if rest else None, float(np.log(left[toxic] / left[ordinary])), *arrays[2:])


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is among the keys, and its value, 0 if not."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = keys[at] == wanted
    return known, np.where(known, values[at], 0.0)


def _values(tables: tuple, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The log-likelihood ratio of each place in two parts, its word's and what is added after the word before, and the keys by which word, word before and pair have to be looked up elsewhere for it, each with whether it has to be. A pair that is found is one part."""
    words, ratios, contexts, shifts, pairs, pair_ratios, other, bits = tables
    different, back = np.unique(h, return_inverse=True)
    known, ratio = _find(words, ratios, different)
    ratio, ask_word = np.where(known, ratio, other)[back], (~known & _may_be(bits, different, 0))[back]
    before = _before(h, sizes)
    after, shift = _find(contexts, shifts, before)
    ask_before = ~after & _may_be(bits, before, 1)
    key, ask_pair = pair_key(before, h), np.zeros(len(h), bool)
    places = np.flatnonzero(after | ask_before)
    found, own = _find(pairs, pair_ratios, key[places])
    ask_pair[places] = ~found & _may_be(bits, key[places], 2)
    known = places[found]
    ratio[known], shift[known] = own[found], 0.0
    ask_word[known] = ask_before[known] = False
    return ratio, shift, h, ask_word, before, ask_before, key, ask_pair


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, row and length of each window: all of WINDOW places, or a shorter row whole."""
    starts = np.cumsum(sizes) - sizes
    n = np.where(sizes > 0, np.maximum(sizes - WINDOW + 1, 1), 0)
    row = np.repeat(np.arange(len(sizes)), n)
    start = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return start, row, np.minimum(sizes, WINDOW)[row]


def _means(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    start, row, length = _windows(sizes)
    total = np.zeros(len(start))
    for k in range(WINDOW):  # term by term, as differences of running sums would depend on what comes before
        total += np.where(k < length, value[np.minimum(start + k, len(value) - 1)], 0.0)
    return start, row, length, total


def _largest(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The largest of each row, minus infinity for none; rows in order."""
    out = np.full(n, -np.inf)
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.maximum.reduceat(x, first)
    return out


def _ratio(spark, model: KneserNey):
    """A row's largest mean where all words with weight are in the array; 0 for no words."""
    shared = spark.sparkContext.broadcast(model.tables)

    @F.pandas_udf("double")
    def ratio(rows: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for i in range(0, len(rows), TEXTS):
            h, sizes = flat(rows.iloc[i : i + TEXTS])
            top = np.zeros(len(sizes))
            if len(h):
                ratio, shift, *_ = _values(shared.value, h, sizes)
                _, row, length, total = _means(ratio + shift, sizes)
                best = _largest(row, total / length, len(sizes))
                top = np.where(sizes > 0, best, 0.0)
            out.append(top)
        return pd.Series(np.concatenate(out))

    return ratio


def _look_up(spark, model: KneserNey):
    """best: a row's largest mean of windows that are known, null for none; open: its other windows, alike ones once: for each place its two parts, and what has to be looked up."""
    shared = spark.sparkContext.broadcast(model.tables)

    @F.pandas_udf("struct<best:double,open:array<array<struct<ratio:double,shift:double,keys:array<struct<_kind:int,_key:bigint>>>>>>")
    def look_up(rows: pd.Series) -> pd.DataFrame:
        best, windows = [], []
        for i in range(0, len(rows), TEXTS):
            h, sizes = flat(rows.iloc[i : i + TEXTS])
            mine: list[dict] = [{} for _ in sizes]
            top = np.full(len(sizes), -np.inf)
            if len(h):
                ratio, shift, *asked = _values(shared.value, h, sizes)
                start, row, length, total = _means(ratio + shift, sizes)
                asks = asked[1] | asked[3] | asked[5]
                has = np.zeros(len(start), bool)
                for k in range(WINDOW):
                    has |= (k < length) & asks[np.minimum(start + k, len(h) - 1)]
                top = _largest(row[~has], (total / length)[~has], len(sizes))
                place = lambda j: (float(ratio[j]), float(shift[j]), tuple((kind, int(asked[2 * kind][j])) for kind in range(3) if asked[2 * kind + 1][j]))  # noqa: B023, E731
                for s, r, n in zip(start[has].tolist(), row[has].tolist(), length[has].tolist(), strict=True):
                    mine[r][tuple(map(place, range(s, s + n)))] = None
            best += [None if np.isinf(b) else float(b) for b in top]
            windows += [[[{"ratio": a, "shift": b, "keys": [{"_kind": k, "_key": x} for k, x in keys]} for a, b, keys in w] for w in own] for own in mine]
        return pd.DataFrame({"best": pd.Series(best, dtype="float64"), "open": windows})

    return look_up


def _with_ratio(docs: DataFrame, model: KneserNey, text: str, name: str) -> DataFrame:
    """docs and a column with the largest length-normalised log-likelihood ratio of a text's expressions; 0 for no words."""
    spark, words = docs.sparkSession, hashed(F.col(f"`{text}`"), WORD)
    if model.rest is None:
        return docs.withColumn(name, _ratio(spark, model)(words))
    key = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    found = docs.select(key.alias(TEXT_KEY), _look_up(spark, model)(words).alias("f")).select(TEXT_KEY, F.when(~F.isnan("f.best"), F.col("f.best")).alias("best"), F.posexplode_outer("f.open").alias("window", "places"))
    found = found.select(TEXT_KEY, "best", "window", F.posexplode_outer("places").alias("place", "x"))
    # a place's own row meets nothing
    own = F.array(F.struct(F.lit(-1).alias("_kind"), F.xxhash64(TEXT_KEY, "window").alias("_key")))
    found = found.select(TEXT_KEY, "best", "window", "place", "x.ratio", "x.shift", F.inline(F.concat(own, F.coalesce("x.keys", F.array().cast("array<struct<_kind:int,_key:bigint>>")))))
    # texts that are equal give equal rows, which count once
    found = found.distinct().join(model.rest, ["_kind", "_key"], "left")
    part = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_value")))
    value = F.coalesce(part(2), F.coalesce(part(0), F.max("ratio")) + F.coalesce(part(1), F.max("shift")))
    found = found.groupBy(TEXT_KEY, "window", "place").agg(F.max("best").alias("best"), value.alias("value"))
    in_order = F.transform(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value")))), lambda x: x["value"])
    mean = F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(in_order), F.lit(0))
    found = found.groupBy(TEXT_KEY, "window").agg(F.max("best").alias("best"), mean.alias("mean"))
    found = found.groupBy(TEXT_KEY).agg(F.max(F.greatest("best", "mean")).alias(name))
    return docs.drop(name).withColumn(TEXT_KEY, key).join(found, TEXT_KEY, "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop(TEXT_KEY)


def _fit_curve(bins: pd.DataFrame) -> tuple[float, float]:
    """Logistic regression on one number by Newton steps, with both classes' prior kept; bins: x, label, n."""
    x, y, n = (bins[c].to_numpy(np.float64) for c in ("x", "label", "n"))
    if len({*y}) < 2:
        return 0.0, -3.0 if not y.any() else 3.0
    mean, std = np.average(x, weights=n), np.sqrt(np.cov(x, fweights=n.astype(int))) or 1.0
    z = np.stack([(x - mean) / std, np.ones_like(x)], 1)
    theta, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    loss = lambda t: (n * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ t))).sum() + (ridge * t * t).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (n * (p - y)) + ridge * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return float(theta[0] / std), float(theta[1] - theta[0] * mean / std)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = BROADCAST_WORDS, most_pairs: int = BROADCAST_WORDS) -> KneserNey:
    """Learns from the rows of labels that aren't held out. docs: doc_id and text. Without labelled rows every score is the same.

    Null texts have no words; rows that repeat, and columns besides, change nothing. most: the words to broadcast at most,
    most_pairs: the pairs, and the words that begin them; they decide where these are looked up and never what comes out.
    """
    bounded_batches(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    labelled = lambda keep: with_labels(docs.select("doc_id", "text"), labels, label, keep)
    salts = max(SALTS, labels.where(F.col(label).isNotNull()).count() // SALT_ROWS)
    counts = cut(_count(labelled(fold != 1).select("label", F.when(fold == 0, 0).otherwise(1).alias("half"), hashed(F.col("text"), WORD).alias("w")), PAIR_DISCOUNT, salts))
    sums = counts.where("kind = 0").agg(*(x for c in CLASSES for x in (F.sum(c).alias(c), F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0))).alias(f"{c}_kept"))), F.count("*").alias("t_n"), F.count(F.when(F.col("t0") + F.col("o0") > 0, 1)).alias("t0_n")).first().asDict()
    seen = _with_ratio(labelled(fold == 2).select("label", "text"), _model(counts, sums, "t0", "o0", most, most_pairs, DISCOUNT), "text", "x").select("label", "x")
    middle = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("x") / BIN_WIDTH)))
    bins = seen.groupBy("label", middle.alias("bin")).agg(F.count("*").alias("n"), F.avg("x").alias("x")).toPandas()
    model = _model(counts, sums, "t", "o", most, most_pairs, DISCOUNT)
    model.slope, model.intercept = _fit_curve(bins)
    return model


def score_toxicity(docs: DataFrame, model: KneserNey, text: str = "text", name: str = "score") -> DataFrame:
    """docs and a column with the probability of label 1, in place of a column of that name. Null and empty texts get what the curve gives for no evidence; rows that repeat get the same; texts may have any length."""
    return _with_ratio(docs, model, text, name).withColumn(name, model.curve(F.col(name)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted. Scores depend on the text alone."""
    docs = docs.select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
