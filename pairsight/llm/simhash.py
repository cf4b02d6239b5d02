"""SimHash near-duplicates found with BK-trees.

Equal fingerprints are one row from the start. Two fingerprints that differ in at most RADIUS of 64 bits agree in
at least two of six blocks of bits, so every one is put under the values of all fifteen pairs of blocks; values that only
one has are dropped. From those under the same value, shards of at most SHARD, trees are grown by tasks: a child hangs on
the edge that is its Hamming distance to the parent. The shards' trees, flat arrays of some 20 bytes a node, are broadcast
and searched with every fingerprint under their value; a search follows only edges within the radius of the distance at
hand. More than TREE_NODES nodes are broadcast in several passes. What would take more than PASSES of them isn't broadcast
but searched where it was grown, with fingerprints that are shuffled there. Links are the same every way.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: First bit and width of the blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints under one value that make one tree, about.
SHARD = 2048
#: Nodes of trees that are broadcast at a time at most: 10 MB.
TREE_NODES = 1 << 19
#: Broadcasts one after the other at most: each reads the rows once more.
PASSES = 64
#: Parts that the links of one component are dealt to when it gets its name.
SALTS = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 for no words."""
    import xxhash

    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8").astype(np.uint64).view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp for each row of docs. A null text has no words."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("fp"))


class BKTree:
    """Metric trees over integers under Hamming distance, in flat arrays. A node has its value, its edge to the parent, its first child and its next sibling."""

    def __init__(self, value: bytes = b"", edge: bytes = b"", child: bytes = b"", sibling: bytes = b"") -> None:
        self.value, self.edge, self.child, self.sibling = (array(kind, x).tolist() for kind, x in zip("QBii", (value, edge, child, sibling), strict=True))

    def arrays(self) -> tuple[bytes, ...]:
        return tuple(array(kind, x).tobytes() for kind, x in zip("QBii", (self.value, self.edge, self.child, self.sibling), strict=True))

    def add(self, x: int, root: int = 0) -> None:
        """Hangs x into the tree of a root; into none where the root is yet to come. A value that is there already stays once."""
        value, edge, child, sibling = self.value, self.edge, self.child, self.sibling
        node, d = root, 0
        while node < len(value) and (d := (x ^ value[node]).bit_count()):
            next_ = child[node]
            while next_ >= 0 and edge[next_] != d:
                next_ = sibling[next_]
            if next_ < 0:
                sibling.append(child[node])
                child[node] = len(value)
                break
            node = next_
        else:
            if node < len(value):
                return
            sibling.append(-1)
        value.append(x)
        edge.append(d)
        child.append(-1)

    def near(self, x: int, radius: int, root: int = 0) -> Iterator[int]:
        """Values within the radius of x."""
        value, edge, child, sibling = self.value, self.edge, self.child, self.sibling
        stack = [root] if root < len(value) else []
        while stack:
            node = stack.pop()
            d = (x ^ value[node]).bit_count()
            if d <= radius:
                yield value[node]
            next_ = child[node]
            while next_ >= 0:
                if -radius <= edge[next_] - d <= radius:
                    stack.append(next_)
                next_ = sibling[next_]


class Forest:
    """What is linked so far, as a parent for each value; hands on an edge to its root for each."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        found = [(x, root) for x in list(self.parent) if (root := self.find(x)) != x]
        self.parent.clear()
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


#: Values that a task's forest holds before it hands its edges on.
FOREST = 200_000


def _groups(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Keys and rows of each group of rows that come sorted by them; a group is one shard's, or two shards'."""
    key, rows = None, []
    for pdf in it:
        rest = [c for c in pdf.columns if c not in keys]
        for k, row in zip(pdf[keys].itertuples(index=False, name=None), pdf[rest].itertuples(index=False, name=None), strict=True):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


def _broadcast_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links found with the trees of some shards broadcast. rows: key, shard, fp, and grows, whether the row is a node of these trees or only looks in them."""

    def grow(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = ["key", "value", "edge", "child", "sibling"], []
        for (key, _), values in _groups(it, ["key", "shard"]):
            tree = BKTree()
            for (x,) in values:
                tree.add(x & 0xFFFFFFFFFFFFFFFF)
            out.append((key, *tree.arrays()))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    nodes = rows.where("grows").select("key", "shard", "fp").repartition("key", "shard").sortWithinPartitions("key", "shard")
    grown = nodes.mapInPandas(grow, "key long, value binary, edge binary, child binary, sibling binary").toArrow()  # some TREE_NODES nodes
    sizes = np.fromiter((len(x) for x in grown["edge"].to_pylist()), np.int64, grown.num_rows)
    order = np.argsort(grown["key"].to_numpy(), kind="stable")
    roots = np.cumsum(sizes) - sizes
    moved = lambda c: np.concatenate([np.zeros(0, np.int32), *(np.where((x := np.frombuffer(b, np.int32)) < 0, -1, x + r).astype(np.int32) for b, r in zip(grown[c].to_pylist(), roots, strict=True))]).tobytes()
    shared = rows.sparkSession.sparkContext.broadcast((grown["key"].to_numpy()[order], roots[order], b"".join(grown["value"].to_pylist()), b"".join(grown["edge"].to_pylist()), moved("child"), moved("sibling")))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, roots, *arrays = shared.value
        trees, forest = BKTree(*arrays), Forest()
        for batch in it:
            wanted = batch.column("key").to_numpy()
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            here = np.flatnonzero(high > low)
            for x, a, b in zip(batch.column("fp").to_numpy().view(np.uint64)[here].tolist(), low[here].tolist(), high[here].tolist(), strict=True):
                for root in roots[a:b].tolist():
                    for y in trees.near(x, radius, root):
                        if x != y:
                            forest.link(x, y)
            if len(forest.parent) > FOREST:
                yield pa.RecordBatch.from_pandas(forest.edges(), preserve_index=False)
        yield pa.RecordBatch.from_pandas(forest.edges(), preserve_index=False)

    return rows.select("key", "fp").mapInArrow(search, "a long, b long")


def _links_in_passes(rows: DataFrame, radius: int, passes: int) -> DataFrame:
    """Links found pass by pass: each broadcasts the trees of a share of the shards, chosen by hash, in which all rows under their values look. A pass ends before the next one begins."""
    if passes == 1:
        return _broadcast_links(rows.withColumn("grows", F.lit(True)), radius)
    turn = F.pmod(F.xxhash64("key", "shard", F.lit("pass")), F.lit(passes))
    # a value with one tree has all its rows in that tree's pass
    found = [cut(_broadcast_links(rows.withColumn("grows", turn == n).where("grows or shards > 1"), radius)) for n in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _shuffled_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links found where trees are grown: each pair of a value's shards is a group of its own. rows: key, shards, shard and fp."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.select("key", F.greatest("shard", "other").alias("s"), F.least("shard", "other").alias("t"), (F.col("shard") < F.col("other")).alias("left"), "fp")

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for (_, s, t), group in _groups(it, ["key", "s", "t"]):
            tree = BKTree()
            if s != t:
                for is_left, x in group:
                    if is_left:
                        tree.add(x & 0xFFFFFFFFFFFFFFFF)
            for is_left, x in group:
                if not is_left:
                    x &= 0xFFFFFFFFFFFFFFFF
                    for y in tree.near(x, radius):
                        forest.link(x, y)
                    if s == t:
                        tree.add(x)
            if len(forest.parent) > FOREST:
                yield forest.edges()
        yield forest.edges()

    return rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t").mapInPandas(search, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect all within the radius of each other. distinct: fp, each once.

    radius: 4 at most, as two blocks of six are left when four hold a difference. Columns of distinct besides are left out; an
    empty table has no links.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError("blocks guarantee a radius of 4 at most")
    fp = F.col("fp")
    block = lambda at, width: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
    keys = [F.lit(n << 22).bitwiseOR(F.call_function("shiftleft", block(*x), F.lit(y[1]))).bitwiseOR(block(*y)) for n, (x, y) in enumerate(combinations(BLOCKS, 2))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, "key").withColumn("shards", F.ceil(F.col("n") / SHARD).cast("int"))
    rows = cut(rows.select("key", "shards", F.pmod(F.xxhash64("fp", F.lit("shard")), F.col("shards")).cast("int").alias("shard"), "fp"))
    nodes = rows.count()
    passes = 1 if nodes <= TREE_NODES else -(-nodes * 5 // (TREE_NODES * 4))  # shares by hash are even to a few percent, as a shard is small
    return _links_in_passes(rows, radius, passes) if passes <= PASSES else _shuffled_links(rows, radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, fp and component_id, the smallest doc_id that links lead to, itself included.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id are linked but no
    component is named after them, unless all of it is null. Rows that repeat an id each get a row.
    """
    prints = cut(fingerprints(docs, doc_id, text))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = cut(least)
    # only what is linked has a root besides itself, and a component of any size is dealt to SALTS parts
    roots = cut(connected_components(links(least.select("fp"), radius)).select(F.col("node").alias("fp"), "root"))
    linked = roots.join(least, "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    linked = roots.withColumn("salt", salt).join(named, ["root", "salt"]).select("fp", "component_id")
    named = least.join(linked, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
