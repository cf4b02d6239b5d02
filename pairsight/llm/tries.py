"""Exact deduplication by Patricia tries that own texts.

Texts are byte strings after white space is put to one space. A trie keeps whole strings in compressed edges; the node at
which a string ends holds the smallest identifier seen for it, how many rows have that identifier, and how many rows
there are. Every task first puts its own rows into a trie, so however many copies a text has, one string a task goes on;
when a trie holds more than HELD_BYTES its heaviest subtrees are spilled, that is handed on as they are, to meet what
other tasks hand on. Then strings are partitioned by length and content hash and, in that order, put into tries again:
once a length and hash are past, nothing can join their subtree and it is spilled with its owners.

Rows find their owner by length and hash. Where a trie has shown that strings of a length and hash differ, rows find it
by their bytes instead, so no two texts are ever held equal because hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import cut

#: Runs of white space other than a single space.
SPACES = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
#: Bytes of strings that a task's trie holds before it spills subtrees.
HELD_BYTES = 32 << 20
#: Bytes and rows that a task hands on at a time, about.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 2000
#: Rows with the same smallest identifier and text that one task writes at most.
TIES = 1 << 16


class Node:
    """What lies under an edge: children by their first byte, and, where a string ends, its owner: smallest identifier (None is the largest), rows with it, rows."""

    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes, owner: tuple | None = None):
        self.edge, self.children, self.owner = edge, {}, owner


def merged(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    first = a if b[0] is None or a[0] is not None and a[0] < b[0] else b
    return first[0], first[1], a[2] + b[2]


def common_length(a: bytes, b: bytes, start: int) -> int:
    """How many first bytes a has in common with b from a place on; whole stretches are compared, halved around the first difference."""
    low, high = 0, min(len(a), len(b) - start)
    if a[:high] == b[start : start + high]:
        return high
    while low + 1 < high:  # the first low bytes agree, the first high ones don't
        half = (low + high) // 2
        if a[low:half] == b[start + low : start + half]:
            low = half
        else:
            high = half
    return low


class Trie:
    """A compressed radix trie over whole byte strings."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def add(self, string: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while at < len(string):
            child = node.children.get(string[at])
            if child is None:
                node.children[string[at]] = Node(string[at:], owner)
                self.held += len(string) - at
                return
            n = common_length(child.edge, string, at)
            if n < len(child.edge):
                fork = Node(child.edge[:n])
                node.children[string[at]] = fork
                child.edge = child.edge[n:]
                fork.children[child.edge[0]] = child
                child = fork
            node, at = child, at + n
        node.owner = merged(node.owner, owner)

    def _under(self, node: Node, above: bytes) -> Iterator[tuple]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            string = above + node.edge
            if node.owner is not None:
                yield string, *node.owner
            stack += [(child, string) for child in node.children.values()]

    def _bytes(self, node: Node) -> int:
        stack, n = [node], 0
        while stack:
            node = stack.pop()
            n += len(node.edge)
            stack += node.children.values()
        return n

    def spill(self, most: int = -1) -> Iterator[tuple]:
        """(string, identifier, rows with it, rows) under the heaviest subtrees, which leave the trie, until it holds ``most`` bytes; all by default."""
        if self.root.owner is not None:
            yield b"", *self.root.owner
            self.root.owner = None
        for n, first in sorted(((self._bytes(c), b) for b, c in self.root.children.items()), reverse=True):
            if self.held <= most:
                break
            yield from self._under(self.root.children.pop(first), b"")
            self.held -= n


def normalised(text: Column) -> Column:
    """The bytes by which texts are compared. Null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ").cast("binary")


def content_hash(string: Column) -> Column:
    return F.xxhash64(string)


def _sliced(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``at`` is the column with the long strings."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[at] or b"")
        if size >= SLICE_BYTES or len(some) >= SLICE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
    """String and owner of each row."""
    ids, ties, rows = (batch.column(c).to_pylist() for c in ("id", "ties", "rows"))
    return ((string.as_py(), owner) for string, owner in zip(batch.column("string"), zip(ids, ties, rows, strict=True), strict=True))


def own(strings: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The owners of strings: n_bytes, hash, different (how many strings have that length and hash), keep_id, ties (rows of the string with that identifier), group_size, text_sha256, and the string itself where several have its length and hash.

    strings: string, binary, and id, of a type that has an order in Python and in Spark alike: numbers, strings, dates.
    """
    kind = strings.schema["id"].dataType
    names = ["string", "id", "ties", "rows"]
    counted = strings.select("string", "id", F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("rows"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, types = Trie(), []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = batch.schema.types
                for row in _rows(batch):
                    trie.add(*row)
                    if trie.held > HELD_BYTES:
                        yield from trie.spill(HELD_BYTES // 2)
            yield from trie.spill()

        yield from _sliced(rows(), names, types, 0)

    sent = counted.mapInArrow(combine, counted.schema).select(F.octet_length("string").alias("n_bytes"), hashed(F.col("string")).alias("hash"), *names)
    sent = sent.repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    out = StructType([StructField("n_bytes", IntegerType()), StructField("hash", sent.schema["hash"].dataType), StructField("different", IntegerType()), StructField("keep_id", kind), StructField("ties", LongType()), StructField("group_size", LongType()), StructField("text_sha256", StringType()), StructField("string", BinaryType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, types = Trie(), []

        def owners(key: tuple) -> list[tuple]:
            found = list(trie.spill())
            return [(*key, len(found), least, ties, n, hashlib.sha256(string).hexdigest(), string if len(found) > 1 else None) for string, least, ties, n in found]

        def rows() -> Iterator[tuple]:
            before = None
            for batch in batches:
                size, code, string, kind, count, _ = batch.schema.types
                types[:] = size, code, pa.int32(), kind, count, count, pa.string(), string
                for key, row in zip(zip(batch.column("n_bytes").to_pylist(), batch.column("hash").to_pylist(), strict=True), _rows(batch), strict=True):
                    if before is not None and key != before:
                        yield from owners(before)
                    before = key
                    trie.add(*row)
            if before is not None:
                yield from owners(before)

        yield from _sliced(rows(), out.names, types, 7)

    return sent.mapInArrow(settle, out)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when they are after runs of white space become a space; null is empty. Of equal texts the row with the
    smallest doc_id stays, null ids last; of rows that repeat that id as well one is kept and the others aren't. Texts may
    have any length; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("string"))
    owners = cut(own(rows.select("string", F.col("doc_id").alias("id")), hashed))
    keyed = rows.select("doc_id", F.octet_length("string").alias("n_bytes"), hashed(F.col("string")).alias("hash"), "string")
    key = ["n_bytes", "hash"]
    found = keyed.drop("string").join(owners.where("different = 1").drop("string"), key)
    if not owners.where("different > 1").isEmpty():
        several = owners.where("different > 1")
        found = found.unionByName(keyed.join(several, [*key, "string"]).drop("string"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = found.where((F.col("ties") == 1) | ~kept).withColumn("kept", kept).select(columns)
    # rows that repeat the smallest id are alike: as many are written, spread over tasks, and the first of them is kept
    tied = owners.where("ties > 1").select("keep_id", "group_size", "text_sha256", "ties", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ties") - 1, F.lit(TIES).cast("long"))).alias("from"))
    tied = tied.repartition("text_sha256", "from").withColumn("n", F.explode(F.sequence("from", F.least(F.col("from") + TIES, "ties") - 1)))
    return found.unionByName(tied.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("n") == 0).alias("kept"), "text_sha256"))
