"""Sort-means, part codes and tries against plain versions, with nulls, repeated rows, ties and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsight.llm import codebooks, sortmeans, tries, vectors

KIND = "vec_id long, embedding array<float>, label int, cluster int, ints string, part string, row string"


def floors(v, scale):
    return [max(-vectors.LARGEST, min(vectors.LARGEST, math.floor(scale * x))) for x in v]


@pytest.fixture(scope="module")
def embeddings(spark):
    r = random.Random(7)
    middles = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(5)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([m + r.gauss(0, 0.05) for m in middles[i % 5]]), i % 3 if i % 11 else None) for i in range(240)]
    rows += [(500 + i, rows[3][1], 1) for i in range(90)]  # one vector that very many share
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2), (7, f32([0.5] * 64), 0), (None, f32([0.25] * 64), None), (None, f32([-0.0] * 64), 1)]
    rows += [(900, None, 0), (901, f32([0.1] * 63) + [float("nan")], 0), (902, f32([0.1] * 63) + [None], 0), (903, f32([0.1] * 63) + [float("-inf")], 0), (904, f32([0.1] * 63), 0), (905, [], 0), (906, f32([1e30] * 63 + [-1e30]), 0)]
    return rows, spark.createDataFrame([(*x, 1, "a", "b", "c") for x in rows], KIND).repartition(3)


def kept_rows(rows):
    return [(i, v, y) for i, v, y in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]


def plain_means(kept, k=8, rounds=10):
    ints = [floors(v, 1024) for _, v, _ in kept]
    key = lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest() if kept[j][0] is not None else "", ints[j])
    centroids = [ints[j] for j in sorted(range(len(kept)), key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in ints:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[i], strict=True)] if groups[i] else c for i, c in enumerate(centroids)]
    return [near(v) for v in ints], centroids


def test_sort_means_is_lloyd(embeddings):
    rows, df = embeddings
    kept = kept_rows(rows)
    wanted, centroids = plain_means(kept)
    inertia = Counter()
    for d, c in wanted:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    got = sortmeans.cluster_digest(df).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == Counter((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _, _), (d, c) in zip(kept, wanted, strict=True))


def test_sort_means_of_few_and_none(embeddings):
    rows, df = embeddings
    few = df.where("vec_id IN (1, 2, 905)")
    assert sorted((r.vec_id, r.distance) for r in sortmeans.cluster_digest(few).collect()) == [(1, 0), (2, 0)]
    assert sortmeans.cluster_digest(df.where("false")).count() == 0
    assert sortmeans.cluster_digest(df.where("vec_id > 899 AND vec_id < 906")).count() == 0
    with pytest.raises(ValueError):
        sortmeans.sort_means(df, k=0)


def test_a_scan_stops_early_and_keeps_ties():
    r = np.random.default_rng(3)
    table = np.array([[0, 0], [10, 0], [-10, 0], [1000, 0], [1000, 7], [10, 0]], np.int64)
    points = np.vstack([r.integers(-20, 20, (300, 2)), r.integers(990, 1010, (300, 2)), [[5, 0], [-5, 0], [10, 0]]])
    every = ((points[:, None] - table[None]) ** 2).sum(2)
    for start in (np.zeros(len(points), np.int32), every.argmax(1).astype(np.int32), every.argmin(1).astype(np.int32)):
        best, least, computed = sortmeans.nearest(points, start, table, sortmeans.orders(table))
        assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    assert computed < len(points) * 5  # of six, starting where they end


def test_part_codes_are_plain_lloyd(embeddings):
    rows, df = embeddings
    kept = kept_rows(rows)
    ints = [floors(v, 256) for _, v, _ in kept]
    parts = [[v[4 * p : 4 * p + 4] for p in range(16)] for v in ints]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, ints[j]))[:64]
    books = [[parts[j][p] for j in first] for p in range(16)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(2):
        groups = defaultdict(list)
        for v in parts:
            for p, x in enumerate(v):
                groups[p, near(x, p)[1]].append(x)
        books = [[[sum(c) // len(c) for c in zip(*groups[p, i], strict=True)] if groups[p, i] else e for i, e in enumerate(books[p])] for p in range(16)]
    coded = [[near(x, p) for p, x in enumerate(v)] for v in parts]
    errors = [sum(d for d, _ in c) for c in coded]
    by_label = Counter()
    for (_, _, y), e in zip(kept, errors, strict=True):
        by_label[y] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    wanted = Counter((i, "".join(f"{c:02x}" for _, c in cs), e, by_label[y], sha) for (i, _, y), cs, e in zip(kept, coded, errors, strict=True))
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codebooks.code_digest(df).collect()) == wanted


def test_part_codes_of_few_and_none(embeddings):
    _, df = embeddings
    assert codebooks.code_digest(df.where("false")).count() == 0
    few = codebooks.code_digest(df.where("vec_id IN (1, 2)")).collect()
    assert sorted((r.vec_id, r.error, r.code) for r in few) == [(1, 0, "00" * 16), (2, 0, "01" * 16)]
    got, books = codebooks.compress_vectors(df.where("vec_id < 200"), parts=4, entries=3, dimensions=64)
    assert books.shape == (4, 3, 16) and {len(r.code) for r in got.collect()} == {8}


def test_weights_beyond_a_half_are_summed_exactly(spark):
    many = (1 << 33) + 5
    df = spark.createDataFrame([(0, [100, -7], many), (0, [90, 3], 3)], "part int, ints array<int>, weight long")
    got = df.coalesce(1).mapInArrow(codebooks._sums(np.array([[[100, -7]]], np.int64)), "part int, code int, place int, total decimal(38,0)").collect()
    assert {(r.place, int(r.total)) for r in got} == {(0, 100 * many + 270), (1, -7 * many + 9), (-1, many + 3)}


# ---- tries


def plain_owners(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    return Counter(out)


def texts():
    r = random.Random(5)
    words = ["alpha", "beta", "é", "😀", "x" * 40, "a", "ab", "abc"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 30])))) for i in range(400)]
    rows += [(1000 + i, "the same \t\n passage") for i in range(300)] + [(900, "the same passage"), (2000, "the same passage")]
    rows += [(5000, None), (5001, ""), (4999, " "), (5002, "\r\n\x0b\x0c"), (5003, "  "), (None, "only nulls"), (None, "only\nnulls"), (None, "a null among"), (5, "a null among")]
    rows += [(7000, "twice"), (7000, "twice"), (7000, "twice"), (7001, "twice"), (8000, "long " * 300_000), (8001, "long  " * 300_000), (8002, "long " * 300_000 + "er")]
    return rows


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, monkeypatch, weak):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, string string, hash int, kept string").repartition(5)
    hashed = (lambda s: F.octet_length(s) % 2) if weak else tries.content_hash
    got = tries.exact_duplicates(df, hashed=hashed)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain_owners(rows)
    assert tries.exact_duplicates(df.where("false")).count() == 0


def test_rows_that_repeat_are_written_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(tries, "TIES", 7)
    rows = [(3, "again")] * 30 + [(4, "again"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in tries.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain_owners(rows)


def test_ids_may_be_strings(spark):
    df = spark.createDataFrame([("b", "t"), ("a", "t"), ("é", "t"), (None, "t")], "name string, body string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in tries.exact_duplicates(df, "name", "body").collect()} == {("b", "a", 4, False), ("a", "a", 4, True), ("é", "a", 4, False), (None, "a", 4, False)}


def test_a_trie_spills_subtrees_and_loses_nothing():
    r = random.Random(11)
    strings = [bytes(r.choice(b"abc") for _ in range(r.choice([0, 1, 2, 5, 60]))) for _ in range(3000)] + [b"shared " * 50 + bytes([i % 7]) for i in range(200)]
    trie, seen, out = tries.Trie(), defaultdict(list), []
    for i, s in enumerate(strings):
        trie.add(s, (i, 1, 1))
        seen[s].append(i)
        if trie.held > 2000:
            out += trie.spill(1000)
            assert trie.held <= 1000 and trie.held == trie._bytes(trie.root)
    out += trie.spill()
    assert trie.held == 0 and not trie.root.children
    again = tries.Trie()
    for s, least, ties, n in out:
        again.add(s, (least, ties, n))
    assert sorted(again.spill()) == sorted((s, min(ids), 1, len(ids)) for s, ids in seen.items())
    assert len(out) > len(seen)


def test_owners_merge_in_any_order():
    owners = [(5, 1, 1), (None, 2, 2), (3, 1, 4), (3, 2, 2)]
    for _ in range(20):
        random.shuffle(owners)
        one = None
        for o in owners:
            one = tries.merged(one, o)
        assert one == (3, 3, 9)
    assert tries.merged((None, 1, 1), (None, 1, 1)) == (None, 2, 2)
