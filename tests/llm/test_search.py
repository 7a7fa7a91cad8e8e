"""Clustering and ranked search against brute force, on odd tables and on the twins' sample."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import ordered

from watchframe.llm import lexical, topk, vafile
from watchframe.session import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranking(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(UPPER))
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        for rank, (_, _, i, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, score))
    return out


def words(rng, n):
    return " ".join(rng.choice(["Red", "green", "BLUE", "Ünï", "x1", "naïve", "zz"]) + rng.choice(["", ".", "-a", "!"]) for _ in range(n))


@pytest.mark.parametrize("bounds", [None, (2, 5)])
def test_ranking(spark, odd, monkeypatch, bounds):
    if bounds:  # several blocks, small tables, texts in pieces
        monkeypatch.setattr(lexical, "ITEMS", bounds[0])
        monkeypatch.setattr(lexical, "TERMS", bounds[1])
        monkeypatch.setattr(lexical, "ELEMENTS", 7)
    rng = random.Random(3)
    items = [(1, "same words the LINE"), (2, None), (3, ""), (None, "word 日本語 twice"), (1, "again idiot"), (5, "absent"), (6, "one-two three"), (6, "one-two three")]
    table = spark.createDataFrame(items, "item_id int, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert ordered(lexical.ranked(odd, table, 3).collect()) == ordered(brute_ranking(docs, items, 3))
    rows = [(rng.randint(0, 99), words(rng, rng.choice([0, 1, 2, 3, 3, 3, 9]))) for _ in range(300)] + [(200 + i, "red green") for i in range(60)]
    items = [(i, words(rng, 4)) for i in range(9)]
    got = lexical.ranked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string"), 20)
    assert ordered(got.collect()) == ordered(brute_ranking(rows, items, 20))


def test_terms_in_pieces(monkeypatch):
    text = ("ab Cd,é" * 5 + "x" * 40 + " y ").encode()
    whole = [t for p in lexical.terms(text) for t in p]
    monkeypatch.setattr(lexical, "PIECE", 9)
    assert [t for p in lexical.terms(text) for t in p] == whole
    assert [t for p in lexical.terms(b"") for t in p] == []


def test_ranking_of_nothing(spark, odd, none):
    table = spark.createDataFrame([(1, "same")], "item_id long, text string")
    for docs, items in ((none, table), (odd, table.limit(0)), (odd, spark.createDataFrame([(1, "absent")], "item_id long, text string"))):
        found = lexical.ranked(docs, items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_large_scores_stay_whole():
    vocabulary = lexical.Vocabulary([{b"a", b"b"}, {b"b"}])
    scorer = lexical.Scorer(vocabulary, np.array([1 << 40, 1 << 41]))
    assert not scorer.exact_in_float
    n, bag = vocabulary.bag(b"a b b c")
    want = [(1 << 40) * (10**9 // 2400) + (1 << 41) * (2 * 10**9 // 3400), (1 << 41) * (2 * 10**9 // 3400)]
    assert n == 4 and scorer.scores([bag], np.array([70])).tolist() == [want]


def brute_clusters(rows, k, rounds, width):
    """(id, cluster, distance, inertia of the cluster, inertia, hash)"""
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(fine, key=lambda r: (name(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in fine]
        groups = {j: [v for (_, v), a in zip(fine, at) if a == j] for j in set(at)}
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in fine]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


@pytest.mark.parametrize("width", [4, 5])
def test_clusters(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.choice([rng.gauss(0, 0.1), round(rng.gauss(0, 1), 1)]) for _ in range(width)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [rows[3], rows[3], (None, rows[4][1]), (None, [0.0] * width)]
    rows += [(-1, None), (-2, []), (-3, [1.0]), (-4, [None] * width), (-5, [math.nan] * width), (-6, [math.inf] * width)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    for k in (1, 7, 40):
        got = vafile.clusters(df, k, 3, width)
        assert ordered(got.collect()) == ordered(brute_clusters(rows, k, 3, width))
    few = df.filter("vec_id < 3")
    assert ordered(vafile.clusters(few, 40, 2, width).collect()) == ordered(brute_clusters([r for r in rows if r[0] is not None and r[0] < 3], 40, 2, width))
    assert vafile.clusters(df.filter("vec_id = -1"), 3, 2, width).count() == 0
    with pytest.raises(ValueError):
        vafile.clusters(spark.createDataFrame([(1, [1e30] * width)], "vec_id long, embedding array<double>"), 1, 1, width)


def test_full_vectors_are_taken_where_intervals_overlap(spark):
    """Well separated groups are told apart by their cells alone, after the first round."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-40, 40, (5, 16)) * 8.0
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.01, 16)).tolist()) for i in range(500)]
    kept = vafile.kept(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 16, 256)
    edges, low, high = vafile.cell_bounds(kept, 16)
    stored = materialize(vafile.va_file(kept, edges), "cells")
    first = np.floor(256 * centres).astype(np.int64)
    centroids, taken = vafile.fitted(stored, first, low, high, 3)
    assert taken == [500, 0, 0] and np.abs(centroids - first).max() <= 3


def test_a_full_block_of_queries_fits():
    """4,096 queries of 64 numbers against as many vectors: every kind of pass stays under 200 MB."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-1000, 1000, (topk.ROWS, 64))
    block = topk.Block(np.arange(topk.QUERIES), vectors[: topk.QUERIES])
    stored = pa.RecordBatch.from_arrays([pa.array([np.arange(topk.ROWS).tobytes()]), pa.array([64]), pa.array([vectors.tobytes()])], names=["ids", "width", "matrix"])
    tracemalloc.start()
    found = list(block.ranges([stored]))[0]
    block.low, block.bits = found.column(1).to_numpy().copy(), np.full(topk.QUERIES, 40)
    block.wanted[:] = 10
    assert sum(b.column(2).to_numpy().sum() for b in block.histogram([stored])) == topk.QUERIES * (topk.ROWS - 1)
    block.score[:], block.last[:] = 10**7, -1
    assert sum(b.num_rows for b in block.chosen([stored])) < topk.QUERIES * topk.ROWS / 10
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
