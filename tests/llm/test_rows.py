"""Mixing, top-k, near-duplicates and statistics against DuckDB and brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import xxhash
from llm.conftest import SCHEMA, ordered, texts_of
from pyspark.sql import functions as F

from watchframe.llm import decision_list, mixing, simhash, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def twin(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()


def test_mixing(spark, odd, none):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), None, rng.choice(["a", "b", "c", None, "é"]), None) for i in range(300)]
    for docs in (odd, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "x y z", None, "s", 1)], SCHEMA)):
        frame = docs.select("doc_id", "text", "source").toArrow()
        want = twin(mixing.ORACLE_SQL["op7_mixing"], documents=frame)
        got = mixing.allocation(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert ordered([(*r[:3], round(r[3], 6), r[4]) for r in got]) == ordered([(*r[:3], round(r[3], 6), r[4]) for r in want])
    assert mixing.allocation(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_rows(odd):
    taken = mixing.allocation(odd)
    rounds = taken.filter("taken > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and got.count() == rounds
    assert got.filter("size = 'own size'").count() == rounds


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(900)]
    vectors += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # ties
    vectors += [(7, [0.5, 0.5, 0.5, 0.5])] * 30 + [(100, [0.1, 0.2, 0.3, 0.4])]  # repeated ids, also of a query
    odd = [(200, None), (None, [1.0] * 4), (300, [1.0, None, 1.0, 1.0]), (400, [float("nan")] * 4), (9, [0.25])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("own"))
    rows = [(i, np.floor(1024 * np.array([*v, 0, 0, 0][:4])).astype(int)) for i, v in vectors + odd[-1:]]
    want = []
    for q, a in rows:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in rows if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for size in (4096, 3):
        assert ordered(topk.top_k(df, rows=size).collect()) == ordered(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 1000 or vec_id = 1001")).count() == 1


def fingerprint(text):
    words = WORDS.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = Counter(xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles)
    return sum(1 << j for j in range(64) if 2 * sum(n for h, n in hashes.items() if h >> j & 1) > len(shingles))


def parts(values):
    """Smallest index of each value's component."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(values))]


def test_near_duplicates(odd, none):
    rows = sorted(texts_of(odd), key=lambda r: (r[0] is None, r[0]))
    prints = [fingerprint(t) for _, t in rows]
    want = [(d, f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, parts(prints), strict=True)]
    assert ordered(simhash.near_duplicates(odd).collect()) == ordered(want)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for _, _, c in want})
    assert simhash.keep_one(none).count() == 0


def test_masks_cover_every_pair():
    masks, rng = simhash.masks(), random.Random(0)
    for _ in range(20_000):
        bits = sum(1 << j for j in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & bits == 0 for m in masks)


def test_links_of_crowded_buckets(spark):
    """Chains and dense groups, through the search and through shared neighbours."""
    rng, values = random.Random(3), set()
    for _ in range(5):
        x = rng.getrandbits(64)
        for _ in range(60):
            values.add(x)
            for j in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                x ^= 1 << j
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    want = parts(values)
    for brute in (4096, 2):
        root = {r["fp"]: r["root"] for r in simhash.roots(simhash.links(df, brute)).collect()}
        got = [root.get(simhash._signed(v), simhash._signed(v)) for v in values]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def counts(text):
    words = WORDS.findall(text)
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 0, 0), (5, None, 1), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = decision_list.quality(odd, labels).collect()
    want = [(d, *counts(t)) for d, t in texts_of(odd)]
    assert ordered([r[:6] for r in got]) == ordered(want)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert decision_list.quality(none, labels.limit(0)).count() == 0


def test_many_kinds_of_words():
    codes = np.random.default_rng(0).integers(0, 9, 400)
    assert decision_list.repeated_words(codes, 9) == decision_list.repeated_words(codes, 1 << 21)


def test_learned_list(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["c"] > 0.9)
    rules = decision_list.learn(x, bad, rng.random(3000) < 0.3)
    found = np.any([r.covers(x) for r in rules], axis=0)
    assert (found == bad).mean() > 0.98
    assert decision_list.learn(x, np.zeros(3000, bool), rng.random(3000) < 0.3) == []
