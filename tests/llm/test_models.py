"""Models: gradients, exact parts against brute force, held-out accuracy on the sample tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import ordered, texts_of
from pyspark.sql import functions as F

from watchframe.llm import language, ngram, pii, toxicity

SF_DIR = "/root/testdata/sf0.01"
sample_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables absent")


def slope(f, x, i, e=1e-4):
    old = x[i]
    x[i] = old + e
    up = f()
    x[i] = old - e
    down = f()
    x[i] = old
    return (up - down) / (2 * e)


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1), (500, 500), (900, 10**9), (700, 10**14)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, top + 1, n))
    e = ngram.EliasFano(values, top).stored()
    assert (e[np.arange(len(values))] == values.astype(np.uint64)).all() if len(values) else e.n == 0
    x = np.concatenate([values, rng.integers(0, top + 1, 500)])
    place, hit = e.successor(x, np.zeros(len(x), np.int64), np.full(len(x), len(values)))
    assert (place == np.searchsorted(values, x)).all() and (hit == np.isin(x, values)).all()


def test_lm(odd, none):
    rows = texts_of(odd)
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)})), 0] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    one, two = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip([1, *t], t, strict=False))
    total, kinds, n, v = Counter(), Counter(), sum(one.values()), len(one)
    for (c, _), k in two.items():
        total[c] += k
        kinds[c] += 1
    want = {}
    for (d, t), words, h in zip(rows, tokens, held, strict=True):
        base = [(one[w] + 1) / (n + v + 1) for w in words]
        weight = [0.75 * kinds[c] / total[c] if total[c] else 1 for c in [1, *words[:-1]]]
        seen = [max(two[c, w] - 0.75, 0) / total[c] if total[c] else 0 for c, w in zip([1, *words], words, strict=False)]
        want[d, t] = h, len(words), sum(one[w] > 0 for w in words), sum(map(math.log10, base)), sum(math.log10(s + a * b) for s, a, b in zip(seen, weight, base, strict=True))
    got = ngram.perplexity_scores(odd).collect()
    assert len(got) == len(rows) and all(r["train_tokens"] == n for r in got)
    exact = sorted((repr(d), *x[:3], round(x[3], 6)) for (d, _), x in [((d, t), want[d, t]) for d, t in rows])
    assert sorted((repr(r[0]), r[1], r[2], r[3], round(r["base_score"], 6)) for r in got) == exact
    scores = sorted((repr(d), want[d, t][4]) for d, t in rows)
    for (_, a), (_, b) in zip(sorted((repr(r[0]), r["score"]) for r in got), scores, strict=True):
        assert abs(a - b) <= 0.03 * max(1, abs(b))
    assert ngram.perplexity_scores(none).count() == 0


def test_language_gradients():
    net = language.Network.fresh(["a", "b"])
    net = language.Network(net.languages, {k: v.astype(np.float64) for k, v in net.parameters.items()})
    codes, label = np.random.default_rng(1).integers(97, 122, (7, 3)).astype(np.uint8), np.array([0, 1, 1])
    grads = net.learn(codes, label)
    loss = lambda: -np.log(net.probabilities(codes)[0][:, np.arange(3), label]).mean()
    for k, g in grads.items():
        i = tuple(np.argwhere(np.abs(g) > 1e-5)[0])
        assert abs(g[i] - slope(loss, net.parameters[k], i)) < 1e-4


@sample_tables
def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language.language(docs).filter("held_out AND n_chars > 100")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count() > 0
    rows = language.language(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == "und" for r in rows if not re.search(r"\w", r["text"] or ""))
    assert language.language(none).count() == 0


def test_rare_language_is_sampled(spark):
    """Three rows among 60,000 are learned from, and predicted."""
    rare = F.col("id").isin(7, 20_011, 41_234)
    text = F.when(rare, F.lit("щука жук и чай " * 20)).otherwise(F.concat(F.lit("the plain words of row "), F.col("id").cast("string")))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(rare, "ru").otherwise("en").alias("lang"))
    texts, labels = language.sample(docs, "doc_id", "text", "lang")
    assert labels.count("ru") == 3 and labels.count("en") == language.SAMPLE
    network = language.train(texts, labels)
    assert language.identify(docs.filter(rare), network).filter("lang_pred = 'ru'").count() == 3


def test_tagger_gradients():
    tagger, rng = pii.Tagger.fresh(), np.random.default_rng(0)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    codes, tags = rng.integers(0, pii.CLASSES, (6, 3)).astype(np.uint8), rng.integers(0, pii.TAGS, (6, 3)).astype(np.uint8)
    grads = tagger.learn(codes, tags)[1]
    for k, g in grads.items():
        i = tuple(np.argwhere(np.abs(g) > 1e-5)[0])
        assert abs(g[i] - slope(lambda: tagger.learn(codes, tags)[0], tagger.p[k], i)) < 1e-5


def test_viterbi():
    tagger, rng = pii.Tagger.fresh(3), np.random.default_rng(0)
    tagger.p["next"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    codes = rng.integers(0, pii.CLASSES, (4, 2)).astype(np.uint8)
    s, best = tagger.scores(codes)[0], tagger.decode(codes)
    for b in range(2):
        value = lambda path: sum(s[t, b, k] for t, k in enumerate(path)) + sum(tagger.p["next"][i, j] for i, j in zip(path, path[1:], strict=False))  # noqa: B023, E731
        every = max(np.ndindex(*[pii.TAGS] * 4), key=value)
        assert tuple(best[:, b]) == every


def base(text):
    def good(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0

    digits = lambda m: [int(c) for c in m if c.isdigit()]
    find = lambda p: list(re.finditer(p, text))
    out = [(0, *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
    out += [(1, *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m[0])) <= 19 and good(digits(m[0]))]
    return out + [(3, *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = np.random.default_rng(0)
    bits = [*"ab@@..--++0123  ()", "a@b.c", "1.2.3.4", "4539148803436467", "+1 555 ", "0000000001.2.3.4"]
    for _ in range(5000):
        text = "".join(rng.choice(bits, rng.integers(0, 40)))
        assert pii.base_spans(text) == base(text)
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


@sample_tables
def test_pii(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "my card 4539.1488.0343.6467 yes"), (-2, "ring +1 (826) 555-4081 190. now"), (-3, "born 2023-11-05, paid 1200.50")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(docs.unionByName(more)).collect()}
    for r in rows.values():
        assert [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if s["base"]] == base(r["text"])
    assert [r["kind"] for r in rows[-1]["spans"]] == ["card"] and not rows[-3]["spans"]
    assert sum(not s["base"] for r in rows.values() for s in r["spans"]) < 10
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(odd).collect()}
    assert hidden[3].endswith("mail <email> or <phone>, card <card> at <ip>") and hidden[7] == "a" * 70_000
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).filter("spans = 'own spans'").count() == odd.count()
    assert pii.find(none).count() == 0


@sample_tables
def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL")
    right = found.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).collect()
    assert dict(map(tuple, right))[0] > 0.97 and dict(map(tuple, right))[1] > 0.75
    few = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    for known in (few, few.limit(0)):
        rows = toxicity.toxicity(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity(none, few).count() == 0


def test_sentences_at_fault():
    texts = [b"fine words here. you utter clown." if i % 2 else b"fine words here. all is well." for i in range(60)]
    model = toxicity.train(texts, np.array([i % 2 == 1 for i in range(60)]))
    score, found = model.score("été bien. You utter CLOWN. fine words".encode())
    assert score > 0.5 and [(a, b) for a, b, _ in found] == [(10, 25)]
    assert model.score(b"")[0] == 0


@sample_tables
def test_long_clean_texts(spark):
    """Held-out clean texts, laid end to end, are clean at any place of some thousand sentences."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(*toxicity.sample(docs, labels.filter(crc != 0), "doc_id", "text", "toxic"))
    clean = docs.join(labels.filter((crc == 0) & (F.col("toxic") == 0)), "doc_id").orderBy("doc_id").select("text").collect()
    scores = [(r["text"].encode(), model.score(r["text"].encode())[0]) for r in clean if r["text"]]
    clean = [t for t, p in scores if p < 0.5]
    assert len(clean) > 0.97 * len(scores)
    for least in (1000, 3000):
        run, n = [], 0
        for text in clean:
            run.append(text)
            n += len(toxicity.sentences(text))
            if n >= least:
                assert model.score(b"\n".join(run))[0] < 0.5
                run, n = [], 0


def test_long_labelled_texts_are_learned_from(spark):
    """A label's texts are picked by hash whatever their length, and one that is longer than the bound is whole."""
    long = "fine words here. " * 5000
    rows = [(i, long if i % 4 == 0 else "you utter clown." if i % 2 else "all is well.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, toxic = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    assert sorted(texts) == sorted(t.encode() for _, t in rows) and toxic.sum() == 20
    assert toxicity.train(texts, toxic).score(long.encode() * 4)[0] < 0.5


def test_ordered_helper():
    assert ordered([(2,), (1,)]) == [(1,), (2,)]


@sample_tables
def test_pii_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = pii.op9_personal_data(spark, SF_DIR).collect()
    assert len(rows) == len(docs) and sum(r["n_ip"] for r in rows) > 0
    for r in rows:
        found = base(docs[r["doc_id"]])
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in found]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in found) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r["spans"].split(",")))
