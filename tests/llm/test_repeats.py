"""Repeated strings against brute force."""

import hashlib
import os
import random
from collections import Counter

import pytest
from llm.conftest import ordered, texts_of

from watchframe.llm import repeats
from watchframe.llm.common import read_documents

SF_DIR = "/root/testdata/sf0.001"


def brute(texts, length):
    """Spans of each text: runs of bytes covered by a string that starts at two places."""
    places = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for p in range(len(t) - length + 1):
            if places[t[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out.append([tuple(s) for s in spans])
    return out


def kept(text, spans):
    edges = [0, *[x for s in spans for x in s], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def same(docs, length, **given):
    rows = [(i, t.encode()) for i, t in texts_of(docs)]
    want = [(i, len(t), s, kept(t, s)) for (i, t), s in zip(rows, brute([t for _, t in rows], length), strict=True)]
    got = repeats.without_repeats(docs, length=length, **given).collect()
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got]
    assert ordered(got) == ordered(want)
    return want


def test_odd_rows(odd, none):
    same(odd, 20)
    same(odd, 400)
    assert repeats.without_repeats(none).count() == 0


@pytest.mark.parametrize("length", [5, 12, 13])
def test_passages(spark, monkeypatch, length):
    """Copies, near copies, passages at the edges of texts, periodic texts, in segments shorter than they are."""
    monkeypatch.setattr(repeats, "SEGMENT", 40)
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    passages = [text(n) for n in (length - 1, length, length + 1, 3 * length, 9 * length)]
    texts = [text(rng.randint(0, 4 * length)) + rng.choice(passages) + text(rng.randint(0, 3 * length)) for _ in range(60)]
    for _ in range(20):
        near = list(passages[4])
        near[rng.randrange(len(near))] = "#"
        texts.append("".join(near))
    texts += [passages[4]] * 5 + ["ab" * 60, "ab" * 50 + "c", "a" * 90, "", None, "a" * length, "q" * length]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = same(docs, length)
    assert any(s for _, _, s, _ in want) and any(not s for _, n, s, _ in want if n)
    same(docs, length, bucket=200)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables absent")
def test_registered_query(spark):
    docs = read_documents(spark, SF_DIR)
    rows = [(i, t.encode()) for i, t in texts_of(docs)]
    want = []
    for (i, t), spans in zip(rows, brute([t for _, t in rows], 400), strict=True):
        want.append((i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(t, spans)).hexdigest()))
    found = repeats.op12_repeats(spark, SF_DIR)
    assert found.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert ordered(found.collect()) == ordered(want) and any(w[2] for w in want)
