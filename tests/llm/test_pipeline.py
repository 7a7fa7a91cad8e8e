"""Pipeline stages on the smallest sample, each against what its operator says of its input."""

import os
from collections import Counter

import public_tokenizers
import pytest
from llm.test_models import base
from llm.test_rows import fingerprint, parts
from tokenizers import Tokenizer

import corpus_pipeline as cp
from watchframe.llm import mixing, pii, queries, simhash
from watchframe.session import materialize

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables absent")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["language", "near_duplicates", "personal_data", "mixing", "encoding"]
    known = materialize(stages["language"](spark, docs, SF_DIR))
    assert known.columns == docs.columns and 0.9 * docs.count() < known.count() <= docs.count()
    single = materialize(stages["near_duplicates"](spark, known, SF_DIR))
    rows = sorted(known.collect(), key=lambda r: r["doc_id"])
    group = parts([fingerprint(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(rows[i]["doc_id"] for i in set(group))
    hidden = materialize(stages["personal_data"](spark, single, SF_DIR))
    assert hidden.columns == docs.columns and hidden.count() == single.count()
    assert not any(base(r["text"]) for r in hidden.collect())
    mixed = materialize(stages["mixing"](spark, hidden, SF_DIR))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.allocation(hidden).filter("taken > 0").collect()}
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter(taken)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = stages["encoding"](spark, mixed, SF_DIR).collect()
    want = Counter((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids)) for r in mixed.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in encoded) == want


def test_overlapping_spans(spark):
    """The union of overlapping spans is hidden, and no more."""
    texts = {
        "at 10.0.0.59 4539148803436467 end": "at <ip> end",
        "x@host.com-4111 1111 1111 1111, ok": "<email>, ok",
        "10.0.0.59 4539148803436467 and 10.0.0.7": "<ip> and <ip>",
    }
    assert all(len({k for k, _, _ in base(t)}) == 2 for t in texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == list(texts.values())


def test_empty_table(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {q.split("_")[0] for q in queries.queries()}


def test_one_row_of_each_component(spark):
    """An id with texts of several components keeps one row of each; repeated rows count as one."""
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue white black"]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (9, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(3, texts[0]), (7, texts[1]), (None, texts[2])], key=repr)


def test_stages_take_odd_rows(spark, odd):
    """Nulls, repeats, very long texts and columns with clashing names go through the whole chain."""
    docs = odd
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF_DIR))
        assert name == "encoding" or docs.columns == odd.columns
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and docs.count() > 0
