"""Token counts and BPE encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import ordered, texts_of
from tokenizers import Tokenizer

from watchframe.llm import bpe, token_counts

BITS = ["a", "s", "t", "re", "'", " ", "  ", "\n", "é", "é", "漢", "１", "23", "!", "<|endoftext|>", "ll", "v", "L", "　", "\x1c", "\x85", "²", "🙂", "don't", "Σ", "İ", "<|"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(0)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(3000)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("chunk", [2, 7, 512])
def test_counts_do_not_depend_on_chunks(strings, chunk):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        counter = token_counts.Counter(f.read(), token_counts.code_point_classes().tobytes(), chunk)
    want = [len(x.ids) for x in library("byte_bpe_50k.json").encode_batch(strings, add_special_tokens=False)]
    assert counter.of_texts(strings).tolist() == want


def test_state_maps_compose():
    table, emits = token_counts.split_transducer()
    rng = np.random.default_rng(0)
    stream = rng.integers(0, 12, 1000).astype(np.uint8)
    whole = token_counts.marks(stream, table, emits, 1000)
    assert all((token_counts.marks(stream, table, emits, n) == whole).all() for n in (1, 3, 64))


def test_count_tokens(odd, none):
    tok = library("byte_bpe_50k.json")
    rows = token_counts.count_tokens(odd)
    assert set(odd.columns) <= set(rows.columns) and rows.filter("spans = 'own spans'").count() == odd.count()
    want = [(d, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for d, t in texts_of(odd)]
    assert ordered(rows.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == ordered(want)
    assert token_counts.count_tokens(none).count() == 0


def test_splitter_and_encoder(strings):
    name = "word_bpe_49k.json"
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    split, tok = bpe.Splitter(bpe.word_patterns(), ["<|startoftext|>", "<|endoftext|>"]), library(name)
    for text in strings:
        got = np.frombuffer(b"".join(encoder(w) for w in split(text)), "<u4").tolist()
        assert got == tok.encode(text, add_special_tokens=False).ids


def test_encode(odd, none):
    tok = library("word_bpe_49k.json")
    want = []
    for d, t in texts_of(odd):
        ids = tok.encode(t, add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want.append((d, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded))
    got = [(r["doc_id"], hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in bpe.encode(odd).collect()]
    assert ordered(got) == ordered(want)
    assert bpe.encode(none).count() == 0
