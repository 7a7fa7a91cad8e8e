import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None,
    "",
    "  \t\n ",
    "One two three. You are an idiot! mail bob@x.example.org or +1 (434) 555-2368, card 4539148803436467 at 10.0.0.7",
    "Ünï cödé don't WE'VE 'tis  twice\n\nΑΣΣ 日本語 １２３ x²  <|endoftext|> end <|startoftext|>",
    "same words here again and again and again and again",
    "same words here again and again and again and again",
    "a" * 70_000,
    "word " * 30_000,
    "the line\nthe line\nthe line\nother |#$%",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None][i % 3], None if i % 4 else 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, TEXTS[3], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = "score spans n_tokens size bucket key fp word held_out taken _bucket _result".split()
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
