"""A corpus from raw documents: known language, one of each group of near-duplicates, personal data hidden, sources
mixed to target weights, and BPE ids. Each stage is stored before the next one reads it.

Nulls, repeats and empty tables: a null or letterless text has no known language and goes; repeated rows are
near-duplicates of each other; a null source is a source; an empty table stays empty through all stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm import bpe, language, mixing, pii, simhash
from watchframe.llm.common import read_documents, small_batches
from watchframe.session import materialize

#: A text whose best language has a lower mean probability has no clear language.
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts of no clear language."""
    small_batches(spark)
    found = language.language(docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang"))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of linked fingerprints."""
    small_batches(spark)
    return simhash.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span; n_chars follows the text."""
    small_batches(spark)
    hidden = pii.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never."""
    return mixing.mixed(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers."""
    small_batches(spark)
    found = bpe.encode(docs, digest=True)
    tokens = F.expr("length(ids) div 4").cast("long").alias("n_tokens")
    return found.select("doc_id", tokens, "ids", F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode_text),
]

#: SQL has no network, XXH64 or tokenizer; tests/llm/test_pipeline.py checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
