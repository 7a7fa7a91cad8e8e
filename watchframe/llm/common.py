"""Helpers that the operators of this subpackage share."""

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space. `bytes.split()` gives the same runs.
WORD = r"[^\x20\x09-\x0D]+"
#: Input bytes for which one bucket of documents is meant.
BUCKET_BYTES = 16 << 20


#: Rows in an Arrow batch: texts may be long, and a task holds a batch in the JVM and in Python.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let this session send texts to Python in batches of BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Leave the worker as it was, as it is used again: with its collector on and freed memory handed back."""
    gc.unfreeze()
    gc.enable()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_column(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str) -> Callable[..., Column]:
    """An Arrow column function; `make` runs once per task and gives the function over batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            yield f(batch)
        give_back()

    return F.arrow_udf(run, returnType=returns)


def add_columns(docs: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """`docs` with the fields of a struct column; a column of the same name is replaced."""
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    held = "_result"
    while held in docs.columns:
        held += "_"
    wide = docs.select(*[F.col(f"`{c}`") for c in kept], result.alias(held))
    return wide.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{held}.{n}").alias(n) for n in names])


def raw_texts(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of items whose sizes sum to about `limit`, one item at least."""
    a, total = 0, 0
    for b, n in enumerate(sizes):
        if b > a and total + n > limit:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def struct_array(columns: dict[str, pa.Array | np.ndarray | list]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def partitions(df: DataFrame) -> int:
    """Tasks for a shuffle of `df`: the session's number, or more when the input is larger than that many buckets."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, math.ceil(size / BUCKET_BYTES)) if size < 1 << 55 else least


def text_buckets(docs: DataFrame, text: str, size: int) -> int:
    """Buckets of about `size` bytes of text, as many as shuffles have partitions at least. Reads the texts once."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // size))


def crc(key: str | Column) -> Column:
    """crc32 of the key as text; a null key counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def first_rows(df: DataFrame, order: list[Column | str], most: int, count: int) -> DataFrame:
    """The first `most` of about twice as many rows that a hash of all columns picks from `count`.

    Without that cut each task would send its own `most` rows to the driver, whatever their number.
    """
    picked = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30)) < int(min(1.0, (2 * most + 1000) / max(count, 1)) * (1 << 30))
    return df.filter(picked).orderBy(*order).limit(most)
