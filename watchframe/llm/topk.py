"""Exact top-k search by distributed histogram selection.

Every query meets every vector, one bounded block of queries at a time. Nothing is sorted: each pass scores all
vectors anew and adds up, per query, a histogram of the scores inside its current interval; the bin that holds the
k-th value becomes the next interval, until a single value is left. Where more vectors share that value than are
wanted, the same narrowing goes on over their ids. A last pass keeps what lies above.

What goes to tasks and back to the driver is bounded by a block: QUERIES rows, or ELEMENTS numbers.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchframe.session import materialize

K, EVERY, SCALE = 10, 100, 1024
#: Queries and numbers in one block; vectors in one stored row; bits by which a pass narrows.
QUERIES, ELEMENTS, ROWS, STEP = 4096, 1 << 21, 4096, 7
#: Scores that a task holds at once; it makes a few more arrays of that length from them.
SCORES = 1 << 20


def _matrix(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their components as floor(scale * x), short ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.ones(len(sizes), bool) if not vectors.null_count else vectors.is_valid().to_numpy(zero_copy_only=False)
    good &= np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fine = good[row]
    out[row[fine], place[fine]] = np.floor(scale * values[fine]).astype(np.int64)
    return good, out[good]


def _stored(ids: np.ndarray, matrix: np.ndarray, rows: int):
    for a in range(0, len(ids), rows):
        part = matrix[a : a + rows]
        yield ids[a : a + rows].tobytes(), part.shape[1], np.ascontiguousarray(part).tobytes()


def _blocks(vectors: DataFrame, key: str, column: str, scale: int, rows: int) -> DataFrame:
    """Vectors that take part, many in a row: (ids, width, matrix)."""

    def pack(batches):
        for batch in batches:
            good, matrix = _matrix(batch.column(1), scale)
            out = list(_stored(batch.column(0).to_numpy(zero_copy_only=False)[good].astype(np.int64), matrix, rows))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["ids", "width", "matrix"])

    named = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").alias("v")).filter("id IS NOT NULL")
    return named.mapInArrow(pack, "ids binary, width int, matrix binary")


class Block:
    """A block of queries and how far each one's k-th place is narrowed."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        n = len(ids)
        self.low, self.bits = np.zeros(n, np.int64), np.zeros(n, np.int64)  # interval of scores, or of ids
        self.by_id = np.zeros(n, bool)
        self.score, self.last = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
        self.wanted, self.done = np.zeros(n, np.int64), np.zeros(n, bool)

    def scores(self, width: int, matrix: np.ndarray) -> np.ndarray:
        """Exact inner products: in floating point where every partial sum is a whole number below 2^53."""
        n = min(width, self.matrix.shape[1])
        a, b = self.matrix[:, :n], matrix[:, :n]
        top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(n, 1)
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ b.T

    def meet(self, batches):
        """Ids and scores of every other vector, for stored rows one after another."""
        for batch in batches:
            for ids, width, matrix in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(matrix, np.int64).reshape(len(ids), width)
                step = max(1, SCORES // max(1, len(self.ids)))
                for a in range(0, len(ids), step):
                    part = ids[a : a + step]
                    yield part, self.scores(width, vectors[a : a + step]), part[None, :] != self.ids[:, None]

    def ranges(self, batches):
        low, high = np.full(len(self.ids), np.iinfo(np.int64).max), np.full(len(self.ids), np.iinfo(np.int64).min)
        count, id_low, id_high = np.zeros(len(self.ids), np.int64), np.iinfo(np.int64).max, np.iinfo(np.int64).min
        for ids, scores, other in self.meet(batches):
            low = np.minimum(low, np.where(other, scores, np.iinfo(np.int64).max).min(axis=1))
            high = np.maximum(high, np.where(other, scores, np.iinfo(np.int64).min).max(axis=1))
            count += other.sum(axis=1)
            id_low, id_high = min(id_low, int(ids.min())), max(id_high, int(ids.max()))
        n = len(self.ids)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(n), low, high, count, np.full(n, id_low), np.full(n, id_high))], names=["q", "low", "high", "n", "id_low", "id_high"])

    def histogram(self, batches):
        at = np.flatnonzero(~self.done)
        shift = np.maximum(self.bits - STEP, 0)[at, None]
        low, by_id, score, bits = self.low[at, None], self.by_id[at, None], self.score[at, None], self.bits[at, None]
        total = np.zeros(len(at) << STEP, np.int64)
        for ids, scores, other in self.meet(batches):
            scores, inside = scores[at], other[at]
            inside &= ~by_id | (scores == score)
            value = np.where(by_id, ids[None, :], scores) - low
            inside &= (value >= 0) & (value >> bits == 0)
            bins = (np.arange(len(at))[:, None] << STEP) + (value >> shift)
            total += np.bincount(bins[inside], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[full >> STEP]), pa.array(full & ((1 << STEP) - 1)), pa.array(total[full])], names=["q", "bin", "n"])

    def narrow(self, counts: np.ndarray, id_low: int, id_bits: int) -> None:
        """Take the bin with the k-th place as the next interval. counts: [query, bin]."""
        for q in np.flatnonzero(~self.done):
            shift, wanted = max(int(self.bits[q]) - STEP, 0), int(self.wanted[q])
            row = counts[q] if self.by_id[q] else counts[q][::-1]  # small ids first, high scores first
            upto = np.cumsum(row)
            i = int(np.searchsorted(upto, wanted))
            wanted -= int(upto[i] - row[i])
            bin_ = i if self.by_id[q] else len(row) - 1 - i
            self.low[q] += bin_ << shift
            self.bits[q], self.wanted[q] = shift, wanted
            if self.by_id[q]:
                self.last[q] = self.low[q] + (1 << shift) - 1
                self.done[q] = shift == 0 or row[i] == wanted
            elif row[i] == wanted:  # the whole bin belongs to the result
                self.score[q], self.last[q], self.done[q] = self.low[q] - 1, np.iinfo(np.int64).min, True
            elif shift == 0:
                self.score[q], self.by_id[q], self.low[q], self.bits[q] = self.low[q], True, id_low, id_bits

    def chosen(self, batches):
        """What lies above the k-th place, and of the rows that share it as many as are wanted."""
        left = np.where(self.by_id, self.wanted, np.iinfo(np.int64).max)
        for ids, scores, other in self.meet(batches):
            above = scores > self.score[:, None]
            tied = (scores == self.score[:, None]) & (ids[None, :] <= self.last[:, None])
            one = tied & self.by_id[:, None] & (ids[None, :] == self.last[:, None])
            for q in np.flatnonzero((one & other).any(axis=1)):
                places = np.flatnonzero(one[q] & other[q])
                tied[q, places[int(left[q]) :]] = False
                left[q] -= min(len(places), int(left[q]))
            q, c = np.nonzero((above | tied) & other)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.ids[q]), pa.array(ids[c]), pa.array(scores[q, c])], names=["q", "query_id", "vec_id", "score"])


def _top_of_block(stored: DataFrame, block: Block, k: int) -> DataFrame:
    ranges = stored.mapInArrow(block.ranges, "q long, low long, high long, n long, id_low long, id_high long")
    found = ranges.groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n"), F.min("id_low"), F.max("id_high")).toPandas().sort_values("q").to_numpy()
    low, high, count = found[:, 1], found[:, 2], found[:, 3]
    id_low, id_bits = int(found[0, 4]), int(found[0, 5] - found[0, 4]).bit_length()
    block.done = count <= k  # all are wanted
    block.wanted = np.full(len(count), k)
    block.low = np.where(block.done, 0, low)
    block.bits = np.array([0 if d else int(b - a).bit_length() for a, b, d in zip(low, high, block.done, strict=True)], np.int64)
    while not block.done.all():
        counted = stored.mapInArrow(block.histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        pdf, counts = counted.toPandas(), np.zeros((len(block.ids), 1 << STEP), np.int64)
        counts[pdf["q"].to_numpy(), pdf["bin"].to_numpy()] = pdf["n"].to_numpy()
        block.narrow(counts, id_low, id_bits)
    rows = stored.mapInArrow(block.chosen, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, key: str = "vec_id", column: str = "embedding", rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k best of all other rows.

    Components count as floor(scale * x); the score is their inner product, over the common components where lengths
    differ, and must fit a long. Ties go to the smaller id. Rows with a null key, a null vector, or a null or
    non-finite component take no part. Rows that repeat an id are candidates of their own, and none is a candidate of
    a query with its id; a repeated query is answered each time. An empty table, or one without a query, gives an
    empty table. Other columns are left out.
    """
    spark = vectors.sparkSession
    stored = materialize(_blocks(vectors, key, column, scale, ROWS), "vectors")
    asked = vectors.filter(F.col(f"`{key}`") % every == 0)
    total, width = asked.agg(F.count("*"), F.max(F.size(F.col(f"`{column}`")))).first()
    size = max(1, min(rows, ELEMENTS // max(1, width or 1)))
    parts = asked.select(F.col(f"`{key}`"), F.col(f"`{column}`")).repartition(max(1, -(-total // size)))
    asked = materialize(_blocks(parts, key, column, scale, size), "queries")
    out = []
    for row in asked.toLocalIterator():
        ids = np.frombuffer(row["ids"], np.int64)
        block = Block(ids, np.frombuffer(row["matrix"], np.int64).reshape(len(ids), row["width"]))
        out.append(materialize(_top_of_block(stored, block, k), "topk"))
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for df in out:
        found = found.unionByName(df)
    return found


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = {
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
}
