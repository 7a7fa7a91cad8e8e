"""Centroid clustering over a VA-file.

Every vector is compressed to a cell of 4 bits per dimension; the cells' edges are percentiles of the whole table, the
outermost ones its least and greatest components. For a set of centroids, lookup tables by pair of dimensions and pair
of cells add up to an interval that holds the vector's squared distance to each centroid. Where one centroid's interval
ends below all others begin, the vector's cluster is known from its cells; only where intervals overlap is the full
vector taken, and only against the centroids that overlap.

A stored row is a block: cells and full vectors of up to ROWS vectors side by side, as Spark reads no single rows of a
columnar file; the rows a block needs are decoded from its bytes. A round looks every vector up in the tables of the
round before and of this one and adds to the sums only what changed its cluster, so that after the first round full
vectors are taken where intervals overlap or a vector moved. Nothing is kept per vector between rounds: a lost
executor's blocks are read again. What goes to tasks is bounded by the centroids, what comes back is their sums.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import give_back
from watchframe.session import materialize

CENTROIDS, ROUNDS, SCALE, WIDTH = 40, 5, 256, 64
#: Cells per dimension (4 bits), vectors in a stored block, and vectors that are looked up at once.
CELLS, ROWS, AT_ONCE = 16, 4096, 512
#: Components beyond this have squared distances that need more than 64 bits.
LARGEST = 1 << 27


def kept(vectors: DataFrame, key: str, column: str, width: int, scale: int) -> DataFrame:
    """(id, v): the vectors of `width` components, none null or non-finite, as floor(scale * x)."""
    x = F.col("x")
    named = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("x"))
    fine = (F.size(x) == width) & F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return named.filter(fine).select("id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids have the k smallest hashes; a null id counts as empty."""
    hashed = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def cell_bounds(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, low, high): inner edges [dimension, CELLS - 1], least and greatest component of each cell."""
    inner = F.array(*[F.lit((i + 1) / CELLS) for i in range(CELLS - 1)])
    columns: list[Column] = []
    for i in range(width):
        v = F.col("v")[i]
        columns += [F.min(v), F.max(v), F.percentile_approx(v, inner, 1000)]
    row = rows.agg(*columns).first()
    least, most = (np.array([row[3 * i + j] for i in range(width)], np.int64) for j in (0, 1))
    if max(-int(least.min()), int(most.max())) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} have squared distances of more than 64 bits")
    edges = np.array([row[3 * i + 2] for i in range(width)], np.int64).reshape(width, CELLS - 1)
    low = np.concatenate([least[:, None], edges + 1], axis=1)
    high = np.concatenate([edges, most[:, None]], axis=1)
    return edges, low, high


def va_file(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """(ids, cells, full): blocks of vectors, two cells to a byte, components as 32-bit integers."""
    width = len(edges)

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                full = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, width)
                cells = np.stack([np.searchsorted(edges[d], full[:, d]) for d in range(width)], axis=1).astype(np.uint8)
                if width % 2:
                    cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], axis=1)
                ids = pa.ListArray.from_arrays(pa.array([0, len(full)], pa.int32()), part.column(0))
                paired = (cells[:, ::2] << 4) | cells[:, 1::2]
                yield pa.RecordBatch.from_arrays([ids, pa.array([paired.tobytes()], pa.binary()), pa.array([full.tobytes()], pa.binary())], names=["ids", "cells", "full"])
        give_back()

    return rows.mapInArrow(pack, f"ids array<{dict(rows.dtypes)['id']}>, cells binary, full binary")


class Lookup:
    """Distance intervals to a set of centroids from cells, and the nearest centroid."""

    def __init__(self, centroids: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        c = centroids.T[:, None, :]  # dimension, cell, centroid
        near = np.maximum(np.maximum(low[:, :, None] - c, c - high[:, :, None]), 0) ** 2
        far = np.maximum(np.abs(c - low[:, :, None]), np.abs(c - high[:, :, None])) ** 2
        both = np.concatenate([near, far], axis=2)
        if len(both) % 2:
            both = np.concatenate([both, np.zeros_like(both[:1])])
        self.table = (both[::2, :, None, :] + both[1::2, None, :, :]).reshape(len(both) // 2, CELLS * CELLS, 2 * k)

    def nearest(self, cells: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, int]:
        """Cluster of each row, the smaller number on ties, and how many full vectors were taken."""
        k, out, taken = len(self.centroids), np.zeros(len(cells), np.int64), 0
        for a in range(0, len(cells), AT_ONCE):
            part = cells[a : a + AT_ONCE]
            bounds = np.zeros((len(part), 2 * k), np.int64)
            for pair, table in enumerate(self.table):
                bounds += table[part[:, pair]]
            maybe = bounds[:, :k] <= bounds[:, k:].min(axis=1, keepdims=True)
            cluster = maybe.argmax(axis=1)
            open_ = np.flatnonzero(maybe.sum(axis=1) > 1)
            if len(open_):
                row, centroid = np.nonzero(maybe[open_])
                vectors = full[a + open_].astype(np.int64)
                exact = np.full((len(open_), k), np.iinfo(np.int64).max)
                exact[row, centroid] = ((vectors[row] - self.centroids[centroid]) ** 2).sum(axis=1)
                cluster[open_] = exact.argmin(axis=1)
                taken += len(open_)
            out[a : a + AT_ONCE] = cluster
        return out, taken


def _decoded(batches, width: int):
    """Blocks as (ids, cells, full)."""
    for batch in batches:
        for i in range(batch.num_rows):
            cells = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8).reshape(-1, (width + 1) // 2)
            full = np.frombuffer(batch.column(2)[i].as_buffer(), "<i4").reshape(-1, width)
            yield batch.column(0)[i].values, cells, full


def changes(stored: DataFrame, old: Lookup | None, new: Lookup) -> DataFrame:
    """(cluster, place, change): what the vectors that changed cluster add to each sum; place -1 is their number,
    -2 (of cluster 0) the full vectors taken for it."""
    k, width = new.centroids.shape

    def run(batches):
        sums, taken = np.zeros((k, width + 2), np.int64), 0
        for _, cells, full in _decoded(batches, width):
            now, n = new.nearest(cells, full)
            was, m = old.nearest(cells, full) if old else (np.full(len(now), -1), 0)
            moved = np.flatnonzero(now != was)
            taken += max(n, m, len(moved))
            rows = np.concatenate([np.ones((len(moved), 1), np.int64), full[moved].astype(np.int64)], axis=1)
            np.add.at(sums[:, 1:], now[moved], rows)
            if old:
                np.subtract.at(sums[:, 1:], was[moved], rows)
        sums[0, 0] = taken
        cluster, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place - 2), pa.array(sums[cluster, place])], names=["cluster", "place", "change"])
        give_back()

    return stored.mapInArrow(run, "cluster long, place long, change long").groupBy("cluster", "place").agg(F.sum("change").alias("change"))


def assigned(stored: DataFrame, lookup: Lookup) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    width, kind = lookup.centroids.shape[1], dict(stored.dtypes)["ids"][len("array<") : -1]

    def run(batches):
        for ids, cells, full in _decoded(batches, width):
            cluster, _ = lookup.nearest(cells, full)
            apart = full.astype(np.int64) - lookup.centroids[cluster]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array((apart * apart).sum(axis=1))], names=["id", "cluster", "distance"])
        give_back()

    return stored.mapInArrow(run, f"id {kind}, cluster int, distance long")


def fitted(stored: DataFrame, centroids: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """Centroids after all rounds, and the full vectors taken in each. An empty cluster keeps its centroid."""
    k, width = centroids.shape
    sums, old, taken = np.zeros((k, width + 2), np.int64), None, []
    for _ in range(rounds):
        new = Lookup(centroids, low, high)
        sums[0, 0] = 0
        for row in changes(stored, old, new).collect():  # centroids times dimensions at most
            sums[row["cluster"], row["place"] + 2] += row["change"]
        n = sums[:, 1]
        centroids = np.where(n[:, None] > 0, sums[:, 2:] // np.maximum(n, 1)[:, None], centroids)
        taken.append(int(sums[0, 0]))
        old = new
    return centroids, taken


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors that are null, of another width, or hold a null or non-finite component take no part. With fewer than k
    vectors there are as many centroids. Rows that repeat come back as often and count as often; a null key is a key
    like others, hashed as empty. An empty table gives an empty table; other columns are left out. A component beyond
    LARGEST after scaling is an error, as its squared distances need more than 64 bits.
    """
    rows = kept(vectors, key, column, width, scale)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"`{key}` {dict(vectors.dtypes)[key]}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    edges, low, high = cell_bounds(rows, width)
    stored = materialize(va_file(rows, edges), "cells")
    centroids, _ = fitted(stored, centroids, low, high, rounds)
    found = materialize(assigned(stored, Lookup(centroids, low, high)), "assigned")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    table = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    parts = [
        """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, unnest(range(1, 65)) AS i, unnest(e) AS x FROM v),
c0 AS (SELECT s.c, x.i, x.x AS x FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), e) - 1 AS c FROM v ORDER BY 2 LIMIT 40) s USING (r))"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.r, c.c, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{n} c USING (i) GROUP BY x.r, c.c) GROUP BY r)""")
        if n < ROUNDS:
            parts.append(f"""c{n + 1} AS (SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
  SELECT a.c, x.i, CAST((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
  FROM x JOIN a{n} a USING (r) GROUP BY a.c, x.i) m USING (c, i))""")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c{ROUNDS} GROUP BY c)")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN h USING (c)"""


ORACLE_SQL = {"op11_clusters": _oracle()}
