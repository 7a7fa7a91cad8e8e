"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints link when at most `RADIUS` of their 64 bits differ. Every bit j has a vector a(j) of RADIUS + 1 bits;
the table of each nonzero vector v compares the bits with <a(j), v> = 1 (mod 2). Any RADIUS differing bits leave
some v orthogonal to all of their vectors, so each linked pair meets in one of the 31 tables for certain, while
others meet with probability about 2^-32.

Only distinct fingerprints go through the tables, so copies cost nothing. A table's bucket of up to `BRUTE`
fingerprints is searched breadth first and gives a spanning forest of its links, never all pairs. A larger bucket
goes through shared neighbours: two fingerprints differ in at most 4 bits exactly if some word differs from both
in at most 2, so each fingerprint meets its 2,081 neighbours, and no neighbour has more members than that.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchframe.llm.common import arrow_column, raw_texts, read_documents
from watchframe.session import materialize

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
BRUTE = 4096


def text_fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the text's word shingles; zero for a text without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[a : a + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprint():
    def make():
        def batch(texts: pa.Array) -> pa.Array:
            return pa.array(np.array([text_fingerprint(x) for x in raw_texts(texts)], np.uint64).view(np.int64))

        return batch

    return arrow_column(make, "long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) per row; null and wordless texts have fingerprint zero."""
    return docs.select(F.col(f"`{key}`"), _fingerprint()(F.col(f"`{text}`")).alias("fp"))


def masks() -> list[int]:
    """The bits each table compares."""
    vectors = [j % (2 ** (RADIUS + 1) - 1) + 1 for j in range(BITS)]
    return [sum(1 << j for j, a in enumerate(vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (RADIUS + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join just what the links of these fingerprints join."""
    left, a, b = values, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= RADIUS
            found, left = left[near], left[~near]
            a.append(np.full(len(found), front[0]))
            b.append(found)
            front = np.concatenate([front[1:], found])
    return a, b


def _bucket_links(batches):
    """Links within the runs of equal (v, part), which may go on over batches."""

    def found(table: np.ndarray, part: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero((table[1:] != table[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.append(starts, len(fp)))
        pairs = starts[sizes == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS
        a, b = [fp[pairs[near]]], [fp[pairs[near] + 1]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            more = forest(fp[s : s + n])
            a += more[0]
            b += more[1]
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now[2] = now[2].view(np.uint64)
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield found(*[x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if held is not None:
        yield found(*held)


def links(distinct: DataFrame, brute: int = BRUTE) -> DataFrame:
    """Links (a, b) over distinct fingerprints `fp` that have the components of all links within the radius."""
    tables = F.array(*[F.lit(_signed(m)) for m in masks()])
    rows = distinct.select("fp", F.posexplode(tables).alias("v", "mask")).select(
        "v", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"
    )
    sizes = rows.groupBy("v", "part").count()
    several = sizes.filter(F.col("count").between(2, brute)).select("v", "part")
    large = sizes.filter(F.col("count") > brute).select("v", "part")
    searched = rows.join(several, ["v", "part"], "left_semi").repartition("v", "part").sortWithinPartitions("v", "part", "fp")
    searched = searched.mapInArrow(_bucket_links, "a long, b long")
    ones = [1 << j for j in range(BITS)]
    near = [0, *ones, *[x | y for i, x in enumerate(ones) for y in ones[:i]]]
    crowded = rows.join(large, ["v", "part"], "left_semi").select("fp").distinct()
    spread = crowded.select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in near])).alias("x"))
    spread = spread.select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    shared = spread.select("fp", F.min("fp").over(Window.partitionBy("point")).alias("least"))
    shared = shared.filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return searched.unionByName(shared)


def roots(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of a link: root is the smallest value of its component, by alternating large and
    small stars. Each round is stored, and rounds end when nothing changes."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = mark(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both).withColumn("m", F.least("u", "m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.join(least(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def components(marked: DataFrame, key: str = "doc_id", brute: int = BRUTE) -> DataFrame:
    """(fp, root, component_id) per distinct fingerprint of the stored table `marked` (key, fp): component_id is the
    smallest key that links reach."""
    distinct = materialize(marked.groupBy("fp").agg(F.min(f"`{key}`").alias("least")), "fingerprints")
    found = roots(links(distinct, brute))
    rooted = materialize(distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", brute: int = BRUTE) -> DataFrame:
    """(key, fingerprint, component_id) for every row of `docs`.

    A null, empty or wordless text has fingerprint zero and links like any other. Rows that repeat come back as
    often; a null key takes part but is never a component's id unless all its keys are null (then it is null).
    Other columns are left out; an empty table gives an empty table.
    """
    marked = materialize(fingerprints(docs, key, text), "fingerprints")
    return marked.join(components(marked, key, brute).select("fp", "component_id"), "fp").select(
        F.col(f"`{key}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", brute: int = BRUTE) -> DataFrame:
    """One row of `docs` for each component: that of the smallest key, and of the smallest hash of the whole row where
    rows share the key. A row with a null key stays only where all keys of its component are null; rows that repeat in
    every column count as one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = "_row"
    while held in docs.columns:
        held += "_"
    marked = docs.select(F.col(f"`{key}`"), F.xxhash64(*columns).alias(held), _fingerprint()(F.col(f"`{text}`")).alias("fp"))
    marked = materialize(marked, "fingerprints")
    classes = components(marked, key, brute).select("fp", "root")
    first = F.min(F.struct(F.col(f"`{key}`").isNull().alias("bare"), F.col(f"`{key}`").alias("k"), F.col(held).alias("row")))
    chosen = materialize(marked.join(classes, "fp").groupBy("root").agg(first.alias("c")).select("c.k", "c.row"), "chosen")
    rows = docs.withColumn(held, F.xxhash64(*columns))
    kept = rows.join(chosen, rows[f"`{key}`"].eqNullSafe(chosen["k"]) & (rows[held] == chosen["row"]), "left_semi")
    return kept.dropDuplicates([key, held]).select(*columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir))
