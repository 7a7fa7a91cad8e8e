"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a stream of its documents in shuffled order, up to three rounds of them. A document's virtual finish
time is the source's words up to and with it, divided by the source's target; the streams merge by finish time
and the mix ends where the next document would exceed the budget.

Running sums never run over a whole table in one task: words are first added up by bins (of the shuffle hash within
a source, of the finish time over all), prefix sums run over the few bins, and rows are only ordered within a bin.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchframe.llm.common import WORD, read_documents
from watchframe.session import materialize

WEIGHTS = (5, 2, 1)
ROUNDS = 3
#: Bins of finish time per target, at each of two levels; finish times from TOP targets on share the last bin.
FINE, TOP = 1024, 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, rank, source_size, target): the budget of all words shared by weight, none above `rounds` times its size.

    Sources by code point, null last, take the weights in turn. With sources in order of cap per weight, the capped
    ones come first, and what is left per weight shows where they end. One row per source passes one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1)
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * rounds)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order, every = Window.orderBy("ratio", "rank"), Window.partitionBy()
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    weights_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - F.coalesce(before, F.lit(0))) / weights_left
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    share = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * share)
    return rows.select("source", "rank", "source_size", target.alias("target"))


def allocation(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, taken) for every row of `docs`: taken is size times its rounds in the mix.

    size counts the text's words (null: 0). A source of no words has target 0. Rows that repeat are rows of their own;
    null keys shuffle as the empty text does; null is a source like others. Other columns are left out; an empty table
    gives an empty table. The order within a source is by md5 of the key, so reruns agree.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    sizes = materialize(sizes.withColumn("hash", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))), "sizes")
    each = materialize(targets(sizes), "targets")
    rows = sizes.withColumn("bin", F.substring("hash", 1, 3))
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    within = Window.partitionBy("source", "bin").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).alias("r")
    rows = rows.join(bins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")))
    rows = rows.select("r.*", (F.col("r.upto") + F.col("b.earlier")).alias("upto_all"))
    queue = rows.alias("r").join(each.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    queue = materialize(queue.select("key", "r.source", "size", "source_size", "target", "rank", "hash", F.col("upto_all").alias("upto")), "queue")
    budget = each.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    last = _last_taken(queue, budget)
    taken = F.lit(0).cast("long")
    if last is not None:
        end = _place(*map(F.lit, last))
        for i in range(ROUNDS):
            place = _place(_finish(F.lit(i)), F.col("rank"), F.lit(i), F.col("hash"), F.col("upto"))
            taken = taken + F.when((F.col("size") > 0) & (place <= end), F.col("size")).otherwise(0)
    return queue.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"))


def _finish(number) -> F.Column:
    return (number * F.col("source_size") + F.col("upto")) / F.col("target")


def _place(*columns) -> F.Column:
    """Place of a copy in the merged order."""
    kinds = {"finish": "double", "rank": "int", "round": "int", "hash": "string", "upto": "long"}
    return F.struct(*[c.cast(kind).alias(name) for c, (name, kind) in zip(columns, kinds.items(), strict=True)])


def _last_taken(queue: DataFrame, budget: int):
    """Place of the last copy that fits in the budget, or None. Copies are the rounds of rows with words."""
    copies = queue.filter("size > 0").withColumn("round", F.explode(F.array(*[F.lit(i) for i in range(ROUNDS)])))
    copies = copies.withColumn("finish", _finish(F.col("round")))
    bin_of = [F.floor(F.least(F.col("finish"), F.lit(float(TOP))) * FINE), F.floor(F.pmod(F.col("finish") * FINE, F.lit(1.0)) * FINE)]
    left, inside = budget, []
    for i, level in enumerate(bin_of):
        bins = copies.filter(F.lit(True) if not inside else inside[0]).groupBy(level.alias("bin")).agg(F.sum("size").alias("words"))
        bins = bins.withColumn("upto", F.sum("words").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        full = bins.filter(F.col("upto") > left).orderBy("bin").first()
        if full is None:  # only where there is no copy
            return None
        left -= full["upto"] - full["words"]
        inside = [F.lit(True) if not inside else inside[0]]
        inside[0] = inside[0] & (level == full["bin"])
        if i == 0 and full["bin"] >= TOP * FINE:
            break
    order = Window.orderBy("finish", "rank", "round", "hash", "upto").rowsBetween(Window.unboundedPreceding, 0)
    place = _place(*map(F.col, ("finish", "rank", "round", "hash", "upto")))
    crossing = copies.filter(inside[0])
    fits = crossing.withColumn("running", F.sum("size").over(order)).filter(F.col("running") <= left).agg(F.max(place).alias("p")).first()["p"]
    if fits is None:  # the last one is before this bin
        first = crossing.agg(F.min(place).alias("p")).first()["p"]
        fits = copies.filter(place < _place(*map(F.lit, first))).agg(F.max(place).alias("p")).first()["p"]
    return fits


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it takes them."""
    found = allocation(docs, key, text, source)
    same = Window.partitionBy("key", "source", "size")
    rounds = found.filter("taken > 0").select(F.col(f"`{key}`").alias("key"), "source", "size", (F.col("taken") / F.col("size")).cast("int").alias("rounds"))
    rounds = rounds.withColumn("n", F.row_number().over(same.orderBy(F.desc("rounds")))).alias("t")
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    keyed = keyed.withColumn("n", F.row_number().over(same.orderBy(F.xxhash64("row")))).alias("d")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("key", "source", "size", "n")]
    both = keyed.join(rounds, on).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    return both.select("d.row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "source")
    return allocation(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = {
    "op7_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sizes GROUP BY source),
capped AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, source_size * 3 AS cap FROM named),
levels AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level,
         row_number() OVER (ORDER BY cap / weight, rank) AS place
  FROM capped),
shares AS (SELECT level AS share FROM levels WHERE level <= ratio ORDER BY place LIMIT 1),
targets AS (SELECT source, rank, source_size, least(cap::DOUBLE, weight * share) AS target FROM levels, shares),
queue AS (
  SELECT doc_id, size, source_size, target, rank, hash,
         CAST(sum(size) OVER (PARTITION BY rank ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
copies AS (
  SELECT *, (round * source_size + upto)::DOUBLE / target AS finish FROM queue, (SELECT unnest([0, 1, 2]) AS round) WHERE size > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, round, hash, upto ROWS UNBOUNDED PRECEDING) AS running FROM copies),
taken AS (
  SELECT rank, hash, upto, CAST(sum(size) AS BIGINT) AS taken FROM merged
  WHERE running <= (SELECT sum(size) FROM sizes) GROUP BY rank, hash, upto)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(CASE WHEN q.size = 0 THEN 0 ELSE coalesce(t.taken, 0) END AS BIGINT) AS taken
FROM queue q LEFT JOIN taken t ON q.rank = t.rank AND q.hash = t.hash AND q.upto = t.upto AND q.size > 0
"""
}
