"""Evaluation metrics of scored events.

Input rows have event_id, a class number `label_int`, a predicted class and a risk score. Ranking
metrics work on one row per distinct score, so equal scores are one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.functions.scalars import utc_format
from watchframe.operators.scans import Wanted, global_scan
from watchframe.schema import ENTITY_TYPES, LABELS, int_to_label

CLASSES = range(len(LABELS))


def _attack() -> Column:
    return (F.col("label_int") > 0).cast("long")


# ---- ranking metrics -----------------------------------------------------------------------------


def score_curve(scored: DataFrame, risk: str = "risk") -> DataFrame:
    """One row per distinct score, highest first in `cum_*`: n, pos, and both summed up to the score."""
    steps = scored.groupBy(F.col(risk).alias("score")).agg(F.count("*").alias("n"), F.sum(_attack()).alias("pos"))
    steps = steps.withColumn("_down", -F.col("score"))
    want = Wanted(sums={"cum_n": F.col("n"), "cum_pos": F.col("pos")})
    return global_scan(steps, want, ["_down"]).drop("_down")


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision times recall step; 0 without positives."""
    steps = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    return curve.agg(F.coalesce(F.try_divide(steps, F.sum("pos")), F.lit(0.0)).alias("average_precision"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null when a class is missing."""
    neg = F.col("n") - F.col("pos")
    above = F.col("cum_pos") - F.col("pos") + F.col("pos") / 2
    pairs = F.sum("pos").cast("double") * F.sum(neg)
    return curve.agg(F.try_divide(F.sum(neg * above), pairs).alias("roc_auc"))


def precision_at_k(scored: DataFrame, curve: DataFrame, risk: str = "risk", fraction: float = 0.01) -> DataFrame:
    """Share of attacks among the top `fraction` by score, at least one row; equal scores by event_id.

    k grows with the data, so no top-k sort: the curve gives the score at which k is reached, and only
    the rows tied at that score are ranked.
    """
    k = F.greatest(F.lit(1), F.floor(F.sum("n") * fraction)).cast("long")
    edge = curve.join(F.broadcast(curve.agg(k.alias("k"))), F.col("cum_n") >= F.col("k"))
    edge = edge.agg(F.max_by(F.struct("score", "k", "n", "pos", "cum_n", "cum_pos"), "score").alias("e")).select("e.*")
    tied = scored.where(F.col(risk) == edge.select("score").scalar())
    tied = global_scan(tied.select("event_id", _attack().alias("pos")), Wanted(sums={"rank": F.lit(1)}), ["event_id"])
    room = edge.select(F.col("k") - F.col("cum_n") + F.col("n")).scalar()
    found = tied.where(F.col("rank") <= room).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tied_pos"))
    hits = F.col("cum_pos") - F.col("pos") + found.scalar()
    return edge.select("k", (hits / F.col("k")).alias("precision_at_k"))


# ---- class metrics -------------------------------------------------------------------------------


def confusion_counts(scored: DataFrame, predicted: str = "predicted_int") -> DataFrame:
    """(label_int, predicted_int, n); at most classes squared rows."""
    return scored.groupBy("label_int", F.col(predicted).alias("predicted_int")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """One row per class seen as label or prediction, a column per predicted class."""
    cell = F.struct(F.col("label_int").alias("c"), F.col("predicted_int").alias("p"), "n")
    seen = F.struct(F.col("predicted_int").alias("c"), F.lit(None).cast("int").alias("p"), F.lit(0).cast("long").alias("n"))
    cells = counts.select(F.inline(F.array(cell, seen)))
    columns = [F.sum(F.when(F.col("p") == i, F.col("n")).otherwise(0)).alias(f"predicted_{i}") for i in CLASSES]
    return cells.groupBy(F.col("c").alias("label_int")).agg(*columns)


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class; 0/0 is 0."""
    hit = F.when(F.col("label_int") == F.col("predicted_int"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    as_label = F.struct(F.col("label_int").alias("class_int"), F.col("n").alias("s"), none.alias("p"), hit.alias("t"))
    as_guess = F.struct(F.col("predicted_int").alias("class_int"), none.alias("s"), F.col("n").alias("p"), none.alias("t"))
    sums = (
        counts.select(F.inline(F.array(as_label, as_guess)))
        .groupBy("class_int")
        .agg(F.sum("s").alias("support"), F.sum("p").alias("guessed"), F.sum("t").alias("hits"))
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hits, guessed, support = F.col("hits"), F.col("guessed"), F.col("support")
    return sums.select(
        "class_int",
        int_to_label(F.col("class_int")).alias("class"),
        share(hits, guessed).alias("precision"),
        share(hits, support).alias("recall"),
        share(2 * hits, guessed + support).alias("f1"),
        "support",
        "hits",
    )


METRICS = ["precision", "recall", "f1"]


def class_report(counts: DataFrame) -> DataFrame:
    """Long rows (metric, class, value): per class, accuracy, macro and weighted averages, macro f1."""
    scores = class_scores(counts)
    total = F.sum("support").cast("double")

    def row(metric: str, group: Column | str, value: Column) -> Column:
        group = F.lit(group) if isinstance(group, str) else group
        return F.struct(F.lit(metric).alias("metric"), group.alias("class"), value.cast("double").alias("value"))

    per_class = scores.select(F.inline(F.array(*[row(m, F.col("class"), F.col(m)) for m in [*METRICS, "support"]])))
    averages = [row(m, "macro avg", F.avg(m)) for m in METRICS]
    averages += [row(m, "weighted avg", F.sum(F.col(m) * F.col("support")) / total) for m in METRICS]
    averages += [row("support", g, total) for g in ("macro avg", "weighted avg")]
    averages += [row("accuracy", "all", F.sum("hits") / total), row("macro_f1", "all", F.avg("f1"))]
    return per_class.unionByName(scores.agg(F.array(*averages).alias("rows")).select(F.inline("rows")))


def false_positive_rate(scored: DataFrame, risk: str = "risk", threshold: float = 50.0) -> DataFrame:
    """Share of normal events above the threshold; 0 when there are none."""
    alarm = F.when(F.col("label_int") == 0, (F.col(risk) > threshold).cast("double"))
    return scored.agg(F.coalesce(F.avg(alarm), F.lit(0.0)).alias("false_positive_rate"))


def metrics_report(scored: DataFrame, risk: str = "risk", predicted: str = "predicted_int") -> DataFrame:
    """Every metric as long rows (metric, class, value). `scored` is read several times: pass a stored table."""
    curve = score_curve(scored, risk)

    def rows(df: DataFrame, column: str, metric: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), F.lit("all").alias("class"), F.col(column).cast("double").alias("value"))

    return (
        rows(precision_at_k(scored, curve, risk), "precision_at_k", "precision_at_1pct")
        .unionByName(rows(average_precision(curve), "average_precision", "pr_auc"))
        .unionByName(rows(roc_auc(curve), "roc_auc", "roc_auc"))
        .unionByName(rows(false_positive_rate(scored, risk), "false_positive_rate", "false_positive_rate"))
        .unionByName(class_report(confusion_counts(scored, predicted)))
    )


def report_summary(report: DataFrame) -> DataFrame:
    """The headline numbers of a report in one row."""

    def pick(metric: str, group: str, name: str) -> Column:
        return F.max(F.when((F.col("metric") == metric) & (F.col("class") == group), F.col("value"))).alias(name)

    return report.agg(
        pick("accuracy", "all", "accuracy"),
        pick("precision", "macro avg", "macro_precision"),
        pick("recall", "macro avg", "macro_recall"),
        pick("macro_f1", "all", "macro_f1"),
        pick("pr_auc", "all", "pr_auc"),
        pick("roc_auc", "all", "roc_auc"),
        pick("precision_at_1pct", "all", "precision_at_1pct"),
    )


# ---- class balance and data statistics -----------------------------------------------------------


def class_weights(df: DataFrame, column: str = "label_int", boosts: dict[int, float] | None = None) -> DataFrame:
    """Balanced weight rows / (classes * rows of the class), times a boost for hard classes."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    boost = F.lit(1.0)
    for value, factor in (boosts or {}).items():
        boost = F.when(F.col(column) == value, factor).otherwise(boost)
    weight = whole.select("rows").scalar() / (whole.select("classes").scalar() * F.col("n"))
    return counts.select(column, "n", (weight * boost).alias("weight"))


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows and percentage per label."""
    counts = df.groupBy(int_to_label(F.col("label_int")).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (F.col("n") * 100.0 / total).alias("pct"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, entities (all and by type), first and last day, attack and normal percentage; one row."""
    attack = _attack()
    # one row per (type, entity): everything else is counted on that much smaller table
    per = df.groupBy("entity_type", "entity_id").agg(
        F.count("*").alias("n"), F.sum(attack).alias("attacks"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )

    def of_type(kind: str) -> Column:
        return F.count_if(F.col("entity_type") == kind)

    n = F.sum("n")
    return per.agg(
        n.alias("events"),
        F.count_distinct("entity_id").alias("entities"),
        of_type("user").alias("users"),
        of_type("edge_device").alias("edge_devices"),
        of_type("service_account").alias("service_accounts"),
        utc_format(F.min("lo"), "yyyy-MM-dd").alias("first_day"),
        utc_format(F.max("hi"), "yyyy-MM-dd").alias("last_day"),
        (F.sum("attacks") * 100.0 / n).alias("attack_pct"),
        ((n - F.sum("attacks")) * 100.0 / n).alias("normal_pct"),
    )


# ---- statistics that add up over days -------------------------------------------------------------

#: log2 of a sketch's registers: a standard error of 1.04 / 2 ** 6 = 1.6 %, in 4 KiB a day and type.
SKETCH_BITS = 12


@dataclass(frozen=True)
class DailyStats:
    """Stored statistics of each day: counts and sketches by type, and beside them each day's entities for exact counts.

    Days are added by appending, so a log is read once; any range of days is answered from these tables.
    """

    counts: DataFrame
    entities: DataFrame

    def save(self, path: str) -> None:
        self.counts.write.mode("append").parquet(f"{path}/counts")
        self.entities.write.mode("append").parquet(f"{path}/entities")

    def between(self, first: str, last: str, exact: bool = False) -> DataFrame:
        """One row for the days from `first` to `last`: as `dataset_stats`, entities by sketch or exactly."""
        day = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        n = F.sum("events")
        row = self.counts.where(day).agg(
            n.alias("events"),
            self._estimate(F.lit(True)).alias("entities"),
            *[self._estimate(F.col("entity_type") == kind).alias(f"{kind}s") for kind in ENTITY_TYPES],
            F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"),
            (F.sum("attacks") * 100.0 / n).alias("attack_pct"),
            ((n - F.sum("attacks")) * 100.0 / n).alias("normal_pct"),
        )
        if not exact:
            return row
        found = self.entities.where(day).groupBy("entity_type", "entity_id").agg(F.lit(1).alias("_one"))
        counted = found.agg(
            F.count_distinct("entity_id").alias("entities"), *[F.count_if(F.col("entity_type") == kind).alias(f"{kind}s") for kind in ENTITY_TYPES]
        )
        return row.withColumns({c: counted.select(c).scalar() for c in counted.columns})

    @staticmethod
    def _estimate(chosen: Column) -> Column:
        merged = F.hll_union_agg(F.when(chosen, F.col("sketch")))
        return F.coalesce(F.hll_sketch_estimate(merged), F.lit(0))


def daily_stats(df: DataFrame) -> DailyStats:
    """Statistics of a log's days. A null entity is counted in none of the distinct counts."""
    rows = df.select(F.to_date("timestamp").alias("day"), "entity_type", "entity_id", _attack().alias("_attack"))
    counts = rows.groupBy("day", "entity_type").agg(
        F.count("*").alias("events"), F.sum("_attack").alias("attacks"), F.hll_sketch_agg("entity_id", SKETCH_BITS).alias("sketch")
    )
    return DailyStats(counts, rows.select("day", "entity_type", "entity_id").distinct())


def load_daily(spark: SparkSession, path: str) -> DailyStats:
    return DailyStats(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/entities"))
