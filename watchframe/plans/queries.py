"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.functions import haversine_km, speed_kmh
from watchframe.functions.scalars import DAY_US, HOUR_US
from watchframe.operators import (
    baseline,
    drift,
    explain,
    features,
    fusion,
    labels,
    metrics,
    outliers,
    profile,
    quality,
    rules,
    selection,
    sequence,
    serving,
)
from watchframe.operators.log import prepared
from watchframe.plans import detect
from watchframe.schema import (
    COMMANDS,
    FEATURES,
    FLAT_EVENT,
    RULE_FLAGS,
    int_to_label,
    mitre_of,
    numeric_features,
    severity,
)
from watchframe.session import materialize, scratch_path
from watchframe.sources import files
from watchframe.sources.adapter import access_log, read_access_log
from watchframe.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]

# thresholds at which the rules fire on the sparse sample tables
THRESHOLDS = rules.Thresholds(
    brute_force_minutes=3 * 1440,
    brute_force_failures=3,
    stuffing_minutes=2 * 1440,
    stuffing_targets=5,
    stuffing_fail_rate=0.5,
)
TRAIN_DAYS = 20
# a run's parameters are the defaults, but for what the sample tables need: 30 days of events with few per entity
SETTINGS = detect.Settings(train_days=TRAIN_DAYS, parse_commands=True, thresholds=THRESHOLDS, baseline_mode="sequential")

_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_access_log(spark, sf_dir)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(_log(spark, sf_dir))


def _r(name: str, digits: int) -> Column:
    return F.round(F.col(name), digits).alias(name)


def _fired(rule: str) -> Column:
    return F.col(f"rule_{rule}").cast("long").alias("fired")


# ---- rules ---------------------------------------------------------------------------------------


@query
def rule_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_entity_rules(_prepared(spark, sf_dir), THRESHOLDS)
    return df.select("event_id", "recent_failures", _fired("brute_force"))


@query
def rule_impossible_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_entity_rules(_prepared(spark, sf_dir), THRESHOLDS)
    speed = F.round(F.coalesce("travel_kmh", F.lit(-1.0)), 3).alias("travel_kmh")
    return df.select("event_id", speed, _fired("impossible_travel"))


@query
def rule_credential_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_address_rules(_prepared(spark, sf_dir), THRESHOLDS)
    return df.select("event_id", "ip_events", "ip_failures", "ip_targets", _fired("credential_stuffing"))


@query
def rule_device_spoofing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_entity_rules(_prepared(spark, sf_dir))
    return df.select("event_id", F.coalesce("prev_device", F.lit("")).alias("prev_device"), _fired("device_spoofing"))


@query
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_rules(_log(spark, sf_dir), THRESHOLDS).select("event_id", "rule_hits")
    return df.withColumns(rules.flags_of(F.col("rule_hits"))).select("event_id", *[F.col(c).cast("long") for c in RULE_FLAGS])


@query
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.with_rules(_log(spark, sf_dir), THRESHOLDS)
    return df.select("event_id", F.inline("rule_hits")).select("event_id", "rule", "detail", "mitre", _r("confidence", 4))


# ---- features ------------------------------------------------------------------------------------


@query
def feat_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepared(spark, sf_dir).withColumns(features.temporal())
    return df.select(
        "event_id", _r("hour_sin", 6), _r("hour_cos", 6), "day_of_week", "is_weekend", "is_work_hours", "is_off_hours"
    )


@query
def feat_raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepared(spark, sf_dir).withColumns({**features.raw_values(False), **features.constants()})
    return df.select(
        "event_id", "session_duration_raw", "bytes_transferred_raw", "command_entropy",
        "auth_method_mismatch", "is_new_geo", "protocol_mismatch",
    )


@query
def feat_gap_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir))
    return df.select("event_id", _r("time_since_last", 6), "session_frequency_1h")


@query
def feat_windowed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir), windowed_frequency=True)
    return df.select("event_id", "session_frequency_1h")


@query
def feat_auth_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir))
    return df.select("event_id", _r("auth_failure_rate", 8))


@query
def feat_resource_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir))
    return df.select("event_id", "resource_novelty", "resource_diversity")


@query
def feat_privilege_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir))
    return df.select("event_id", _r("privilege_expansion_rate", 8), "privilege_expansion_velocity")


@query
def feat_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir))
    return df.select(
        "event_id", _r("geo_velocity_kmh", 3), "impossible_travel_flag", _r("geo_distance_from_primary", 3), _r("geo_anomaly_score", 6)
    )


@query
def feat_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_entity_features(_prepared(spark, sf_dir))
    return df.select("event_id", "device_stability_index", "new_device_flag", "fingerprint_mismatch")


@query
def feat_ip_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_address_features(_prepared(spark, sf_dir))
    return df.select("event_id", "unique_entities_per_ip")


@query
def feat_freq_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _prepared(spark, sf_dir)
    df = features.with_frequencies(features.with_address_features(log), log)
    return df.select("event_id", _r("resource_freq_encoding", 10), _r("ip_freq_encoding", 10))


@query
def feat_command_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _prepared(spark, sf_dir).withColumns(features.raw_values(True))
    return df.select("event_id", _r("command_entropy", 6))


_ROUNDED = {"time_since_last": 6, "geo_velocity_kmh": 3, "geo_distance_from_primary": 3}


def _rounded_features(names: list[str]) -> list[Column]:
    scaled = [F.round(F.col(c) / 1e6, 3).alias(c) if c.endswith("_zscore") else _r(c, _ROUNDED.get(c, 6)) for c in names]
    return scaled


@query
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 37 features; the z-scores in millions, as the as-written baseline freezes at 1e-6 spread."""
    return features.compute_features(_log(spark, sf_dir)).select("event_id", *_rounded_features(FEATURES))


_ZSCORES = [f"{m}_zscore" for m in baseline.MEASURES]


def _rows_and_hits(df: DataFrame, names: list[Column]) -> DataFrame:
    flags = [F.col(c).cast("long").alias(c) for c in RULE_FLAGS]
    return df.select("event_id", *names, *flags, F.size("rule_hits").cast("long").alias("hits"))


@query
def features_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main product: all 37 features, the rule flags and the number of hits of every event, on shared partitionings."""
    df = detect.with_features_and_rules(_log(spark, sf_dir), detect.Settings(thresholds=THRESHOLDS, baseline_mode="sequential"))
    return _rows_and_hits(df, _rounded_features(FEATURES))


def _scores() -> list[Column]:
    """What the daily baseline adds."""
    return [_r("entity_maturity_weight", 6), F.col("is_cold_start"), F.col("accepted").cast("long").alias("accepted"), *[_r(z, 4) for z in _ZSCORES]]


@query
def score_second_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days after the twentieth, scored as a log of their own on the stored state that the days before left."""
    s = detect.Settings(thresholds=THRESHOLDS)
    log = _log(spark, sf_dir)
    cut = log.agg(F.date_trunc("day", F.min("timestamp")) + F.expr("INTERVAL 20 DAYS")).scalar()
    _, carried = detect.process(log.where(F.col("timestamp") < cut), s)
    path = scratch_path(spark, "carried")
    carried.save(path)
    df, _ = detect.process(log.where(F.col("timestamp") >= cut), s, detect.load_carried(spark, path))
    scored = {*_ZSCORES, "entity_maturity_weight", "is_cold_start"}
    return _rows_and_hits(df, [*_rounded_features([c for c in FEATURES if c not in scored]), *_scores()])


@query
def baseline_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default plan says of every event: the baseline of the days before."""
    df = detect.with_features_and_rules(_log(spark, sf_dir), detect.Settings(thresholds=THRESHOLDS))
    return df.select("event_id", *_scores())


# ---- checks, labels, splits ----------------------------------------------------------------------


def _flawed(log: DataFrame) -> DataFrame:
    """The log with defects planted by event number, to give validation something to find."""
    n = F.col("event_id") % 50

    def broken(column: str, at: int, value: Column) -> Column:
        return F.when(n == at, value).otherwise(F.col(column))

    return log.withColumns(
        {
            "entity_type": broken("entity_type", 1, F.lit("robot")),
            "auth_method": broken("auth_method", 2, F.lit("magic")),
            "source_ip": broken("source_ip", 3, F.lit("999.999.999.999")),
            "geo_lat": broken("geo_lat", 4, F.lit(95.0)),
            "geo_lon": broken("geo_lon", 5, F.lit(-181.0)),
            "session_duration": broken("session_duration", 6, F.lit(-1.0)),
            "bytes_transferred": broken("bytes_transferred", 7, F.lit(-5)),
            "resource_accessed": broken("resource_accessed", 8, F.lit(None).cast("string")),
            "auth_success": broken("auth_success", 9, F.lit(None).cast("boolean")),
        }
    )


@query
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.with_reasons(_flawed(_log(spark, sf_dir)), quality.event_checks())
    return df.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query
def validate_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 10
    k = (F.col("event_id") % 300).cast("string")
    ip = (
        F.when(n == 0, F.concat(F.lit("1.2.3."), k))
        .when(n == 1, F.concat(F.lit("001.02.3."), k))
        .when(n == 2, F.concat(k, F.lit(".1.1")))
        .when(n == 3, F.concat(F.lit("1.1.1.1."), k))
        .when(n == 4, F.concat(F.lit("1..1."), k))
        .when(n == 5, F.concat(F.lit("1.a.1."), k))
        .when(n == 6, F.concat(k, F.lit(".0.0.-1")))
        .when(n == 7, F.lit(""))
        .when(n == 8, F.concat(F.lit(" 1.2.3."), k))
        .otherwise(F.concat_ws(".", k, k, k, k))
    )
    df = _log(spark, sf_dir).withColumn("ip", ip)
    return df.select("event_id", "ip", quality.is_ipv4(F.col("ip")).cast("long").alias("ok"))


@query
def validate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _log(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 40 == 0, "phishing").otherwise(int_to_label(F.col("label_int"))).alias("label")
    )
    return quality.validate_labels(named)[1].select("event_id", "label", F.array_join("reasons", ",").alias("reasons"))


@query
def validate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles derived from the log: the resource set of an entity must hold 3 to 20 names."""
    log = _log(spark, sf_dir)
    first = [F.min(c).alias(c) for c in ("entity_type", "auth_method", "device_os", "device_firmware", "device_mac", "device_protocol")]
    made = log.groupBy("entity_id").agg(
        *first,
        F.min("geo_lat").alias("home_lat"),
        F.min("geo_lon").alias("home_lon"),
        F.lit(9.0).alias("typical_hour_mean"),
        (F.avg("session_duration") / 8).alias("typical_hour_std"),
        F.sort_array(F.collect_set(F.regexp_extract("resource_accessed", "([0-9]+)$", 1))).alias("resource_set"),
        F.lit(5.0).alias("session_duration_mean_log"),
        F.lit(0.4).alias("session_duration_std_log"),
        (F.count("*") / 30).alias("avg_daily_events"),
        F.avg("bytes_transferred").cast("long").alias("bytes_mean"),
        F.lit(2000).cast("long").alias("bytes_std"),
    )
    checked = quality.with_reasons(made, quality.profile_checks())
    return checked.select("entity_id", F.array_join("reasons", ",").alias("reasons"))


@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_split(_log(spark, sf_dir), TRAIN_DAYS).select("event_id", F.col("is_train").cast("long").alias("is_train"))


@query
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    hidden = log.select(
        "event_id", F.when(F.col("event_id") % 7 == 0, "other").otherwise(int_to_label(F.col("label_int"))).alias("label")
    )
    df = labels.encode_labels(labels.join_labels(log.drop("label_int"), hidden))
    return df.select("event_id", "label", F.col("label_int").cast("long").alias("label_int"), F.col("is_attack").cast("long").alias("is_attack"))


@query
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from a file of their own, as a log and its labels are delivered."""
    log = _log(spark, sf_dir).withColumn("label", int_to_label(F.col("label_int")))
    path = scratch_path(spark, "labels")
    log.select("event_id", "label").write.option("header", True).csv(path)
    found = labels.encode_labels(labels.join_labels(log.drop("label", "label_int").withColumn("event_id", F.col("event_id").cast("string")), files.read_labels(spark, path)))
    return found.select("event_id", "label", F.col("label_int").cast("long").alias("label_int"))


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_distribution(_log(spark, sf_dir)).select("label", "n", _r("pct", 4))


@query
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.dataset_stats(_log(spark, sf_dir))
    return df.withColumns({"attack_pct": F.round("attack_pct", 4), "normal_pct": F.round("normal_pct", 4)})


@query
def stats_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of ten days from the stored statistics of each day, added in two parts; exact, with the sketches' error."""
    log, path = _log(spark, sf_dir), scratch_path(spark, "daily")
    early = F.col("timestamp") < F.lit("2024-01-12").cast("timestamp")
    for part in (log.where(early), log.where(~early)):
        metrics.daily_stats(part).save(path)
    daily = metrics.load_daily(spark, path)
    exact, close = (daily.between("2024-01-06", "2024-01-15", x) for x in (True, False))
    near = F.abs(close.select("entities").scalar() - F.col("entities")) <= 0.05 * F.col("entities")
    rounded = {c: F.round(c, 4) for c in ("attack_pct", "normal_pct")}
    return exact.withColumns(rounded).withColumn("sketch_is_close", near.cast("long"))


@query
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = int_to_label(F.col("pred_stub"))
    return _log(spark, sf_dir).select(
        "event_id",
        severity(F.col("risk_stub")).alias("severity"),
        mitre_of(label).alias("mitre"),
        serving.is_alarm(F.col("risk_stub")).cast("long").alias("alarm"),
    )


# ---- metrics -------------------------------------------------------------------------------------


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    attacks = _log(spark, sf_dir).where("label_int > 0")
    df = metrics.class_weights(attacks, boosts=fusion.HARD)
    return df.select(F.col("label_int").cast("long").alias("label_int"), "n", _r("weight", 6))


@query
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    df = metrics.precision_at_k(log, metrics.score_curve(log, "risk_stub"), "risk_stub")
    return df.select("k", _r("precision_at_k", 6))


@query
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.score_curve(_log(spark, sf_dir), "risk_stub")
    return metrics.average_precision(curve).select(_r("average_precision", 8))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.score_curve(_log(spark, sf_dir), "risk_stub")
    return metrics.roc_auc(curve).select(_r("roc_auc", 8))


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.confusion_counts(_log(spark, sf_dir), "pred_stub")
    return metrics.class_report(counts).select("metric", "class", _r("value", 8))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = metrics.confusion_matrix(metrics.confusion_counts(_log(spark, sf_dir), "pred_stub"))
    return df.withColumn("label_int", F.col("label_int").cast("long"))


@query
def false_positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.false_positive_rate(_log(spark, sf_dir), "risk_stub").select(_r("false_positive_rate", 8))


@query
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, written as JSON and read back."""
    scored = materialize(_log(spark, sf_dir).select("event_id", "label_int", "risk_stub", "pred_stub"), "scored")
    path = scratch_path(spark, "report")
    files.write_report(metrics.metrics_report(scored, "risk_stub", "pred_stub"), path)
    return files.read_report(spark, path).select("metric", "class", _r("value", 8))


@query
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(_log(spark, sf_dir).select("event_id", "label_int", "risk_stub", "pred_stub"), "scored")
    df = metrics.report_summary(metrics.metrics_report(scored, "risk_stub", "pred_stub"))
    return df.select(*[_r(c, 8) for c in df.columns])


# ---- command sequences ---------------------------------------------------------------------------


@query
def command_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands written as list text in two spellings, decoded and encoded to ids."""
    vocabulary = F.array(*[F.lit(c) for c in COMMANDS])
    known = F.get(vocabulary, (F.col("event_id") % len(COMMANDS)).cast("int"))
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("['"), known, F.lit("', 'login_failed']")))
        .when(kind == 1, F.concat(F.lit("[np.str_('"), known, F.lit("'), np.str_('logout')]")))
        .when(kind == 2, F.lit("[]"))
        .otherwise(F.concat(F.lit("oops '"), known, F.lit("'")))
    )
    ids = files.encode_commands(files.decode_list(text))
    return _log(spark, sf_dir).select("event_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def _normal(log: DataFrame) -> DataFrame:
    return labels.normal_only(log)


@query
def markov_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.transitions(_normal(_log(spark, sf_dir)))


@query
def markov_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    model = sequence.fit(_normal(log))
    df = sequence.with_surprise(log, model)
    return df.select("event_id", _r("sequence_anomaly_score", 6))


# ---- baselines -----------------------------------------------------------------------------------


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns baselines need, on one partitioning by entity."""
    df = features.with_entity_features(_prepared(spark, sf_dir)).withColumns(features.raw_values(False))
    kept = ["event_id", "entity_id", "entity_type", "ts_us", "session_duration_raw", "bytes_transferred_raw"]
    return df.select(*kept, "auth_failure_rate", "resource_diversity", "geo_velocity_kmh")


@query
def baseline_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores in millions: the as-written baseline freezes at a spread of 1e-6."""
    df = baseline.with_sequential(_behaviour(spark, sf_dir))
    return df.select("event_id", _r("entity_maturity_weight", 6), "is_cold_start", *_rounded_features(_ZSCORES))


@query
def baseline_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = baseline.batched(_behaviour(spark, sf_dir))
    return df.select("event_id", *_scores())


@query
def baseline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity baselines after the last slice."""
    _, state = baseline.batched(_behaviour(spark, sf_dir))
    # the bias takes exact halves to one side, whatever the last bit says
    means = [F.round(F.col("mean")[i] + 1e-7, 3).alias(f"{m}_mean") for i, m in enumerate(baseline.MEASURES)]
    spreads = [F.round(F.sqrt(F.col("var")[i]) + 1e-7, 3).alias(f"{m}_std") for i, m in enumerate(baseline.MEASURES)]
    return state.entities.select("entity_id", "n", *means, *spreads)


@query
def cold_start_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = baseline.entity_maturity(baseline.with_sequential(_behaviour(spark, sf_dir)))
    return baseline.cold_start_entities(counts)


# ---- profiles and serving ------------------------------------------------------------------------


@query
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile._summary(_log(spark, sf_dir))
    vector = [F.col("behavioral_vector")[i].cast("long").alias(name) for i, name in enumerate(profile.VECTOR)]
    return df.select("entity_id", "cohort", "account_age", "maturity_weight", "maturity_level", *vector)


@query
def entity_drift_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.drift_series(_log(spark, sf_dir)).select("entity_id", F.posexplode("drift_data").alias("point", "value"))
    return df.withColumn("point", F.col("point").cast("long"))


@query
def entity_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.with_spike(profile.drift_series(_log(spark, sf_dir))).where("spike is not null")
    return df.select("entity_id", F.col("spike.value").alias("value"), F.col("spike.index").alias("index"))


@query
def requested_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by id list; ids come from `nation`, and many of them name no entity."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    wanted = nation.select((F.col("n_nationkey") * 90).cast("string").alias("entity_id"))
    df = profile.requested_profiles(_log(spark, sf_dir), wanted)
    return df.select(
        "entity_id", "cohort", "account_age", "maturity_weight", "maturity_level",
        F.array_join(F.col("behavioral_vector").cast("array<string>"), ",").alias("vector"),
        F.size("drift_data").cast("long").alias("points"),
    )


@query
def kpi_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return serving.kpi_tiles(log, metrics.class_report(metrics.confusion_counts(log, "pred_stub")))


@query
def kpi_tiles_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.kpi_tiles(_log(spark, sf_dir), hours=24)


@query
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _log(spark, sf_dir).withColumn("predicted", int_to_label(F.col("pred_stub")))
    df = serving.triage_queue(named, limit=100, only="high", risk="risk_stub")
    return df.withColumns({"risk_score": F.round("risk_score", 4), "alarm": F.col("alarm").cast("long")})


@query
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's timeline. Rules look at other entities on the same addresses; only rows they can read go through them."""
    near = serving.around_entity(_prepared(spark, sf_dir), "7", THRESHOLDS.stuffing_minutes * 60_000_000)
    df = serving.entity_timeline(rules.with_rules(near, THRESHOLDS), "7")
    return df.withColumn("anomalous", F.col("anomalous").cast("long"))


@query
def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.event_rate(_log(spark, sf_dir), "1 hour")


@query
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.recent_events(_log(spark, sf_dir)).select("event_id", "entity_id", _r("risk_stub", 4))


@query
def unused_resource_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return labels.unused_pairs(log, log)


@query
def unused_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    df = labels.unused_resources(log, log)
    return df.select("entity_id", F.array_join("unused", ",").alias("unused"))


@query
def far_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = serving.entity_homes(_log(spark, sf_dir))
    return serving.far_places(homes, 9000.0).select("entity_id", "far_city", _r("far_km", 3))


@query
def geo_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and speed from each event's place to a fixed point, with and without time passing."""
    seconds = (F.col("event_id") % 3) * 3600.0
    lat, lon = F.col("geo_lat"), F.col("geo_lon")
    speed = speed_kmh(lat, lon, F.lit(0.0), F.lit(10.006), F.lit(10.0), seconds)
    return _log(spark, sf_dir).select(
        "event_id",
        F.round(haversine_km(lat, lon, F.lit(10.006), F.lit(10.0)), 3).alias("km"),
        F.when(speed == float("inf"), -1.0).otherwise(F.round(speed, 3)).alias("kmh"),
    )


# ---- sources -------------------------------------------------------------------------------------


def _flat(log: DataFrame) -> DataFrame:
    return log.select(*[F.col(c).cast("string").alias(c) if c == "event_id" else F.col(c) for c in FLAT_EVENT.fieldNames()])


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "entity_id", F.unix_micros("timestamp").alias("us"), "source_ip", _r("geo_lat", 6), "resource_accessed",
        F.col("auth_success").cast("long").alias("auth_success"), _r("session_duration", 6),
        F.array_join("command_sequence", "|").alias("commands"), "device_os", "device_mac", "bytes_transferred",
    )


@query
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as CSV without labels, and read back."""
    path = scratch_path(spark, "dataset")
    files.write_dataset(_flat(_log(spark, sf_dir)).withColumn("label", F.lit("normal")), path)
    return _shown(files.read_events(spark, f"{path}/access_logs"))


@query
def source_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as nested JSON, read back and flattened."""
    flat = _flat(_log(spark, sf_dir))
    nested = flat.select(
        "event_id", "entity_id", "entity_type", "timestamp", "source_ip",
        F.struct(F.col("geo_city").alias("city"), F.col("geo_country").alias("country"), F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon")).alias("geo_location"),
        "resource_accessed", "auth_method", "auth_success", "session_duration", "command_sequence",
        F.struct(F.col("device_os").alias("os"), F.col("device_firmware").alias("firmware_version"), F.col("device_mac").alias("mac_address"), F.col("device_protocol").alias("protocol")).alias("device_fingerprint"),
        "bytes_transferred",
    )
    path = scratch_path(spark, "nested")
    nested.write.option("timestampFormat", files.TIME_FORMAT).json(path)
    return _shown(files.read_nested_events(spark, path))


# ---- models --------------------------------------------------------------------------------------


def _outlier_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = ["session_duration", "bytes_transferred", "geo_lat", "recent_failures", "travel_kmh"]
    df = rules.with_entity_rules(_prepared(spark, sf_dir), THRESHOLDS)
    return df.select("event_id", "label_int", *names), names


@query
def ecod_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _outlier_columns(spark, sf_dir)
    return outliers.ecod_exact(materialize(df), names).select("event_id", _r("ecod_score", 4))


@query
def ecod_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted ECOD: ranks of the normal events, scores of all."""
    df, names = _outlier_columns(spark, sf_dir)
    df = materialize(df)
    normal = labels.normal_only(df)
    signs = normal.agg(*[outliers._skew_sign(F.skewness(outliers.finite_or_zero(F.col(c)))) for c in names]).first()
    scored = outliers.with_ecod(df, materialize(outliers.value_ranks(normal, names), "ranks"), names, list(signs))
    return scored.select("event_id", F.round("ecod", 4).alias("ecod_score"))


@query
def outlier_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _outlier_columns(spark, sf_dir)
    df = materialize(df)
    model = outliers.fit(labels.normal_only(df), names, outliers.Params())
    return outliers.with_outliers(df, model).select("event_id", _r("tabular_anomaly_score", 6), "tabular_flag")


_runs: dict[tuple, tuple] = {}


def _run(spark: SparkSession, sf_dir: str) -> tuple:
    """One training run per session and state of the data's files, shared by the model queries."""
    files_ = spark.read.parquet(f"{sf_dir}/events.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    state = files_.distinct().agg(F.count("*"), F.sum(F.xxhash64(*files_.columns).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, tuple(state))
    if key not in _runs:
        _runs[key] = detect.run(_log(spark, sf_dir), SETTINGS)
    return _runs[key]


@query
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored, _ = _run(spark, sf_dir)
    return scored.select("event_id", _r("risk", 4), "predicted_int", "predicted")


@query
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored, _ = _run(spark, sf_dir)
    return serving.triage_queue(scored.where("risk >= 50"), limit=100)


@query
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, report = _run(spark, sf_dir)
    return report.select("metric", "class", _r("value", 6))


@query
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    detector, scored, _ = _run(spark, sf_dir)
    df = explain.explanations(scored, detector.fusion)
    return df.select("event_id", "text", "mitre", _r("risk_score", 4), "predicted_type")


@query
def contamination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which risks lie above the exact 98th percentile."""
    log = _log(spark, sf_dir)
    cut = selection.quantile(log, "risk_stub", 0.98)
    return log.select("event_id", F.lit(round(cut, 9)).alias("cut"), (F.col("risk_stub") > cut).cast("long").alias("flag"))


@query
def joint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk, joint probabilities and label from the chance of an attack and the shares of its kinds; many shares tie."""
    k = F.col("event_id") % 7
    kinds = F.array(*[F.when((k + i) % 3 == 0, 0.25).otherwise(0.125) for i in range(fusion.ATTACKS)])
    df = fusion.fused(_log(spark, sf_dir), F.col("risk_stub") / 100, kinds)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return df.select("event_id", _r("risk", 6), F.round(total + 1e-9, 6).alias("total"), F.col("predicted_int").cast("long").alias("predicted_int"), "predicted")


@query
def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyst's text of every event, from contributions that are exact in binary and tie often."""
    k = F.col("event_id") % 64
    values = [("bytes_transferred_raw", k / 16 - 2), ("hour_sin", 1 - k / 32), ("auth_failure_rate", (k % 4) / 4 - 0.5)]
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")) for n, v in values])
    log = rules.with_rules(_log(spark, sf_dir), THRESHOLDS)
    text = explain.narration(int_to_label(F.col("pred_stub")), F.floor("risk_stub").cast("double"), explain.top_features(parts, 2), F.col("rule_hits"))
    return log.select("event_id", text.alias("text"))


@query
def explanation_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every scored event, whether its contributions and the base add up to what the models say of it."""
    detector, scored, _ = _run(spark, sf_dir)
    rows = explain.with_contributions(scored, detector.fusion)
    gate, kinds = (explain.base_value(f(detector.fusion, spark)) for f in (explain.gate_leaves, explain.attribution_leaves))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v["value"])
    attack = 1 - F.col("probabilities")[0]
    of_gate = F.abs(1 / (1 + F.exp(-(total("shap_values") + gate))) - attack) < 1e-6
    share = F.try_divide(F.element_at("probabilities", F.col("predicted_int") + 1), attack)
    base = F.element_at(F.array(*[F.lit(float(x)) for x in kinds]), F.greatest("predicted_int", F.lit(1)))
    of_kind = F.when(F.col("predicted_int") > 0, F.abs(total("kind_values") + base - share) < 1e-6).otherwise(F.col("kind_values").isNull())
    return rows.select("event_id", of_gate.cast("long").alias("gate"), of_kind.cast("long").alias("kind"))


@query
def clean_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input without null, NaN or infinity, as a sum over the columns."""
    n = F.col("event_id") % 5
    value = F.col("session_duration")
    odd = F.when(n == 0, F.lit(None)).when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, float("-inf")).otherwise(value)
    df = _log(spark, sf_dir).withColumn("odd", odd)
    total = reduce(lambda a, b: a + b, [outliers.matrix(["odd", "session_duration"])[i] for i in range(2)])
    return df.select("event_id", F.round(total, 4).alias("total"))


@query
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each numeric feature; the z-scores in millions, as in `feature_table`."""
    df = features.compute_features(_log(spark, sf_dir))
    shown = {c: F.round(F.col(c) / 1e6, 3) if c.endswith("_zscore") else F.col(c) for c in numeric_features(df.columns)}
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(v).alias("mean")) for c, v in shown.items()])
    return df.agg(cells.alias("c")).select(F.inline("c")).select("feature", _r("mean", 4))


# ---- drift ---------------------------------------------------------------------------------------


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.buckets(_prepared(spark, sf_dir), F.col("label_int") > 0, 6 * HOUR_US)


@query
def drift_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir)


@query
def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the default delta. The sample's rate is steady, so the query plants a shift in its events: from the 16th day on
    every other event counts as anomalous, and from the 24th day on none of these."""
    log = _prepared(spark, sf_dir)
    day = F.date_diff(F.timestamp_micros("ts_us"), F.lit("2024-01-01"))
    odd = (F.col("label_int") > 0) | (day.between(15, 22) & (F.col("event_id") % 2 == 0))
    found = drift.drift_events(drift.buckets(log, odd, 6 * HOUR_US))
    dropped = F.col("metadata")["dropped_buckets"].cast("long").alias("dropped")
    return found.select("cohort", "type", "message", "bucket_us", dropped, F.col("metadata")["rate"].alias("rate"))


@query
def drift_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series after users were reset 15 days in; and which cohorts are watched."""
    series = _series(spark, sf_dir)
    resets = series.where("cohort = 'user'").groupBy("cohort").agg((F.min("bucket_us") + 15 * DAY_US).alias("reset_us"))
    kept = drift.after_reset(series, resets)
    return kept.join(drift.active_cohorts(series), "cohort").groupBy("cohort").agg(F.sum("n").alias("n"), F.count("*").alias("buckets"))


# ---- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return prepared(access_log(events))


@query
def stream_previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "previous")
    stateful.start_previous(_stream(spark, sf_dir), path).awaitTermination()
    df = stateful.PreviousSink(path).rows(spark)
    return df.select(F.col("event_id").cast("string").alias("event_id"), F.coalesce("prev_us", F.lit(0)).alias("prev_us"), F.coalesce("prev_device", F.lit("")).alias("prev_device"))


@query
def stream_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding counts per address, windows that are still open at the end included."""
    panes = stateful.failure_panes(_stream(spark, sf_dir), "source_ip", "12 hours", "1 hour")
    df = stateful.failure_counts(stateful.drained_windows(panes, "source_ip", "entity_id"), "source_ip", "2 days", "12 hours")
    return df.select(F.unix_seconds("window.start").alias("window_start"), "source_ip", "events", "failures", "targets")


@query
def stream_cohort_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = stateful.cohort_rates(_stream(spark, sf_dir), F.col("label_int") > 0, "1 hour", "1 hour")
    df = stateful.drained_windows(rates, "entity_type")
    return df.select(F.unix_seconds("window.start").alias("window_start"), "entity_type", "events", "anomalies")


@query
def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines updated by a stream: a day of feature rows arrives, the stream takes it in, and so on."""
    rows = _behaviour(spark, sf_dir)
    span = DAY_US
    table = materialize(rows.withColumn("slice", F.col("ts_us") - F.pmod("ts_us", F.lit(span))))
    path, sink_path = scratch_path(spark, "feature-stream"), scratch_path(spark, "baseline-stream")
    for (start,) in sorted(table.select("slice").distinct().collect()):
        table.where(F.col("slice") == start).drop("slice").write.mode("append").parquet(path)
        stateful.start_baseline(spark.readStream.schema(rows.schema).parquet(path), sink_path).awaitTermination()
    df = stateful.BaselineSink(sink_path).scored(spark)
    return df.select("event_id", *_scores())
