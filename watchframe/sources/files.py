"""Access logs, labels, profiles and reports as files: readers and writers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from watchframe.schema import COMMANDS, FLAT_EVENT, LABEL, NESTED_EVENT, PROFILE


# text form of timestamps in files; they carry no zone and mean UTC, the session time zone
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
READ_FORMAT = "yyyy-MM-dd['T'][' ']HH:mm:ss[.SSSSSS][.SSS][XXX]"


def _as_text_lists(schema: StructType) -> StructType:
    """CSV form of a schema: lists are text."""
    fields = [f if not isinstance(f.dataType, ArrayType) else type(f)(f.name, StringType(), True) for f in schema]
    return StructType(fields)


def _read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, in any column order: read as text by header name, then cast.

    A schema given to the CSV reader is applied by position, and the column order of these files is not
    fixed. `try_cast` turns unreadable values into null, which validation reports.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    wanted = [
        (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema
    ]
    return raw.select(*wanted)


def read_events(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Flat events from CSV, JSON or parquet, command text decoded to an array."""
    if format == "csv":
        df = _read_csv(spark, path, FLAT_EVENT)
    elif format == "json":
        df = spark.read.schema(FLAT_EVENT).option("timestampFormat", READ_FORMAT).json(path)
    else:
        df = spark.read.format(format).load(path)
    return with_commands(df)


def read_nested_events(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Flat events from the nested form."""
    nested = spark.read.schema(NESTED_EVENT).option("timestampFormat", READ_FORMAT).format(format).load(path)
    return flatten_events(nested)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, LABEL)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Entity profiles; the two list columns are decoded from text."""
    df = _read_csv(spark, path, _as_text_lists(PROFILE))
    return df.withColumns({c: decode_list(F.col(c)) for c in ("resource_set", "typical_commands")})


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A metrics report written by `write_report`."""
    return spark.read.schema("metric string, class string, value double").json(path)


def flatten_events(nested: DataFrame) -> DataFrame:
    """Nested events to the flat layout."""
    geo, device = F.col("geo_location"), F.col("device_fingerprint")
    moved = {
        "geo_lat": geo["lat"],
        "geo_lon": geo["lon"],
        "geo_city": geo["city"],
        "geo_country": geo["country"],
        "device_os": device["os"],
        "device_firmware": device["firmware_version"],
        "device_mac": device["mac_address"],
        "device_protocol": device["protocol"],
    }
    return nested.withColumns(moved).select(*FLAT_EVENT.fieldNames())


# ---- commands ------------------------------------------------------------------------------------


def decode_list(text: Column) -> Column:
    """Items of the text of a list such as `['a', "b"]`; anything else gives an empty array. Never evaluated.

    Within quotes a backslash makes the next character a plain one.
    """
    quoted = r"""'((?:[^'\\]|\\[\s\S])*)'|"((?:[^"\\]|\\[\s\S])*)\""""
    items = F.transform(
        F.regexp_extract_all(text, F.lit(quoted), F.lit(0)),
        lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\([\s\S])", "$1"),
    )
    listed = text.rlike(r"^\s*\[[\s\S]*\]\s*$")
    return F.when(F.coalesce(listed, F.lit(False)), items).otherwise(F.array().cast("array<string>"))


def with_commands(df: DataFrame) -> DataFrame:
    """`command_sequence` as array<string>, decoded when it is text."""
    commands = F.col("command_sequence")
    if isinstance(df.schema["command_sequence"].dataType, StringType):
        decoded = decode_list(commands)
    else:
        decoded = F.coalesce(commands, F.array().cast("array<string>"))
    return df.withColumn("command_sequence", decoded)


def encode_commands(commands: Column, vocabulary: list[str] | None = None) -> Column:
    """Command ids: position in the vocabulary + 1, unknown commands 0."""
    names = COMMANDS if vocabulary is None else vocabulary
    ids = F.create_map(*[F.lit(v) for i, name in enumerate(names) for v in (name, i + 1)])
    return F.transform(commands, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(0)))


# ---- sinks ---------------------------------------------------------------------------------------


def _quoted(item: Column) -> Column:
    """An item as `decode_list` reads it: quotes and backslashes get a backslash."""
    return F.concat(F.lit("'"), F.regexp_replace(item, r"([\\'])", r"\\$1"), F.lit("'"))


def write_dataset(events: DataFrame, path: str, profiles: DataFrame | None = None, format: str = "csv") -> None:
    """Labelled events as a log without labels, a label table and, when given, the profiles."""

    def put(df: DataFrame, name: str) -> None:
        if format == "csv":
            lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
            quoted = {c: F.format_string("[%s]", F.array_join(F.transform(c, _quoted), ", ")) for c in lists}
            writer = df.withColumns(quoted).write.option("header", True).option("escape", '"')
            writer.option("timestampFormat", TIME_FORMAT).csv(f"{path}/{name}")
        else:
            df.write.format(format).save(f"{path}/{name}")

    put(events.drop("label"), "access_logs")
    put(events.select("event_id", "label"), "hidden_labels")
    if profiles is not None:
        put(profiles, "entity_profiles")


def write_report(report: DataFrame, path: str) -> None:
    """Metric rows (metric, class, value) as JSON lines."""
    report.select("metric", "class", "value").write.json(path)
