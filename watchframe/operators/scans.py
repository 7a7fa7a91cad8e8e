"""Ordered scans per key that do not put a hot key into one task.

Nearly every operator of this engine looks backwards: running sums, the previous event, the first event,
sums over the last minutes. For most keys a Spark window does that. A key that holds a large share of
all rows would make its window a single huge task, so such keys take another road with the same result:

* the rows of hot keys are range-partitioned by (key, order), which cuts a long key into blocks of
  about equal size wherever it is long, even inside one timestamp;
* each block is scanned by a window of its own;
* one summary row per block (sums, first, last) is scanned in block order and joined back as carry.

The order of rows is (ts_us, event_id); rows that share both are taken in any order, on either road, and a null
key is a key like others. A key counts as hot above `watchframe.hotRows` rows; blocks aim at `watchframe.blockRows` rows.

Frames over the last `span` are never sliding frames (Spark recomputes those for every row). They are
the difference of two growing frames, or on the split road a running sum over arrivals and departures.
All of it is linear in the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchframe.functions.scalars import HOUR_US, MINUTE_US, SECOND_US
from watchframe.session import materialize, setting

ORDER = ("ts_us", "event_id")
HOT_ROWS = 4_000_000
BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Wanted:
    """What one scan adds to the rows, as name -> column.

    sums: running sum up to and including the row (null counts as 0)
    prev: value on the key's previous row
    next: value on the key's next row
    first: value on the key's first row
    fills: last non-null value on any earlier row
    totals: sum over all rows of the key
    tails: name -> (column, k), sum over the last k rows including this one
    """

    sums: Mapping[str, Column] = field(default_factory=dict)
    prev: Mapping[str, Column] = field(default_factory=dict)
    next: Mapping[str, Column] = field(default_factory=dict)
    first: Mapping[str, Column] = field(default_factory=dict)
    fills: Mapping[str, Column] = field(default_factory=dict)
    totals: Mapping[str, Column] = field(default_factory=dict)
    tails: Mapping[str, tuple[Column, int]] = field(default_factory=dict)

    def __or__(self, other: Wanted) -> Wanted:
        return Wanted(**{f.name: {**getattr(self, f.name), **getattr(other, f.name)} for f in fields(self)})


@dataclass(frozen=True)
class Spec:
    """Everything to compute on one partitioning by a key, so that operators can share it.

    pairs: scans keyed by (key, another column); their results may be used in the two below
    want: the scan keyed by the key
    moves: name -> (span_us, gain, loss), see `plain_slide`
    inputs: columns the above read besides the key and event_id; with these named, only they take the
        split road, and the results are joined back to whole rows by the id that a row was stored with
    """

    pairs: Mapping[tuple[str, ...], Wanted] = field(default_factory=dict)
    want: Wanted = field(default_factory=Wanted)
    moves: Mapping[str, tuple[int, Column, Column]] = field(default_factory=dict)
    inputs: frozenset[str] = frozenset()

    def __or__(self, other: Spec) -> Spec:
        pairs = {k: self.pairs.get(k, Wanted()) | other.pairs.get(k, Wanted()) for k in {**self.pairs, **other.pairs}}
        return Spec(pairs, self.want | other.want, {**self.moves, **other.moves}, self.inputs | other.inputs)

    def steps(self, key: str) -> Callable[[DataFrame, Road], DataFrame]:
        def run(df: DataFrame, road: Road) -> DataFrame:
            for keys, want in self.pairs.items():
                df = road.scan(df, keys, want)
            df = road.scan(df, [key], self.want)
            return road.slide(df, [key], self.moves) if self.moves else df

        return run

    def over(self, df: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
        """`df` with everything added; `source` as in `per_key`."""
        return per_key(df, key, self.steps(key), source, sorted(self.inputs - {key}))


class Road(NamedTuple):
    """The two scan functions a set of steps is written against."""

    scan: Callable[..., DataFrame]
    slide: Callable[..., DataFrame]


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys above the row limit, or None. At most rows / limit of them exist."""
    limit = setting(df, "hotRows", HOT_ROWS)
    if df.count() <= limit:
        return None
    counts = df.groupBy(*keys).count().where(F.col("count") > limit)
    hot = materialize(counts.select(*keys), "hot")
    return None if hot.isEmpty() else hot


def per_key(
    df: DataFrame,
    key: str,
    steps: Callable[[DataFrame, Road], DataFrame],
    source: DataFrame | None = None,
    inputs: Sequence[str] = (),
) -> DataFrame:
    """Run `steps` on all rows: hot keys on the split road, the others on plain windows.

    The plain road is hash-partitioned by `key` once; windows keyed by (key, anything) reuse that. Keys
    are counted on `source` when given: a table with the same keys that is cheaper to read than `df`.
    """
    hot = hot_keys(df if source is None else source, [key])
    if hot is None:
        return steps(df.repartition(key), PLAIN)
    # stored once: both roads read it, and a row is told apart by the id that it was written with, as event_id
    # may repeat or be null
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    hot = hot.select(F.col(key).alias("_hot"))
    is_hot = df[key].eqNullSafe(hot["_hot"])
    cold = steps(df.join(hot, is_hot, "left_anti").drop("_row").repartition(key), PLAIN)
    rows = df.join(hot, is_hot, "left_semi")
    if not inputs:
        return cold.unionByName(steps(rows.drop("_row"), SPLIT))
    # the split road stores its rows between scans, so only what it reads goes there
    found = materialize(steps(rows.select("_row", key, "event_id", *inputs), SPLIT).drop(key, "event_id", *inputs), "found")
    return cold.unionByName(rows.join(found, "_row").drop("_row"))


def running_index(df: DataFrame, name: str, source: DataFrame | None = None) -> DataFrame:
    """1-based position of each row in the whole log.

    Hours, minutes or seconds are the blocks, the longest of which none is too full. If a second is too
    full, range partitions are.
    """
    source = df if source is None else source
    width = block_width(source)
    if width is None:
        return split_scan(df, [], Wanted(sums={name: F.lit(1)}))
    # blocks are counted on the narrow table; hours pass one task, at most 8,784 a year, and blocks one per hour
    counts = source.groupBy(_start("ts_us", width).alias("_at")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_hour", _start("_at", HOUR_US))
    hours = counts.groupBy("_hour").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col("_hour").alias("_h"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_hour").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    counts = counts.join(hours, counts["_hour"].eqNullSafe(hours["_h"])).select("_at", (F.col("_ahead") + F.col("_earlier")).alias("_ahead"))
    if width == HOUR_US:  # so few go to every task; the rows, which are wide here, need no second shuffle
        counts = F.broadcast(counts)
    rows = df.withColumn("_block", _start("ts_us", width))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_block").orderBy(*ORDER)))
    joined = rows.join(counts, rows["_block"].eqNullSafe(counts["_at"]))
    return joined.select(*df.columns, (F.col("_place") + F.col("_ahead")).alias(name))


def _start(column: str, width: int) -> Column:
    return F.col(column) - F.pmod(column, F.lit(width))


def block_width(df: DataFrame, keys: Sequence[str] = ()) -> int | None:
    """Longest time block in which no stretch of the log, or of a key of it, exceeds the row limit."""
    limit = setting(df, "hotRows", HOT_ROWS)
    if df.count() <= limit:
        return HOUR_US
    counts = materialize(df.groupBy(*keys, _start("ts_us", SECOND_US).alias("s")).agg(F.count("*").alias("n")), "seconds")
    for width in (HOUR_US, MINUTE_US, SECOND_US):
        fullest = counts.groupBy(*keys, _start("s", width)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if fullest <= limit:
            return width
    return None


def global_scan(df: DataFrame, want: Wanted, order: Sequence[str]) -> DataFrame:
    """Scan a whole table in `order`: one window if it fits a block, else range partitions."""
    df = materialize(df, "ordered")
    if df.count() <= setting(df, "blockRows", BLOCK_ROWS):
        return plain_scan(df, [], want, order)
    return split_scan(df, [], want, order)


# ---- plain road ---------------------------------------------------------------------------------


def plain_scan(df: DataFrame, keys: Sequence[str], want: Wanted, order: Sequence[str] = ORDER) -> DataFrame:
    win = Window.partitionBy(*keys).orderBy(*order)
    run = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = win.rowsBetween(Window.unboundedPreceding, -1)
    new = {n: F.sum(F.coalesce(c, F.lit(0))).over(run) for n, c in want.sums.items()}
    new |= {n: F.lag(c).over(win) for n, c in want.prev.items()}
    new |= {n: F.lead(c).over(win) for n, c in want.next.items()}
    new |= {n: F.first(c).over(run) for n, c in want.first.items()}
    new |= {n: F.last(c, ignorenulls=True).over(past) for n, c in want.fills.items()}
    new |= {n: F.sum(F.coalesce(c, F.lit(0))).over(Window.partitionBy(*keys)) for n, c in want.totals.items()}
    for n, (c, k) in want.tails.items():
        older = win.rowsBetween(Window.unboundedPreceding, -k)
        new[n] = F.sum(c).over(run) - F.coalesce(F.sum(c).over(older), F.lit(0))
    return df.withColumns(new) if new else df


def plain_slide(df: DataFrame, keys: Sequence[str], moves: Mapping[str, tuple[int, Column, Column]]) -> DataFrame:
    """name -> (span_us, gain, loss): sum of gain on rows up to this one, minus loss on rows older than the span.

    With gain == loss this is the sum over the last `span_us`, both ends included, seen in row order.
    The order by time alone needs no second sort, as rows already lie in (time, event) order.
    """
    run = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    by_time = Window.partitionBy(*keys).orderBy("ts_us")
    gains = {f"_gain_{n}": F.sum(gain).over(run) for n, (_, gain, _) in moves.items()}
    losses = {}
    for n, (span, _, loss) in moves.items():
        gone = F.sum(loss).over(by_time.rangeBetween(Window.unboundedPreceding, -span - 1))
        losses[n] = F.col(f"_gain_{n}") - F.coalesce(gone, F.lit(0))
    return df.withColumns(gains).withColumns(losses).drop(*gains)


# ---- split road ---------------------------------------------------------------------------------


def split_scan(df: DataFrame, keys: Sequence[str], want: Wanted, order: Sequence[str] = ORDER) -> DataFrame:
    """`plain_scan` with every key cut into blocks of consecutive rows."""
    parts = max(1, math.ceil(df.count() / setting(df, "blockRows", BLOCK_ROWS)))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("_block", F.spark_partition_id())
    # written out: the block of a row must be the same for the rows and for the summaries
    return _carry(materialize(ranged, "blocks"), keys, want, order)


def _carry(df: DataFrame, keys: Sequence[str], want: Wanted, order: Sequence[str]) -> DataFrame:
    """Scan inside (keys, _block), then add what earlier blocks of the key hand over. Drops `_block`."""
    by_block = [*keys, "_block"]
    win = Window.partitionBy(*by_block).orderBy(*order)
    run = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = win.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)

    # struct-wrapped, so that a null value differs from "no such row"
    prev = F.struct(*[c.alias(n) for n, c in want.prev.items()])
    following = F.struct(*[c.alias(n) for n, c in want.next.items()])
    first = F.struct(*[c.alias(n) for n, c in want.first.items()])
    inside = {f"_i_{n}": F.sum(F.coalesce(c, F.lit(0))).over(run) for n, c in want.sums.items()}
    inside |= {f"_i_{n}": F.last(c, ignorenulls=True).over(past) for n, c in want.fills.items()}
    inside |= {f"_i_{n}": F.sum(c).over(run) for n, (c, _) in want.tails.items()}
    ends = {f"_e_{n}": F.sum(F.coalesce(c, F.lit(0))) for n, c in want.sums.items()}
    ends |= {f"_e_{n}": F.sum(F.coalesce(c, F.lit(0))) for n, c in want.totals.items()}
    ends |= {f"_e_{n}": F.max_by(c, F.when(c.isNotNull(), at)) for n, c in want.fills.items()}
    if want.prev:
        inside["_i_prev"] = F.lag(prev).over(win)
        ends["_e_prev"] = F.max_by(prev, at)
    if want.next:
        inside["_i_next"] = F.lead(following).over(win)
        ends["_e_next"] = F.min_by(following, at)
    if want.first:
        inside["_i_first"] = F.first(first).over(run)
        ends["_e_first"] = F.min_by(first, at)
    if want.tails:
        inside["_pos"] = F.row_number().over(win)
    rows = df.withColumns(inside)
    summary = df.groupBy(*by_block).agg(*[c.alias(n) for n, c in ends.items()]) if ends else df.select(*by_block).distinct()
    for n, (_, k) in want.tails.items():
        rows = rows.withColumn(
            f"_i_{n}", F.col(f"_i_{n}") - F.coalesce(F.lag(f"_i_{n}", k).over(win), F.lit(0))
        )
        summary = _join_blocks(summary, _tail(df, by_block, order, n, *want.tails[n]), by_block, "inner")

    blocks = Window.partitionBy(*keys).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry = {f"_c_{n}": F.sum(f"_e_{n}").over(earlier) for n in want.sums}
    carry |= {f"_c_{n}": F.sum(f"_e_{n}").over(Window.partitionBy(*keys)) for n in want.totals}
    carry |= {f"_c_{n}": F.last(f"_e_{n}", ignorenulls=True).over(earlier) for n in want.fills}
    if want.prev:
        carry["_c_prev"] = F.lag("_e_prev").over(blocks)
    if want.next:
        carry["_c_next"] = F.lead("_e_next").over(blocks)
    if want.first:
        carry["_c_first"] = F.first("_e_first").over(earlier)
    for n, (_, k) in want.tails.items():
        lists = F.collect_list(f"_e_{n}").over(blocks.rowsBetween(1 - k, -1))
        carry[f"_c_{n}"] = F.slice(F.flatten(F.reverse(lists)), 1, k - 1)
    handed = summary.select(*by_block, *[c.alias(n) for n, c in carry.items()])

    joined = _join_blocks(rows, handed, by_block, "left")
    out = {n: F.col(f"_i_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in want.sums}
    out |= {n: F.col(f"_c_{n}") for n in want.totals}
    out |= {n: F.coalesce(F.col(f"_i_{n}"), F.col(f"_c_{n}")) for n in want.fills}
    out |= {n: F.coalesce(F.col("_i_prev"), F.col("_c_prev")).getField(n) for n in want.prev}
    out |= {n: F.coalesce(F.col("_i_next"), F.col("_c_next")).getField(n) for n in want.next}
    out |= {n: F.coalesce(F.col("_c_first"), F.col("_i_first")).getField(n) for n in want.first}
    for n, (_, k) in want.tails.items():
        missing = F.greatest(F.lit(k) - F.col("_pos"), F.lit(0))
        older = F.slice(F.coalesce(F.col(f"_c_{n}"), F.array()), F.lit(1), missing)
        out[n] = F.col(f"_i_{n}") + F.aggregate(older, F.lit(0).cast("long"), lambda a, v: a + v)
    keep = [c for c in df.columns if c != "_block"]
    return joined.select(*keep, *[c.alias(n) for n, c in out.items()])


def _join_blocks(df: DataFrame, more: DataFrame, by_block: Sequence[str], how: str) -> DataFrame:
    """Join by keys and block; a null key is a key like others."""
    named = more.select(*[F.col(c).alias(f"_b_{c}") for c in by_block], *[c for c in more.columns if c not in by_block])
    same = reduce(and_, [df[c].eqNullSafe(named[f"_b_{c}"]) for c in by_block])
    return df.join(named, same, how).drop(*[f"_b_{c}" for c in by_block])


def _tail(df: DataFrame, by_block: Sequence[str], order: Sequence[str], name: str, value: Column, k: int) -> DataFrame:
    """The last k-1 values of each block, newest first."""
    back = Window.partitionBy(*by_block).orderBy(*[F.desc(c) for c in order])
    last = df.select(*by_block, value.cast("long").alias("_v"), F.row_number().over(back).alias("_r")).where(
        F.col("_r") < k
    )
    pairs = F.array_sort(F.collect_list(F.struct("_r", "_v")))
    return last.groupBy(*by_block).agg(F.transform(pairs, lambda p: p["_v"]).alias(f"_e_{name}"))


def split_slide(df: DataFrame, keys: Sequence[str], moves: Mapping[str, tuple[int, Column, Column]]) -> DataFrame:
    """`plain_slide` as running sums over arrivals and, a span later, departures; one pass per span."""
    for span in sorted({span for span, _, _ in moves.values()}):
        df = _sweep(df, keys, span, {n: (gain, loss) for n, (s, gain, loss) in moves.items() if s == span})
    return df


def _sweep(df: DataFrame, keys: Sequence[str], span_us: int, moves: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    arrive = df.withColumns({f"_m_{n}": gain.cast("long") for n, (gain, _) in moves.items()})
    arrive = arrive.withColumn("_leaving", F.lit(0))
    losses = {f"_m_{n}": -loss.cast("long") for n, (_, loss) in moves.items()}
    held = {*keys, "event_id"}
    leave = df.withColumns(losses).where(" or ".join(f"{n} <> 0" for n in losses))
    leave = leave.select(
        *[F.col(f.name) if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != "ts_us"],
        (F.col("ts_us") + span_us).alias("ts_us"),
        *losses,
        F.lit(1).alias("_leaving"),
    )
    want = Wanted(sums={n: F.col(f"_m_{n}") for n in moves})
    # a row leaves only after every arrival at the same microsecond has been counted
    both = split_scan(arrive.unionByName(leave), keys, want, ("ts_us", "_leaving", "event_id"))
    return both.where("_leaving = 0").drop("_leaving", *losses)


PLAIN = Road(plain_scan, plain_slide)
SPLIT = Road(split_scan, split_slide)
