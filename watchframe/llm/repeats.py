"""Removal of repeated byte strings by bucket-pointer refinement.

Strings of LENGTH bytes that start at two places are found as a suffix array built by bucket pointers finds them: put
places into buckets by a q-gram, then refine a bucket only where it has several members, by the identifiers of the
buckets that its members have at later offsets, and use each identifier again for longer strings.

* Places. Every string of LENGTH bytes is led by one of its q-grams (q = LENGTH / 2), that of the least hash, the last of
  equals. Equal strings have the same leader at the same offset, so it is enough to sort leaders, one in about
  LENGTH / 4 bytes; the strings that a leader leads start at a run of consecutive places.
* Identifiers are two 64-bit polynomial hashes of the content, so a bucket has the same identifier in every task
  without renumbering: of a q-gram; of LENGTH bytes, from the buckets at offsets 0 and LENGTH - q; of a run, from the
  identifiers of its first and last string. Different strings share all 128 bits with probability of about 2^-128 a pair.
* Level 0: buckets by the leader's q-gram. A leader alone in its bucket leads no repeated string.
* Level 1: members are told apart by the identifier of their whole run. Where two runs are equal, all their strings
  are repeated and nothing more is asked. In a bucket of one kind of run that ends it.
* Level 2: in buckets of several kinds, the strings of runs of their own, and of one member of each other kind, are
  told apart one by one.

Documents are dealt by hash into buckets of BUCKET bytes and shuffled once, packed; that exchange is read again at each
level. A task asks about an identifier once per bucket of documents that holds it, so one that a third of all rows
share is asked as often as there are such buckets, and no group is larger. A level sends on what its predecessor left.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from watchframe.llm.common import raw_texts, read_documents, text_buckets
from watchframe.llm.packed import packed, unpacked

LENGTH = 400
#: Bytes of text in a bucket of documents; places that are hashed at once.
BUCKET, SEGMENT = 4 << 20, 1 << 16
#: Byte values and bases of the two polynomial hashes, modulo 2^64.
_DRAWN = np.random.default_rng(12)
_VALUES = _DRAWN.integers(0, 1 << 64, (2, 256), np.uint64)
_BASES = [int(x) | 5 for x in _DRAWN.integers(0, 1 << 64, 2, np.uint64)]
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)  # odd constants of splitmix64
_HALF = np.uint64(32)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> _HALF)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a string whose parts, or whose beginning and end, have these identifiers."""
    return _scrambled(a * _MIX[0] + _scrambled(b))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Finder:
    """Leaders, runs and identifiers in a bucket of documents; `ends` are the ends of its texts in `data`."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.gram = length, -(-length // 2)
        self.window = length - self.gram + 1
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        n = min(SEGMENT, len(self.data)) + length + 1
        self.powers = [_powers(b, n) for b in _BASES]
        self.inverses = [_powers(pow(b, -1, 1 << 64), n) for b in _BASES]

    def sums(self, lane: int, a: int, b: int) -> np.ndarray:
        """Hashes of the prefixes of data[a:b]."""
        out = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUES[lane][self.data[a:b]] * self.powers[lane][: b - a], out=out[1:])
        return out

    def segments(self) -> Iterator[tuple[int, int]]:
        last = len(self.data) - self.length + 1
        for a in range(0, last, SEGMENT):
            yield a, min(a + SEGMENT, last)

    def runs(self) -> np.ndarray:
        """Rows (first place, last place, bucket of the leader) in order, as unsigned integers."""
        out, g = [], self.gram
        bits = int(SEGMENT + self.window).bit_length()
        mask = np.uint64((1 << bits) - 1)
        for a, b in self.segments():
            sums = self.sums(0, a, b - 1 + self.length)
            hashed = _scrambled((sums[g:] - sums[:-g]) * self.inverses[0][: len(sums) - g])
            least = (hashed & ~mask) | (mask - np.arange(len(hashed), dtype=np.uint64))
            size = 1
            while size < self.window:  # the least of `size` neighbours, doubling
                step = min(size, self.window - size)
                least = np.minimum(least[:-step], least[step:])
                size += step
            leader = (mask - (least & mask)).astype(np.int64)
            whole = np.ones(b - a, bool)
            for e in self.ends[np.searchsorted(self.ends, a) : np.searchsorted(self.ends, b + self.length, "right")].tolist():
                whole[max(0, e - self.length + 1 - a) : max(0, e - a)] = False
            p = np.flatnonzero(whole)
            if not len(p):
                continue
            at = leader[p]
            cut = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(p) != 1)) + 1])
            end = np.append(cut[1:], len(p)) - 1
            out.append(np.stack([p[cut] + a, p[end] + a, at[cut] + a, hashed[at[cut]].view(np.int64)], axis=1))
        if not out:
            return np.zeros((0, 3), np.uint64)
        rows = np.concatenate(out)
        same = (rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 0] == rows[:-1, 1] + 1)  # a run goes on in the next segment
        first = np.concatenate([[0], np.flatnonzero(~same) + 1])
        last = np.append(first[1:], len(rows)) - 1
        return np.stack([rows[first, 0], rows[last, 1], rows[first, 3]], axis=1).view(np.uint64)

    def strings(self, places: np.ndarray) -> np.ndarray:
        """Identifiers [place, 2] of the strings at places in ascending order."""
        out, g, shift = np.empty((len(places), 2), np.uint64), self.gram, self.length - self.gram
        for a, b in self.segments():
            i, j = np.searchsorted(places, (a, b))
            if i == j:
                continue
            p = (places[i:j] - a).astype(np.int64)
            for lane in range(2):
                sums, inverse = self.sums(lane, a, a + int(p[-1]) + self.length), self.inverses[lane]
                first = (sums[p + g] - sums[p]) * inverse[p]
                later = (sums[p + shift + g] - sums[p + shift]) * inverse[p + shift]
                out[i:j, lane] = joined(first, later)
        return out

    def kinds(self, runs: np.ndarray) -> np.ndarray:
        """Identifiers [run, 2] of whole runs."""
        first, last = self.strings(runs[:, 0].view(np.int64)), self.strings(runs[:, 1].view(np.int64))
        span = (runs[:, 1] - runs[:, 0]) * _MIX[0]
        return joined(first, last + span[:, None])

    def cut(self, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
        """Maximal spans (text, start, end) covered by intervals in ascending order, none of which crosses texts."""
        if not len(start):
            return []
        text = np.searchsorted(self.ends, start, "right")
        new = np.concatenate([[True], (start[1:] > end[:-1]) | (text[1:] != text[:-1])])
        at = np.flatnonzero(new)
        begin = np.concatenate([[0], self.ends])[text[at]]
        return list(zip(text[at].tolist(), (start[at] - begin).tolist(), (end[np.append(at[1:], len(start)) - 1] - begin).tolist(), strict=True))


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, a row of each group) of rows of unsigned integers."""
    order = np.lexsort(rows.T[::-1])
    sorted_ = rows[order]
    new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _found(rows: np.ndarray, answers: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of the answer that equals each row, 0 without one."""
    group, first = _grouped(np.concatenate([answers, rows]))
    value = np.zeros(len(first), np.int64)
    value[group[: len(answers)]] = values
    return value[group[len(answers) :]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _spread(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, run) for every place of the runs."""
    n = (runs[:, 1] - runs[:, 0]).astype(np.int64) + 1
    run = np.repeat(np.arange(len(runs)), n)
    return runs[run, 0].view(np.int64) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n), run


#: What a run, or a string, was found to be.
WHOLE, ASK = 1, 2


class Level:
    """What a bucket of documents asks at each level, and what it makes of the answers."""

    def __init__(self, length: int, kind: pa.DataType):
        self.length, self.kind = length, kind

    def finder(self, packs: pa.Table) -> tuple[Finder, list[pa.Array]]:
        texts, keys = [], []
        for batch in unpacked(packs):
            keys.append(batch.column(0))
            texts += raw_texts(batch.column(1))
        return Finder(texts, self.length), keys

    def grams(self, packs: pa.Table) -> pa.Table:
        """(gram, kind, bucket, n): each leader's q-gram once; `kind` is of its runs, or null where they differ."""
        finder, _ = self.finder(packs)
        runs = finder.runs()
        kinds = finder.kinds(runs)[:, 0]
        order = np.lexsort((kinds, runs[:, 2]))
        gram, kind = runs[order, 2], kinds[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(gram)) - 1 if len(gram) else first
        differ = kind[first] != kind[last]
        kind = pa.array(kind[first].view(np.int64), mask=differ)
        return self.table(packs, {"gram": _signed(gram[first]), "kind": kind, "n": pa.array(np.minimum(last - first + 1, 2).astype(np.int8))})

    def table(self, packs: pa.Table, columns: dict) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table(columns | {"bucket": pa.array(np.full(n, packs["bucket"][0].as_py(), np.int32))})

    def runs(self, packs: pa.Table, answers: pa.Table) -> pa.Table:
        """(a, b, mixed, bucket, n): the kinds of runs whose leader's q-gram is not alone."""
        if not answers.num_rows:
            return self.table(packs, {"a": _signed(np.zeros(0, np.int64)), "b": _signed(np.zeros(0, np.int64)), "mixed": pa.array([], pa.bool_()), "n": pa.array([], pa.int8())})
        finder, _ = self.finder(packs)
        runs = finder.runs()
        value = _found(runs[:, 2:], answers["gram"].to_numpy().view(np.uint64)[:, None], 1 + answers["mixed"].to_numpy(zero_copy_only=False))
        runs, value = runs[value > 0], value[value > 0]
        kinds = finder.kinds(runs)
        group, first = _grouped(kinds)
        n = np.minimum(np.bincount(group, minlength=len(first)), 2).astype(np.int8)
        return self.table(packs, {"a": _signed(kinds[first, 0]), "b": _signed(kinds[first, 1]), "mixed": pa.array(value[first] == 2), "n": pa.array(n)})

    def judged(self, packs: pa.Table, answers: pa.Table) -> tuple[Finder, list[pa.Array], np.ndarray, np.ndarray]:
        """The runs that answers of level 1 speak of, and what they say."""
        finder, keys = self.finder(packs)
        runs = finder.runs()
        pairs = np.stack([answers[c].to_numpy().view(np.uint64) for c in "ab"], axis=1)
        value = _found(finder.kinds(runs), pairs, answers["value"].to_numpy())
        return finder, keys, runs[value > 0], value[value > 0]

    def strings(self, packs: pa.Table, answers: pa.Table) -> pa.Table:
        """(a, b, bucket, n): the strings of runs that are told apart one by one."""
        if not (answers.num_rows and max(answers["value"].to_pylist()) >= ASK):
            return self.table(packs, {"a": _signed(np.zeros(0, np.int64)), "b": _signed(np.zeros(0, np.int64)), "n": pa.array([], pa.int8())})
        finder, _, runs, value = self.judged(packs, answers)
        runs, value = runs[value >= ASK], value[value >= ASK]
        place, run = _spread(runs)
        ids = finder.strings(place)
        group, first = _grouped(ids)
        # a run that is repeated elsewhere stands for two, so that others find its strings
        n = np.minimum(np.bincount(group, weights=np.where(value[run] & WHOLE, 2, 1), minlength=len(first)), 2).astype(np.int8)
        return self.table(packs, {"a": _signed(ids[first, 0]), "b": _signed(ids[first, 1]), "n": pa.array(n)})

    def kept(self, packs: pa.Table, answers: pa.Table) -> pa.Table:
        """(key, n_bytes, spans, kept)"""
        about_strings = answers["level"].to_numpy() == 2
        finder, keys, runs, value = self.judged(packs, answers.filter(pa.array(~about_strings)))
        place, _ = _spread(runs[value == ASK])
        strings = answers.filter(pa.array(about_strings))
        if strings.num_rows and len(place):
            pairs = np.stack([strings[c].to_numpy().view(np.uint64) for c in "ab"], axis=1)
            place = place[_found(finder.strings(place), pairs, np.ones(len(pairs), np.int64)) > 0]
        else:
            place = place[:0]
        whole = runs[(value & WHOLE) > 0].view(np.int64)
        start, end = np.concatenate([whole[:, 0], place]), np.concatenate([whole[:, 1], place]) + self.length
        order = np.argsort(start, kind="stable")
        spans: list[list[dict]] = [[] for _ in finder.ends]
        for text, a, b in finder.cut(start[order], end[order]):
            spans[text].append({"start": a, "end": b})
        begin, kept = 0, []
        for own, e in zip(spans, finder.ends.tolist(), strict=True):
            edges = [begin, *[begin + x for s in own for x in (s["start"], s["end"])], e]
            kept.append(b"".join([finder.data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            begin = e
        sizes = np.diff(finder.ends, prepend=0)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"key": pa.chunked_array(keys, self.kind), "n_bytes": pa.array(sizes), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})


def _told(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` with the number of places that share the keys, in `total`."""
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(key, n_bytes, spans array<struct<start, end>>, kept binary) of every row of `docs`.

    A text is its UTF-8 bytes. Each byte covered by a string of `length` bytes that also starts elsewhere, in this text
    or another, is cut; `spans` are the maximal cut runs and `kept` the rest. Strings never cross texts and are judged
    on the input. A null text is empty; texts shorter than `length` stay whole. Rows that repeat, null keys included,
    are places of their own, so repeated rows of long texts lose all. An empty table gives an empty table; other
    columns are left out. Memory: a bucket of documents, one text at least, and about 80 bytes for each of its places that level 2
    tells apart.
    """
    packs, _ = packed(docs, [key, text], text, text_buckets(docs, text, bucket))
    kind = dict(docs.dtypes)[key]

    def dealt(columns: DataFrame, f: Callable, schema: str) -> DataFrame:
        return packs.groupBy("bucket").cogroup(columns.groupBy("bucket")).applyInArrow(lambda left, right: f(left, right), schema)

    level = Level(length, to_arrow_type(docs.schema[key].dataType))
    grams = packs.groupBy("bucket").applyInArrow(lambda table: level.grams(table), "gram long, kind long, n byte, bucket int")
    same = Window.partitionBy("gram")
    grams = _told(grams, "gram").withColumn("mixed", (F.count("kind").over(same) < F.count("*").over(same)) | (F.min("kind").over(same) < F.max("kind").over(same)))
    grams = grams.filter("total > 1").select("bucket", "gram", "mixed")
    runs = _told(dealt(grams, level.runs, "a long, b long, mixed boolean, n byte, bucket int"), "a", "b")
    alone = F.col("total") == 1
    speaks = F.col("mixed") & (alone | (F.col("bucket") == F.min("bucket").over(Window.partitionBy("a", "b"))))
    value = F.when(alone, 0).otherwise(WHOLE) + F.when(speaks, ASK).otherwise(0)
    runs = runs.select("bucket", "a", "b", value.cast("long").alias("value")).filter("value > 0")
    strings = _told(dealt(runs, level.strings, "a long, b long, n byte, bucket int"), "a", "b").filter("total > 1")
    answers = runs.withColumn("level", F.lit(1)).unionByName(strings.select("bucket", "a", "b", F.lit(1).cast("long").alias("value"), F.lit(2).alias("level")))
    found = dealt(answers, level.kept, f"key {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return found.select(F.col("key").alias(key), "n_bytes", "spans", "kept")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op12_repeats": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, base, h[2 * base + 1 : 2 * base + 1798] AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399, 500)) AS base FROM d WHERE len(h) >= 800)),
places AS (SELECT r, base + i AS p, hash(h[2 * i + 1 : 2 * i + 800]) AS k FROM (SELECT r, base, h, unnest(range(0, least(500, len(h) // 2 - 399))) AS i FROM pieces)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM places) WHERE n > 1),
runs AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS span FROM (
  SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 1 ELSE 0 END AS new FROM again)),
spans AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY r, span),
cut AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM spans),
parts AS (SELECT r, string_agg(h[2 * since + 1 : 2 * a], '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || h[2 * last + 1 :], h))) AS kept_sha256
FROM d LEFT JOIN parts USING (r)
"""
}
