"""Ranked lexical search by bag deduplication.

A document matters to a query set only through its bag: how often it holds each term of the items' vocabulary, and
its length norm m. Documents are cut down to bags, equal bags (found by hash, verified by comparing them whole) are
one class, a class is scored once against all items, and only the classes that can reach an item's result are
expanded to their members, smallest doc_id first. A class never holds more members than a result has rows, so a bag
that a third of all documents share is no larger group than any other.

Items are asked in blocks whose vocabulary and score table are bounded (ITEMS, TERMS); a block is what goes to tasks.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from watchframe.llm.common import give_back, raw_texts, read_documents, slices
from watchframe.session import materialize, scratch_path

K = 50
#: Items, and pairs of item and term, in a block (one item at least).
ITEMS, TERMS = 2048, 1 << 18
#: Bytes of a text that are split at once; numbers in a table of scores, or of postings, at once.
PIECE, ELEMENTS = 1 << 20, 1 << 21

#: Terms are runs of digits, letters and anything beyond ASCII; only A-Z are lower-cased.
_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time; a term is never cut."""
    spaced, a = text.translate(_SPACED), 0
    while a < len(spaced):
        b = len(spaced)
        if b - a > PIECE:
            b = spaced.rfind(b" ", a, a + PIECE)
            b = b if b > a else spaced.find(b" ", a + PIECE)
            b = b if b > a else len(spaced)
        yield spaced[a:b].split()
        a = b


class Vocabulary:
    """The terms of a block of items, numbered, and which items hold each."""

    def __init__(self, items: list[set[bytes]]):
        self.number = {t: i for i, t in enumerate(sorted(set().union(*items)))}
        pairs = sorted((self.number[t], i) for i, held in enumerate(items) for t in held)
        self.start = np.searchsorted([t for t, _ in pairs], np.arange(len(self.number) + 1))
        self.items, self.n_items = np.array([i for _, i in pairs], np.int64), len(items)
        self.longest = max(map(len, items), default=0)

    def bag(self, text: bytes) -> tuple[int, bytes]:
        """How many terms a text has, and its bag: numbers of the terms, then how often each, as one kind of integer."""
        counts, n = Counter(), 0
        for piece in terms(text):
            n += len(piece)
            counts.update(piece)
        number = self.number
        held = sorted((number[t], c) for t, c in counts.items() if t in number)
        if not held:
            return n, b""
        bag = np.array(held, np.int64).T.ravel()
        size = 2 if bag.max() < 1 << 16 else 8
        return n, bytes([size]) + bag.astype(f"<u{size}").tobytes()


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a bag."""
    held = np.frombuffer(bag, f"<u{bag[0]}", offset=1).astype(np.int64)
    return held[: len(held) // 2], held[len(held) // 2 :]


def blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[set[bytes]]]]:
    """(keys, sets of terms) of bounded blocks of items; rows that repeat a key are one item with all their terms."""
    rows = items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).orderBy("id")
    keys, held, size = [], [], 0
    for row in rows.toLocalIterator():
        found = set().union(*terms((row["text"] or "").encode("utf-8", "replace")))
        if keys and row["id"] == keys[-1]:
            size += len(found - held[-1])
            held[-1] |= found
            continue
        if keys and (len(keys) >= ITEMS or size + len(found) > TERMS):
            yield keys, held
            keys, held, size = [], [], 0
        keys.append(row["id"])
        held.append(found)
        size += len(found)
    if keys:
        yield keys, held


def bags(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(id, n, bag) of each document: its terms with repeats, and its bag (empty without a term of the vocabulary)."""

    def run(batches):
        for batch in batches:
            found = [vocabulary.bag(x) for x in raw_texts(batch.column(1))]
            n, held = pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, held], names=["id", "n", "bag"])
        give_back()

    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, f"id {dict(named.dtypes)['id']}, n long, bag binary")


def frequencies(stored: DataFrame, terms_: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches):
        total = np.zeros(terms_, np.int64)
        for batch in batches:
            held = [unpack(x)[0] for x in batch.column(0).to_pylist()]
            if held:
                total += np.bincount(np.concatenate(held), minlength=terms_)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    counted = stored.filter("length(bag) > 0").select("bag").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(terms_, np.int64)
    for row in counted.toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def classes(stored: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(bag, m, ids): documents of equal bag and norm, with their k smallest ids in order, nulls last."""
    norm = F.expr(f"50 + (CAST(n AS DECIMAL(18,0)) * CAST({50 * n_docs} AS DECIMAL(19,0))) div {n_terms}").cast("long")
    rows = stored.filter("length(bag) > 0").select("id", "bag", norm.alias("m")).withColumn("h", F.xxhash64("bag", "m"))
    same = ["h", "m", "bag"]  # the hash deals, the whole bag decides
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_last("id")))).filter(F.col("place") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return first.groupBy(*same).agg(ids.alias("ids")).select("bag", "m", "ids")


class Scorer:
    """Scores of classes against a block of items."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights
        self.exact_in_float = vocabulary.longest * int(weights.max(initial=0)) * 1_000_000 < 2**53

    def scores(self, held: list[bytes], m: np.ndarray) -> np.ndarray:
        """[class, item]"""
        v, out = self.vocabulary, np.zeros(len(held) * self.vocabulary.n_items, np.int64)
        found = [unpack(x) for x in held]
        each = np.repeat(np.arange(len(held)), [len(t) for t, _ in found])
        term, tf = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        value = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[each]))
        spread = v.start[term + 1] - v.start[term]
        for a, b in slices(spread.tolist(), ELEMENTS):
            n = spread[a:b]
            place = np.repeat(v.start[term[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(each[a:b] * v.n_items, n) + v.items[place]
            if self.exact_in_float:
                low = int(cell.min(initial=0))
                part = np.bincount(cell - low, weights=np.repeat(value[a:b], n))
                out[low : low + len(part)] += part.astype(np.int64)
            else:
                np.add.at(out, cell, np.repeat(value[a:b], n))
        return out.reshape(len(held), v.n_items)


class Best:
    """The k best classes of each item among those seen; of equal scores the one seen first."""

    def __init__(self, n_items: int, k: int):
        self.k, self.bar = k, np.zeros(n_items, np.int64)
        self.item, self.score, self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        row, item = np.nonzero(scores > self.bar)
        if not len(row):
            return
        kept, place = np.unique(row, return_inverse=True)
        more = ids.take(pa.array(kept))
        base = 0 if self.ids is None else len(self.ids)
        held = more if self.ids is None else pa.concat_arrays([self.ids, more])
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]])
        at = np.concatenate([self.at, base + place])
        order = np.lexsort((at, -score, item))
        item, score, at = item[order], score[order], at[order]
        start = np.searchsorted(item, np.arange(len(self.bar)))
        inside = np.arange(len(item)) - start[item] < self.k
        self.item, self.score, at = item[inside], score[inside], at[inside]
        full = np.bincount(self.item, minlength=len(self.bar)) == self.k
        last = np.searchsorted(self.item, np.arange(len(self.bar)), side="right") - 1
        self.bar[full] = self.score[last[full]]
        kept, self.at = np.unique(at, return_inverse=True)  # numbered in the order they came
        self.ids = held.take(pa.array(kept))


def _ranked(docs: DataFrame, keys: list, held: list[set[bytes]], kind: str, item_type: pa.DataType, k: int, key: str, text: str, totals: tuple | None) -> tuple[DataFrame | None, tuple]:
    vocabulary = Vocabulary(held)
    stored = materialize(bags(docs, key, text, vocabulary), "bags")
    n_docs, n_terms = totals or stored.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms or not vocabulary.number:
        return None, (n_docs, n_terms)
    df = frequencies(stored, len(vocabulary.number))
    scorer = Scorer(vocabulary, np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64))
    ids = pa.array(keys, item_type)
    id_kind = dict(stored.dtypes)["id"]
    rows = max(1, ELEMENTS // len(keys))

    def score(batches):
        best = Best(len(keys), k)
        for batch in batches:
            m = batch.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                best.add(scorer.scores(part.column(0).to_pylist(), m[a : a + rows]), part.column(2))
        if best.ids is not None:
            for a in range(0, len(best.item), 4096):
                at = pa.array(best.at[a : a + 4096])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.item[a : a + 4096])), pa.array(best.score[a : a + 4096]), best.ids.take(at)], names=["item", "score", "ids"])
        give_back()

    # a task sees its classes by their smallest id, so that of equal scores the first ones matter
    lined = classes(stored, n_docs, n_terms, k).sortWithinPartitions(F.asc_nulls_last(F.col("ids")[0]))
    found = lined.mapInArrow(score, f"item {kind}, score long, ids array<{id_kind}>")
    expanded = found.select("item", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return expanded.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), (n_docs, n_terms)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item key, rank int, doc key, score long): for each item the k documents of the highest scores above 0.

    Equal scores go by ascending key, a null key last. A null text has no term; an item without a term that occurs has
    no row. Rows of `items` that repeat a key are one item; rows of `docs` that repeat are documents of their own.
    Empty tables give an empty table, other columns are left out.
    """
    spark = docs.sparkSession
    kind, id_kind = dict(items.dtypes)[item_key], dict(docs.dtypes)[key]
    names = [F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score"]
    path, totals, some = scratch_path(spark, "ranked"), None, False
    for keys, held in blocks(items, item_key, item_text):
        found, totals = _ranked(docs, keys, held, kind, to_arrow_type(items.schema[item_key].dataType), k, key, text, totals)
        if found is not None:
            found.select(*names).write.mode("append").parquet(path)
            some = True
    empty = spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` {id_kind}, score long")
    return spark.read.schema(empty.schema).parquet(path) if some else empty


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op13_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
norms AS (SELECT r, doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, totals WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN norms USING (r) GROUP BY item_id, doc_id, r),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
}
