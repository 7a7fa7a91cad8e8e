"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of its distinct words and their beginnings; a document is toxic unless none of its
sentences is (noisy-or). The word weights are learned in numpy from document labels alone, on a bounded sample of
labelled documents of any length. Noisy-or grows with the number of sentences even when none is toxic, so the odds are
then sharpened until LONG clean sentences laid end to end make a clean document. Scoring runs beside the scan over every sentence of every text, and locates those at fault.
"""

import zlib
from array import array
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import add_columns, arrow_column, crc, first_rows, raw_texts, read_documents
from watchframe.session import materialize

#: Bounds of the sample that weights are learned from: documents of each label, bytes after which no further text of a
#: label is taken (each is taken whole), features, and documents that a feature is found in at least.
SAMPLE, SAMPLE_BYTES, VOCABULARY, LEAST = 1500, 16 << 20, 40_000, 8
#: Clean sentences that together stay below 0.5, and the parts of the sample that show what is needed for it.
LONG, FOLDS = 10_000, 3
MARGIN, SCALES = 0.5, (1.0, 1.5, 2.0, 3.0, 4.0)
#: Words have letters, digits and any character beyond ASCII; sentences end with these.
_ENDS = b".!?\n"
_CODE = bytes(0x0A if b in _ENDS else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def sentences(raw: bytes) -> list[bytes]:
    """Lower-case sentences, of the same lengths as in the text, with one byte between them."""
    return raw.lower().translate(_CODE).split(b"\n")


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 4 to 7 bytes, marked as such."""
    return [word, *[word[:n] + b"-" for n in range(4, 8) if len(word) >= n]]


class _Words(dict):
    """What all features of a word weigh, by word; a bounded memory of `weights`."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = sum(map(self.weights.get, features(word), repeat(0.0)))
        return found


class Model:
    """Weights of features and the bias of a sentence."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = _Words(weights)

    def sentence_scores(self, raw: bytes) -> list[float]:
        """Log-odds per sentence; one without words is never toxic."""
        get = self.words.__getitem__
        return [self.bias + sum(map(get, set(words))) if (words := s.split()) else -np.inf for s in sentences(raw)]

    def score(self, raw: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of the text, and (start, end, probability) in code points of each sentence at 0.5 or more."""
        odds = np.array(self.sentence_scores(raw))
        whole = float(-np.expm1(-np.logaddexp(0, odds).sum()))
        found = []
        if (odds >= 0).any():
            sizes = np.array([len(s) + 1 for s in sentences(raw)])
            ends = np.cumsum(sizes) - 1
            for i in np.flatnonzero(odds >= 0):
                a, b = int(ends[i] - sizes[i] + 1), int(ends[i])
                while raw[a:b][:1].isspace():
                    a += 1
                start = len(raw[:a].decode("utf-8", "replace"))
                found.append((start, start + len(raw[a:b].decode("utf-8", "replace")), float(1 / (1 + np.exp(-odds[i])))))
        return min(max(whole, 0.0), 1.0), found


def _document(raw: bytes) -> set[bytes]:
    return {f for w in set(raw.lower().translate(_CODE).split()) for f in features(w)}


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Weights from all texts, sharpened as texts need that were left out: those of each fold, by a model of the others."""
    model, fold = fit(texts, toxic), np.arange(len(texts)) % FOLDS
    if not model.weights:
        return model
    odds = [np.empty(0)] * len(texts)
    for k in range(FOLDS):
        part = fit([texts[i] for i in np.flatnonzero(fold != k)], toxic[fold != k])
        for i in np.flatnonzero(fold == k):
            found = np.array((part if part.weights else model).sentence_scores(texts[i]))
            odds[i] = found[np.isfinite(found)]
    return sharpened(model, *sharpness(odds, toxic))


def sharpened(model: Model, scale: float, shift: float) -> Model:
    return Model({w: scale * x for w, x in model.weights.items()}, scale * (model.bias - shift))


def sharpness(odds: list[np.ndarray], toxic: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of log-odds: MARGIN, as a sentence just below 0.5 leaves no room for others, and the least scale at
    which any LONG clean sentences in a row stay below 0.5. Clean texts that are at 0.5 by themselves are left out."""
    flat = np.concatenate([*odds, np.empty(0)]) - MARGIN
    text = np.repeat(np.arange(len(odds)), [len(x) for x in odds])
    for scale in SCALES:
        each = np.logaddexp(0, scale * flat)
        over = np.bincount(text, each, len(odds)) >= np.log(2)
        calm = each[~(over | toxic)[text]]
        if not len(calm) or np.add.reduceat(calm, np.arange(0, len(calm), LONG)).max() < np.log(2):
            break
    return scale, MARGIN


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Noisy-or likelihood by Adam over all documents at once."""
    rough = np.zeros(1 << 20, np.int32)  # documents by hash of the feature: bounds memory before features are told apart
    for raw in texts:
        rough += np.bincount(np.unique([zlib.crc32(f) & 0xFFFFF for f in _document(raw)]).astype(np.int64), minlength=1 << 20).astype(np.int32)
    count: Counter = Counter()
    bad_count: Counter = Counter()
    for raw, bad in zip(texts, toxic, strict=True):
        found = [f for f in _document(raw) if rough[zlib.crc32(f) & 0xFFFFF] >= LEAST]
        count.update(found)
        if bad:
            bad_count.update(found)
    vocabulary = {w: i for i, (w, n) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n >= LEAST}
    if not vocabulary or toxic.all() or not toxic.any():
        return Model({}, -20.0 if not toxic.any() else 20.0)
    word, sentence, document = array("q"), array("q"), array("q")
    for d, raw in enumerate(texts):
        for s in sentences(raw):
            if words := set(s.split()):
                ids = {vocabulary[f] for w in words for f in features(w) if f in vocabulary}
                word.extend(ids)
                sentence.extend([len(document)] * len(ids))
                document.append(d)
    word, sentence, document = (np.array(x, np.int64) for x in (word, sentence, document))
    y, n_bad, n_good = toxic.astype(float), toxic.sum(), (~toxic).sum()
    names = sorted(vocabulary, key=vocabulary.get)
    seen, seen_bad = np.array([count[w] for w in names]), np.array([bad_count[w] for w in names])
    odds = np.log((seen_bad + 1) / (n_bad + 2)) - np.log((seen - seen_bad + 1) / (n_good + 2))
    x = np.append(np.where(odds > 1, odds, 0.0), -6.0)  # the bias is last
    weight = np.where(toxic, 0.5 / n_bad, 0.5 / n_good)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, x[word], len(document)) + x[-1]
        total = np.maximum(np.bincount(document, np.logaddexp(0, z), len(texts)), 1e-12)
        slope = weight * np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        each = slope[document] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, each[sentence], len(names)), each.sum()) + decay * np.append(x[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model({w: float(t) for w, t in zip(names, x, strict=False) if abs(t) > 1e-3}, float(x[-1]))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Up to `most` texts of either label, picked and ordered by hashes of the labels' keys, whatever their length; of each
    label, those that SAMPLE_BYTES lets begin."""
    known = labels.select(F.col(key).cast("long").alias("_key"), F.col(label).cast("int").alias("_y")).filter("_key IS NOT NULL AND _y IN (0, 1)")
    order = F.md5(F.col("_key").cast("string").cast("binary"))
    counts = dict(map(tuple, known.groupBy("_y").count().collect()))
    chosen = [first_rows(known.filter(F.col("_y") == y), [order, "_key"], most, counts.get(y, 0)) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).dropDuplicates(["_key"])  # at most 2 * most rows, so they may be broadcast
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    texts = texts.filter(F.col("_text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "_key").dropDuplicates(["_key"])  # a repeated key gives one of its texts
    rows = materialize(rows.withColumn("_bytes", F.octet_length("_text").cast("long")), "sample")  # stored: its sizes are looked at first
    before, taken = {0: 0, 1: 0}, []
    for k, y, n in rows.orderBy(order, "_key").select("_key", "_y", "_bytes").collect():
        if before[y] < SAMPLE_BYTES:
            taken.append(k)
        before[y] += n
    found = {}
    for k, y, t in rows.filter(F.col("_key").isin(taken)).select("_key", "_y", "_text").toLocalIterator():
        found[k] = t.encode("utf-8", "replace"), y == 1
    return [found[k][0] for k in taken], np.array([found[k][1] for k in taken], bool)


def score_with(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` with score, predicted (score >= threshold) and sentences, an array of (start, end, score) of those at fault.

    A null or empty text has no sentence and score 0. Columns of these names are replaced, all others kept.
    """
    weights, bias = model.weights, model.bias

    def make():
        own = Model(weights, bias)

        def batch(texts: pa.Array) -> pa.Array:
            found = [own.score(x) for x in raw_texts(texts)]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            scores = np.array([s for s, _ in found], np.float64)
            return pa.StructArray.from_arrays([pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)], names=["score", "predicted", "sentences"])

        return batch

    found = arrow_column(make, "score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")
    return add_columns(docs, found(F.col(f"`{text}`")), ["score", "predicted", "sentences"])


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """`docs` with held_out (crc32 of the key mod 5 is 0), score, predicted and sentences.

    Weights come from labels of rows that are not held out; without any label no text is toxic. Repeated rows and
    null keys are scored like others; an empty table gives an empty table.
    """
    texts, y = sample(docs, labels.filter(crc(key) % 5 != 0), key, text, label)
    return score_with(docs, train(texts, y), text).withColumn("held_out", crc(key) % 5 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
