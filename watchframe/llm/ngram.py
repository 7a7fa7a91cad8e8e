"""LM scoring with an Elias-Fano n-gram trie, built in shards over all training documents.

The model is a bigram language model with absolute discounting that falls back on smoothed word counts:

    p(w | c) = max(n(c, w) - D, 0) / n(c) + D * types(c) / n(c) * base(w),   base(w) = (n(w) + 1) / (N + V + 1)

and p(w | c) = base(w) after a context that was never seen. Documents are dealt into buckets; each bucket counts its
distinct words and pairs once and sends them to the shard of the pair's context. A shard adds the counts of all buckets
up and builds its part of the trie: words in order of their hashes with monotone Elias-Fano pointers to their
successors, which form one Elias-Fano sequence with each context's successors after those of the context before, and
discounted probabilities and fall-back weights quantised to a byte. The levels are memory-mapped from an unnamed file.
The shard then answers the buckets' own pairs by successor search within the context, one byte a pair.

Nothing grows in the driver, no word or pair of any frequency weighs more than once a bucket, and no count is capped.
Words are told apart by 64-bit hashes. Memory: one bucket of documents, or one shard of the trie, at a time.
"""

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import crc, raw_texts, read_documents
from watchframe.llm.packed import from_bytes, packed, to_bytes, unpacked

DISCOUNT = 0.75
BEGIN, END = (xxhash.xxh64_intdigest(x, 1) for x in (b"begin of text", b"end of text"))
_PLACES = np.array([[p[i] if i < len(p := [b for b in range(8) if byte >> b & 1]) else 8 for i in range(8)] for byte in range(256)], np.int64)


class EliasFano:
    """A rising sequence of n whole numbers in about 2 + log2(last / n) bits each."""

    def __init__(self, values: np.ndarray, last: int):
        self.n = n = len(values)
        self.shift = max(0, (max(last, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        if self.shift:
            bits = (values[:, None] >> np.arange(self.shift, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        high = (values >> np.uint64(self.shift)).astype(np.int64) + np.arange(n)
        size = -(-(n + (last >> self.shift) + 2) // 64) * 64
        marks = np.zeros(size // 8, np.uint8)
        np.bitwise_or.at(marks, high >> 3, np.left_shift(1, high & 7).astype(np.uint8))
        self.levels = [np.append(low, np.zeros(8, np.uint8)), marks]
        ones = np.bitwise_count(marks.view(np.uint64)).astype(np.int64)
        self.levels.append(np.concatenate([[0], np.cumsum(64 - ones)]))  # zeros before each word
        self.levels.append(np.concatenate([[0], np.cumsum(ones)]))

    def stored(self) -> "EliasFano":
        """The same, with its levels memory-mapped from a file without a name, gone when it is let go."""
        file, at = tempfile.TemporaryFile(), []
        for level in self.levels:
            file.seek(-(-file.tell() // 64) * 64)
            at.append(file.tell())
            file.write(level.tobytes())
        file.flush()
        self.levels = [np.memmap(file, level.dtype, "r", offset, level.shape) for level, offset in zip(self.levels, at, strict=True)]
        return self

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th zero or one, counted from 0."""
        marks, before = self.levels[1], self.levels[2 if zeros else 3]
        word = np.searchsorted(before, k, "right") - 1
        left, place = k - before[word], word * 8
        found = np.full(len(k), -1, np.int64)
        for _ in range(8):
            byte = marks[place] ^ np.uint8(255 if zeros else 0)
            n = np.bitwise_count(byte).astype(np.int64)
            here = (found < 0) & (left < n)
            found[here] = place[here] * 8 + _PLACES[byte[here], left[here]]
            on = found < 0
            left, place = np.where(on, left - n, left), np.where(on, np.minimum(place + 1, len(marks) - 1), place)
        return found

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        bit = i * self.shift
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= self.levels[0][np.minimum(byte + k, len(self.levels[0]) - 1)].astype(np.uint64) << np.uint64(8 * k)
        return (out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.shift) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, False) - i).astype(np.uint64)
        return (high << np.uint64(self.shift)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value at or above x among places [first, last), and whether it is x."""
        x = x.astype(np.uint64)
        high, low = (x >> np.uint64(self.shift)).astype(np.int64), x & np.uint64((1 << self.shift) - 1)
        a = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - (high - 1), 0)
        end = self._select(high, True) - high
        a, end = np.maximum(a, first), np.minimum(end, last)
        b = np.maximum(a, end)
        stop = b.copy()
        while (open_ := a < b).any():
            at = np.flatnonzero(open_)
            middle = (a[at] + b[at]) >> 1
            less = self._low(middle) < low[at]
            a[at[less]] = middle[less] + 1
            b[at[~less]] = middle[~less]
        hit = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < stop)
        hit[inside] = self._low(a[inside]) == low[inside]
        return a, hit


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte per positive value (1 to 255) and what each byte stands for (0: nothing), bins even in the logarithm's ranks."""
    book = np.zeros(256)
    if not len(values):
        return np.empty(0, np.uint8), book
    logs = np.log10(values)
    levels = np.unique(np.quantile(logs, np.linspace(0, 1, 255)))
    edges = (levels[1:] + levels[:-1]) / 2
    book[1 : 1 + len(levels)] = 10**levels
    return (np.searchsorted(edges, logs) + 1).astype(np.uint8), book


class Trie:
    """A shard of the model: words, their successors, and quantised probabilities."""

    def __init__(self, words: np.ndarray, successors: np.ndarray, pairs: np.ndarray, counts: np.ndarray, discount: float):
        """words, successors: hashes in order; pairs: context number << 32 | successor number, in order, with counts."""
        self.words, self.successors = words, successors
        context = (pairs >> np.uint64(32)).astype(np.int64)
        kinds = np.bincount(context, minlength=len(words))
        total = np.bincount(context, counts, len(words))
        self.width = max(len(successors), 1)
        relative = context * self.width + (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.children = EliasFano(relative, len(words) * self.width).stored()
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(kinds)]), len(pairs)).stored()
        self.codes, self.book = quantised((counts - discount) / total[context] if len(pairs) else np.empty(0))
        seen = total > 0
        self.weights = np.zeros(len(words), np.uint8)
        self.weights[seen], self.weight_book = quantised(discount * kinds[seen] / total[seen])
        self.weight_book[0] = 1.0  # a context never seen falls back entirely

    def look_up(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each pair's probability, 0 for pairs that training has not."""
        first, last = (self.pointers[context + i].astype(np.int64) for i in (0, 1))
        place, hit = self.children.successor(context * self.width + successor, first, last)
        out = np.zeros(len(context), np.uint8)
        out[hit] = self.codes[place[hit]]
        return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Bucket:
    """Tokens of one bucket of documents by the order of their hashes, and its distinct pairs."""

    def __init__(self, table: pa.Table):
        numbers, self.keys, held, texts = _Numbers(), [], [], []
        number = numbers.__getitem__
        for batch in unpacked(table):
            self.keys.append(batch.column(0))
            held += batch.column(2).to_pylist()
            for raw in raw_texts(batch.column(1)):
                texts.append(np.array([0, *map(number, raw.lower().split()), 0], np.int64))
        self.held = np.array(held, bool)
        hashes = np.array([*[xxhash.xxh64_intdigest(w) for w in numbers], BEGIN, END], np.uint64)
        self.hashes, rank = np.unique(hashes, return_inverse=True)
        for t in texts:
            t[0], t[-1] = len(numbers), len(numbers) + 1
        self.sizes = np.array([len(t) - 1 for t in texts], np.int64)
        self.token = rank[np.concatenate([t[1:] for t in texts])]
        self.context = rank[np.concatenate([t[:-1] for t in texts])]
        self.document = np.repeat(np.arange(len(texts)), self.sizes)
        keys = (self.context.astype(np.uint64) << np.uint64(32)) | self.token.astype(np.uint64)
        self.pairs, self.place = np.unique(keys, return_inverse=True)

    def of_shards(self, shards: int):
        """(shard, places of its words, places of its pairs), every shard in turn."""
        shard = (self.hashes % np.uint64(shards)).astype(np.int64)
        of_pair = shard[(self.pairs >> np.uint64(32)).astype(np.int64)]
        words, pairs = np.argsort(shard, kind="stable"), np.argsort(of_pair, kind="stable")
        w, p = (np.searchsorted(x[o], np.arange(shards + 1)) for x, o in ((shard, words), (of_pair, pairs)))
        for s in range(shards):
            yield s, words[w[s] : w[s + 1]], pairs[p[s] : p[s + 1]]


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned kind that holds all."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _put(**arrays: np.ndarray) -> bytes:
    return to_bytes({k: pa.array([x.dtype.str.encode() + b":" + x.tobytes()], pa.binary()) for k, x in arrays.items()})


def _get(data: bytes) -> dict[str, np.ndarray]:
    batch, out = from_bytes(data), {}
    for name in batch.schema.names:
        kind, _, raw = batch.column(name)[0].as_py().partition(b":")
        out[name] = np.frombuffer(raw, kind.decode())
    return out


def perplexity_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: F.Column | None = None, discount: float = DISCOUNT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    Rows where `held_out` is true are scored but not learned from; by default those whose key's crc32 mod 7 is 2. Words
    are lower-cased in A-Z. A null or empty text is one end. Repeated rows are learned and scored each, null keys count
    as an empty text; other columns are left out; an empty table gives an empty table. Without a training row all words
    are unknown and share one probability.
    """
    held = crc(key) % 7 == 2 if held_out is None else held_out
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    packs, n = packed(rows, ["key", "text", "held"], "text")

    def ask(table: pa.Table) -> pa.Table:
        bucket, number = Bucket(table), table["bucket"][0].as_py()
        learned = ~bucket.held[bucket.document]
        words = np.bincount(bucket.token[learned], minlength=len(bucket.hashes))
        pairs = np.bincount(bucket.place[learned], minlength=len(bucket.pairs))
        out = []
        for _, w, p in bucket.of_shards(n):
            context = (bucket.pairs[p] >> np.uint64(32)).astype(np.int64)
            successor, place = np.unique((bucket.pairs[p] & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
            out.append(_put(words=bucket.hashes[w], counts=_narrow(words[w]), context=_narrow(np.bincount(np.searchsorted(w, context), minlength=len(w))), successors=bucket.hashes[successor], place=_narrow(place), pairs=_narrow(pairs[p])))
        return pa.table({"shard": pa.array(range(n), pa.int32()), "bucket": pa.array([number] * n, pa.int32()), "question": pa.array(out, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        asked = [_get(x) for x in table["question"].to_pylist()]
        words = np.unique(np.concatenate([x["words"] for x in asked]))
        successors = np.unique(np.concatenate([x["successors"] for x in asked]))
        counts, keys = np.zeros(len(words), np.int64), []
        for x in asked:
            at = np.searchsorted(words, x["words"])
            counts[at] += x["counts"].astype(np.int64)
            context = np.repeat(at, x["context"].astype(np.int64))
            keys.append((context.astype(np.uint64) << np.uint64(32)) | np.searchsorted(successors, x["successors"])[x["place"]].astype(np.uint64))
        pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
        pair_counts = np.bincount(place, np.concatenate([x["pairs"] for x in asked]), len(pairs))
        del place
        trie = Trie(words, successors, pairs[pair_counts > 0], pair_counts[pair_counts > 0], discount)
        totals, out = np.array([counts.sum(), (counts > 0).sum()], np.int64), []
        for x, k in zip(asked, keys, strict=True):
            at = np.searchsorted(words, x["words"])
            codes = trie.look_up((k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out.append(_put(counts=_narrow(counts[at]), weights=trie.weights[at], codes=codes, book=trie.book, weight_book=trie.weight_book, totals=totals))
        return pa.table({"bucket": table["bucket"], "shard": table["shard"], "answer": pa.array(out, pa.binary())})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        found = dict(zip(answers["shard"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        counts, weight = np.zeros(len(bucket.hashes), np.int64), np.ones(len(bucket.hashes))
        p, total = np.zeros(len(bucket.pairs)), np.zeros(2, np.int64)
        for s, w, own in bucket.of_shards(n):
            x = _get(found[s])
            counts[w], weight[w], p[own] = x["counts"], x["weight_book"][x["weights"]], x["book"][x["codes"]]
            total += x["totals"]
        base = (counts + 1) / (int(total[0]) + int(total[1]) + 1)
        size = len(bucket.sizes)
        each = np.log10(p[bucket.place] + weight[bucket.context] * base[bucket.token])
        known = np.bincount(bucket.document, counts[bucket.token] > 0, size).astype(np.int64)
        return pa.table({
            "key": pa.chunked_array(bucket.keys),
            "held_out": bucket.held,
            "n_tokens": bucket.sizes,
            "n_known": known,
            "train_tokens": np.full(size, total[0], np.int64),
            "base_score": np.bincount(bucket.document, np.log10(base)[bucket.token], size),
            "score": np.bincount(bucket.document, each, size),
        })

    questions = packs.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, question binary")
    answers = questions.groupBy("shard").applyInArrow(answer, "bucket int, shard int, answer binary")
    result = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = packs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, f"key {kind}, {result}")
    return scored.withColumnRenamed("key", key)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_scores(read_documents(spark, sf_dir))
