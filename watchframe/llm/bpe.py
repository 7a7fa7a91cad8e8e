"""BPE encoding and decoding by a table of distinct words.

Texts are split into words in Spark tasks; each distinct word is encoded once in the shard that its hash names,
and its ids are joined back at every position in the buckets that asked for it. Decoding joins each id to its
piece in the vocabulary, once per distinct word of a bucket; the vocabulary is a fixed table of 49,408 rows.
"""

import hashlib
import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from watchframe.llm.common import give_back, raw_texts, read_documents, text_buckets
from watchframe.llm.packed import from_bytes, packed, to_bytes, unpacked


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


def word_patterns() -> tuple[str, str]:
    """`'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+` with its classes written out, the commonest case first:
    for texts within the basic plane, whose classes are looked up at once, and for all others."""
    kinds = {"L": [], "N": [], "S": []}
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            kinds[kind].append(i)
        elif chr(i).isspace() and not 0x1C <= i <= 0x1F:
            kinds["S"].append(i)
    out = []
    for top in (0xFFFF, sys.maxunicode):
        letter, number, space = (_ranges([i for i in kinds[k] if i <= top]) for k in "LNS")
        out.append(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+")
    return out[0], out[1]


class Splitter:
    """Words of a text as the tokenizer's normalizer and splitter make them; special strings stand for themselves."""

    def __init__(self, patterns: tuple[str, str], special: list[str]):
        self.basic, self.all = (re.compile(p).findall for p in patterns)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma by character, not by place
        return text.lower()

    def words(self, text: str) -> list[str]:
        return (self.basic if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.all)(text)

    def __call__(self, text: str) -> list[str]:
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        if len(parts) == 1:
            return self.words(self.normal(text))
        out = []
        for i, part in enumerate(parts):
            out += [part] if i % 2 else self.words(self.normal(part))
        return out


class Encoder:
    """Ids of one word, by the library's model without its normalizer and splitter."""

    def __init__(self, tokenizer: str):
        self.model = Tokenizer.from_str(tokenizer).model
        data = json.loads(tokenizer)
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain}
        letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
        self.letters = [letters[b] for b in range(256)]

    def __call__(self, word: str) -> bytes:
        if word in self.special:
            return np.array([self.special[word]], "<u4").tobytes()
        if not word.isascii() or not word.isprintable():
            word = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])
        return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x.decode("utf-8", "replace") for x in raw_texts(batch.column(column))]


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


def _by_shard(words: Iterable[str], shards: int) -> dict[int, list[str]]:
    """Distinct words of a bucket by shard, each list in order."""
    out: dict[int, list[str]] = {}
    for word in sorted(words):
        out.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % shards, []).append(word)
    return out


#: Bytes of text in a bucket: a task holds its distinct words, their ids and the bucket's result.
BUCKET = 6 << 20


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, digest: bool = False) -> DataFrame:
    """One row (key, ids, decoded) per document: ids as little-endian unsigned 32-bit integers, and their decoding, or
    with `digest` the lowercase hex SHA-256 of its UTF-8.

    `path` is a word-level BPE in the tokenizers library's JSON; beginnings and ends are not added, nothing is cut
    or padded, special strings in a text are their tokens. A null or empty text has no ids and an empty decoding.
    Repeated rows come back as often as they come in, null keys as null; an empty table gives an empty table. Other
    columns are left out. Memory: one bucket of documents at a time.
    """
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    data = json.loads(tokenizer)
    special = [x["content"] for x in data["added_tokens"]]
    patterns = word_patterns()
    kind = dict(docs.dtypes)[key]
    packs, n = packed(docs, [key, text], text, text_buckets(docs, text, BUCKET))

    def ask(table: pa.Table) -> pa.Table:
        split, words = Splitter(patterns, special), set()
        for batch in unpacked(table):
            for t in _texts(batch, 1):
                words.update(split(t))
        bucket, asked = table["bucket"][0].as_py(), _by_shard(words, n)
        return pa.table({"shard": pa.array(list(asked), pa.int32()), "bucket": pa.array([bucket] * len(asked), pa.int32()), "words": pa.array([to_bytes({"w": pa.array(w)}) for w in asked.values()], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        encoder, known, ids = Encoder(tokenizer), {}, []
        for data in table["words"].to_pylist():
            out = []
            for word in from_bytes(data).column(0).to_pylist():
                found = known.get(word)
                if found is None:
                    found = known[word] = encoder(word)
                out.append(found)
            ids.append(to_bytes({"i": pa.array(out, pa.binary())}))
        return pa.table({"bucket": table["bucket"], "shard": table["shard"], "ids": pa.array(ids, pa.binary())})

    def join(table: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = {i: token for token, i in data["model"]["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        split, out, numbers, rows = Splitter(patterns, special), [], Numbers(), []
        number = numbers.__getitem__
        for batch in unpacked(table):
            texts = [np.array([*map(number, split(t))], np.int32) for t in _texts(batch, 1)]
            rows.append((batch.column(0), texts))
        asked = _by_shard(numbers, n)
        ids = [b""] * len(numbers)
        for shard, found in zip(answers["shard"].to_pylist(), answers["ids"].to_pylist(), strict=True):
            for word, x in zip(asked[shard], from_bytes(found).column(0).to_pylist(), strict=True):
                ids[numbers[word]] = x
        del asked, numbers, number
        decoded = [" ".join([pieces[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]
        shown = lambda x: hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() if digest else x
        schema = pa.schema([(key, rows[0][0].type), ("ids", pa.binary()), ("decoded", pa.string())])
        for keys, texts in rows:
            for a in range(0, len(texts), 500):
                each = [x.tolist() for x in texts[a : a + 500]]
                columns = [keys.slice(a, len(each)), pa.array([b"".join([ids[w] for w in x]) for x in each], pa.binary()), pa.array([shown(" ".join([decoded[w] for w in x])) for x in each], pa.string())]
                out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        rows.clear()
        del ids, decoded
        give_back()
        return pa.Table.from_batches(out, schema=schema)

    questions = packs.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, words binary")
    answers = questions.groupBy("shard").applyInArrow(answer, "bucket int, shard int, ids binary")
    return packs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(join, f"`{key}` {kind}, ids binary, decoded string")


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(read_documents(spark, sf_dir), digest=True)
    return found.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.col("decoded").alias("decoded_sha256"),
    )
