"""Token counts by compiled finite-state transducers.

Two deterministic transducers give the number of tokens of a byte-level BPE without building the tokens:

* the *split* transducer reads classes of code points and marks on its transitions where a piece begins, one
  step late where the rule looks ahead. A batch of texts is one stream cut into chunks of equal length. Each
  chunk first becomes a map from every entry state to its exit state; the maps are composed by a parallel
  prefix scan, which gives each chunk its true entry state; a second pass then reads the marks of all chunks
  side by side. Chunk edges may fall anywhere, also inside a piece.
* the *count* transducer reads the bytes of a piece. Each transition carries the change in the number of
  tokens. Its state is what the BPE merges can still depend on: the trailing bytes that may begin a token,
  and the last token of each prefix that ends among them. States are made when first met and then kept.

The documents never move: no shuffle, and memory is bounded by `STREAM` code points per step.
"""

import gc
import json
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import add_columns, arrow_column, raw_texts, read_documents, slices, struct_array

#: Code points in one stream, and in one chunk of it.
STREAM, CHUNK = 2_000_000, 512
#: Pieces whose counts are kept, and states of the count transducer, before both start anew.
KEPT = 300_000
LIMIT = 512

# Classes of code points. The letters that may end a contraction have classes of their own.
LETTER, STMD, R, V, L, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
# States of the split transducer.
FRESH, LETTERS, NUMBERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(12)
HERE, BEFORE = 1, 2  # a piece begins at this code point; at the one before


def code_point_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
        elif c.isspace() and not 0x1C <= i <= 0x1F:
            out[i] = WHITE
    for letters, k in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
        for c in letters:
            out[ord(c)] = k
    return out


def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for each state and class, for the pattern
    `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`."""
    letters = {LETTER, STMD, R, V, L, E}

    def begin(c: int) -> tuple[int, int]:
        if c == END:
            return FRESH, HERE
        if c in letters:
            return LETTERS, HERE
        return {NUMBER: NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: QUOTED, OTHER: OTHERS}[c], HERE

    def joined(c: int) -> int:
        return LETTERS if c in letters else NUMBERS if c == NUMBER else OTHERS

    def step(state: int, c: int) -> tuple[int, int]:
        white = c in (SPACE, WHITE)
        if state == LETTERS and c in letters or state == NUMBERS and c == NUMBER:
            return state, 0
        if state in (OTHERS, QUOTED) and c in (OTHER, QUOTE):
            return OTHERS, 0
        if state == QUOTED and c in (STMD, R, V, L):
            return {STMD: FRESH, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
        if state in (QUOTED_R, QUOTED_V, QUOTED_L):
            if c == (L if state == QUOTED_L else E):
                return FRESH, 0
            to, mark = step(LETTERS, c)  # no contraction: a word began at the code point before
            return to, mark | BEFORE
        if state in (ONE_SPACE, ONE_WHITE, SPACES, WHITES) and white:
            return SPACES if c == SPACE else WHITES, 0
        if c != END and state == ONE_SPACE:
            return joined(c), 0
        if c != END and state == SPACES:
            return joined(c), BEFORE
        if c != END and state == WHITES:
            to, mark = begin(c)
            return to, mark | BEFORE
        return begin(c)

    table = [[step(s, c) for c in range(12)] for s in range(12)]
    return np.array([[x[0] for x in row] for row in table], np.uint8), np.array([[x[1] for x in row] for row in table], np.uint8)


def compose(maps: np.ndarray) -> np.ndarray:
    """State of each chunk's start, from the chunk maps [chunks, states], by an inclusive parallel prefix scan."""
    done, step = maps.astype(np.intp), 1
    while step < len(done):
        later = np.take_along_axis(done[step:], done[:-step], axis=1)  # first the earlier map, then the later one
        done = np.concatenate([done[:step], later])
        step *= 2
    return np.concatenate([[FRESH], done[:-1, FRESH]])


def marks(classes: np.ndarray, table: np.ndarray, emits: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each place of the stream."""
    n = len(classes)
    states, kinds = table.shape
    grid = np.full(-(-n // chunk) * chunk, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(-1, chunk).T)
    flat, out = table.ravel().astype(np.intp) * kinds, emits.ravel()  # states as offsets of their rows
    maps = np.tile(np.arange(states) * kinds, (grid.shape[1], 1))
    for column in grid[:, :, None]:
        maps += column
        maps = flat.take(maps)
    state, said = compose(maps // kinds) * kinds, np.empty_like(grid)
    for i, column in enumerate(grid):
        state += column
        said[i] = out.take(state)
        state = flat.take(state)
    said = said.T.ravel()[:n]
    begins = said & HERE > 0
    begins[:-1] |= said[1:] & BEFORE > 0
    return begins


class CountTransducer:
    """Number of BPE tokens of a piece, one transition per byte; states are compiled when first met.

    A state lists the open starts: the places, the present one first, from which the bytes since then begin
    some token. Each has the node of those bytes in the trie of all tokens, the last token of the text up to
    there, and how many tokens that text has beside the whole. Merges are learned bottom up, so a token's
    parts have lower ranks than itself.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.made = {a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for token in vocabulary:
            node = 0
            for byte in token:
                if byte not in self.trie[node]:
                    self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][byte]
            self.token[node] = token
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, None, 0),)
        self.states, self.numbers, self.moves, self.fits_memo = [start], {start: 0}, [{}], {}

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """Parts on the outer edge (0: left, 1: right) from the byte up, each with the rank that absorbs it."""
        key = (token, side)
        if key not in self.spines:
            up, rank, part = [], float("inf"), token
            while part is not None:
                up.append((part, rank))
                parts = self.made.get(part)
                part, rank = (parts[side], parts[2]) if parts else (None, rank)
            self.spines[key] = up[::-1]
        return self.spines[key]

    def fits(self, left: bytes | None, right: bytes) -> bool:
        """Whether the two tokens stay as they are when they meet: no merge across comes before those inside."""
        if left is None:
            return True
        key = (left, right)
        if key not in self.fits_memo:
            self.fits_memo[key] = self._fits(self.spine(left, 1), self.spine(right, 0))
        return self.fits_memo[key]

    def _fits(self, left: list[tuple[bytes, float]], right: list[tuple[bytes, float]]) -> bool:
        i = j = 0
        while True:
            (a, ends_a), (b, ends_b) = left[i], right[j]
            across = self.ranks.get((a, b))
            if across is not None and across < ends_a and across <= ends_b:
                return False
            if ends_a == ends_b == float("inf"):
                return True
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1

    def compile(self, number: int, byte: int) -> tuple[int, int]:
        """Next state and change in the count."""
        opened, found, trie = [], None, self.trie
        for node, last, count in self.states[number]:
            to = trie[node].get(byte)
            if to is None:
                continue
            if trie[to]:
                opened.append((to, last, count))
            if found is None and (token := self.token[to]) is not None and self.fits(last, token):
                found, change = token, count + 1
        if found is None:
            raise ValueError(f"no token ends with byte {byte}")
        state = ((0, found, 0), *[(node, last, count - change) for node, last, count in opened])
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.moves[number][byte] = move = (self.numbers[state], change)
        return move

    def count(self, piece: bytes) -> int:
        if len(self.states) > KEPT:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in piece:
            try:
                state, change = moves[state][byte]
            except KeyError:
                state, change = self.compile(state, byte)
            total += change
        return total


def byte_letters() -> dict[str, int]:
    """Byte of each letter in which byte-level vocabularies are written: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(text: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[str]]:
    """Vocabulary and merges as bytes, and the special strings, of a byte-level BPE in JSON."""
    data, letters = json.loads(text), byte_letters()
    to_bytes = lambda s: bytes(letters[c] for c in s)
    return (
        {to_bytes(k): v for k, v in data["model"]["vocab"].items()},
        [(to_bytes(a), to_bytes(b)) for a, b in data["model"]["merges"]],
        [x["content"] for x in data["added_tokens"]],
    )


class Counts(dict):
    """Tokens by piece; a piece that is not known yet goes through the transducer."""

    def __init__(self, transducer: CountTransducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        found = self.transducer.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found


class Counter:
    """Tokens of whole texts."""

    def __init__(self, tokenizer: str, classes: bytes, chunk: int = CHUNK):
        vocabulary, merges, self.special = read_tokenizer(tokenizer)
        self.transducer = CountTransducer(vocabulary, merges)
        self.classes = np.frombuffer(classes, np.uint8)
        self.table, self.emits = split_transducer()
        self.chunk, self.counts = chunk, Counts(self.transducer)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Special strings count one token each and part the text, as the library's default has it."""
        counts, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            sections = [text]
            for mark in self.special:
                if mark in text:
                    sections = [x for s in sections for x in s.split(mark)]
            counts[i] = len(sections) - 1
            parts += sections
            owner += [i] * len(sections)
        stream = "\n".join(parts)
        points = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = np.append(self.classes[points], END)
        classes[ends] = END
        begins = marks(classes, self.table, self.emits, self.chunk)
        begins[ends] = True
        at = np.flatnonzero(begins)
        real = classes[at] != END
        starts, stops = at[:-1][real[:-1]].tolist(), at[1:][real[:-1]].tolist()
        pieces = [stream[a:b] for a, b in zip(starts, stops, strict=True)]
        each = np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces))
        part = np.cumsum(~real)[real]
        np.add.at(counts, np.asarray(owner), np.bincount(part, each, len(parts)).astype(np.int64))
        return counts


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Texts of any length are counted whole. Repeated rows are
    counted each; an empty table gives an empty table. Columns of these three names are replaced, all others
    kept. `path` is a byte-level BPE in the tokenizers library's JSON.
    """
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    classes = code_point_classes().tobytes()

    def make():
        gc.freeze()
        gc.disable()  # many small tables and no cycles: looking through them again and again would take half the time
        counter = Counter(tokenizer, classes)

        def batch(texts: pa.Array) -> pa.Array:
            raw = raw_texts(texts)
            counts = np.zeros(len(raw), np.int64)
            for a, b in slices([len(x) for x in raw], STREAM):
                counts[a:b] = counter.of_texts([x.decode("utf-8", "replace") for x in raw[a:b]])
            return struct_array({"n_bytes": np.array([len(x) for x in raw], np.int64), "n_tokens": counts, "over_limit": counts > limit})

        return batch

    found = arrow_column(make, "n_bytes long, n_tokens long, over_limit boolean")
    return add_columns(docs, found(F.col(f"`{text}`")), ["n_bytes", "n_tokens", "over_limit"])


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
