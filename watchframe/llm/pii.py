"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network reads windows of character classes that overlap by half; each window is decoded by Viterbi, and every
position takes its tag from the window in whose middle it lies, so spans are settled over the whole text. Every
kind holds a digit or an @; windows without either have no span and need no decoding. Trained in numpy on a bounded
sample of texts whose labelled spans are the patterns' own, with separators varied so that other writings are known
too. An added span must pass its kind's exact check (Luhn sum, digits, an @ and a dot) and touch no pattern's span.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import add_columns, arrow_column, first_rows, raw_texts, read_documents

KINDS = ("email", "ip", "card", "phone")
WINDOW, HALF, HIDDEN, LANES = 64, 32, 10, 2048
#: Bounds of the sample: texts, their bytes, and windows of each kind (as many without a span).
SAMPLE, TEXT_BYTES, WINDOWS = 1500, 32 << 10, 200
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind
_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUPS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "@", ".", "-", "+", "(", ")", " ", "\n", "_%", ",", ":;", "=", "\"'", "/"]
OTHER, FOREIGN, PAD = len(_GROUPS), len(_GROUPS) + 1, len(_GROUPS) + 2
CLASSES = PAD + 1
_CLASS = np.full(128, OTHER, np.uint8)
for _i, _group in enumerate(_GROUPS):
    for _c in _group:
        _CLASS[ord(_c)] = _i


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(numbers))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; from each @ the local part reaches back as far as it can."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    if not _TRIGGER.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


def plausible(kind: int, text: str) -> bool:
    """Exact check of an added span."""
    n = digits(text)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", text) is not None
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return re.fullmatch(r"[0-9.:,\[\]-]+", text) is not None and len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(n) <= 19 and luhn(n) and re.fullmatch(r"[0-9][0-9 ./_-]*[0-9]", text) is not None
    return (8 if text[0] == "+" else 10) <= len(n) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", text) is not None and re.search(r"[^0-9]", text) is not None


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], FOREIGN).astype(np.uint8)


def windows_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows with a digit or an @, and their classes [window, place]."""
    n = max(1, -(-max(len(codes) - HALF, 0) // HALF))
    padded = np.full((n + 1) * HALF, PAD, np.uint8)
    padded[: len(codes)] = codes[: len(padded)]
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HALF]
    some = ((view == 0) | (view == 3)).any(axis=1)
    return np.flatnonzero(some) * HALF, view[some]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Two LSTM layers, tag scores, and CRF transitions."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @staticmethod
    def fresh(seed: int = 0) -> "Tagger":
        random, p = np.random.default_rng(seed), {}
        for side in ("left", "right"):
            p[f"{side}_embed"] = random.normal(0, 0.5, (CLASSES, 4 * HIDDEN))
            p[f"{side}_own"] = random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        p["out"], p["out_bias"] = random.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS)
        p["next"] = np.zeros((TAGS, TAGS))
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _layer(self, side: str, codes: np.ndarray, trace: list | None) -> np.ndarray:
        own, table = self.p[f"{side}_own"], self.p[f"{side}_embed"]
        h = np.zeros((codes.shape[1], HIDDEN), own.dtype)
        c, out = np.zeros_like(h), np.empty((*codes.shape, HIDDEN), own.dtype)
        for t in range(len(codes)) if side == "left" else range(len(codes) - 1, -1, -1):
            x = table.take(codes[t], axis=0) + h @ own
            gates, g = _sigmoid(x[:, : 3 * HIDDEN]), np.tanh(x[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            top = np.tanh(c)
            if trace is not None:
                trace.append((t, h, before, i, f, o, g, top))
            h = o * top
            out[t] = h
        return out

    def scores(self, codes: np.ndarray, traces: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tag scores [place, window, tag] and states for classes [place, window]."""
        sides = [self._layer(s, codes, None if traces is None else traces[i]) for i, s in enumerate(("left", "right"))]
        states = np.concatenate(sides, axis=2)
        return states @ self.p["out"] + self.p["out_bias"], states

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags [place, window]."""
        s = self.scores(codes)[0]
        best, back = s[0], np.empty(s.shape, np.uint8)
        for t in range(1, len(s)):
            each = best[:, :, None] + self.p["next"]
            back[t] = each.argmax(axis=1)
            best = each.max(axis=1) + s[t]
        tags = np.empty(codes.shape, np.uint8)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(codes.shape[1])
        for t in range(len(s) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags

    def learn(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of whole windows, and its gradients by forward and backward sums."""
        traces: list[list] = [[], []]
        s, states = self.scores(codes, traces)
        step, n, rows = self.p["next"], codes.shape[1], np.arange(codes.shape[1])

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[0] = s[0]
        for t in range(1, len(s)):
            ahead[t] = total(ahead[t - 1][:, :, None] + step, 1) + s[t]
        for t in range(len(s) - 2, -1, -1):
            behind[t] = total(step + (s[t + 1] + behind[t + 1])[:, None, :], 2)
        z = total(ahead[-1], 1)
        d = np.exp(ahead + behind - z[None, :, None])
        d_next = np.zeros_like(step)
        for t in range(1, len(s)):
            d_next += np.exp(ahead[t - 1][:, :, None] + step + (s[t] + behind[t] - z[:, None])[:, None, :]).sum(axis=0)
        np.subtract.at(d_next, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        gold = sum(s[t, rows, tags[t]] for t in range(len(s))) + sum(step[tags[t - 1], tags[t]] for t in range(1, len(s)))
        d[np.arange(len(s))[:, None], rows[None, :], tags] -= 1
        d /= n
        grads = {"next": d_next / n, "out": np.einsum("tbh,tbk->hk", states, d), "out_bias": d.sum(axis=(0, 1))}
        ds = d @ self.p["out"].T
        for k, side in enumerate(("left", "right")):
            own = self.p[f"{side}_own"]
            d_own, d_table = np.zeros_like(own), np.zeros_like(self.p[f"{side}_embed"])
            dh, dc = np.zeros((n, HIDDEN), own.dtype), np.zeros((n, HIDDEN), own.dtype)
            for t, h, before, i, f, o, g, top in reversed(traces[k]):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dc + dh * o * (1 - top * top)
                dx = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(d_table, codes[t], dx)
                d_own += h.T @ dx
                dh, dc = dx @ own.T, dc * f
            grads[f"{side}_own"], grads[f"{side}_embed"] = d_own, d_table
        return float((z - gold).mean()), grads


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.uint8)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


def varied(text: str, spans: list[tuple[int, int, int]], random: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with other separators in its cards and phones, and their spans."""
    out, done, moved = [], 0, []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < done:
            continue
        part, mark = text[a:b], "- ./"[random.integers(4)]
        if kind == 2:
            part = mark.join(re.findall("[0-9]{1,4}", "".join(map(str, digits(part)))))
        elif kind == 3:
            part = re.sub(r"[ ().-]+", mark, part).lstrip("+" if random.random() < 0.5 else "")
        out.append(text[done:a])
        start = sum(map(len, out))
        moved.append((kind, start, start + len(part)))
        out.append(part)
        done = b
    return "".join([*out, text[done:]]), moved


def train(texts: list[str], steps: int = 200, lanes: int = 100, seed: int = 0) -> Tagger:
    """A tagger from texts labelled by their pattern spans; half of the windows with spans have varied separators."""
    random = np.random.default_rng(seed)
    by_kind: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(KINDS) + 1)]
    for text in texts:
        spans = base_spans(text)
        for change in (False, True) if any(k > 1 for k, _, _ in spans) else (False,):
            now, marked = varied(text, spans, random) if change else (text, spans)
            codes, tags = codes_of(now), tags_of(len(now), marked)
            starts, windows = windows_of(codes)
            for a, w in zip(starts.tolist(), windows, strict=True):
                own = np.zeros(WINDOW, np.uint8)
                own[: len(tags[a : a + WINDOW])] = tags[a : a + WINDOW]
                kinds = {int(t - 1) // 2 for t in own if t}
                for k in kinds or {len(KINDS)}:
                    by_kind[k].append((w, own))
    rows = []
    for k, found in enumerate(by_kind):
        most = WINDOWS * (len(KINDS) if k == len(KINDS) else 1)
        rows += [found[i] for i in random.permutation(len(found))[:most]]
    tagger = Tagger.fresh(seed)
    if not rows:
        tagger.p["out_bias"][0] = 50  # nothing to learn from: everything is outside
        return tagger
    codes, tags = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p, step = tagger.p, 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    while step < steps:
        order = random.permutation(len(rows))
        for a in range(0, len(order), lanes):
            part = order[a : a + lanes]
            _, grads = tagger.learn(np.ascontiguousarray(codes[part].T), np.ascontiguousarray(tags[part].T))
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] -= (0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def added_spans(texts: list[str], known: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger adds to the known ones, for texts with a digit or an @."""
    found = [windows_of(codes_of(t)) for t in texts]
    starts = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    tags = [np.zeros(len(t), np.uint8) for t in texts]
    windows = np.concatenate([f[1] for f in found]) if found else np.empty((0, WINDOW), np.uint8)
    for a in range(0, len(windows), LANES):
        best = tagger.decode(np.ascontiguousarray(windows[a : a + LANES].T)).T
        for row in np.flatnonzero(best.any(axis=1)):
            own, start = tags[owner[a + row]], int(starts[a + row])
            first = start if start == 0 else start + HALF // 2
            last = len(own) if start + WINDOW >= len(own) else start + WINDOW - HALF // 2
            own[first:last] = best[row, first - start : last - start]
    out = []
    for text, marks, spans in zip(texts, tags, known, strict=True):
        more, i = [], 0
        taken = np.zeros(len(text) + 1, bool)
        for _, a, b in spans:
            taken[a:b] = True
        places = np.flatnonzero(marks).tolist()
        while i < len(places):
            kind, j = (int(marks[places[i]]) - 1) // 2, i
            while j + 1 < len(places) and places[j + 1] == places[j] + 1 and marks[places[j + 1]] == 2 + 2 * kind:
                j += 1
            a, b = places[i], places[j] + 1
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if a < b and whole and not taken[a:b].any() and plausible(kind, text[a:b]):
                more.append((kind, a, b))
                taken[a:b] = True
            i = j + 1
        out.append(more)
    return out


def sample(docs: DataFrame, key: str, text: str, most: int = SAMPLE) -> list[str]:
    """Texts with a digit or an @, picked and ordered by hashes."""
    order = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(order.alias("_order"), F.col(f"`{text}`").alias("_text"))
    rows = rows.filter((F.octet_length("_text") <= TEXT_BYTES) & F.col("_text").rlike("[0-9@]"))
    return first_rows(rows, ["_order", F.md5(F.col("_text").cast("binary"))], most, rows.count()).toPandas()["_text"].tolist()


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with spans: an array of (kind, start, end, base), code points with end exclusive, by kind, then start.

    base marks the fixed patterns' spans, which always stay. A null or empty text has none. Texts are read whole;
    repeated rows and null keys are treated like others; an empty table gives an empty table. A column named spans is
    replaced, all others are kept.
    """
    parameters = train(sample(docs, key, text)).p
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def make():
        tagger = Tagger(parameters)

        def batch(column: pa.Array) -> pa.Array:
            texts = [x.decode("utf-8", "replace") for x in raw_texts(column)]
            spans = [base_spans(t) for t in texts]
            some = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
            more = dict(zip(some, added_spans([texts[i] for i in some], [spans[i] for i in some], tagger), strict=True))
            rows = [sorted([(k, a, b, True) for k, a, b in s] + [(k, a, b, False) for k, a, b in more.get(i, [])]) for i, s in enumerate(spans)]
            found = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": c} for k, a, b, c in r] for r in rows], kind)
            return pa.StructArray.from_arrays([found], names=["spans"])

        return batch

    found = arrow_column(make, "spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    return add_columns(docs, found(F.col(f"`{text}`")), ["spans"])


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each span of its text replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, from the first start to the last end, by the kind of the first.
    """
    row, whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text")
    marked = find(docs.select(row, F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text")
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))

    def put(state: Column, span: Column) -> Column:
        before = whole.substr(state["done"] + 1, span["start"] - state["done"])
        replaced = F.struct(F.concat(state["out"], before, F.lit("<"), span["kind"], F.lit(">")).alias("out"), span["end"].alias("done"))
        longer = F.struct(state["out"].alias("out"), span["end"].alias("done"))
        return F.when(span["start"] >= state["done"], replaced).when(span["end"] > state["done"], longer).otherwise(state)

    rest = F.aggregate(ordered, start, put, lambda s: F.concat(s["out"], whole.substr(s["done"] + 1, F.length(whole))))
    hidden = F.when(F.size("spans") > 0, rest).otherwise(whole)
    return marked.select(*[hidden.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
