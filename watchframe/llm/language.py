"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read windows of bytes from either side; each position gets language odds from both
states, and a document's probabilities are the mean over the positions of its letters, over all windows of its
whole text. Trained in numpy by backpropagation through time on a bounded sample; scored beside the scan, with the
windows of a batch side by side and memory bounded by LANES windows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import add_columns, arrow_column, crc, raw_texts, read_documents
from watchframe.session import materialize

WINDOW, HIDDEN, LANES = 64, 8, 2048
#: Bounds of the sample: documents of each language, and code points of the passage that each gives at a place that
#: its key draws.
SAMPLE, PASSAGE = 1000, 320
UNKNOWN = "und"
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


class Layer:
    """A gated recurrent layer with straight-line gates: h = n + z (h - n), r and z from clip(x / 4 + 1/2, 0, 1)."""

    def __init__(self, parameters: dict[str, np.ndarray], name: str, backward: bool):
        self.embed, self.own, self.bias = (parameters[f"{name}_{k}"] for k in ("embed", "own", "bias"))
        self.name, self.backward = name, backward

    def steps(self, length: int):
        return range(length - 1, -1, -1) if self.backward else range(length)

    def run(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States [time, lane, hidden] for byte codes [time, lane]."""
        h = np.zeros((codes.shape[1], self.own.shape[0]), np.float32)
        out, size = np.empty((*codes.shape, self.own.shape[0]), np.float32), self.own.shape[0]
        table = self.embed + self.bias
        for t in self.steps(len(codes)):
            x, u = table.take(codes[t], axis=0), h @ self.own
            raw = x[:, : 2 * size] + u[:, : 2 * size]
            gates = np.clip(raw * 0.25 + 0.5, 0, 1)
            r, z = gates[:, :size], gates[:, size:]
            slope = x[:, 2 * size :] + r * u[:, 2 * size :]
            n = np.clip(slope, -1, 1)
            if trace is not None:
                trace.append((t, h, raw, r, z, slope, n, u[:, 2 * size :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def back(self, codes: np.ndarray, trace: list, slope_out: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        size = self.own.shape[0]
        dh = np.zeros_like(slope_out[0])
        d_table, d_own = np.zeros_like(self.embed), np.zeros_like(self.own)
        for t, h, raw, r, z, slope, n, u in reversed(trace):
            dh = dh + slope_out[t]
            dn = dh * (1 - z) * (np.abs(slope) < 1)
            open_ = (np.abs(raw) < 2) * 0.25
            d = np.concatenate([dn * u * open_[:, :size], dh * (h - n) * open_[:, size:], dn], axis=1)
            du = d.copy()
            du[:, 2 * size :] *= r
            np.add.at(d_table, codes[t], d)
            d_own += h.T @ du
            dh = dh * z + du @ self.own.T
        grads[f"{self.name}_embed"] = d_table
        grads[f"{self.name}_own"] = d_own
        grads[f"{self.name}_bias"] = d_table.sum(axis=0)


class Network:
    """Both layers and the output over languages."""

    def __init__(self, languages: list[str], parameters: dict[str, np.ndarray]):
        self.languages, self.parameters = languages, parameters
        self.layers = [Layer(parameters, "left", False), Layer(parameters, "right", True)]

    @staticmethod
    def fresh(languages: list[str], seed: int = 0) -> "Network":
        random, p = np.random.default_rng(seed), {}
        for name in ("left", "right"):
            p[f"{name}_embed"] = random.normal(0, 0.5, (256, 3 * HIDDEN))
            p[f"{name}_own"] = random.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
            p[f"{name}_bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(HIDDEN)])
        p["out"] = random.normal(0, 0.3, (2 * HIDDEN, len(languages)))
        p["out_bias"] = np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in p.items()})

    def probabilities(self, codes: np.ndarray, traces: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language probabilities and states of every position [time, lane, ...]."""
        states = np.concatenate([x.run(codes, None if traces is None else traces[i]) for i, x in enumerate(self.layers)], axis=2)
        odds = states @ self.parameters["out"] + self.parameters["out_bias"]
        odds = np.exp(odds)  # states are at most 1, so these stay small
        return odds / odds.sum(axis=2, keepdims=True), states

    def learn(self, codes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over positions of letters."""
        traces: list[list] = [[], []]
        p, states = self.probabilities(codes, traces)
        mask = _LETTER[codes]
        d = p.copy()
        d[:, np.arange(len(label)), label] -= 1
        d *= (mask / max(mask.sum(), 1))[:, :, None]
        grads = {"out": np.einsum("tbh,tbl->hl", states, d), "out_bias": d.sum(axis=(0, 1))}
        ds = d @ self.parameters["out"].T
        for i, layer in enumerate(self.layers):
            layer.back(codes, traces[i], ds[:, :, i * HIDDEN : (i + 1) * HIDDEN], grads)
        return grads

    def documents(self, texts: list[bytes], lanes: int = LANES) -> np.ndarray:
        """Mean probabilities over the letters of each whole text; zeros where there are none."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        sizes = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        data = np.frombuffer(b"".join([t.lower().ljust(n * WINDOW, b"\0") for t, n in zip(texts, sizes.tolist(), strict=True)]), np.uint8)
        data = data.reshape(-1, WINDOW)
        for a in range(0, len(data), lanes):
            codes = np.ascontiguousarray(data[a : a + lanes].T)
            mask = _LETTER[codes]
            p = self.probabilities(codes)[0]
            own = owner[a : a + lanes]
            count += np.bincount(own, mask.sum(axis=0), len(texts))
            for k, each in enumerate(np.einsum("tbl,tb->lb", p, mask.astype(np.float32))):
                total[:, k] += np.bincount(own, each, len(texts))
        return total / np.maximum(count, 1)[:, None]


def train(texts: list[bytes], labels: list[str], rounds: int = 4, lanes: int = 256, most: int = 4800, seed: int = 0) -> Network | None:
    """A network from labelled passages: windows drawn in equal shares of each language, by Adam."""
    languages = sorted(set(labels))
    windows: dict[str, list[bytes]] = {x: [] for x in languages}
    for text, label in zip(texts, labels, strict=True):
        text = text.lower()
        windows[label] += [text[a : a + WINDOW].ljust(WINDOW, b"\0") for a in range(0, len(text), WINDOW)]
    languages = [x for x in languages if windows[x]]
    if not languages:
        return None
    network, random = Network.fresh(languages, seed), np.random.default_rng(seed)
    p, step = network.parameters, 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    data = [np.frombuffer(b"".join(windows[x]), np.uint8).reshape(-1, WINDOW) for x in languages]
    share = most // len(languages)
    for _ in range(rounds):
        drawn = [x[random.integers(0, len(x), share)] for x in data]
        codes, label = np.concatenate(drawn), np.repeat(np.arange(len(languages)), share)
        order = random.permutation(len(label))
        for a in range(0, len(order), lanes):
            part = order[a : a + lanes]
            grads, step = network.learn(np.ascontiguousarray(codes[part].T), label[part]), step + 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def sample(docs: DataFrame, key: str, text: str, label: str, most: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """A passage from each of up to `most` labelled rows of every language, picked and ordered by hashes."""
    key_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")
    order = F.md5(key_text)
    named = docs.filter(F.col(f"`{text}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    start = F.pmod(F.crc32(F.concat(key_text, F.lit("place").cast("binary"))), F.greatest(F.length(f"`{text}`") - PASSAGE, F.lit(1)))
    passage = F.col(f"`{text}`").substr((start + 1).cast("int"), F.lit(PASSAGE))
    rows = named.select(order.alias("_order"), passage.alias("_text"), F.col(f"`{label}`").cast("string").alias("_label"))
    counts = materialize(rows.groupBy("_label").agg(F.count("*").alias("_count")), "languages")
    # one pass over the documents picks about twice as many rows of each language as are kept; the rest reads those only
    share = F.least(F.lit(1.0), F.lit(2 * most + 1000) / F.col("_count")) * (1 << 30)
    picked = F.pmod(F.xxhash64("_order", "_text", "_label"), F.lit(1 << 30)) < share
    picked = materialize(rows.join(F.broadcast(counts), "_label").filter(picked).select("_order", "_text", "_label"), "passages")
    texts, labels = [], []
    for (name,) in counts.select("_label").orderBy("_label").collect():
        found = picked.filter(F.col("_label") == name).select("_order", "_text").orderBy("_order", "_text").limit(most).collect()
        texts += [r["_text"].encode("utf-8", "replace") for r in found]
        labels += [name] * len(found)
    return texts, labels


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, the mean probability of that language.

    A null text, or one without a letter, is `und` with score 0, and so is every text when there is no network.
    Columns of these names are replaced, all others kept.
    """
    languages, parameters = (network.languages, network.parameters) if network else ([], {})

    def make():
        own = Network(languages, parameters) if languages else None

        def batch(texts: pa.Array) -> pa.Array:
            raw = raw_texts(texts)
            known = np.array([bool(own) and any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in raw], bool)
            if not known.any():
                return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(raw), pa.string()), pa.array(np.zeros(len(raw)))], names=["lang_pred", "score"])
            p = own.documents(raw)
            best = p.argmax(axis=1)
            names = [languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            scores = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0).astype(np.float64)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

        return batch

    return add_columns(docs, arrow_column(make, "lang_pred string, score double")(F.col(f"`{text}`")), ["lang_pred", "score"])


def language(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """`docs` with held_out (crc32 of the key mod 4 is 2), lang_pred and score.

    The network is trained on rows that are not held out. Repeated rows and null keys are treated like others (a
    null key counts as an empty text); without a labelled row every text is `und`; an empty table gives an empty one.
    """
    held_out = crc(key) % 4 == 2
    network = train(*sample(docs.filter(~held_out), key, text, label))
    return identify(docs, network, text).withColumn("held_out", held_out)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(read_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")
