"""Quality rules: a decision list learned by sequential covering, as ordered Spark conditional expressions.

Statistics of whole texts are taken once, in Arrow batches beside the scan. From labelled documents a list of rules
is learned: each rule is grown on two thirds of them, condition by condition by information gain over threshold
candidates, pruned on the other third, and taken while it is right there; what it covers is set aside. The list
becomes one `when` chain over the stored statistics.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm.common import add_columns, arrow_column, crc, first_rows, raw_texts, read_documents, struct_array
from watchframe.session import materialize

#: The most labelled documents that a list is learned from (picked and ordered by hashes).
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"
_BETWEEN = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # white space, and what is not the first byte of a code point


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words in three-word windows that occur twice or more. codes: a number for each word, below `kinds`."""
    if len(codes) < 3:
        return 0
    pair = codes[:-1] * kinds + codes[1:]
    if kinds >= 1 << 20:  # too many for one number of three words
        pair, kinds = np.unique(pair, return_inverse=True)[1].astype(np.int64), len(codes)
        _, inverse, count = np.unique(pair[:-1] * kinds + np.unique(codes[2:], return_inverse=True)[1], return_inverse=True, return_counts=True)
    else:
        _, inverse, count = np.unique(pair[:-1] * kinds + codes[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(codes), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def text_counts(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    numbers = _Numbers()
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda these: len(raw) - len(raw.translate(None, these))
    return (
        len(words),
        len(raw.translate(None, _BETWEEN)),
        without(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(codes, len(numbers)),
        len(lines),
        without(_UPPER),
        without(_DIGITS),
        without(_MARKS),
        len(numbers),
    )


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with COUNTS; a null text counts as an empty one. Columns of these names are replaced."""

    def make():
        def batch(texts: pa.Array) -> pa.Array:
            rows = np.array([text_counts(x) for x in raw_texts(texts)], np.int64).reshape(-1, len(COUNTS))
            return struct_array(dict(zip(COUNTS, rows.T.copy(), strict=True)))

        return batch

    kind = ", ".join(f"{c} long" for c in COUNTS)
    return add_columns(docs, arrow_column(make, kind)(F.col(f"`{text}`")), COUNTS)


def features() -> dict[str, Column]:
    """What rules compare, by name."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "words_a_line": F.col("n_words") / lines,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words,
        "distinct": F.col("n_distinct") / words,
    }


@dataclass(frozen=True)
class Rule:
    """A text that meets all conditions (feature, above, threshold) is rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, [(x[f] > t) if above else (x[f] <= t) for f, above, t in self.conditions])

    def column(self) -> Column:
        known = features()
        return reduce(lambda a, b: a & b, [(known[f] > t) if above else (known[f] <= t) for f, above, t in self.conditions])


def _candidates(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values, at most 64 by quantiles of all and of the bad ones."""
    q = np.linspace(0, 1, 33)
    levels = np.unique(np.concatenate([np.quantile(values, q), np.quantile(values[bad], q) if bad.any() else []]))
    return (levels[1:] + levels[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule | None:
    conditions, inside = [], np.ones(len(bad), bool)
    while len(conditions) < most and (bad & inside).sum() and (~bad & inside).sum():
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        best, gain = None, 1e-9
        for name, values in x.items():
            order = np.argsort(values[inside], kind="stable")
            ordered = values[inside][order]
            below_bad = np.concatenate([[0], np.cumsum(bad[inside][order])])
            for t in _candidates(ordered, bad[inside][order]):
                k = int(np.searchsorted(ordered, t, "right"))
                for above in (True, False):
                    p = int(below_bad[-1] - below_bad[k]) if above else int(below_bad[k])
                    total = len(ordered) - k if above else k
                    if p and (found := p * (np.log2(p / total) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (name, above, float(t)), found
        if best is None:
            break
        conditions.append(best)
        inside &= Rule((best,)).covers(x)
    return Rule(tuple(conditions)) if conditions else None


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.8, most_rules: int = 16, most_conditions: int = 4) -> list[Rule]:
    """Rules in order. prune: the rows that rules are pruned and judged on; the others grow them."""
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, check = left & ~prune, left & prune
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if rule is None:
            break
        seen, wrong = {k: v[check] for k, v in x.items()}, bad[check]
        scored = []
        for n in range(len(rule.conditions), 0, -1):
            covered = Rule(rule.conditions[:n]).covers(seen)
            p, total = int((wrong & covered).sum()), int(covered.sum())
            scored.append(((2 * p - total) / max(total, 1), p, p / max(total, 1), Rule(rule.conditions[:n])))
        _, p, right, rule = max(scored, key=lambda s: s[:2])
        if p < 2 or right < precision:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def learn_from(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled rows of a statistics table; label 0 is bad, null labels are left out."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key), F.col(label).alias("_label"))
    columns = {k: v.alias(k) for k, v in features().items()}
    rows = stats.join(known, key).filter(~base_failed())
    rows = rows.select(F.md5(F.col(key).cast("string").cast("binary")).alias("_order"), "_label", (crc(key) % 3 == 1).alias("_prune"), *columns.values())
    pdf = first_rows(rows, ["_order", *columns], sample, known.count()).toPandas()
    if pdf.empty:
        return []
    return learn({k: pdf[k].to_numpy() for k in columns}, pdf["_label"].to_numpy() == 0, pdf["_prune"].to_numpy())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """True where the first rule that holds, or the default, keeps the text."""
    if not rules:
        return F.lit(True)
    chain = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(rule.column(), F.lit(False))
    return chain.otherwise(F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS, base_failed, kept) for every row of `docs`.

    Null, empty and wordless texts have counts of 0 and fail the base. Repeated rows come back as often, null keys as
    null; an empty table gives an empty table; without labels only the base decides. Labels that repeat a key count
    each. Other columns are left out.
    """
    stats = materialize(statistics(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), text).select(key, *COUNTS), "statistics")
    rules = learn_from(stats, labels, key)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept")
