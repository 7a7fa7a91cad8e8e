"""Why an alert was raised: feature contributions, and a text for the analyst.

Contributions are path-dependent tree SHAP values (Lundberg et al. 2018): to the gate's log-odds, which is why the
risk is high, and to the share of the predicted kind of attack in the attribution forest, which is why it is that kind. The trees are
read from their saved form, turned into leaf boxes on the driver (trees times leaves, bounded by the models'
parameters) and sent to the tasks, which handle alert rows in Arrow batches. A row meets each split once, and leaves beside
each other are looked up together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchframe.operators.fusion import ATTACKS, FusionModel
from watchframe.operators.outliers import matrix
from watchframe.schema import mitre_of, severity
from watchframe.session import scratch_path


class Leaf(NamedTuple):
    """A leaf as a box: for each feature on its path the interval (low, high] and the share of rows kept.

    `value` is a number, or an array of one number per class.
    """

    value: float | np.ndarray
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


class Tree(NamedTuple):
    """A tree's splits, parents first and subtree by subtree: feature, cut and how many splits lie above. Leaves come with their
    `ways`: the split that a leaf hangs on, and of every split on its path the feature and whether the leaf is on the low side."""

    features: list[int]
    cuts: list[float]
    depths: list[int]
    leaves: list[Leaf]
    ways: list[tuple[int, list[tuple[int, bool]]]]


def _tree(nodes: pd.DataFrame, value: Callable[[dict], float | np.ndarray]) -> Tree:
    """One tree with its boxes; several splits on one feature become one interval."""
    rows = {n["id"]: n for n in nodes["nodeData"]}
    tree = Tree([], [], [], [], [])
    todo = [(0, {}, -1, [])]
    while todo:
        at, box, above, way = todo.pop()
        node = rows[at]
        if node["leftChild"] < 0:
            f = list(box)
            parts = np.array([box[i] for i in f]).reshape(len(f), 3)
            tree.leaves.append(Leaf(value(node), np.array(f, dtype=int), parts[:, 0], parts[:, 1], parts[:, 2]))
            tree.ways.append((above, way))
            continue
        feature, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
        place = len(tree.features)
        tree.features.append(feature)
        tree.cuts.append(cut)
        tree.depths.append(len(way))
        for child, interval in (("leftChild", (low, min(high, cut))), ("rightChild", (max(low, cut), high))):
            kept = rows[node[child]]["rawCount"] / node["rawCount"]
            step = (feature, child == "leftChild")
            todo.append((node[child], {**box, feature: (*interval, share * kept)}, place, [*way, step]))
    return tree


def _leaves(nodes: pd.DataFrame, value: Callable[[dict], float | np.ndarray]) -> list[Leaf]:
    """Boxes of one tree."""
    return _tree(nodes, value).leaves


def _reaches(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """[feature, row]: the mean, over orders of the features, of the chance to reach a leaf without the feature.

    `inside` and `share` are by feature and row. The path is extended by one feature after another, which keeps for each
    number of known features the weight of all sets of that size, and each feature is unwound from the whole again:
    quadratic in the path's length.
    """
    d, n = inside.shape
    weight = np.zeros((d + 1, n))
    weight[0] = 1.0
    for k in range(d):  # k features are on the path already
        for size in range(k, -1, -1):
            weight[size + 1] += inside[k] * weight[size] * (size + 1) / (k + 2)
            weight[size] *= share[k] * (k + 1 - size) / (k + 2)
    out = np.zeros((d, n))
    for i in range(d):
        known, rest = inside[i] > 0, weight[d]
        for size in range(d - 1, -1, -1):
            if_known = rest * (d + 1) / (size + 1)
            if_not = weight[size] * (d + 1) / (share[i] * (d - size))
            out[i] += np.where(known, if_known, if_not)
            rest = weight[size] - if_known * share[i] * (d - size) / (d + 1)
    return out


#: Leaves whose tables are made and held at a time.
LEAVES = 256


def _tables(leaves: Sequence[Leaf], rows: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """By leaf, for every pattern of features that a row may meet: [feature, pattern], whether it is inside less its share, and
    its reach. None for paths with more patterns than rows."""
    out: list = [None] * len(leaves)
    for d in {len(leaf.features) for leaf in leaves}:
        if not d or 2**d > rows:
            continue
        at = [i for i, leaf in enumerate(leaves) if len(leaf.features) == d]
        inside = np.tile((np.arange(2**d) >> np.arange(d)[:, None] & 1).astype(float), len(at))
        share = np.repeat(np.array([leaves[i].share for i in at]).T, 2**d, axis=1)
        off, reaches = inside - share, _reaches(inside, share)
        for place, i in enumerate(at):
            own = slice(place * 2**d, (place + 1) * 2**d)
            out[i] = off[:, own], reaches[:, own]
    return out


def _contributions(leaves: Sequence[Leaf], x: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Shapley value of every column for every row, summed over leaves; of the row's class where leaves have several.

    A leaf gives a row what the row's pattern says: which features of the leaf's path it is inside of. Patterns are at most
    two to the path's length, so what they give is worked out once and looked up.
    """
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    for start in range(0, len(leaves), LEAVES):
        chunk = leaves[start : start + LEAVES]
        for leaf, table in zip(chunk, _tables(chunk, len(x))):
            if not len(leaf.features):
                continue
            inside = [(columns[f] > low) & (columns[f] <= high) for f, low, high in zip(leaf.features, leaf.low, leaf.high)]
            if table is None:
                parts = np.array(inside, dtype=float)
                share = np.repeat(leaf.share[:, None], len(x), axis=1)
                value = leaf.value if kind is None else leaf.value[kind]
                phi[leaf.features] += value * (parts - share) * _reaches(parts, share)
                continue
            off, reaches = table
            pattern = np.zeros(len(x), dtype=np.intp)
            for j, known in enumerate(inside):
                pattern += known.astype(np.intp) << j
            if kind is None:
                given = leaf.value * off * reaches
            else:
                given = (leaf.value[:, None] * off[:, None] * reaches[:, None]).reshape(len(off), -1)
                pattern += kind * off.shape[1]
            for f, values in zip(leaf.features, given):
                phi[f] += values[pattern]
    return phi.T


#: Rows for every pattern of a longest path, at least, for whole trees to be looked up.
PATTERN_ROWS = 4

#: Rows that meet a tree at a time, which a core's cache holds.
TREE_ROWS = 8192

#: Rows for which the tables of a tree are made at a time.
EXPLAINED_ROWS = 65_536


def _below(tree: Tree, kinds: np.ndarray | None, rows: int) -> list[dict[int, np.ndarray]]:
    """By split, for each feature what the leaves on it give a row of each kind, by the sides the row takes at the split
    (the last bit) and those above it."""
    out: list[dict[int, np.ndarray]] = [{} for _ in tree.features]
    for leaf, (at, way), table in zip(tree.leaves, tree.ways, _tables(tree.leaves, rows)):
        if table is None:
            continue
        sides = np.arange(2 ** len(way))
        inside = np.ones((len(leaf.features), len(sides)), dtype=bool)
        place = {f: j for j, f in enumerate(leaf.features)}
        for bit, (feature, low) in enumerate(reversed(way)):
            inside[place[feature]] &= (sides >> bit & 1) == low
        pattern = (inside << np.arange(len(place))[:, None]).sum(axis=0)
        given = np.take(table[0] * table[1], pattern, axis=1)
        if kinds is None:
            given = leaf.value * given
        else:
            given = (leaf.value[kinds][:, None] * given[:, None]).reshape(len(given), -1)
        for f, values in zip(leaf.features, given):
            out[at][f] = out[at][f] + values if f in out[at] else values
    return out


def _tree_contributions(trees: Sequence[Tree], x: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """`_contributions` of the trees' leaves. Of many rows each split is met once, whatever the number of leaves behind it, and
    the leaves that hang on one split are looked up together."""
    longest = max((depth + 1 for tree in trees for depth in tree.depths), default=0)
    if len(x) < PATTERN_ROWS * 2**longest:
        return _contributions([leaf for tree in trees for leaf in tree.leaves], x, kind)
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    kinds, own_kind = (None, None) if kind is None else np.unique(kind, return_inverse=True)
    for tree in trees:
        below = _below(tree, kinds, len(x))
        for start in range(0, len(x), TREE_ROWS):
            own = slice(start, start + TREE_ROWS)
            sides: list = [None] * longest
            for f, cut, depth, tables in zip(tree.features, tree.cuts, tree.depths, below):
                low = columns[f, own] <= cut
                sides[depth] = 2 * sides[depth - 1] + low if depth else low.astype(np.intp)
                if not tables:
                    continue
                at = sides[depth] if kinds is None else sides[depth] + (own_kind[own] << depth + 1)
                for g, values in tables.items():
                    phi[g, own] += values.take(at)
    return phi.T


def _gathered(batches: Iterator, rows: int) -> Iterator[list]:
    """Successive batches in lists of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch[0] if isinstance(batch, tuple) else batch)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def base_value(leaves: Sequence[Leaf]) -> float | np.ndarray:
    """Log-odds, or share of each class, before any feature is known."""
    total = sum(leaf.value * leaf.share.prod() for leaf in leaves)
    return total if isinstance(total, np.ndarray) else float(total)


def _trees(saved: Any, spark, name: str) -> pd.DataFrame:
    path = scratch_path(spark, name)
    saved.write().save(path)
    return spark.read.parquet(f"{path}/data").toPandas()  # at most trees * 2 ** (depth + 1) rows


def gate_trees(model: FusionModel, spark) -> list[Tree]:
    """The gate's trees, valued in log-odds (its margin counts half)."""
    weights = model.gate.treeWeights
    trees = _trees(model.gate, spark, "gate").groupby("treeID")
    return [_tree(nodes, lambda n, w=2 * weights[tree]: w * n["prediction"]) for tree, nodes in trees]


def attribution_trees(model: FusionModel, spark) -> list[Tree]:
    """The attribution forest's trees, valued in shares of each kind of attack, which add up over the trees."""
    n = model.attribution.getNumTrees

    def shares(node: dict) -> np.ndarray:
        counts = np.zeros(ATTACKS)
        counts[: len(node["impurityStats"])] = node["impurityStats"]
        return counts / counts.sum() / n

    return [_tree(nodes, shares) for _, nodes in _trees(model.attribution, spark, "attribution").groupby("treeID")]


def gate_leaves(model: FusionModel, spark) -> list[Leaf]:
    """All leaf boxes of the gate."""
    return [leaf for tree in gate_trees(model, spark) for leaf in tree.leaves]


def attribution_leaves(model: FusionModel, spark) -> list[Leaf]:
    """All leaf boxes of the attribution forest."""
    return [leaf for tree in attribution_trees(model, spark) for leaf in tree.leaves]


def with_contributions(alerts: DataFrame, model: FusionModel) -> DataFrame:
    """Add `shap_values` (to the gate's log-odds) and `kind_values` (to the share of the predicted kind among attacks,
    null where none is predicted): array<struct<feature, value>> in column order."""
    spark = alerts.sparkSession
    plain = lambda trees: [tuple(t._replace(leaves=[tuple(leaf) for leaf in t.leaves])) for t in trees]
    gate = spark.sparkContext.broadcast(plain(gate_trees(model, spark)))
    forest = spark.sparkContext.broadcast(plain(attribution_trees(model, spark)))
    width = len(model.columns)

    def built(trees: list[tuple]) -> list[Tree]:
        return [(tree := Tree(*t))._replace(leaves=[Leaf(*leaf) for leaf in tree.leaves]) for t in trees]

    def rows(batches: list[pd.Series]) -> np.ndarray:
        return np.concatenate([np.stack(b.to_numpy()) if len(b) else np.zeros((0, width)) for b in batches])

    def by_batch(phi: np.ndarray, batches: list[pd.Series]) -> Iterator[pd.Series]:
        for part in np.split(phi, np.cumsum([len(b) for b in batches])[:-1]):
            yield pd.Series(list(part))

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = built(gate.value)
        for held in _gathered(batches, EXPLAINED_ROWS):
            yield from by_batch(_tree_contributions(trees, rows(held)), held)

    @F.pandas_udf("array<double>")
    def explain_kind(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        trees = built(forest.value)
        for held in _gathered(batches, EXPLAINED_ROWS):
            x, predicted = zip(*held)
            kind = np.maximum(np.concatenate(predicted).astype(int) - 1, 0)
            yield from by_batch(_tree_contributions(trees, rows(x), kind), x)

    names = F.array(*[F.lit(c) for c in model.columns])
    named = lambda values: F.zip_with(names, values, lambda f, v: F.struct(f.alias("feature"), v.alias("value")))
    x = matrix(model.columns)
    out = alerts.withColumn("shap_values", named(explain(x))).withColumn("_kind", explain_kind(x, F.coalesce("predicted_int", F.lit(0))))
    return out.withColumn("kind_values", F.when(F.col("predicted_int") > 0, named(F.col("_kind")))).drop("_kind")


def top_features(values: Column, k: int = 5) -> Column:
    """The k largest contributions by size; equal sizes keep column order."""
    keyed = F.transform(values, lambda v, i: F.struct((-F.abs(v["value"])).alias("size"), i.alias("i"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["v"])


def narration(predicted: Column, risk: Column, top: Column, hits: Column) -> Column:
    """The analyst's text. Its wording and symbols are fixed values."""
    mark = F.when(risk >= 90, "🔴").when(risk >= 70, "🟠").when(risk >= 50, "🟡").otherwise("🟢")
    name = F.replace(F.upper(predicted), F.lit("_"), F.lit(" "))
    head = F.format_string("%s %s — %s (risk %.0f/100)", mark, severity(risk), name, F.bround(risk, 0))
    factors = F.transform(
        top,
        lambda t: F.format_string(
            "  • %s: %+.3f (%s)",
            t["feature"],
            F.bround(t["value"], 3),  # halves to even, as in the other texts
            F.when(t["value"] > 0, "↑ increases risk").otherwise("↓ decreases risk"),
        ),
    )
    trace = F.transform(
        hits, lambda h: F.format_string("  ⚡ %s: %s\n     MITRE ATT&CK: %s", h["rule"], h["detail"], h["mitre"])
    )
    rules = F.concat(F.array(F.lit(""), F.lit("Rule engine detections:")), trace)
    tag = mitre_of(predicted)
    closing = F.when(F.size(hits) > 0, rules).when(
        tag != "", F.array(F.concat(F.lit("\nMITRE ATT&CK: "), tag))
    )
    none = F.array().cast("array<string>")
    lines = F.concat(F.array(head, F.lit(""), F.lit("Contributing factors:")), factors, F.coalesce(closing, none))
    return F.array_join(lines, "\n")


def explanations(
    scored: DataFrame, model: FusionModel, min_risk: float = 50.0, top_k: int = 5
) -> DataFrame:
    """One explanation per event at or above `min_risk`."""
    alerts = with_contributions(scored.where(F.col("risk") >= min_risk), model)
    alerts = alerts.withColumn("top_features", top_features(F.col("shap_values"), top_k))
    text = narration(F.col("predicted"), F.col("risk"), F.col("top_features"), F.col("rule_hits"))
    return alerts.select(
        "event_id",
        text.alias("text"),
        "shap_values",
        "top_features",
        top_features(F.col("kind_values"), top_k).alias("kind_features"),
        F.col("rule_hits").alias("rule_trace"),
        mitre_of(F.col("predicted")).alias("mitre"),
        F.col("risk").alias("risk_score"),
        F.col("predicted").alias("predicted_type"),
    )
