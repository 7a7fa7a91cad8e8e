"""Sequence model, outlier detectors, fusion, explanations and drift on small data."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import START, by_event
from watchframe.operators import drift, explain, fusion, outliers, sequence
from watchframe.plans import detect
from watchframe.schema import LABELS


def sessions(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "event_id int, command_sequence array<int>")


def test_markov(spark):
    model = sequence.fit(sessions(spark, [[1, 2], [1, 2], [1, 3], [5], [], None]))
    df = sequence.with_surprise(sessions(spark, [[1, 2], [9, 1], [7], [], None, [1, 2, 4]]), model)
    a, v = 1e-5, 3
    known = -math.log((2 + a) / (3 + a * v))
    fresh = -math.log(a / (a * v))  # state 2 was never a source
    assert by_event(df, "sequence_anomaly_score") == pytest.approx([known, math.log(v), 0, 0, 0, (known + fresh) / 2])


def test_markov_without_training(spark):
    model = sequence.fit(sessions(spark, [[1]]))
    assert by_event(sequence.with_surprise(sessions(spark, [[1, 2]]), model), "sequence_anomaly_score") == [0.0]


def test_markov_model_is_stored(spark, tmp_path):
    model = sequence.fit(sessions(spark, [[1, 2, 1]]))
    model.save(str(tmp_path / "m"))
    again = sequence.load(spark, str(tmp_path / "m"))
    rows = sessions(spark, [[1, 2], [2, 1]])
    assert by_event(sequence.with_surprise(rows, again), "sequence_anomaly_score") == by_event(
        sequence.with_surprise(rows, model), "sequence_anomaly_score"
    )


@pytest.fixture(scope="module")
def cloud(spark):
    """Two correlated columns, a third with many ties, and three far points at the end."""
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2), float(rng.random() < 0.2)) for i in range(400)]
    rows += [(400, 9.0, 25.0, 0.0), (401, -8.0, 30.0, 0.0), (402, -9.0, -20.0, 1.0)]
    return spark.createDataFrame(rows, "event_id int, a double, b double, c double")


def exact_ecod(rows):
    x = np.array([[r.a, r.b, r.c] for r in rows])
    total = np.zeros(len(x))
    for j in range(3):
        col = x[:, j]
        left = -np.log([(col <= v).mean() for v in col])
        right = -np.log([(col >= v).mean() for v in col])
        skew = ((col - col.mean()) ** 3).mean()
        total += np.maximum(np.maximum(left, right), left if skew < 0 else right)
    return total


@pytest.mark.parametrize("limit", ["4000000", "50"])
def test_exact_ecod(spark, cloud, limit):
    """Also with value 0.0 and 1.0 of the tied column above the limit, on the broadcast side."""
    spark.conf.set("watchframe.hotRows", limit)
    spark.conf.set("watchframe.blockRows", "60")
    try:
        got = by_event(outliers.ecod_exact(cloud, ["a", "b", "c"]), "ecod_score")
    finally:
        spark.conf.unset("watchframe.hotRows")
        spark.conf.unset("watchframe.blockRows")
    assert got == pytest.approx(list(exact_ecod(cloud.orderBy("event_id").collect())))


def test_outlier_model(spark, cloud, tmp_path):
    columns = ["a", "b", "c"]
    params = outliers.Params(trees=60, sample=128)
    model = outliers.fit(cloud, columns, params)
    df = outliers.with_outliers(cloud, model)
    raw = outliers._raw_scores(cloud, model.nodes, model.ranks, model.facts)
    isolation = dict(zip(range(403), by_event(raw, "iforest")))
    ranks = sorted(isolation, key=isolation.get)
    assert {400, 401, 402} == set(ranks[-3:])
    flags = by_event(df, "tabular_flag")
    assert flags[400:] == [1, 1, 1] and 8 <= sum(flags) <= 20
    exact = exact_ecod(cloud.orderBy("event_id").collect())
    assert by_event(raw, "ecod") == pytest.approx(list(exact))
    model.save(str(tmp_path / "o"))
    again = outliers.with_outliers(cloud, outliers.load(spark, str(tmp_path / "o")))
    assert by_event(again, "tabular_anomaly_score") == by_event(df, "tabular_anomaly_score")
    # a second fit on the same rows in another order gives the same model
    other = outliers.with_outliers(cloud, outliers.fit(cloud.repartition(7, "b"), columns, params))
    assert by_event(other, "tabular_anomaly_score") == pytest.approx(by_event(df, "tabular_anomaly_score"))


@pytest.mark.parametrize("rows, sample, trees", [(10, 256, 7), (500, 32, 5), (500, 256, 9)])
def test_tree_samples(spark, rows, sample, trees):
    df = spark.range(rows).select(F.col("id").alias("event_id"), F.array(F.col("id").cast("double")).alias("x"))
    out = outliers.tree_samples(df, outliers.Params(trees=trees, sample=sample))
    size = min(rows, sample)
    per_tree = out.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("x").alias("d")).collect()
    assert sorted((r.tree, r.n, r.d) for r in per_tree) == [(t, size, size) for t in range(trees)]


def shapley(value, width):
    """Shapley values from a set function."""
    out = []
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        total = 0.0
        for k in range(width):
            w = math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width)
            total += sum(w * (value({*s, i}) - value(set(s))) for s in itertools.combinations(rest, k))
        out.append(total)
    return out


def test_contributions_against_all_subsets():
    import pandas as pd

    def node(i, left=-1, right=-1, f=-1, cut=0.0, n=0, p=0.0):
        split = {"featureIndex": f, "leftCategoriesOrThreshold": [cut] if f >= 0 else [], "numCategories": -1}
        return {"id": i, "leftChild": left, "rightChild": right, "split": split, "rawCount": n, "prediction": p}

    tree = [
        node(0, 1, 2, 0, 0.5, 100), node(1, 3, 4, 1, 0.5, 60), node(2, 5, 6, 0, 0.8, 40),
        node(3, n=20, p=1.0), node(4, n=40, p=-2.0), node(5, n=30, p=0.5), node(6, n=10, p=4.0),
    ]
    nodes = {n["id"]: n for n in tree}

    def expected(x, known, at=0):
        n = nodes[at]
        if n["leftChild"] < 0:
            return n["prediction"]
        f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        left, right = n["leftChild"], n["rightChild"]
        if f in known:
            return expected(x, known, left if x[f] <= cut else right)
        return sum(nodes[c]["rawCount"] / n["rawCount"] * expected(x, known, c) for c in (left, right))

    leaves = explain._leaves(pd.DataFrame({"nodeData": tree}), lambda n: n["prediction"])
    x = np.array([[0.1, 0.9, 7.0], [0.7, 0.2, 7.0], [0.9, 0.5, 7.0], [0.5, 0.5, 7.0]])
    got = explain._contributions(leaves, x)
    for row, phi in zip(x, got):
        assert phi == pytest.approx(shapley(lambda s: expected(row, s), 3))
    assert explain.base_value(leaves) == pytest.approx(expected(x[0], set()))
    both = explain._leaves(pd.DataFrame({"nodeData": tree}), lambda n: np.array([n["prediction"], -2 * n["prediction"]]))
    assert explain._contributions(both, x, np.array([0, 1, 1, 0])) == pytest.approx(got * np.array([[1], [-2], [-2], [1]]))


@pytest.fixture(scope="module")
def labelled(spark):
    """A log in which failures and odd devices are attacks of two kinds."""
    from datetime import timedelta

    from conftest import DEFAULTS
    from watchframe.schema import FLAT_EVENT

    rng = random.Random(8)
    rows = []
    for i in range(400):
        kind = rng.choices([0, 1, 5], [0.8, 0.1, 0.1])[0]
        event = {
            **DEFAULTS,
            "event_id": f"{i:05d}",
            "timestamp": START + timedelta(hours=i * 2),
            "entity_id": f"e{i % 5}",
            "auth_success": kind != 1,
            "bytes_transferred": rng.randrange(900, 1100) + (50_000 if kind == 5 else 0),
            "session_duration": rng.gauss(60, 5),
            "command_sequence": "['login', 'logout']" if kind != 1 else "['login', 'export_data']",
        }
        rows.append((*[event[c] for c in FLAT_EVENT.fieldNames()], kind))
    from pyspark.sql.types import IntegerType, StructType

    from watchframe.sources.files import with_commands

    return with_commands(spark.createDataFrame(rows, StructType([*FLAT_EVENT]).add("label_int", IntegerType())))


def test_end_to_end(spark, labelled, tmp_path):
    settings = detect.Settings(
        train_days=25,
        parse_commands=True,
        outliers=outliers.Params(trees=20, sample=64),
        fusion=fusion.Params(trees=4, depth=3, attribution_trees=10),
    )
    detector, scored, report = detect.run(labelled, settings)
    values = {(r.metric, r["class"]): r.value for r in report.collect()}
    assert values["accuracy", "all"] > 0.9 and values["pr_auc", "all"] > 0.9
    rows = scored.select("risk", "probabilities", "predicted_int", "predicted").collect()
    for r in rows:
        assert 0 <= r.risk <= 100
        assert sum(r.probabilities) == pytest.approx(1.0)
        assert r.risk == pytest.approx(100 * (1 - r.probabilities[0]))
        assert r.predicted_int == max(range(8), key=lambda i: (r.probabilities[i], -i))
        assert r.predicted == LABELS[r.predicted_int]
        assert r.probabilities[2] == r.probabilities[6] == r.probabilities[7] == 0.0
    detector.save(str(tmp_path / "d"))
    fresh = detect.load(spark, str(tmp_path / "d")).scored(scored.drop("risk", "probabilities", "predicted_int", "predicted", *fusion.SCORES, "tabular_flag"))
    assert by_event(fresh, "risk") == pytest.approx(by_event(scored, "risk"))

    texts = explain.explanations(scored, detector.fusion, min_risk=50.0).collect()
    assert len(texts) == sum(r.risk >= 50 for r in rows) > 0
    base = explain.base_value(explain.gate_leaves(detector.fusion, spark))
    for t in texts:
        logit = base + sum(v.value for v in t.shap_values)
        assert 100 / (1 + math.exp(-logit)) == pytest.approx(t.risk_score)
        sizes = [abs(v.value) for v in t.top_features]
        assert len(sizes) == 5 and sizes == sorted(sizes, reverse=True)
        assert t.text.splitlines()[2] == "Contributing factors:"
    kinds = explain.base_value(explain.attribution_leaves(detector.fusion, spark))
    assert sum(kinds) == pytest.approx(1.0)
    alerts = explain.with_contributions(scored.where("risk >= 50"), detector.fusion).select("probabilities", "predicted_int", "kind_values").collect()
    for r in alerts:
        if not r.predicted_int:
            assert r.kind_values is None
            continue
        share = r.probabilities[r.predicted_int] / (1 - r.probabilities[0])
        assert kinds[r.predicted_int - 1] + sum(v.value for v in r.kind_values) == pytest.approx(share)


def test_narration(spark):
    hit = "array(named_struct('rule','brute_force','detail','9 failed','mitre','T1110','confidence',0.5D))"
    none = "cast(array() as array<struct<rule:string,detail:string,mitre:string,confidence:double>>)"
    top = "array(named_struct('feature','x','value',0.4567D), named_struct('feature','y','value',-1.0D))"

    def text(risk, label, hits):
        df = spark.sql(f"SELECT '{label}' AS p, {risk}D AS r, {top} AS t, {hits} AS h")
        return df.select(explain.narration(F.col("p"), F.col("r"), F.col("t"), F.col("h"))).first()[0]

    factors = "\n\nContributing factors:\n  • x: +0.457 (↑ increases risk)\n  • y: -1.000 (↓ decreases risk)"
    assert text(92.4, "brute_force", hit) == (
        f"🔴 CRITICAL — BRUTE FORCE (risk 92/100){factors}\n\nRule engine detections:\n  ⚡ brute_force: 9 failed\n     MITRE ATT&CK: T1110"
    )
    assert text(72.5, "low_and_slow", none) == (
        f"🟠 HIGH — LOW AND SLOW (risk 72/100){factors}\n\nMITRE ATT&CK: T1048 (Exfiltration Over Alternative Protocol)"
    )
    assert text(10.0, "normal", none) == f"🟢 LOW — NORMAL (risk 10/100){factors}"


def series(spark, rates, cohort="user", n=1):
    return spark.createDataFrame([(cohort, i, n, int(r * n)) for i, r in enumerate(rates)], "cohort string, bucket_us bigint, n bigint, anomalies bigint")


def test_drift_is_found_after_the_shift(spark):
    found = drift.drift_events(series(spark, [0] * 30 + [1] * 30), delta=0.99).orderBy("bucket_us").collect()
    assert found and 30 <= found[0].bucket_us < 60
    assert found[0].type == "distribution_shift" and "'user'" in found[0].message


def test_no_drift_in_a_steady_rate(spark):
    steady = series(spark, [0.02] * 200, n=100).unionByName(series(spark, [0.02] * 100 + [0.2] * 100, "edge_device", 100))
    found = drift.drift_events(steady)
    assert {r.cohort for r in found.collect()} == {"edge_device"}
    assert {r.cohort for r in drift.active_cohorts(steady).collect()} == {"user", "edge_device"}
    resets = spark.createDataFrame([("edge_device", 100)], "cohort string, reset_us bigint")
    assert drift.drift_events(drift.after_reset(steady, resets)).count() == 0


def quadratic(series, delta, min_side=5):
    """(position, buckets dropped) when every split of the window is tested at every step."""
    n, hits, start, out = np.array([x[0] for x in series], float), np.array([x[1] for x in series], float), 0, []
    for end in range(1, len(series) + 1):
        old = start
        while end - start > 1 and drift._cuts(n[start:end], hits[start:end], delta, min_side):
            start += 1
        if start > old:
            out.append((end - 1, start - old))
    return out


def test_adaptive_window():
    rng = random.Random(4)
    for trial in range(20):
        rates = [rng.choice([0.02, 0.1, 0.4]) for _ in range(4)]
        series = [(n := rng.randrange(0, 60), sum(rng.random() < r for _ in range(n))) for r in rates for _ in range(rng.randrange(20, 60))]
        whole = drift.Window(0.01, 5, len(series))
        assert [(i, d) for i, x in enumerate(series) if (d := whole.add(*x))] == quadratic(series, 0.01)
        window, held = drift.Window(0.01, 5), []
        for i, x in enumerate(series):
            dropped = window.add(*x)
            held = (held + [x])[dropped:]
            sizes = [e[3] for e in window.entries]
            assert sizes == sorted(sizes, reverse=True) and max(sizes.count(s) for s in sizes) <= 5
            assert [sum(c) for c in zip(*held)] == [sum(e[k] for e in window.entries) for k in (0, 1)] and len(held) == sum(e[2] for e in window.entries)
            assert len(window.entries) <= 6 * (1 + math.log2(i + 2))


def test_surprise_in_the_row_equals_the_join(spark):
    """On both roads: null and unknown commands, short sessions, repeated and null ids."""
    sessions = [["a", "b", "a"], ["b", None, "a"], ["c"], [], None, ["z", "z"], ["a", "b", "c", "a", "b"]]
    rows = spark.createDataFrame([(i % 4 or None, s) for i, s in enumerate(sessions * 3)], "event_id long, command_sequence array<string>")
    model = sequence.fit(rows.limit(9))
    near = sequence.with_surprise(rows, model).collect()
    spark.conf.set("watchframe.rowLocalPairs", "0")
    try:
        far = sequence.with_surprise(rows, model).collect()
    finally:
        spark.conf.unset("watchframe.rowLocalPairs")
    shown = lambda found: sorted((str(r.event_id), str(r.command_sequence), round(r.sequence_anomaly_score, 9)) for r in found)
    assert shown(near) == shown(far) and len(near) == 21


def test_reaches_are_worked_out_by_pattern(monkeypatch):
    """However many rows there are, a leaf's reaches are taken for the patterns of its path; the sums stay the same."""
    rng = np.random.default_rng(3)
    leaves = []
    for d in (0, 1, 2, 2, 3):
        low = rng.uniform(-1, 0, d)
        leaves.append(explain.Leaf(rng.random(7), rng.choice(4, d, replace=False), low, low + 0.7, rng.uniform(0.2, 0.9, d)))
    x, kind = rng.uniform(-1, 1, (1000, 4)), rng.integers(0, 7, 1000)
    alone = np.concatenate([explain._contributions(leaves, x[i : i + 1], kind[i : i + 1]) for i in range(1000)])
    seen = []
    reaches = explain._reaches
    monkeypatch.setattr(explain, "_reaches", lambda inside, share: seen.append(inside.size) or reaches(inside, share))
    assert (explain._contributions(leaves, x, kind) == alone).all()
    assert sum(seen) == 1 * 2 + 2 * (2 * 4) + 3 * 8


def test_small_matrix_takes_few_tasks(spark):
    assert fusion._in_fewer_tasks(spark.range(100).repartition(8)).rdd.getNumPartitions() == 1
    assert fusion._in_fewer_tasks(spark.range(40_000).repartition(8)).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("limit", ["0", "5", "500000"])
def test_ecod_in_the_row_equals_the_join(spark, cloud, limit, capsys):
    """No column, the one of two values and all columns looked up in the row; values beside the fitted ones too."""
    columns = ["a", "b", "c"]
    fitted = cloud.where("event_id % 2 = 0")
    ranks = outliers.value_ranks(fitted, columns).localCheckpoint()
    signs = [1.0, -1.0, 0.0]
    spark.conf.set("watchframe.rowValues", limit)
    try:
        scored = outliers.with_ecod(cloud, ranks, columns, signs)
        got = by_event(scored, "ecod")
        scored.explain()
    finally:
        spark.conf.unset("watchframe.rowValues")
    assert ("Exchange" in capsys.readouterr().out) == (limit != "500000")
    known = np.array(fitted.select(*columns).collect(), float)
    want = []
    for row in cloud.orderBy("event_id").select(*columns).collect():
        total, floor = 0.0, 1 / (len(known) + 1)
        for f, sign in enumerate(signs):
            left = -math.log(max((known[:, f] <= row[f]).mean(), floor))
            right = -math.log(max((known[:, f] >= row[f]).mean(), floor))
            total += max(left, right, left if sign < 0 else right if sign > 0 else left + right)
        want.append(total)
    assert got == pytest.approx(want)


def test_ecod_without_fitted_rows(spark, cloud):
    ranks = outliers.value_ranks(cloud.limit(0), ["a"])
    assert outliers.with_ecod(cloud, ranks, ["a"], [0.0]).isEmpty()


def test_outlier_model_of_one_column(spark, cloud):
    df = outliers.with_outliers(cloud, outliers.fit(cloud, ["b"], outliers.Params(trees=20, sample=64)))
    assert by_event(df, "tabular_flag")[401:] == [1, 1]


def test_forest_as_heaps():
    """A tree takes one look-up of a feature and of a threshold a level; leaves end where a walk over the nodes ends."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(11_000, 4)).round(1)
    x[:, 1] = rng.integers(0, 2, len(x))
    grow = outliers._grow(outliers.Params(seed=5), 4)
    draws = [x[:30], x[30:60, :] * [1, 0, 0, 0], x[60:61]]  # whole trees, one of ties, a single leaf
    nodes = pd.concat([grow(pd.DataFrame({"tree": t, "x": list(d)})) for t, d in enumerate(draws)])
    forest = outliers._packed(nodes.sample(frac=1, random_state=1), 30)
    assert forest["feature"].shape == forest["threshold"].shape == (3, 31) and forest["depth"].shape == (3, 32)
    by_tree = [dict(zip(t["node"], t.itertuples(index=False))) for _, t in nodes.groupby("tree")]
    found = outliers._forest_scores(forest, x)
    assert found.shape == (11_000,) and outliers._forest_scores(forest, x[:0]).shape == (0,)
    for i in [*range(50), 4999, 5000, 10_999]:
        lengths = []
        for tree in by_tree:
            node = tree[0]
            while node.feature >= 0:
                node = tree[node.below if x[i, node.feature] <= node.threshold else node.above]
            lengths.append(node.depth)
        assert found[i] == pytest.approx(2 ** (-np.mean(lengths) / forest["norm"]), rel=1e-12)
    assert outliers._forest_scores(outliers._packed(nodes[:0], 0), x[:0]).shape == (0,)


def test_training_scores_only_what_the_models_read(spark, monkeypatch):
    read = ["event_id", "label_int", "command_sequence", *detect.FEATURES, *fusion.RULE_FLAGS]
    seen = []

    def scored(df, *_, **options):
        seen.append((sorted(df.columns), options))
        return df

    monkeypatch.setattr(outliers, "fit", scored)
    monkeypatch.setattr(sequence, "fit", scored)
    monkeypatch.setattr(outliers, "with_outliers", scored)
    monkeypatch.setattr(sequence, "with_surprise", scored)
    monkeypatch.setattr(fusion, "fit", scored)
    wide = spark.range(1).select(*[F.lit(0).alias(c) for c in [*read, "geo_city", "rule_hits", "probabilities"]])
    detect.fit(wide)
    assert [columns for columns, _ in seen] == [sorted(read)] * 5
    assert seen[2][1] == {"in_row": False}  # the rows' order, which the forest draws by, is the join's


def grown_tree(rng, width, depth, value):
    """Rows of a saved tree whose splits take features at random, the same one more than once; some leaves come early."""
    nodes, todo = [], [(0, 0, 1000)]
    while todo:
        at, level, n = todo.pop()
        leaf = level == depth or (level > 1 and rng.random() < 0.2)
        children = (-1, -1) if leaf else (len(nodes) + len(todo) + 1, len(nodes) + len(todo) + 2)
        split = {"featureIndex": -1 if leaf else int(rng.integers(width)), "leftCategoriesOrThreshold": [] if leaf else [float(rng.uniform(-1, 1))]}
        nodes.append({"id": at, "leftChild": children[0], "rightChild": children[1], "split": split, "rawCount": n, "prediction": value(rng)})
        if not leaf:
            todo += [(children[0], level + 1, n * 0.3), (children[1], level + 1, n * 0.7)]
    return nodes


@pytest.mark.parametrize("classes", [None, 7])
def test_trees_are_met_split_by_split(monkeypatch, classes):
    """Contributions of whole trees equal those leaf by leaf; a split is met once a row and leaves on it are looked up together."""
    import pandas as pd

    rng = np.random.default_rng(6)
    trees = [
        explain._tree(pd.DataFrame({"nodeData": grown_tree(rng, 5, depth, lambda g: g.normal(size=classes))}), lambda n: n["prediction"])
        for depth in (0, 1, 3, 5, 6)
    ]
    assert any(len(leaf.features) < len(way) for tree in trees for leaf, (_, way) in zip(tree.leaves, tree.ways))
    x = rng.uniform(-1, 1, (600, 5))
    kind = None if classes is None else rng.integers(1, classes, 600)
    leaves = [leaf for tree in trees for leaf in tree.leaves]
    want = explain._contributions(leaves, x, kind)
    monkeypatch.setattr(explain, "TREE_ROWS", 250)
    monkeypatch.setattr(explain, "_contributions", None)  # the leaf-by-leaf road is not taken
    assert explain._tree_contributions(trees, x, kind) == pytest.approx(want, abs=1e-12)


def test_batches_are_explained_together():
    batches = [([0] * n,) for n in (3, 4, 9, 1, 0)]
    assert [[len(b[0]) for b in held] for held in explain._gathered(iter(batches), 7)] == [[3, 4], [9], [1, 0]]


def test_large_training_tables_are_scored_in_the_row(spark, monkeypatch):
    """Above the bound no cells are joined for the training scores; both roads give the same scores."""
    rng = random.Random(2)
    rows = [(i, int(i % 9 == 0), ["login", rng.choice("ab")], *[rng.random() for _ in [*detect.FEATURES, *fusion.RULE_FLAGS]]) for i in range(60)]
    train = spark.createDataFrame(rows, ["event_id", "label_int", "command_sequence", *detect.FEATURES, *fusion.RULE_FLAGS])
    seen, cut = [], outliers.fitted_tails
    monkeypatch.setattr(outliers, "fitted_tails", lambda *a: seen.append("joined") or cut(*a))
    monkeypatch.setattr(fusion, "fit", lambda scored, p: by_event(scored, *fusion.SCORES))
    settings = detect.Settings(outliers=outliers.Params(trees=5, sample=16))
    joined = detect.fit(train, settings).fusion
    assert seen == ["joined"]
    monkeypatch.setattr(detect, "JOINED_ROWS", 59)
    in_row = detect.fit(train, settings).fusion
    assert seen == ["joined"] and len(in_row) == 60
    assert [x for row in in_row for x in row] == pytest.approx([x for row in joined for x in row])


def test_gate_by_histograms_is_mllibs(spark, monkeypatch, tmp_path):
    """Above the bound the gate's trees come from sums over blocks: the same probabilities, saved and loaded too."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 5))
    x[:, 3] = rng.integers(0, 4, 3000)
    x[:, 4] = 1.0  # a column without thresholds
    odds = x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=3000)
    label = np.where(odds > 1.5, rng.integers(1, 3, 3000), 0)
    columns = [f"c{i}" for i in range(5)]
    train = spark.createDataFrame([(int(y), *map(float, row)) for y, row in zip(label, x)], ["label_int", *columns]).repartition(3)
    params = fusion.Params(trees=13, depth=3, rate=0.1, attribution_trees=2, attribution_depth=2)
    monkeypatch.setattr(fusion.boosting, "BLOCK_ROWS", 500)
    grown = []
    monkeypatch.setattr(fusion.boosting, "trees", lambda *a, f=fusion.boosting.trees: grown.extend(f(*a)) or grown)
    mllib = fusion.fit(train, columns, params)
    assert not grown
    monkeypatch.setattr(fusion, "HISTOGRAM_ROWS", 2999)
    own = fusion.fit(train, columns, params)
    assert len(grown) == own.gate.getNumTrees == own.gate.getMaxIter() == 13 and own.gate.treeWeights == mllib.gate.treeWeights
    assert [sum(t.rows[t.column < 0]) for t in grown] == [3000] * 13
    own.save(str(tmp_path / "own"))
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(500, 5)))], ["event_id", *columns])
    risks = [by_event(fusion.predict(rows, m), "risk") for m in (mllib, own, fusion.load(str(tmp_path / "own")))]
    assert risks[1] == risks[2] == pytest.approx(risks[0], abs=1e-9) and len(set(risks[0])) > 50
    shares = [explain.base_value(explain.gate_leaves(m, spark)) for m in (mllib, own)]
    assert shares[1] == pytest.approx(shares[0], abs=1e-9)


def test_gate_refuses_rows_without_label(spark, monkeypatch):
    monkeypatch.setattr(fusion, "HISTOGRAM_ROWS", 1)
    train = spark.createDataFrame([(0, 1.0), (None, 2.0), (1, 3.0)], "label_int int, a double")
    with pytest.raises(ValueError, match="no label"):
        fusion.fit(train, ["a"], fusion.Params(trees=2))
