from functools import reduce

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.operators import classifiers, neighbours
from veilwright.operators.classifiers import ALL_MODELS, KNN, Task, all_predictions, fit_model
from veilwright.operators.kernel_machine import fit_kernel_machine, rbf, solve_dual
from veilwright.operators.neighbours import Index, fits_in_memory, knn_predict, nearest, search_effort, squared_distances
from veilwright.operators.scoring import accuracy, class_scores, confusion, result_table, weighted_scores
from veilwright.operators.splitting import train_test_split
from veilwright.operators.summary import compare_models
from veilwright.plans.utility import prepare_variants, run_utility, with_row_key


def test_scores_by_hand(spark):
    pred = spark.createDataFrame(
        [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "b", "b"), (5, "c", "a"), (6, "a", "d")],
        "id long, label string, prediction string")
    counts = confusion(pred)
    assert accuracy(counts).first()["accuracy"] == 0.5
    per = {r["class"]: r for r in class_scores(counts).collect()}
    assert (per["c"]["precision"], per["c"]["f1"], per["d"]["support"]) == (0.0, 0.0, 0)
    w = weighted_scores(counts).first()
    assert w["precision"] == pytest.approx((3 * 0.5 + 2 * 2 / 3 + 0) / 6)
    assert w["recall"] == pytest.approx(0.5)
    assert w["f1"] == pytest.approx((3 * 0.4 + 2 * 0.8 + 0) / 6)


@pytest.mark.parametrize("options", [{}, {"small_bytes": 0}, {"small_bytes": 0, "pivots": 5, "chunk_rows": 30},
                                     {"small_bytes": 0, "pivots": 150, "chunk_rows": 7}])
def test_neighbours_equal_brute_force(spark, options):
    """Clusters, one of which holds most rows, and many equal distances."""
    rng = np.random.default_rng(4)
    points = np.round(np.concatenate([rng.normal(0, 1, (260, 3)), rng.normal(9, 1, (60, 3)), np.zeros((40, 3))]), 1)
    asked = np.round(np.concatenate([rng.normal(0, 1, (50, 3)), rng.normal(5, 3, (20, 3)), np.zeros((5, 3))]), 1)
    train = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i long, a double, b double, c double")
    test = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(asked)], "q long, a double, b double, c double")
    got = {(r["q"], r["rank"]): (r["i"], r["distance"])
           for r in nearest(train, test, ["a", "b", "c"], "i", "q", 4, **options).collect()}
    assert len(got) == 4 * len(asked)
    for q, p in enumerate(asked):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(d)), d))[:4]
        assert [got[(q, r + 1)][0] for r in range(4)] == list(order)
        assert np.allclose([got[(q, r + 1)][1] for r in range(4)], d[order])


@pytest.mark.parametrize("shape", ["sphere", "far", "copies", "narrow"])
@pytest.mark.parametrize("codes", [0, 2])
def test_index_equals_brute_force(shape, codes):
    """Several boxes and groups; rounding must not lose a row, nor folds or category codes."""
    rng = np.random.default_rng(6)
    points, asked = (rng.normal(size=(n, 2 if shape == "narrow" else 20)) for n in (5000, 1200))
    if shape == "sphere":
        points, asked = (p / np.linalg.norm(p, axis=1, keepdims=True) for p in (points, asked))
    elif shape == "far":
        points, asked = points * 1e-4 + 1e6, asked * 1e-4 + 1e6
    elif shape == "copies":
        points[:3000] = points[0]
        asked[:100] = points[0]
    points, asked = (np.hstack((p, rng.integers(0, 3, (len(p), codes)))) for p in (points, asked))
    folds, own = (rng.integers(0, 3, len(p)) for p in (points, asked))
    for f, g in ((None, None), (folds, own)):
        gaps, places = Index(points, f, codes).search(asked, g, 5)
        all_ = np.sqrt(squared_distances(asked, points, codes))
        if f is not None:
            all_[g[:, None] == f[None, :]] = np.inf
        best = np.argsort(all_, axis=1, kind="stable")[:, :5]
        assert (places == best).all() if shape != "far" else np.allclose(gaps, np.take_along_axis(all_, best, 1), rtol=1e-9)
        assert np.allclose(gaps, np.take_along_axis(all_, best, 1), rtol=1e-9)


def test_index_measures_few_pairs(monkeypatch):
    """A row of a narrow table is compared with its surroundings, not with all rows."""
    rng = np.random.default_rng(7)
    points, seen = rng.normal(size=(40_000, 2)), []
    plain = neighbours._distances
    monkeypatch.setattr(neighbours, "_distances", lambda a, b, codes=0: seen.append(len(a) * len(b)) or plain(a, b, codes))
    Index(points, None, 0).search(points[:4000], None, 5)
    assert sum(seen) < 4000 * len(points) / 5


def test_query_rows_go_once_to_a_unit(spark):
    """Where no leaf can be left out, a query row is not repeated for each leaf."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(rng.normal(size=(400, 30)))], "tid long, x array<double>")
    placed, summary = neighbours._build(rows, 40, 5)
    assert placed.count() == 400 and (summary.rows > 0).sum() > 20
    _, units = neighbours._units(summary, 10)
    sent = neighbours._routed(rows.withColumnRenamed("tid", "qid"), summary, 5, units)
    assert sent.count() == 400 and sent.agg(F.max(F.size("cells"))).first()[0] == 1


@pytest.mark.parametrize("options", [{}, {"small_bytes": 0}])
def test_copies_of_a_vector(spark, options):
    """Only the smallest ids of equal vectors are kept, and they win."""
    train = spark.range(3000).select((2999 - F.col("id")).alias("i"), F.lit(1.0).alias("a"))
    test = spark.range(3).select(F.col("id").alias("q"), F.lit(1.0).alias("a"))
    assert sorted((r["q"], r["rank"], r["i"]) for r in nearest(train, test, ["a"], "i", "q", 4, **options).collect()) == [
        (q, r + 1, r) for q in range(3) for r in range(4)]
    base = train.select(F.col("i").alias("tid"), F.array("a").alias("x"))
    assert neighbours._first_copies(base, 4, 1)[0].count() == 4


def test_search_effort_grows_below_linearly(spark):
    """Clustered points: eight times the rows take less than four times the distances per query."""
    rng = np.random.default_rng(9)

    def points(n, offset):
        centre = rng.integers(0, 40, size=(n, 2)) * 10.0
        p = centre + rng.normal(0, 0.5, size=(n, 2))
        return spark.createDataFrame([(offset + i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i long, a double, b double")

    asked = points(60, 0)
    effort = [search_effort(points(n, 1000), asked, ["a", "b"], "i", "i", 3).agg(F.avg("distances")).first()[0] for n in (1500, 12_000)]
    assert effort[1] < 4 * effort[0] and effort[1] < 12_000 / 8
    assert search_effort(asked.where("false"), asked, ["a", "b"], "i", "i").agg(F.max("distances")).first()[0] == 0


def test_broadcast_guard_counts_ids_and_labels(spark):
    wide = spark.range(100).select(F.array(F.col("id").cast("double")).alias("x"), F.repeat(F.lit("k"), 1000).alias("key"))
    assert fits_in_memory(wide, limit=50_000) and not fits_in_memory(wide, limit=50_000, others=["key"])


def test_neighbours_of_few_or_no_rows(spark):
    test = spark.createDataFrame([(1, 0.0), (2, None)], "q long, a double")
    two = spark.createDataFrame([(7, 1.0, "x"), (8, 2.0, "y"), (9, None, "z")], "i long, a double, l string")
    for options in ({}, {"small_bytes": 0}):
        assert nearest(two, test, ["a"], "i", "q", 5, **options).count() == 2
        assert nearest(two.where("false"), test, ["a"], "i", "q", 5, **options).count() == 0
    assert knn_predict(two, test, ["a"], "i", "q", "l").collect() == [(1, "x")]  # a tie: the smaller label


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(0 if i % 2 else 6)), float(rng.normal(0 if i % 2 else 6)), "odd" if i % 2 else "even")
            for i in range(200)]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, label string")


def test_models_learn_clear_clusters(separable):
    task = Task(("x1", "x2"), "label", "id")
    train, test = train_test_split(separable, "id")
    train, test = task.prepare(train).cache(), task.prepare(test).cache()
    options = {"Random Forest": {"trees": 10}, "SVM": {"chunk": 40}, "Logistic Regression": {"max_iter": 50}}
    for name in ALL_MODELS:
        scored = fit_model(name, train, **options.get(name, {}))(test)
        assert accuracy(confusion(scored)).first()["accuracy"] > 0.9, name
    with pytest.raises(ValueError):
        fit_model("Oracle", train)


def test_every_variant_has_its_own_model(separable):
    """Labels of the second variant are swapped: a shared model would score both alike."""
    task = Task(("x1", "x2"), "label", "id")
    train, test = train_test_split(separable, "id")
    swapped = train.withColumn("label", F.when(F.col("label") == "odd", "even").otherwise("odd"))
    out = {r["Dataset"]: r for r in result_table(
        all_predictions({"Original": train, "Synthetic": swapped}, test, task, (KNN,))).collect()}
    assert out["Original"]["Accuracy"] > 0.9 and out["Synthetic"]["Accuracy"] > 0.9
    assert out["Original"]["F1"] > 0.9 and out["Synthetic"]["F1"] < 0.1


def test_comparison_without_synthetic(spark):
    rows = [("Original", "KNN", 0.5, 0.4, 0.3, 0.2)]
    df = spark.createDataFrame(rows, "Dataset string, Model string, Accuracy double, Precision double, Recall double, F1 double")
    r = compare_models(df).first()
    assert r["original_accuracy"] == 0.5 and r["synthetic_accuracy"] is None


def test_shared_vocabulary_and_targets(spark, separable):
    a = spark.createDataFrame([(1, "x", "p", "u1"), (2, "y", "q", "u2")], "k long, w string, t string, uid string")
    b = spark.createDataFrame([(3, "z", "p", "u3")], "k long, w string, t string, uid string")
    ready = prepare_variants({"Original": a, "Synthetic": b}, a, "t", "k", {"uid": "id", "w": "categorical"})
    assert ready.task.features == ("w_0", "w_1")
    assert ready.train["Synthetic"].columns == ready.test.columns
    keyed = with_row_key(spark.createDataFrame([("a",), ("a",), ("b",)], "v string"))
    assert keyed.select("_row_key").distinct().count() == 3
    results = run_utility(*train_test_split(separable, "id"), "label", "id")
    assert [r["Dataset"] for r in results.collect()] == ["Original"]


def test_a_target_of_many_classes(spark):
    rows = spark.range(360).select("id", (F.col("id") % 120).cast("double").alias("x"), (F.col("id") % 120).cast("string").alias("label"))
    train, test = rows.where("id < 240"), rows.where("id >= 240")
    result = run_utility(train, test, "label", "id", models=(KNN,), folds=2, options={KNN: {"neighbours": 1}}).first()
    assert result["Dataset"] == "Original" and result["Recall"] == 1.0


def exact_decisions(train, asked, gamma, cost=1.0):
    """One dual over all rows of a two-class problem."""
    x, y = np.array([r["x"] for r in train]), np.array([1.0 if r["label"] == "even" else -1.0 for r in train])
    alpha, offset = solve_dual(rbf(x, x, gamma), y, cost, tolerance=1e-6)
    return rbf(np.array([r["x"] for r in asked]), x, gamma) @ (alpha * y) + offset


def test_dual_solver_meets_the_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    k = rbf(x, x, 0.7)
    alpha, offset = solve_dual(k, y, 1.0, tolerance=1e-6)
    margin = y * (k @ (alpha * y) + offset)
    assert abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and alpha.max() <= 1
    assert (margin[alpha == 0] >= 1 - 1e-4).all() and (margin[alpha == 1] <= 1 + 1e-4).all()
    free = (alpha > 0) & (alpha < 1)
    assert np.allclose(margin[free], 1, atol=1e-4)


def test_cascade_equals_one_dual(separable):
    task = Task(("x1", "x2"), "label", "id")
    train, test = train_test_split(separable, "id")
    train, test = task.prepare(train), task.prepare(test)
    rows, asked = train.collect(), test.orderBy("key").collect()
    want = exact_decisions(rows, asked, 0.3)
    for chunk in (1000, 25):
        machine = fit_kernel_machine(train, 0.3, chunk=chunk)
        got = machine.decisions(test).orderBy("key").collect()
        assert np.allclose([r["sums"][0] for r in got], want, atol=0.01) and machine.passes == (1 if chunk == 1000 else machine.passes)
        assert [r["prediction"] for r in machine.predict(test).orderBy("key").collect()] == [
            "even" if v > 0 else "odd" for v in want]


def test_cascade_of_noisy_rows(spark):
    """Classes that overlap: near the exact machine, also when chunks are too large to be merged."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 2))
    label = np.where(x[:, 0] * x[:, 1] + 0.4 * rng.normal(size=500) > 0, "even", "odd")
    df = spark.createDataFrame([(i, str(s), list(map(float, p))) for i, (p, s) in enumerate(zip(x, label))],
                               "key long, label string, x array<double>")
    train, test = df.where("key < 400"), df.where("key >= 400")
    want = np.where(exact_decisions(train.collect(), test.orderBy("key").collect(), 0.5) > 0, "even", "odd")
    for options in ({"chunk": 80}, {"chunk": 80, "most": 100}):
        machine = fit_kernel_machine(train, 0.5, **options)
        got = [r["prediction"] for r in machine.predict(test).orderBy("key").collect()]
        assert np.mean(np.array(got) == want) >= 0.93
        assert (len(machine.machines()) > 1) == ("most" in options)


def test_machine_of_many_or_no_classes(spark):
    rows = [(i, f"c{i % 4}", [float(i % 4) * 5 + (i % 7) * 0.1, 1.0]) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, label string, x array<double>")
    machine = fit_kernel_machine(df, 0.5, chunk=10)
    assert all(r["label"] == r["prediction"] for r in machine.predict(df).collect())
    one = fit_kernel_machine(df.where("label = 'c1'"), 0.5)
    assert {r["prediction"] for r in one.predict(df).collect()} == {"c1"}
    assert {r["prediction"] for r in fit_kernel_machine(df.where("false"), 0.5).predict(df).collect()} == {None}


def test_the_forest_keeps_node_ids_and_its_predictions(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    draw = np.random.default_rng(2)
    rows = [(i, f"c{draw.integers(0, 3)}", [float(draw.integers(0, 9)), float(draw.normal())]) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, label string, x array<double>")
    plain, seen = RandomForestClassifier.fit, []

    def without(self, *args):
        seen.append(self.getCacheNodeIds())
        return plain(self.setCacheNodeIds(False), *args)

    kept = fit_model("Random Forest", df, trees=8)(df).orderBy("key").collect()
    monkeypatch.setattr(RandomForestClassifier, "fit", without)
    assert fit_model("Random Forest", df, trees=8)(df).orderBy("key").collect() == kept
    assert seen == [True]


@pytest.mark.parametrize(("rows", "warm"), [(2, False), (90, False), (400, False), (400, True)])
def test_dual_steps_are_those_of_the_plain_rule(rows, warm):
    draw = np.random.default_rng(rows)
    x = draw.integers(0, 12, (rows, 2)).astype(float)
    y = np.where(x[:, 0] + draw.normal(0, 6, rows) > 6, 1.0, -1.0)
    y[:2] = 1.0, -1.0
    k, cost = rbf(x, x, 0.05), 1.0
    start = np.zeros(rows)
    if warm:
        a, b = np.flatnonzero(y > 0)[:20], np.flatnonzero(y < 0)[:20]
        start[a], start[b] = 0.5, 0.5
    alpha = start.copy()
    gradient = y * (k @ (alpha * y)) - 1.0
    steps = 0
    while True:
        push = -y * gradient
        up, down = np.where(y > 0, alpha < cost, alpha > 0), np.where(y > 0, alpha > 0, alpha < cost)
        i = int(np.argmax(np.where(up, push, -np.inf)))
        if push[i] - push[down].min() < 1e-3:
            break
        gap, curve = push[i] - push, np.maximum(k[i, i] + np.diag(k) - 2.0 * k[i], 1e-12)
        j = int(np.argmax(np.where(down & (gap > 0), gap * gap / curve, -np.inf)))
        move = min(gap[j] / curve[j], cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * move
        alpha[j] -= y[j] * move
        gradient += y * move * (k[i] - k[j])
        steps += 1
    assert steps
    alpha[alpha < 1e-12], alpha[alpha > cost * (1 - 1e-12)] = 0.0, cost
    assert np.array_equal(solve_dual(k, y, cost, start)[0], alpha)


def test_cross_validation_of_a_large_table(spark, setting, monkeypatch):
    """Beyond the size that is broadcast every fold is scored, with the same predictions, keys that repeat or are missing included."""
    from veilwright.catalogue import jobs

    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(0, 1, (300, 2)), np.ones((60, 2))])
    keys = [None if i % 50 == 0 else (1 << 60) + i // 14 if i % 7 == 0 else (1 << 61) + i for i in range(len(points))]
    # Equal distances are many, but not among rows with equal keys.
    points = [p if i % 50 == 0 or i % 7 == 0 else np.round(p, 1) for i, p in enumerate(points)]
    rows = spark.createDataFrame([(k, "abc"[int(p[0] * 10) % 3], [*map(float, p)]) for k, p in zip(keys, points, strict=True)],
                                 "key long, label string, x array<double>")

    def predictions():
        parts = classifiers.cross_validated(rows, "Original", KNN)
        return sorted(map(tuple, reduce(DataFrame.unionByName, parts).collect()))

    def accuracies():
        return sorted(map(tuple, jobs()["g7_cross_validated_accuracy"](spark, SF).collect()))

    small = predictions(), accuracies()
    built, plain = [], neighbours._build
    monkeypatch.setattr(neighbours, "_build", lambda *args: built.append(args) or plain(*args))
    monkeypatch.setattr(neighbours, "SMALL_BYTES", 0)
    large = predictions(), accuracies()
    assert len(built) == 2  # one tree for all folds
    assert {r[2] for r in large[0]} == set(range(5)) and len(large[1]) == 5
    assert large == small
