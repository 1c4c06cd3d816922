import itertools
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilwright.operators.anonymity import (DistinctLDiversity, EntropyLDiversity, KAnonymity, Roles, anonymise_at,
                                            generalise)
from veilwright.operators.hierarchy import (IntervalHierarchy, LookupHierarchy, MapHierarchy, MaskHierarchy,
                                            age_hierarchy, crime_hierarchy, descent_hierarchy, latitude_hierarchy,
                                            levels_report, longitude_hierarchy, sex_hierarchy)
from veilwright.operators.lattice import build_lattice, find_optimum, score_nodes
from veilwright.operators.loss import attribute_report, loss_report
from veilwright.plans.anonymise import anonymise


def labels(h, df, key):
    out = h.attach(df).select(key, f"`_labels_{h.attribute}`").collect()
    return {r[0]: r[1] for r in out}


def test_age_bands(spark, people):
    got = labels(age_hierarchy(spark, "age").validate(), people, "age")
    assert got[-1][1:] == ["*"] * 4 and got[101][1:] == ["*"] * 4
    assert got[5][1:] == ["0-4", "0-9", "0-19", "*"]
    assert got[10][1:] == ["5-9", "0-9", "0-19", "*"]
    assert got[16][1:] == ["15-19", "10-19", "0-19", "*"]
    assert got[20][1:] == ["15-19", "10-19", "0-19", "*"]
    table = {r["value"]: r["labels"] for r in age_hierarchy(spark, "age").table.collect()}
    assert len(table) == 124 and table["100"] == ["95-99", "90-99", "80-99", "*"] and table["11"][0] == "10-14"


def test_sex_and_descent(spark, people):
    got = labels(sex_hierarchy(spark, "sex").validate(), people, "sex")
    assert got["M"] == ["M", "Person", "*"] and got["-"] == ["-", "Unknown", "*"] and got[None] == [None, "", "*"]
    assert descent_hierarchy(spark, "d").validate().table.count() == 22
    other = spark.createDataFrame([("Q",)], "sex string")
    assert labels(sex_hierarchy(spark, "sex"), other, "sex")["Q"] == ["Q", "*", "*"]


def test_longitude_and_latitude(spark, people):
    lon = labels(longitude_hierarchy("lon"), people, "lon")
    assert lon[-118.95][1:] == ["-119 to -118.9", "<-119 .. -119 to -118.9", "<-119 .. -118.6 to -118.5", "*"]
    assert lon[-118.0][1] == ">-118" and lon[-200.0][1] == "<-119" and lon[300.0][1:] == ["*"] * 4
    lat = latitude_hierarchy("lat")
    assert labels(lat, people, "lat")[30.0][1] == "30-30.5" and lat.group_labels(2)[-1] == ">35"  # a short last group


def test_interval_from_data(spark, people):
    h = IntervalHierarchy.from_data(people, "lat", 10)
    got = labels(h, people, "lat")
    assert got[30.0][1:] == ["[30, 30.5[", "[30, 31[", "[30, 33[", "*"]
    assert got[35.0][1] == "[34.5, 35.000001["  # the maximum belongs to the last interval
    levels = {r["level"]: r["groups"] for r in levels_report(people, h).collect()}
    assert levels == {0: 5, 1: 3, 2: 3, 3: 2, 4: 1}
    negative = spark.createDataFrame([(-5.0,), (-1.0,), (None,)], "x double")
    got = labels(IntervalHierarchy.from_data(negative, "x", 2), negative, "x")
    assert got[-1.0][1] == "[-3, -0.999999[" and got[None][1] == "*"
    assert labels(IntervalHierarchy.from_data(negative.where("false"), "x"), negative, "x")[-5.0][1] == "*"


def test_map_and_mask(spark):
    crimes = spark.createDataFrame([("BURGLARY",), ("OTHER THING",), (None,)], "c string")
    h = crime_hierarchy("c")
    assert len(h.mapping) == 36
    got = labels(h, crimes, "c")
    assert got["BURGLARY"] == ["BURGLARY", "PROPERTY DAMAGE", "*"] and got["OTHER THING"][1:] == ["*", "*"]
    x = spark.createDataFrame([(33.0,), (5.25,), (-3.5,), (123.0,), (None,)], "x double")
    got = labels(MaskHierarchy("x", 2, 1), x, "x")
    assert got[33.0] == ["33.0", "33.*", "3*.*", "**.**"]
    assert got[-3.5][1:] == ["-03.*", "-0*.*", "**.**"] and got[123.0][1:] == ["*"] * 3
    assert got[None] == [None, "*", "*", "*"]


def test_broken_hierarchies(spark):
    def table(rows):
        return spark.createDataFrame(rows, "value string, labels array<string>")

    for rows in ([("a", ["x", "*"]), ("a", ["y", "*"])], [("a", ["x", "p"]), ("b", ["x", "q"])],
                 [("a", ["x", "*"]), ("b", ["x"])]):
        with pytest.raises(ValueError):
            LookupHierarchy("v", table(rows), 2).validate()


def test_roles(people):
    good = Roles(("age", "sex"), ("disease",), ("id", "zip", "lat", "lon"))
    assert good.check(people) is good
    for bad in (Roles(("age",)), Roles(("age", "age"), (), tuple(people.columns)), Roles((), (), tuple(people.columns)),
                Roles(("nope",), (), tuple(people.columns))):
        with pytest.raises(ValueError):
            bad.check(people)


def hierarchies(spark, people):
    zips = people.select(F.col("zip").alias("value")).distinct().withColumn(
        "labels", F.array(F.concat(F.substring("value", 1, 3), F.lit("*")), F.lit("*")))
    return [age_hierarchy(spark, "age"), sex_hierarchy(spark, "sex"), LookupHierarchy("zip", zips, 2)]


def test_suppression_by_hand(spark, people):
    hs = hierarchies(spark, people)
    node = {"age": 2, "sex": 1, "zip": 0}
    a = anonymise_at(people, hs, node)
    rows = {r["id"]: (r["age"], r["sex"], r["zip"], r["out"]) for r in a.table(flag="out").collect()}
    assert rows[2] == ("0-9", "Person", "1000", False) and rows[3] == rows[2]
    assert rows[4] == ("0-9", "Person", "1001", False) and rows[9] == ("10-19", "Person", "1002", False)
    assert {i for i, r in rows.items() if r[3]} == {1, 6, 7, 8} and rows[1][:3] == ("*", "*", "*")
    assert a.suppression().first()["suppressed_text"] == "40.00%"
    assert a.class_statistics().first()["classes"] == 3
    assert a.table(drop_suppressed=True).count() == 6
    with pytest.raises(ValueError):
        anonymise_at(people, hs, node, suppression_limit=0.3)
    with pytest.raises(ValueError):
        generalise(people, hs, {"age": 9, "sex": 0, "zip": 0})
    diverse = anonymise_at(people, hs, node, [KAnonymity(2), DistinctLDiversity("disease", 2)])
    assert {r["id"] for r in diverse.table(drop_suppressed=True).collect()} == {2, 3, 9, 10}
    even = anonymise_at(people, hs, node, [EntropyLDiversity("disease", 2)])
    assert {r["id"] for r in even.table(drop_suppressed=True).collect()} == {2, 3, 9, 10}


def test_all_suppressed_and_nothing_suppressed(spark, people):
    hs = hierarchies(spark, people)
    every = anonymise_at(people, hs, {"age": 0, "sex": 0, "zip": 0}, [KAnonymity(100)])
    got = {r["metric"]: r["value"] for r in loss_report(every).collect()}
    assert got["granularity"] == pytest.approx(0) and got["generalisation_intensity"] == pytest.approx(0)
    assert got["non_uniform_entropy"] == pytest.approx(1) and got["average_class_size"] is None
    none = anonymise_at(people, hs, {"age": 0, "sex": 0, "zip": 0}, [KAnonymity(1)])
    got = {r["metric"]: r["value"] for r in loss_report(none).collect()}
    assert got["granularity"] == pytest.approx(1) and got["ambiguity"] == pytest.approx(1)
    assert got["non_uniform_entropy"] == pytest.approx(0) and got["squared_error"] == pytest.approx(1)
    assert attribute_report(none).count() == 3


def test_hot_class_without_broadcast(spark, people, setting):
    """One class holds most rows; with broadcasting off the salted join gives the same table."""
    many = people.crossJoin(spark.range(50).select(F.col("id").alias("copy"))).where("id <> 1 or copy = 0")
    many = many.unionByName(many.where("id = 4").crossJoin(spark.range(9).select(F.col("id").alias("x"))).drop("x"))
    hs = hierarchies(spark, people)
    node = {"age": 1, "sex": 0, "zip": 0}
    a = anonymise_at(many, hs, node, [KAnonymity(2)]).table(flag="out")
    want = Counter(tuple(r) for r in a.collect())
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    b = anonymise_at(many, hs, node, [KAnonymity(2)]).table(flag="out")
    assert Counter(tuple(r) for r in b.collect()) == want and sum(r["out"] for r in b.collect()) == 1


def brute_force(rows, paths, models, limit, objective):
    """All nodes by plain loops: (cost, total level, node) of the best."""
    q, n = len(paths), len(rows)
    leaves = [defaultdict(Counter) for _ in range(q)]
    freq = [defaultdict(Counter) for _ in range(q)]
    for i, p in enumerate(paths):
        for v, ls in p.items():
            for level, label in enumerate(ls):
                leaves[i][level][label] += 1
                freq[i][level][label] += sum(1 for r in rows if r[0][i] == v)

    def whole(i, level, label):
        return level > 0 and label == "*"

    def weight(i, level, label):
        if objective == "loss":
            k = len(paths[i]) if whole(i, level, label) else leaves[i][level][label]
            return (k - 1) / (len(paths[i]) - 1)
        return math.log2(n if whole(i, level, label) else freq[i][level][label])

    best = []
    for node in itertools.product(*[range(len(next(iter(p.values())))) for p in paths]):
        classes = defaultdict(list)
        for v, s in rows:
            classes[tuple(paths[i][v[i]][node[i]] for i in range(q))].append((v, s))
        cost = lost = 0
        for key, members in classes.items():
            seen = Counter(s for _, s in members)
            ok = all(
                len(members) >= m.k if isinstance(m, KAnonymity)
                else len(seen) >= m.l if isinstance(m, DistinctLDiversity)
                else -sum(c / len(members) * math.log(c / len(members)) for c in seen.values()) >= math.log(m.l) - 1e-9
                for m in models)
            lost += 0 if ok else len(members)
            for v, _ in members:
                for i in range(q):
                    top = (1 if objective == "loss" else math.log2(n))
                    own = 0 if objective == "loss" else weight(i, 0, paths[i][v[i]][0])
                    cost += (weight(i, node[i], key[i]) if ok else top) - own
        if lost <= limit * n:
            best.append((round(cost, 6), sum(node), node))
    return min(best) if best else None


MODELS = {
    "k": [KAnonymity(3)],
    "distinct": [KAnonymity(2), DistinctLDiversity("s", 2)],
    "entropy": [EntropyLDiversity("s", 1.7)],
}


@pytest.mark.parametrize("one_job", [10**9, 0])
@pytest.mark.parametrize("objective,models,limit", [
    ("loss", "k", 1.0), ("entropy", "k", 0.02), ("loss", "distinct", 0.2), ("entropy", "entropy", 0.0)])
def test_search_equals_brute_force(spark, one_job, objective, models, limit):
    a_paths = {f"a{i}": [f"a{i}", f"A{i // 2}", f"B{i // 4}", "*"] for i in range(8)}
    b_paths = {f"b{i}": [f"b{i}", "low" if i < 2 else "high", "*"] for i in range(5)}
    c_paths = {f"c{i}": [f"c{i}", "*"] for i in range(3)}
    rows = [((f"a{(i * i) % 7}", f"b{(i * 3) % 5 if i % 4 else 0}", f"c{i % 3 if i % 5 else 0}"), f"s{(i // 3) % 3}")
            for i in range(70)]
    df = spark.createDataFrame([(*v, s) for v, s in rows], "a string, b string, c string, s string")
    hs = [
        LookupHierarchy(n, spark.createDataFrame([(v, ls[1:]) for v, ls in p.items()], "value string, labels array<string>"),
                        len(next(iter(p.values()))) - 1)
        for n, p in (("a", a_paths), ("b", b_paths), ("c", c_paths))
    ]
    want = brute_force(rows, [a_paths, b_paths, c_paths], MODELS[models], limit, objective)
    got = find_optimum(df, hs, MODELS[models], limit, objective, one_job_cells=one_job)
    assert tuple(got.node[x] for x in "abc") == want[2]
    assert got.suppressed <= limit * len(rows)


def ladder(spark, name, values, height):
    """Levels that halve the values again and again, then ``*``."""
    rows = [(f"{name}{i}", [f"{name}{level}:{i >> level}" for level in range(1, height)] + ["*"]) for i in range(values)]
    return LookupHierarchy(name, spark.createDataFrame(rows, "value string, labels array<string>"), height), {
        v: [v, *ls] for v, ls in rows}


@pytest.mark.parametrize("subsets,models,limit", [
    (1, "k", 1.0), (2, "k", 0.05), (3, "distinct", 0.3), (2, "distinct", 0.0), (2, "entropy", 0.4)])
def test_search_with_subset_bounds_equals_brute_force(spark, subsets, models, limit):
    """Batches of few nodes, so that the bounds decide what is examined."""
    made = [ladder(spark, n, v, h) for n, v, h in (("a", 8, 4), ("b", 4, 3), ("c", 6, 3), ("d", 3, 2))]
    rows = [((f"a{(i * i) % 8}", f"b{i % 4 if i % 3 else 0}", f"c{(i * 5) % 6}", f"d{(i // 7) % 3}"), f"s{(i // 3) % 3}")
            for i in range(90)]
    df = spark.createDataFrame([(*v, s) for v, s in rows], "a string, b string, c string, d string, s string")
    want = brute_force(rows, [p for _, p in made], MODELS[models], limit, "loss")
    got = find_optimum(df, [h for h, _ in made], MODELS[models], limit, one_job_cells=0, subsets=subsets)
    assert tuple(got.node[x] for x in "abcd") == want[2]
    assert got.cost * len(rows) * 4 == pytest.approx(want[0], abs=1e-3)  # a share of the cost of suppressing everything
    assert len({tuple(r["node"]) for r in got.scored}) == len(got.scored)


def test_twelve_attributes_need_no_list_of_nodes(spark):
    """244 million nodes; few are examined, and no other node near the answer is better."""
    names = [f"q{i:02d}" for i in range(12)]
    hs = [ladder(spark, n, 8, 4)[0] for n in names]
    # Three attributes that vary, nine with one odd row each: at the bottom only the odd rows are suppressed.
    rows = [tuple(f"{n}{(i >> j) % 2 if j < 3 else int(i == 7 * j)}" for j, n in enumerate(names)) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = find_optimum(df, hs, [KAnonymity(3)], 0.9, one_job_cells=50_000)
    assert len(got.scored) < 500 and got.suppressed == 9 and set(got.node.values()) == {0}
    assert got.cost == pytest.approx(9 / 400)


def test_no_node_is_possible(spark, people):
    with pytest.raises(ValueError):
        find_optimum(people, hierarchies(spark, people), [KAnonymity(11)], 0.5)


def test_job(spark, people, tmp_path):
    roles = Roles(("age", "sex", "zip"), ("disease",), ("id", "lat", "lon"))
    out = anonymise(people, roles, hierarchies(spark, people), output=str(tmp_path / "out"))
    sizes = out.table(drop_suppressed=True).groupBy("age", "sex", "zip").count().collect()
    assert min(r["count"] for r in sizes) >= 2
    assert {r["attribute"] for r in out.optimum.levels(spark).collect()} == {"age", "sex", "zip"}
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "out"))
    assert back.count() == 10 and back.columns == people.columns
    with pytest.raises(ValueError):
        anonymise(people, roles, hierarchies(spark, people), [DistinctLDiversity("zip", 2)])
