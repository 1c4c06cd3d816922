import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright.functions.columns import bin_index, col, parse_double, percent_text
from veilwright.functions.hashing import uniform
from veilwright.functions.joins import lookup, lookup_weighted
from veilwright.functions.normal import inside_unit, normal_cdf, normal_quantile
from veilwright.functions.ranking import exact_quantiles, prefix_sums, row_ranks
from veilwright.functions.sketches import RankSketch, quantile_sketches


def test_normal_functions(spark):
    z = spark.range(-60, 61).select((F.col("id") / 10).alias("z"))
    for r in z.select("z", normal_cdf("z").alias("p")).collect():
        assert abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 2e-7
    p = spark.range(1, 1000).select((F.col("id") / 1000).alias("p")).select(inside_unit("p").alias("p"))
    for r in p.select("p", normal_quantile("p").alias("z")).collect():
        assert abs(0.5 * (1 + math.erf(r["z"] / math.sqrt(2))) - r["p"]) < 1e-7


def test_uniform_is_a_function_of_the_row(spark):
    a = [r[0] for r in spark.range(1000).select(uniform(F.col("id"), 1, 2)).collect()]
    b = [r[0] for r in spark.range(0, 1000, 1, 7).select(uniform(F.col("id"), 1, 2)).collect()]
    assert a == b and 0 < min(a) and max(a) < 1 and abs(np.mean(a) - 0.5) < 0.05
    assert a != [r[0] for r in spark.range(1000).select(uniform(F.col("id"), 2, 2)).collect()]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_prefix_sums_over_slices(spark, setting, coalesce):
    """With and without merged partitions: one slice, and several with one group spread over them."""
    setting("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rows = [("hot" if i % 3 else None if i % 2 else "cold", i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, m long")
    out = {(r["g"], r["o"]): (r["m_before"], r["m_total"]) for r in prefix_sums(df, ["g"], ["o"], ["m"]).collect()}
    assert len(out) == 500
    for g in ("hot", "cold", None):
        seen, mine = 0, sorted((o, m) for h, o, m in rows if h == g)
        for o, m in mine:
            assert out[(g, o)] == (seen, sum(x for _, x in mine))
            seen += m
    ranks = row_ranks(df, [], ["o"]).orderBy("o").collect()
    assert [r["rank"] for r in ranks] == list(range(500))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_exact_quantiles(spark, setting, coalesce):
    setting("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    values = [float((i * 37) % 101) for i in range(400)] + [5.0] * 200
    df = spark.createDataFrame([(v, None if i % 4 == 0 else v * 2) for i, v in enumerate(values)], "x double, y double")
    got = {(r["column"], r["probability"]): r["quantile"] for r in exact_quantiles(df, ["x", "y"], [0, .25, .5, .9, 1]).collect()}
    y = [v * 2 for i, v in enumerate(values) if i % 4]
    for p in (0, .25, .5, .9, 1):
        assert got[("x", p)] == pytest.approx(np.quantile(values, p))
        assert got[("y", p)] == pytest.approx(np.quantile(y, p))


def test_lookup_is_null_safe(spark):
    base = spark.createDataFrame([("a",), (None,), ("z",)], "k string")
    dim = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert {(r["k"], r["v"]) for r in lookup(base, dim, ["k"], ["v"]).collect()} == {("a", 1), (None, 2), ("z", None)}


def test_lookup_weighted_with_hot_keys(spark, setting):
    """Without broadcast joins the hot key (a third of the rows) is answered by a broadcast; the answer is the same."""
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("k"), F.col("id").alias("i"))
    dim = base.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 2)
    small = {(r["i"], r["v"]) for r in lookup_weighted(base, dim, ["k"], ["v"], "n").collect()}
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    hot = lookup_weighted(base, dim, ["k"], ["v"], "n")
    assert hot.columns == ["k", "i", "v"]
    assert {(r["i"], r["v"]) for r in hot.collect()} == small and len(small) == 3000


def test_staging_without_a_shared_folder(spark, monkeypatch):
    from veilwright.functions import staging

    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    root = staging.scratch_root(Session())
    assert root == staging.scratch_root(Session()) and "veilwright" in root

    class Cluster(Session):
        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(RuntimeError):
        staging.scratch_root(Cluster())
    kept = staging.stage(spark.range(3))
    assert kept.count() == 3
    monkeypatch.setattr(staging, "_staged", staging._staged[-1:])
    assert staging.release(spark) == 1


def test_small_helpers(spark):
    df = spark.createDataFrame([(" 1.5 ", 0.125), ("", 1.0), ("x", 0.0), (None, None)], "t string, s double")
    out = df.select(parse_double(F.col("t")).alias("d"), percent_text(F.col("s")).alias("p")).collect()
    assert [r["d"] for r in out] == [1.5, None, None, None]
    assert [r["p"] for r in out][:2] == ["12.50%", "100.00%"]
    bins = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in bins.select(bin_index(F.col("x"), 0.0, 10.0, 10)).collect()] == [0, 9, 9, 0, None]
    assert [r[0] for r in bins.select(bin_index(F.col("x"), 3.0, 3.0, 10)).collect()] == [0, 0, 0, 0, None]
    odd = spark.createDataFrame([(1,)], "`a.b ``c` int")
    assert odd.select(col("a.b `c")).first()[0] == 1


def test_lookup_weighted_with_equal_rows(spark, setting):
    """Nine tenths of the rows are one row: they never reach the join's shuffle, and none is lost or doubled."""
    base = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    dim = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = lookup_weighted(base, dim.withColumn("v", F.col("k") + 1), ["k"], ["v"], "n")
    assert got.count() == 20_000 and got.where("v <> k + 1 or v is null").count() == 0


def test_row_key_spreads_equal_rows(spark):
    from veilwright.plans.utility import KEY, with_row_key

    df = spark.range(0, 20_000, numPartitions=8).select(F.when(F.col("id") % 10 > 0, F.lit(1)).otherwise(F.col("id")).alias("x"))
    keyed = with_row_key(df)
    assert keyed.count() == keyed.select(KEY).distinct().count() == 20_000
    sizes = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 20_000 / 8 * 2


@pytest.mark.parametrize("kind", ["sorted", "reversed", "random", "hot", "few"])
def test_rank_sketch_keeps_its_bound(kind):
    rng = np.random.default_rng(6)
    n = 50 if kind == "few" else 60_000
    values = {"sorted": np.arange(n, dtype=float), "reversed": np.arange(n, 0, -1.0), "random": rng.normal(size=n),
              "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 500, n).astype(float)), "few": rng.normal(size=n)}[kind]
    parts = []
    for part in np.array_split(values, 7):
        s = RankSketch(200)
        s.add(part)
        parts.append(s)
    whole = RankSketch(200)
    for s in parts:
        whole.merge(s.levels, s.n, s.error)
    assert whole.n == n and sum(len(v) << i for i, v in enumerate(whole.levels)) == n
    assert sum(len(v) for v in whole.levels) < 200 * 15 and (whole.error == 0) == (kind == "few")
    ordered, ps = np.sort(values), [i / 50 for i in range(51)]
    for p, v in zip(ps, whole.quantiles(ps), strict=True):
        low, high = np.searchsorted(ordered, v), np.searchsorted(ordered, v, "right") - 1
        asked = p * (n - 1)
        assert low - math.ceil(asked) <= whole.error and math.floor(asked) - high <= whole.error
    assert whole.error <= 0.08 * n


def test_quantile_sketches_of_groups(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("a"),
                                  F.when(F.col("id") % 3 == 0, F.lit(None).cast("double")).otherwise(-F.col("id")).alias("b"))
    got = {(r["g"], r["column"]): r for r in quantile_sketches(df.repartition(7), ["a", "b"], [0.0, 0.5, 1.0], 0.01, ["g"]).collect()}
    assert set(got) == {(0, "a"), (0, "b"), (1, "a"), (1, "b")}
    assert got[0, "a"]["quantiles"][0] == 0 and got[1, "a"]["rows"] == 1500 and got[0, "b"]["n"] == 1000
    assert abs(got[1, "a"]["quantiles"][1] - 1500) <= 2 * got[1, "a"]["rank_error"] + 2
    none = quantile_sketches(df.where("false"), ["a"], [0.5])
    assert none.count() == 0
    only = quantile_sketches(df.select(F.lit(None).cast("double").alias("a")), ["a"], [0.5]).first()
    assert (only["n"], only["low"], only["quantiles"], only["rows"]) == (0, None, [], 3000)
