import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwright.operators import copula as c
from veilwright.operators import fidelity as q
from veilwright.operators.metadata import detect_kinds
from veilwright.plans.synthesise import rows_for, synthesise, synthesise_file
from veilwright.sources.models import load_model, save_model

ODD = "odd name (x)\t"


@pytest.fixture(scope="module")
def real(spark):
    base = spark.range(4000).select("id", (F.randn(1)).alias("e"), F.randn(2).alias("f"), F.rand(3).alias("u"))
    return base.select(
        "id", (F.col("e") * 10 + 50).alias("x"), F.round(F.col("e") * 8 + F.col("f") * 4).cast("int").alias("y"),
        F.when(F.col("u") < 0.3, F.lit(0.0)).otherwise(F.col("u")).alias(ODD),
        F.when(F.col("e") > 0.5, "high").when(F.col("u") < 0.05, F.lit(None)).otherwise("low").alias("c"),
        F.when(F.col("u") > 0.2, F.col("f")).alias("gaps"), F.timestamp_seconds(F.col("id") * 1000).alias("at"),
        F.lit("same").alias("one"),
    ).cache()


@pytest.fixture(scope="module")
def fitted(real):
    return c.fit(real)


def test_sample_keeps_shape(spark, real, fitted):
    s = c.sample(spark, fitted, 3000, seed=7).cache()
    assert s.schema.simpleString() == real.schema.simpleString() and s.count() == 3000
    lo, hi = real.agg(F.min("x"), F.max("x")).first()
    assert s.where((F.col("x") < lo) | (F.col("x") > hi)).count() == 0
    assert {r["c"] for r in s.select("c").distinct().collect()} <= {"high", "low", None}
    assert s.select("id").distinct().count() == 3000 and s.where("one <> 'same'").count() == 0
    r = s.agg(F.avg(F.col("gaps").isNull().cast("int")), F.avg((F.col(f"`{ODD}`") == 0).cast("int")),
              F.corr("x", "y"), F.avg((F.col("c") == "high").cast("int"))).first()
    want = real.agg(F.corr("x", "y")).first()[0]
    assert abs(r[0] - 0.2) < 0.04 and abs(r[1] - 0.3) < 0.04 and abs(r[2] - want) < 0.1
    assert q.overall(q.column_shapes(real, s, fitted.kinds)).where("property = 'Overall'").first()["score"] > 0.95


def test_same_seed_same_rows(spark, fitted):
    a, b = c.sample(spark, fitted, 500, 1), c.sample(spark, fitted, 500, 1, partitions=7)
    assert a.exceptAll(b).count() == 0 and a.exceptAll(c.sample(spark, fitted, 500, 2)).count() > 400


def test_saved_model_draws_the_same(spark, fitted, tmp_path):
    again = load_model(spark, save_model(spark, fitted, str(tmp_path / "m")))
    assert c.sample(spark, again, 200, 3).exceptAll(c.sample(spark, fitted, 200, 3)).count() == 0


def test_wide_vocabulary_stays_a_table(spark, monkeypatch):
    words = spark.range(3000).select(
        F.concat(F.lit("w"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("string")).alias("w"),
        (F.col("id") % 100 / 7).alias("x"))
    plain = c.fit(words, {"w": "categorical", "x": "numerical"})
    expected = c.sample(spark, plain, 2000, 5)
    monkeypatch.setattr(c, "INLINE_CATEGORIES", 5)
    model = c.fit(words, {"w": "categorical", "x": "numerical"})
    got = c.sample(spark, model, 2000, 5)
    assert got.where("w is null").count() == 0 and got.count() == 2000
    assert got.exceptAll(expected).count() == 0  # both ways give the same rows


def test_edges(spark, mixed):
    one = c.fit(mixed.limit(1))
    assert c.sample(spark, one, 5).count() == 5
    empty = c.fit(mixed.where("false"), {"id": "id", "a": "numerical", "b": "numerical", "c": "categorical",
                                         ODD: "numerical"})
    assert c.sample(spark, empty, 3).select("a", "c").distinct().collect() == [(None, None)]
    with pytest.raises(ValueError):
        c.sample(spark, one, -1)
    with pytest.raises(ValueError):
        synthesise(mixed, "m", "CTGAN")
    with pytest.raises(ValueError):
        rows_for("everything", 5, None)
    assert np.allclose(np.diag(c.repair_correlation(np.array([[1, .9, -.9], [.9, 1, .9], [-.9, .9, 1]]))), 1)


def test_file_job(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text("amount,area\n" + "".join(f"{i * 3 % 50},{'urban' if i % 3 else 'rural'}\n" for i in range(100))
                    + ",urban\n")
    made, original, name = synthesise_file(spark, str(path), test_size=0.25)
    assert (name, original.count(), made.table.count()) == ("loans", 100, 75)


def test_quality_of_a_table_with_itself(real):
    kinds = detect_kinds(real)
    assert {r["score"] for r in q.diagnostic_details(real, real, kinds).collect()} == {1.0}
    scores = [r["score"] for r in q.quality_details(real, real, kinds).collect() if r["score"] is not None]
    assert min(scores) > 1 - 1e-9


def test_scores_by_hand(spark):
    r = spark.createDataFrame([(1, 0.0, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, 3.0, None)], "id long, x double, c string")
    s = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "z"), (2, 9.0, None), (None, None, "b")], "id long, x double, c string")
    assert q.key_uniqueness(s, ["id"]).first()["score"] == 0.5
    assert q.boundary_adherence(r, s, ["x"]).first()["score"] == pytest.approx(2 / 3)
    assert q.category_adherence(r, s, ["c"]).first()["score"] == 0.75
    assert q.ks_complement(r, s, ["x"]).first()["score"] == pytest.approx(1 - 1 / 3)
    assert q.tv_complement(r, s, ["c"]).first()["score"] == pytest.approx(0.75)
    assert q.structure_score(r, s.drop("c")) == pytest.approx(2 / 3)
    far = spark.createDataFrame([(5, 100.0, "q")], "id long, x double, c string")
    assert q.ks_complement(r, far, ["x"]).first()["score"] == 0 and q.tv_complement(r, far, ["c"]).first()["score"] == 0


def test_both_correlation_plans_agree(real, monkeypatch):
    other, names = real.where("id % 2 = 0"), ["x", "y", "gaps", ODD]
    a = {(r["column"], r["other"]): r["score"] for r in q.correlation_similarity(real, other, names).collect()}
    monkeypatch.setattr(q, "WIDE_PAIRS", 0)
    b = {(r["column"], r["other"]): r["score"] for r in q.correlation_similarity(real, other, names).collect()}
    assert len(a) == 6 and a == pytest.approx(b)


def test_plot_data(real):
    rows = q.target_plot_data(real, real, "x", "numerical", 10).collect()
    assert sum(r["real_n"] for r in rows) == 4000 and all(r["real_n"] == r["synth_n"] for r in rows)


def test_wide_tables_with_gaps(spark):
    """Gram matrices and joint counts against pandas, with a constant column and one that is all missing."""
    rng = np.random.default_rng(7)
    d = 12
    base = rng.normal(size=(300, d)) @ rng.normal(size=(d, d))
    base[:, 4] = 3.25
    frame = pd.DataFrame({f"x{i}": base[:, i] + (1e6 if i == 2 else 0) for i in range(d)})
    for i in range(d):
        frame.loc[rng.random(300) < 0.15, f"x{i}"] = np.nan
    frame["x7"] = np.nan
    names = list(frame.columns)
    real, synthetic = frame.iloc[:180], frame.iloc[180:]
    tables = [spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in t.to_numpy()],
                                    ", ".join(f"{n} double" for n in names)).repartition(3) for t in (real, synthetic)]
    got = {(r["column"], r["other"]): r["score"] for r in q.correlation_similarity(*tables, names).collect()}
    assert len(got) == d * (d - 1) // 2
    cr, cs = real.corr(min_periods=2), synthetic.corr(min_periods=2)
    for (a, b), score in got.items():
        if a in ("x4", "x7") or b in ("x4", "x7"):
            assert score is None
        else:
            assert score == pytest.approx(1 - abs(cr[a][b] - cs[a][b]) / 2, abs=1e-6)

    text = [t.apply(lambda c: c.map(lambda v: None if np.isnan(v) else f"c{int(v) % 3}")) for t in (real, synthetic)]
    tables = [spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in t.itertuples(index=False)],
                                    ", ".join(f"{n} string" for n in names)).repartition(3) for t in text]
    got = {(r["column"], r["other"]): r["score"] for r in q.contingency_similarity(*tables, names).collect()}
    for (a, b), score in got.items():
        shares = [t.fillna("none").groupby([a, b]).size() / len(t) for t in text]
        gap = shares[0].sub(shares[1], fill_value=0).abs().sum()
        assert score == pytest.approx(1 - gap / 2)


def test_pair_counter_sends_on_what_it_cannot_hold(spark, monkeypatch):
    from veilwright.operators import fidelity

    rows = [(i % 2, f"a{i % 50}", f"b{i % 7}", None if i % 3 else "c") for i in range(2000)]
    df = spark.createDataFrame(rows, "_r int, x0 string, x1 string, x2 string").coalesce(1)
    want = sorted(map(str, fidelity.pair_counts(df, [(0, 1), (0, 2)]).collect()))
    monkeypatch.setattr(fidelity, "PAIR_ENTRIES", 20)
    monkeypatch.setattr(fidelity, "PAIR_ROWS", 64)
    assert sorted(map(str, fidelity.pair_counts(df, [(0, 1), (0, 2)]).collect())) == want and len(want) == 350 + 100
