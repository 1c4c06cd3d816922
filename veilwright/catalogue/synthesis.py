"""Queries for the copula. A sample has no SQL twin, but what it must respect has: sizes, bounds, categories, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.staging import scratch_path, stage
from ..operators import fidelity
from ..operators.copula import (GRID_ERROR, category_marginals, fit, normal_scores, number_marginals, sample, score_correlation)
from ..operators.metadata import detect_kinds
from ..plans.synthesise import four_variants, hybrid, rows_for, synthesise
from ..sources.models import model_tables, save_model, load_model
from ..sources.tables import write_synthetic
from .anonymisation import MIXED, NODE, customers_at
from .registry import query, rounded, sketch_check, sketch_sql, table

GRID = 200
POINTS = ", ".join(str(i / GRID) for i in range(GRID + 1))


@query("e1_number_marginals", "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", unnest(range({GRID + 1})) AS position,
  round(unnest(quantile_cont({c}, [{POINTS}])), 6) AS value FROM customer""" for c in ("c_acctbal", "c_nationkey")))
def marginals(spark, sf):
    found = number_marginals(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], GRID, exact=True)
    rows = [(m.column, i, v) for m in found.values() for i, v in enumerate(m.grid)]  # the model: 201 numbers a column
    return rounded(spark.createDataFrame(rows, "column string, position bigint, value double"))


@query("e1_grid_rank_error", sketch_sql("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), GRID + 1))
def grid_error(spark, sf):
    """The ranks of the grids that ``fit`` takes from sketches, against exact ranks."""
    lines = table(spark, sf, "lineitem")
    return sketch_check(lines, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), [i / GRID for i in range(GRID + 1)],
                        GRID_ERROR / GRID)


@query("e1_category_intervals", "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", v AS value, n,
  round((sum(n) OVER (ORDER BY v) - n) / sum(n) OVER (), 6) AS low, round(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 6) AS high
  FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)""" for c in ("o_orderstatus", "o_orderpriority")))
def intervals(spark, sf):
    return rounded(category_marginals(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("e1_score_correlation")
def correlation(spark, sf):
    """The correlation of normal scores; every column of orders but its key."""
    orders = table(spark, sf, "orders")
    model = fit(orders, detect_kinds(orders))
    matrix = score_correlation(normal_scores(orders, model))
    n = model.modelled
    return rounded(spark.createDataFrame(
        [(n[i], n[j], float(matrix[i, j])) for i in range(len(n)) for j in range(len(n))],
        "a string, b string, value double"))


def _checks(real, synthetic, key, numbers, words):
    """Rows, keys that repeat, numbers out of bounds, unseen categories: the last three must be 0."""
    synthetic = stage(synthetic, "sample")
    bad = fidelity.boundary_adherence(real, synthetic, numbers).unionByName(
        fidelity.category_adherence(real, synthetic, words)).where("score < 1").groupBy().agg(F.count(F.lit(1)))
    return synthetic.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_keys")
    ).withColumn("bad_columns", bad.scalar())


@query("e2_sample", 'SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS repeated_keys, CAST(0 AS BIGINT) AS bad_columns FROM orders')
def sample_checks(spark, sf):
    orders = table(spark, sf, "orders")
    model = fit(orders)
    return _checks(orders, sample(spark, model, model.rows), "o_orderkey",
                   ["o_custkey", "o_totalprice", "o_orderdate"], ["o_orderstatus", "o_orderpriority"])


@query("e2_sample_rows")
def sample_rows(spark, sf):
    part = table(spark, sf, "part")
    model = fit(part)
    return rounded(sample(spark, model, model.rows))


@query("e4_sample_by_test_size", """SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS "rows", CAST(0 AS BIGINT) AS repeated_keys,
  CAST(0 AS BIGINT) AS bad_columns FROM customer""")
def sample_by_test_size(spark, sf):
    customer = table(spark, sf, "customer")
    model = fit(customer)
    made = synthesise(customer, "customer", rows="custom", kinds=model.kinds,
                      custom_rows=int(rows_for("same_as_original", model.rows, None) * 0.8))
    return _checks(customer, made.table, "c_custkey", ["c_acctbal", "c_nationkey"], ["c_mktsegment"])


@query("e5_synthesis_job", """SELECT false AS first_loaded, true AS second_loaded, count(*) AS "rows",
  count(*) AS same_rows FROM customer""")
def synthesis_job(spark, sf):
    """Run twice with one model folder: the second run loads the model and draws the same rows."""
    customer, folder = table(spark, sf, "customer"), scratch_path(spark, "models")
    first = synthesise(customer, "customer", model_folder=folder, output_folder=scratch_path(spark, "out"))
    second = synthesise(customer, "customer", model_folder=folder, output_folder=scratch_path(spark, "out"))
    same = first.table.intersectAll(second.table).agg(F.count(F.lit(1)).alias("same_rows"))
    return first.table.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(first.loaded).alias("first_loaded"), F.lit(second.loaded).alias("second_loaded"), "rows",
        same.scalar().alias("same_rows"))


@query("a4_write_synthetic", 'SELECT count(*) AS "rows", 6 AS columns FROM part')
def write_sample(spark, sf):
    model = fit(table(spark, sf, "part"))
    path = write_synthetic(sample(spark, model, model.rows), scratch_path(spark, "synthetic"), "part")
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(back.columns)))


@query("a11_saved_model", """SELECT 'metadata' AS part, CAST(5 AS BIGINT) AS "rows" UNION ALL SELECT 'numbers', 2
UNION ALL SELECT 'categories', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'correlation', 9""")
def saved_model(spark, sf):
    path = save_model(spark, fit(table(spark, sf, "customer")), scratch_path(spark, "model"))
    load_model(spark, path)
    return model_tables(spark, path)


@query("a11_saved_model_content", f"""WITH x AS (SELECT list_sort(list(c_acctbal)) AS v, count(*) AS n FROM customer),
k AS (SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1),
i AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS total FROM k)
SELECT 'numbers' AS part, 'c_acctbal' AS name, CAST(i AS BIGINT) AS position,
  round(v[CAST(floor(i / {GRID}.0::double * (n - 1)) AS BIGINT) + 1], 6) AS value FROM x, range({GRID + 1}) AS r(i)
UNION ALL SELECT 'numbers', 'null share', 0, 0.0
UNION ALL SELECT 'low', value, n, round((upto - n) / total::double, 6) FROM i
UNION ALL SELECT 'high', value, n, round(upto / total::double, 6) FROM i
UNION ALL SELECT 'diagonal', 'c_acctbal', 0, 1.0 UNION ALL SELECT 'diagonal', 'c_mktsegment', 1, 1.0""")
def saved_model_content(spark, sf):
    """What a loaded model holds: the grid of a number, the intervals of categories, the diagonal of the correlation."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    kinds = {"c_custkey": "id", "c_acctbal": "numerical", "c_mktsegment": "categorical"}
    model = load_model(spark, save_model(spark, fit(customer, kinds), scratch_path(spark, "model")))
    grid = model.numbers["c_acctbal"]
    rows = [("numbers", "c_acctbal", i, v) for i, v in enumerate(grid.grid)] + [("numbers", "null share", 0, grid.null_share)]
    rows += [("diagonal", n, i, float(model.correlation[i, i])) for i, n in enumerate(model.modelled)]
    found = spark.createDataFrame(rows, "part string, name string, position bigint, value double")
    for side in ("low", "high"):
        found = found.unionByName(model.categories.where("column = 'c_mktsegment'").select(
            F.lit(side).alias("part"), F.col("value").alias("name"), F.col("n").alias("position"), F.col(side).alias("value")))
    return rounded(found)


@query("e6_hybrid")
def hybrid_rows(spark, sf):
    """Synthesised from the anonymised customers: generalised attributes are categories."""
    return hybrid(customers_at(spark, sf, MIXED), "customer").table


@query("e6_four_variants")
def variants_quality(spark, sf):
    """Quality of each variant against the original, over the columns that keep their meaning."""
    customer = table(spark, sf, "customer")
    variants = four_variants(customer, customers_at(spark, sf, NODE), "customer",
                             output_folder=scratch_path(spark, "variants"))
    parts = None
    for name, t in variants.items():
        one = fidelity.tv_complement(
            customer, t, ["c_mktsegment"]).select(F.lit(name).alias("variant"), "column", "metric", "score")
        parts = one if parts is None else parts.unionByName(one)
    return rounded(parts)
