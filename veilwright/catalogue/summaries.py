"""Queries for counts and summary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.splitting import with_folds
from ..operators.summary import class_distribution, compare_moments, describe, min_max, row_count
from .registry import draw, query, rounded, sketch_check, sketch_sql, table

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def order_halves(spark, sf):
    """Two halves of orders by a draw on the key; they play original and synthetic."""
    marked = with_folds(table(spark, sf, "orders"), "o_orderkey", folds=2, seed=6, name="half")
    return marked.where("half = 0").drop("half"), marked.where("half = 1").drop("half")


HALVES = f"""halves AS (SELECT *, CAST({draw('o_orderkey', 7)} % 2 AS INTEGER) AS half FROM orders)"""


@query("c1_row_count", 'SELECT count(*) AS "rows" FROM lineitem')
def count_rows(spark, sf):
    return row_count(table(spark, sf, "lineitem"))


@query("c2_class_distribution", """SELECT o_orderstatus, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM orders)::double, 6) AS share FROM orders GROUP BY o_orderstatus""")
def distribution(spark, sf):
    return rounded(class_distribution(table(spark, sf, "orders"), "o_orderstatus"))


def _describe_sql(source: str, columns, group: str | None = None) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT {group + ' AS variant, ' if group else ''}'{c}' AS "column", count({c}) AS "count",
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max
FROM {source} {'GROUP BY ' + group if group else ''}""")
    return "\nUNION ALL ".join(parts)


@query("c3_describe", _describe_sql("lineitem", NUMBERS))
def describe_numbers(spark, sf):
    return rounded(describe(table(spark, sf, "lineitem"), NUMBERS))


@query("c3_describe_variants", _describe_sql("lineitem", NUMBERS, "l_linestatus"))
def describe_variants(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("variant"), *NUMBERS)
    return rounded(describe(lines, NUMBERS, ["variant"]))


@query("c3_describe_sketch")
def describe_sketch(spark, sf):
    """Quartiles from sketches, one scan."""
    return rounded(describe(table(spark, sf, "lineitem"), NUMBERS, exact=False))


@query("c3_sketch_rank_error", sketch_sql("lineitem", NUMBERS, 3))
def describe_sketch_error(spark, sf):
    """The ranks of sketched quartiles against exact ranks, with sketches small enough to compact."""
    return sketch_check(table(spark, sf, "lineitem"), NUMBERS, [0.25, 0.5, 0.75], 0.02)


@query("c4_compare_moments", "\nUNION ALL ".join(f"""SELECT '{c}' AS "column",
  round(avg({c}) FILTER (l_linestatus = 'O'), 6) AS original_mean,
  round(stddev_samp({c}) FILTER (l_linestatus = 'O'), 6) AS original_std,
  round(avg({c}) FILTER (l_linestatus = 'F'), 6) AS synthetic_mean,
  round(stddev_samp({c}) FILTER (l_linestatus = 'F'), 6) AS synthetic_std FROM lineitem""" for c in NUMBERS))
def moments(spark, sf):
    lines = table(spark, sf, "lineitem")
    return rounded(compare_moments(
        lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), NUMBERS))


@query("c5_min_max", "SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def bounds(spark, sf):
    return min_max(table(spark, sf, "customer"), "c_acctbal")
