"""Queries that score one half of a table against the other."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.staging import scratch_path
from ..operators import fidelity as q
from ..sources.reports import write_evaluation
from .registry import query, rounded, table
from .summaries import HALVES, order_halves

KINDS = {"o_orderkey": "id", "o_custkey": "numerical", "o_totalprice": "numerical", "o_orderdate": "numerical",
         "o_orderstatus": "categorical", "o_orderpriority": "categorical"}
NUMBERS = ["o_custkey", "o_totalprice", "o_orderdate"]
WORDS = ["o_orderstatus", "o_orderpriority"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

BASE = f"""WITH {HALVES}, src AS (SELECT half, o_orderkey, o_custkey::double AS o_custkey, o_totalprice,
  epoch(o_orderdate)::double AS o_orderdate, o_orderstatus, o_orderpriority FROM halves),
size AS (SELECT count(*) FILTER (half = 0) AS r, count(*) FILTER (half = 1) AS s FROM src)"""


def _row(prop: str, column: str, other: str | None, metric: str, score: str) -> str:
    second = f"'{other}'" if other else "CAST(NULL AS VARCHAR)"
    return (f"SELECT '{prop}' AS property, {column} AS \"column\", {second} AS other, '{metric}' AS metric, "
            f"round({score}, 6) AS score")


KEY = _row("Data Validity", "'o_orderkey'", None, "KeyUniqueness",
           "count(DISTINCT o_orderkey) / count(*)::double") + " FROM src WHERE half = 1"
BOUNDS = "\nUNION ALL ".join(_row(
    "Data Validity", f"'{c}'", None, "BoundaryAdherence",
    f"avg(({c} BETWEEN (SELECT min({c}) FROM src WHERE half = 0) AND (SELECT max({c}) FROM src WHERE half = 0))::int)"
) + " FROM src WHERE half = 1" for c in NUMBERS)
CATEGORIES = "\nUNION ALL ".join(_row(
    "Data Validity", f"'{c}'", None, "CategoryAdherence",
    f"avg(({c} IN (SELECT {c} FROM src WHERE half = 0))::int)") + " FROM src WHERE half = 1" for c in WORDS)
STRUCTURE = _row("Data Structure", "CAST(NULL AS VARCHAR)", None, "TableStructure", "1.0")


def _ks(source: str, column: str, flag: str) -> str:
    return f"""SELECT 'Column Shapes' AS property, '{column}' AS "column", CAST(NULL AS VARCHAR) AS other,
  'KSComplement' AS metric, round(1 - max(abs(cr / nr - cs / ns)), 6) AS score FROM (
  SELECT sum(a) OVER (ORDER BY v) AS cr, sum(b) OVER (ORDER BY v) AS cs, sum(a) OVER ()::double AS nr,
    sum(b) OVER ()::double AS ns FROM (SELECT {column} AS v, count(*) FILTER ({flag}) AS a,
    count(*) FILTER (NOT ({flag})) AS b FROM {source} GROUP BY 1))"""


def _tv(column: str) -> str:
    return f"""SELECT 'Column Shapes' AS property, '{column}' AS "column", CAST(NULL AS VARCHAR) AS other,
  'TVComplement' AS metric, round(1 - sum(abs(a / r::double - b / s::double)) / 2, 6) AS score FROM (
  SELECT count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b FROM src GROUP BY {column}), size"""


def _corr(a: str, b: str) -> str:
    return _row("Column Pair Trends", f"'{a}'", b, "CorrelationSimilarity",
                f"1 - abs(corr({a}, {b}) FILTER (half = 0) - corr({a}, {b}) FILTER (half = 1)) / 2") + " FROM src"


def _bin(c: str) -> str:
    low, high = f"(SELECT min({c}) FROM src WHERE half = 0)", f"(SELECT max({c}) FROM src WHERE half = 0)"
    return f"greatest(0, least(9, CAST(floor(({c} - {low}) / (({high} - {low}) / 10)) AS INTEGER)))"


def _contingency(a: str, b: str) -> str:
    u, v = (_bin(c) if c in NUMBERS else c for c in (a, b))
    return f"""SELECT 'Column Pair Trends' AS property, '{a}' AS "column", '{b}' AS other,
  'ContingencySimilarity' AS metric, round(1 - sum(abs(a / r::double - b / s::double)) / 2, 6) AS score FROM (
  SELECT count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b FROM src GROUP BY {u}, {v}), size"""


KS = "\nUNION ALL ".join(_ks("src", c, "half = 0") for c in NUMBERS)
TV = "\nUNION ALL ".join(_tv(c) for c in WORDS)
CORR = "\nUNION ALL ".join(_corr(a, b) for a, b in combinations(NUMBERS, 2))
MIXED_PAIRS = [(a, b) for a, b in combinations([*WORDS, *NUMBERS], 2) if a in WORDS]
CONTINGENCY = "\nUNION ALL ".join(_contingency(a, b) for a, b in MIXED_PAIRS)


def _overall(details: str) -> str:
    return f"""{BASE}, details AS ({details}),
per AS (SELECT property, avg(score) AS score FROM details GROUP BY property)
SELECT property, round(score, 5) AS score FROM per UNION ALL SELECT 'Overall', round(avg(score), 5) FROM per"""


@query("f1_key_uniqueness", f"{BASE} {KEY}")
def key_uniqueness(spark, sf):
    return rounded(q.key_uniqueness(order_halves(spark, sf)[1], ["o_orderkey"]))


@query("f1_key_uniqueness_repeated", """SELECT 'Data Validity' AS property, 'l_orderkey' AS "column",
  CAST(NULL AS VARCHAR) AS other, 'KeyUniqueness' AS metric,
  round(count(DISTINCT l_orderkey) / count(*)::double, 6) AS score FROM lineitem""")
def key_repeated(spark, sf):
    return rounded(q.key_uniqueness(table(spark, sf, "lineitem"), ["l_orderkey"]))


@query("f2_boundary_adherence", f"{BASE} {BOUNDS}")
def boundary_adherence(spark, sf):
    return rounded(q.boundary_adherence(*order_halves(spark, sf), NUMBERS))


@query("f3_category_adherence", f"{BASE} {CATEGORIES}")
def category_adherence(spark, sf):
    return rounded(q.category_adherence(*order_halves(spark, sf), WORDS))


@query("f5_diagnostic", _overall("\nUNION ALL ".join([KEY, BOUNDS, CATEGORIES, STRUCTURE])))
def diagnostic(spark, sf):
    return rounded(q.diagnostic(*order_halves(spark, sf), KINDS), 5)


@query("f6_ks_complement", f"{BASE} {KS}")
def ks_complement(spark, sf):
    return rounded(q.ks_complement(*order_halves(spark, sf), NUMBERS))


@query("f6_ks_complement_lineitem", "\nUNION ALL ".join(_ks("lineitem", c, "l_linestatus = 'O'") for c in LINE_NUMBERS))
def ks_lines(spark, sf):
    lines = table(spark, sf, "lineitem")
    return rounded(q.ks_complement(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), LINE_NUMBERS))


@query("f7_tv_complement", f"{BASE} {TV}")
def tv_complement(spark, sf):
    return rounded(q.tv_complement(*order_halves(spark, sf), WORDS))


@query("f8_correlation_similarity", f"{BASE} {CORR}")
def correlation_similarity(spark, sf):
    return rounded(q.correlation_similarity(*order_halves(spark, sf), NUMBERS))


@query("f9_contingency_similarity", f"{BASE} {CONTINGENCY}")
def contingency_similarity(spark, sf):
    return rounded(q.contingency_similarity(*order_halves(spark, sf), WORDS, NUMBERS))


# Forty columns from the embeddings, with gaps; the halves are rows with even and odd ids.
WIDE = 40


def wide_halves(spark, sf, text: bool):
    vectors = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    columns = []
    for i in range(WIDE):
        cell = F.get(x, F.pmod(F.lit(i), F.size(x))) * F.lit(float(1 + i))
        known = F.col("vec_id") % (5 + i) != 0
        shown = F.concat(F.lit("c"), (F.floor(cell * 3) % 4).cast("string")) if text else cell
        columns.append(F.when(known, shown).alias(f"x{i}"))
    halves = vectors.select("vec_id", *columns)
    return [halves.where(F.col("vec_id") % 2 == i).drop("vec_id") for i in (0, 1)]


WIDE_LONG = f"""WITH v AS (SELECT vec_id, vec_id % 2 AS half, embedding::double[] AS x FROM embeddings),
cell AS (SELECT vec_id, half, i, CASE WHEN vec_id % (5 + i) <> 0 THEN x[i % len(x) + 1] * (1 + i)::double END AS c
  FROM v, range({WIDE}) AS r(i)),
text AS (SELECT vec_id, half, i, 'c' || (floor(c * 3)::bigint % 4)::varchar AS t FROM cell)"""


@query("f8_correlation_similarity_wide", f"""{WIDE_LONG}, per AS (SELECT a.i AS a, b.i AS b, a.half, corr(a.c, b.c) AS c
  FROM cell a JOIN cell b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL)
SELECT 'Column Pair Trends' AS property, 'x' || a AS "column", 'x' || b AS other, 'CorrelationSimilarity' AS metric,
  round(1 - abs(max(c) FILTER (half = 0) - max(c) FILTER (half = 1)) / 2, 6) AS score FROM per GROUP BY a, b""")
def correlation_similarity_wide(spark, sf):
    """780 pairs of columns with gaps, from Gram matrices."""
    return rounded(q.correlation_similarity(*wide_halves(spark, sf, False), [f"x{i}" for i in range(WIDE)]))


@query("f9_contingency_similarity_wide", f"""{WIDE_LONG}, size AS (SELECT count(*) FILTER (half = 0) AS r,
  count(*) FILTER (half = 1) AS s FROM v),
joint AS (SELECT a.i AS a, b.i AS b, a.t AS u, b.t AS v, count(*) FILTER (a.half = 0) AS rn, count(*) FILTER (a.half = 1) AS sn
  FROM text a JOIN text b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL)
SELECT 'Column Pair Trends' AS property, 'x' || a AS "column", 'x' || b AS other, 'ContingencySimilarity' AS metric,
  round(1 - sum(abs(rn / r::double - sn / s::double)) / 2, 6) AS score FROM joint, size GROUP BY a, b""")
def contingency_similarity_wide(spark, sf):
    return rounded(q.contingency_similarity(*wide_halves(spark, sf, True), [f"x{i}" for i in range(WIDE)]))


@query("f10_column_shapes", f"{BASE} {KS} UNION ALL {TV}")
def column_shapes(spark, sf):
    return rounded(q.column_shapes(*order_halves(spark, sf), KINDS))


QUALITY = _overall("\nUNION ALL ".join([KS, TV, CORR, CONTINGENCY]))


@query("f11_quality", QUALITY)
def quality(spark, sf):
    return rounded(q.quality(*order_halves(spark, sf), KINDS), 5)


@query("a10_evaluation_files", QUALITY)
def evaluation_files(spark, sf):
    real, synthetic = order_halves(spark, sf)
    quality_rows = q.quality(real, synthetic, KINDS)
    folder = write_evaluation(q.diagnostic(real, synthetic, KINDS), quality_rows, scratch_path(spark, "evaluation"))
    return rounded(spark.read.schema(quality_rows.schema).json(f"{folder}/quality"), 5)


def _shares() -> str:
    return """SELECT bucket, a AS real_n, b AS synth_n, round(a / r::double, 6) AS real_share,
  round(b / s::double, 6) AS synth_share FROM counted, size"""


@query("f12_target_categories", f"""{BASE}, counted AS (SELECT o_orderstatus AS bucket, count(*) FILTER (half = 0) AS a,
  count(*) FILTER (half = 1) AS b FROM src GROUP BY 1) {_shares()}""")
def target_categories(spark, sf):
    return rounded(q.target_plot_data(*order_halves(spark, sf), "o_orderstatus", "categorical"))


@query("f12_target_histogram", f"""{BASE}, counted AS (SELECT {_bin("o_totalprice").replace("least(9,", "least(19,")
       .replace("/ 10)", "/ 20)")}::varchar AS bucket, count(*) FILTER (half = 0) AS a, count(*) FILTER (half = 1) AS b
  FROM src GROUP BY 1) {_shares()}""")
def target_histogram(spark, sf):
    return rounded(q.target_plot_data(*order_halves(spark, sf), "o_totalprice", "numerical"))
