"""Queries for loading, writing, cleaning, encoding and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import parse_double, percent_text, round4
from ..functions.staging import scratch_path
from ..operators.encoding import BinaryEncoder, OneHotEncoder, split_features_label
from ..operators.metadata import detect_metadata
from ..operators.missing import handle_missing, impute_mean, impute_median, impute_mode, missing_report
from ..operators.splitting import with_folds, with_split
from ..plans.preprocess import preprocess
from ..sources.cache import read_or_compute, table_fingerprint
from ..sources.hierarchy_files import BOM, read_hierarchy, write_hierarchy
from ..sources.quoted import read_quoted
from ..sources.reports import write_cleaning_report
from ..sources.tables import load_table, preview, write_table
from .registry import GAPS, LABELLED, draw, labelled_documents, orders_with_gaps, query, rounded, sketch_check, sketch_sql, table

CUSTOMER_TYPED = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer"""


@query("a1_load_delimited", CUSTOMER_TYPED)
def load_delimited(spark, sf):
    path = write_table(table(spark, sf, "customer"), scratch_path(spark, "customer"), "csv", ";")
    return load_table(spark, path, ";")[0]


@query("a1_load_quoted_text", """SELECT doc_id, '  ' || text || chr(10) || '"quoted";  ' AS text, lang, source, n_chars
FROM documents""")
def load_quoted_text(spark, sf):
    """Whole texts with line breaks, quotes, separators and outer blanks go out and come back as they were."""
    docs = table(spark, sf, "documents").withColumn("text", F.concat(F.lit("  "), "text", F.lit('\n"quoted";  ')))
    path = write_table(docs, scratch_path(spark, "documents"), "csv", ";")
    return load_table(spark, path, ";", docs.schema)[0]


FILE_BYTES = 256 * 1024 * 1024


def large_files(docs, most: int = FILE_BYTES):
    """``docs`` in as many partitions as keep their texts at about ``most`` bytes each."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most))
    return docs.coalesce(1) if parts == 1 else docs.repartition(parts)


@query("a1_load_quoted_text_split", """SELECT doc_id, '  ' || text || chr(10) || '"quoted";  ' AS text, lang, source, n_chars
FROM documents""")
def load_quoted_text_split(spark, sf):
    """The same from large files, by many tasks: no range of a file knows by itself whether it begins inside a cell.

    Up to ``FILE_BYTES`` of text make one file; more are dealt to files of about that size, so no task writes them all."""
    docs = table(spark, sf, "documents").withColumn("text", F.concat(F.lit("  "), "text", F.lit('\n"quoted";  ')))
    path = write_table(large_files(docs), scratch_path(spark, "documents"), "csv", ";")
    cells = read_quoted(spark, path, docs.columns, ";")
    return cells.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


@query("a2_write_cleaned", f"WITH {LABELLED} SELECT * FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def write_cleaned(spark, sf):
    cleaned = handle_missing(labelled_documents(spark, sf), "drop")
    path = write_table(cleaned, scratch_path(spark, "cleaned"), "csv")
    return load_table(spark, path, ",", cleaned.schema)[0]


@query("a3_reuse_cleaned", f"""WITH {GAPS},
full_rows AS (SELECT count(*) AS n FROM gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL),
all_rows AS (SELECT count(*) AS n FROM gaps)
SELECT 'first' AS attempt, false AS reused, n AS "rows" FROM full_rows
UNION ALL SELECT 'second', true, n FROM full_rows
UNION ALL SELECT 'other option', false, n FROM all_rows""")
def reuse_cleaned(spark, sf):
    source, folder = orders_with_gaps(spark, sf), scratch_path(spark, "cache")
    parts = []
    for attempt, strategy in (("first", "drop"), ("second", "drop"), ("other option", "mode")):
        key = table_fingerprint(source, {"strategy": strategy})
        out, reused = read_or_compute(spark, folder, "orders", key, lambda s=strategy: handle_missing(source, s))
        parts.append(out.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(attempt).alias("attempt"), F.lit(reused).alias("reused"), "rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a5_read_for_anonymisation", CUSTOMER_TYPED)
def read_for_anonymisation(spark, sf):
    path = write_table(table(spark, sf, "customer"), scratch_path(spark, "customer"), "csv", ",")
    return load_table(spark, path)[0]


def nation_levels(spark, sf):
    """nation key → nation → region → ``*``."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("value"), F.array("n_name", "r_name", F.lit("*")).alias("labels")
    )


@query("a7_read_hierarchy", """SELECT n_nationkey::varchar AS value, n_name AS level_1, r_name AS level_2,
  '*' AS level_3 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def read_hierarchy_file(spark, sf):
    marked = nation_levels(spark, sf).orderBy("value").coalesce(1).withColumn(
        "value", F.when(F.col("value") == "0", F.concat(F.lit(BOM), F.col("value"))).otherwise(F.col("value"))
    )
    path = write_hierarchy(marked, scratch_path(spark, "hierarchy"), 3)
    return read_hierarchy(spark, path).select(
        "value", *[F.get("labels", F.lit(i)).alias(f"level_{i + 1}") for i in range(3)])


REPORT = f"""WITH {LABELLED} SELECT 'documents' AS dataset, count(*) AS original_rows, 6 AS original_columns,
  count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS processed_rows, 6 AS processed_columns,
  CAST(sum((quality IS NULL)::int + (toxic IS NULL)::int) AS BIGINT) AS missing_before,
  CAST(0 AS BIGINT) AS missing_after,
  count(*) FILTER (quality IS NULL OR toxic IS NULL) AS dropped_rows FROM labelled"""


@query("a9_cleaning_report", REPORT)
def cleaning_report(spark, sf):
    raw = labelled_documents(spark, sf)
    report = missing_report(raw, handle_missing(raw, "drop"), "documents")
    path = write_cleaning_report(report, scratch_path(spark, "report"))
    return spark.read.schema(report.schema).json(path)


@query("a12_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def preview_rows(spark, sf):
    return preview(table(spark, sf, "customer"), 10, ["c_custkey"])


@query("b1_drop_missing", f"WITH {LABELLED} SELECT * FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_rows(spark, sf):
    return handle_missing(labelled_documents(spark, sf), "drop")


@query("b1_keep_missing", f"WITH {LABELLED} SELECT * FROM labelled")
def keep_rows(spark, sf):
    return handle_missing(labelled_documents(spark, sf), None)


@query("b2_impute_mean", f"""WITH {GAPS} SELECT o_orderkey,
  round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gaps)), 4) AS o_totalprice FROM gaps""")
def mean_filled(spark, sf):
    filled = impute_mean(orders_with_gaps(spark, sf), ["o_totalprice"])
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


MEDIAN = f"""WITH {GAPS} SELECT o_orderkey,
  round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM gaps)), 4) AS o_totalprice FROM gaps"""


@query("b3_impute_median", MEDIAN)
def median_filled(spark, sf):
    filled = impute_median(orders_with_gaps(spark, sf), ["o_totalprice"])
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("b4_impute_mode", f"""WITH {GAPS}, best AS (SELECT o_orderpriority AS m FROM gaps
  WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT m FROM best)) AS o_orderpriority FROM gaps""")
def mode_filled(spark, sf):
    return impute_mode(orders_with_gaps(spark, sf), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("b6_missing_report", REPORT)
def count_missing(spark, sf):
    raw = labelled_documents(spark, sf)
    return missing_report(raw, handle_missing(raw, "drop"), "documents")


def _bits(column: str, ordinal: str, width: int) -> str:
    return ", ".join(f"CAST(({ordinal} >> {width - 1 - i}) & 1 AS INTEGER) AS {column}_{i}" for i in range(width))


@query("b8_binary_encoding", f"""WITH ranks AS (SELECT p_partkey, p_size,
  dense_rank() OVER (ORDER BY p_brand) AS b, dense_rank() OVER (ORDER BY p_type) AS t FROM part)
SELECT p_partkey, {_bits("p_brand", "b", 5)}, {_bits("p_type", "t", 3)}, p_size FROM ranks""")
def binary_encoded(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return BinaryEncoder.fit(part, None, ["p_brand", "p_type"]).transform(part)


@query("b8_binary_encoding_large_vocabulary", f"""WITH ranks AS (SELECT c_custkey,
  dense_rank() OVER (ORDER BY c_mktsegment) AS b FROM customer)
SELECT c_custkey, {_bits("c_mktsegment", "b", 3)} FROM ranks""")
def binary_encoded_table(spark, sf):
    """The path for vocabularies that stay a table on the cluster."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return BinaryEncoder.fit(customer, None, ["c_mktsegment"], inline_limit=0).transform(customer)


TYPES = ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("b10_one_hot", "SELECT p_partkey, p_size, " + ", ".join(
    f'(p_type = \'{t}\') AS "p_type_{t}"' for t in TYPES) + " FROM part")
def one_hot(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    return OneHotEncoder.fit(part, None, ["p_type"]).transform(part)


@query("b11_features_and_label", """SELECT 'features' AS side, 4 AS columns, count(*) AS "rows" FROM customer
UNION ALL SELECT 'label', 1, count(*) FROM customer""")
def features_and_label(spark, sf):
    x, y = split_features_label(table(spark, sf, "customer"), "c_mktsegment")

    def shape(side, df):
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(side).alias("side"), F.lit(len(df.columns)).alias("columns"), "rows")

    return shape("features", x).unionByName(shape("label", y))


@query("b12_train_test_split",
       f"SELECT o_orderkey, {draw('o_orderkey', 42)} % 10000 < 2000 AS is_test FROM orders")
def split_rows(spark, sf):
    return with_split(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query("b14_folds", f"SELECT o_orderkey, CAST({draw('o_orderkey', 43)} % 5 AS INTEGER) AS fold FROM orders")
def fold_rows(spark, sf):
    return with_folds(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query("b14_stratified_folds", f"""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY {draw('o_orderkey', 43)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders""")
def stratified_fold_rows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return with_folds(orders, "o_orderkey", stratify="o_orderpriority").select("o_orderkey", "fold")


def _metadata_sql(source: str, columns: list[tuple[str, str]]) -> str:
    few = "least(10, CAST(floor(count(*) / 10.0 + 0.5) AS BIGINT))"
    parts = []
    for i, (name, kind) in enumerate(columns):
        unique = f"count(*) > 1 AND count(*) = count(DISTINCT {name})"
        if kind == "text":
            rule = f"CASE WHEN {unique} THEN 'id' ELSE 'categorical' END"
        else:
            whole = f"bool_and({name} = floor({name}))"
            rule = (f"CASE WHEN {whole} AND {unique} THEN 'id' WHEN {whole} AND min({name}) >= 0 AND "
                    f"count(DISTINCT {name}) <= {few} THEN 'categorical' ELSE 'numerical' END")
        parts.append(f"SELECT '{name}' AS \"column\", {rule} AS sdtype, {i} AS position FROM {source}")
    return "\nUNION ALL ".join(parts)


@query("b15_metadata_part", _metadata_sql("part", [
    ("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "number"),
    ("p_retailprice", "number")]))
def metadata_part(spark, sf):
    return detect_metadata(table(spark, sf, "part"))


@query("b15_metadata_lineitem", _metadata_sql("lineitem", [
    ("l_orderkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_discount", "number"),
    ("l_returnflag", "text"), ("l_linestatus", "text")]))
def metadata_lineitem(spark, sf):
    return detect_metadata(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))


@query("b16_round_and_format", """SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_price,
  printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM orders)) AS share_text
FROM orders GROUP BY o_orderstatus""")
def round_and_format(spark, sf):
    orders = table(spark, sf, "orders")
    total = orders.agg(F.count(F.lit(1))).scalar()
    return orders.groupBy("o_orderstatus").agg(
        round4(F.avg("o_totalprice")).alias("mean_price"), F.count(F.lit(1)).alias("n")
    ).select("o_orderstatus", "mean_price", percent_text(F.col("n") / total).alias("share_text"))


@query("b17_parse_number", """SELECT event_id, try_cast(nullif(trim(regexp_extract(props, ': *([^}]*)', 1)), '') AS DOUBLE)
  AS k, try_cast(event_type AS DOUBLE) AS no_number FROM events""")
def parse_number(spark, sf):
    text = F.regexp_extract("props", r": *([^}]*)", 1)
    return table(spark, sf, "events").select(
        "event_id", parse_double(text).alias("k"), parse_double(F.col("event_type")).alias("no_number"))


@query("b18_preprocess", f"""WITH {GAPS},
kept AS (SELECT * FROM gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL),
ranks AS (SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) AS p FROM kept)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_bits("o_orderpriority", "p", 3)} FROM ranks""")
def preprocess_job(spark, sf):
    source = orders_with_gaps(spark, sf).drop("o_orderdate")
    path = write_table(source, scratch_path(spark, "orders"), "csv", ";")
    return preprocess(spark, path, ";", "o_orderstatus", "drop").encoded


@query("b3_impute_median_sketch")
def median_sketch(spark, sf):
    """The one-scan variant for very large tables; the fill is a quantile sketch, so SQL gives no exact twin."""
    filled = impute_median(orders_with_gaps(spark, sf), ["o_totalprice"], exact=False)
    return rounded(filled.select("o_orderkey", "o_totalprice"), 4)


@query("b3_sketch_rank_error", f"WITH {GAPS} " + sketch_sql("gaps", ["o_totalprice"], 1))
def median_sketch_error(spark, sf):
    """The rank of the sketched median against the exact one."""
    return sketch_check(orders_with_gaps(spark, sf), ["o_totalprice"], [0.5], 0.02)
