"""Queries that train and score classifiers.

The deterministic ones use exact neighbours over the embeddings. Their ``Synthetic`` variant is the training half with
every vector shrunk a little, which SQL can reproduce.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import scratch_path
from ..operators.anonymity import KAnonymity, anonymise_at
from ..operators.classifiers import (ALL_MODELS, FOREST, KNN, LOGISTIC, SVM, TREE, Task, all_predictions, cross_validated,
                                     fit_model, train_models)
from ..operators.covers import Generalised
from ..operators.neighbours import knn_predict, nearest
from ..operators.scoring import accuracy, confusion, result_table, weighted_scores
from ..operators.splitting import train_test_split
from ..operators.summary import compare_models, mean_accuracy
from ..plans.benchmark import run_benchmark, run_one_hot_benchmark
from ..plans.synthesise import split_then_synthesise, variants_for_utility
from ..plans.utility import prepare_variants, run_utility
from ..sources.reports import read_model_scores, write_model_scores
from ..sources.tables import write_table
from .anonymisation import LABELS, customer_hierarchies
from .registry import draw, labelled_documents, query, rounded, table

TASK = Task(("embedding",), "label", "vec_id")


def vectors(spark, sf):
    return train_test_split(table(spark, sf, "embeddings"), "vec_id")


def shrunk(df):
    return df.withColumn("embedding", F.transform(
        F.col("embedding").cast("array<double>"), lambda v: v * F.lit(0.9) + F.lit(0.01)))


def variants(spark, sf):
    train, test = vectors(spark, sf)
    return {"Original": train, "Synthetic": shrunk(train)}, test


SPLIT = f"""WITH v AS (SELECT vec_id, embedding::double[] AS x, label::varchar AS label,
  {draw('vec_id', 42)} % 10000 < 2000 AS is_test, {draw('vec_id', 43)} AS d FROM embeddings)"""

NEAREST = SPLIT + """, pairs AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label, a.label AS truth,
  list_distance(a.x, b.x) AS distance FROM v a, v b WHERE a.is_test AND NOT b.is_test),
near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, t) AS rank FROM pairs QUALIFY rank <= 5)"""

VOTES = NEAREST + """, votes AS (SELECT q, any_value(truth) AS truth, label, count(*) AS n FROM near GROUP BY q, label),
pred AS (SELECT q AS vec_id, any_value(truth) AS label, first(label ORDER BY n DESC, label) AS prediction FROM votes GROUP BY q)"""


@query("g2_nearest_neighbours", NEAREST + """ SELECT q AS vec_id, t AS neighbour_vec_id, round(distance, 6) AS distance,
  CAST(rank AS INTEGER) AS rank FROM near""")
def neighbours(spark, sf):
    return rounded(nearest(*vectors(spark, sf), "embedding", "vec_id", "vec_id"))


@query("g2_nearest_neighbours_cells", NEAREST + """ SELECT q AS vec_id, t AS neighbour_vec_id,
  round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near""")
def neighbours_cells(spark, sf):
    """The path for training tables too large to broadcast: cells around pivots, chunks of bounded size."""
    return rounded(nearest(*vectors(spark, sf), "embedding", "vec_id", "vec_id", small_bytes=0, chunk_rows=2000))


@query("g2_knn_predictions", VOTES + " SELECT vec_id, CAST(prediction AS INTEGER) AS prediction FROM pred")
def knn_predictions(spark, sf):
    return knn_predict(*vectors(spark, sf), "embedding", "vec_id", "vec_id", "label")


FOLDS = """, train AS (SELECT * FROM v WHERE NOT is_test), folded AS (SELECT *, (row_number() OVER
  (PARTITION BY label ORDER BY d, vec_id) - 1) % 5 AS fold FROM train),
cv_pairs AS (SELECT a.vec_id AS q, a.fold, a.label AS truth, b.label, list_distance(a.x, b.x) AS distance, b.vec_id AS t
  FROM folded a, folded b WHERE a.fold <> b.fold),
cv_near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, t) AS rank FROM cv_pairs QUALIFY rank <= 5),
cv_votes AS (SELECT q, fold, truth, label, count(*) AS n FROM cv_near GROUP BY ALL),
cv_pred AS (SELECT q, fold, truth, first(label ORDER BY n DESC, label) AS prediction FROM cv_votes GROUP BY q, fold, truth),
cv AS (SELECT fold, avg((truth = prediction)::int) AS accuracy FROM cv_pred GROUP BY fold)"""


@query("g7_cross_validated_accuracy", SPLIT + FOLDS + " SELECT CAST(fold AS INTEGER) AS fold, round(accuracy, 6) AS accuracy FROM cv")
def cross_validation(spark, sf):
    train, _ = vectors(spark, sf)
    predictions = reduce(DataFrame.unionByName, cross_validated(TASK.prepare(train), "Original", KNN))
    return rounded(accuracy(confusion(predictions, ["fold"]), ["fold"]))


def _weighted(name: str, source: str) -> str:
    return f"""{name} AS (SELECT sum(sup * p) / sum(sup) AS precision, sum(sup * r) / sum(sup) AS recall,
  sum(sup * f) / sum(sup) AS f1 FROM (SELECT sup, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f
  FROM (SELECT c.label, count(*) FILTER ({source}.label = c.label) AS sup,
    coalesce(count(*) FILTER ({source}.label = c.label AND prediction = c.label)
      / nullif(count(*) FILTER (prediction = c.label), 0)::double, 0) AS p,
    coalesce(count(*) FILTER ({source}.label = c.label AND prediction = c.label)
      / nullif(count(*) FILTER ({source}.label = c.label), 0)::double, 0) AS r
    FROM {source}, (SELECT DISTINCT label FROM {source}) c GROUP BY c.label)))"""


@query("g8_weighted_scores", VOTES + ", " + _weighted("w", "pred") +
       " SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM w")
def weighted(spark, sf):
    train, test = vectors(spark, sf)
    predictions = fit_model(KNN, TASK.prepare(train))(TASK.prepare(test))
    return rounded(weighted_scores(confusion(predictions)))


# The shrunk variant: neighbours inside it are those of the original, distances from test rows are not.
RESULTS = VOTES + FOLDS + f""", s_pairs AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label, a.label AS truth,
  list_distance(a.x, list_transform(b.x, lambda e: e * 0.9::double + 0.01::double)) AS distance
  FROM v a, v b WHERE a.is_test AND NOT b.is_test),
s_near AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, t) AS rank FROM s_pairs QUALIFY rank <= 5),
s_votes AS (SELECT q, any_value(truth) AS truth, label, count(*) AS n FROM s_near GROUP BY q, label),
s_pred AS (SELECT q AS vec_id, any_value(truth) AS label, first(label ORDER BY n DESC, label) AS prediction
  FROM s_votes GROUP BY q), {_weighted("wo", "pred")}, {_weighted("ws", "s_pred")},
results AS (SELECT 'Original' AS "Dataset", 'KNN' AS "Model", round((SELECT avg(accuracy) FROM cv), 4) AS "Accuracy",
  round(precision, 4) AS "Precision", round(recall, 4) AS "Recall", round(f1, 4) AS "F1" FROM wo
UNION ALL SELECT 'Synthetic', 'KNN', round((SELECT avg(accuracy) FROM cv), 4), round(precision, 4), round(recall, 4),
  round(f1, 4) FROM ws)"""


def knn_results(spark, sf):
    tables, test = variants(spark, sf)
    return result_table(all_predictions(tables, test, TASK, (KNN,)))


@query("g9_result_table", RESULTS + " SELECT * FROM results")
def results(spark, sf):
    return knn_results(spark, sf)


@query("a8_model_scores_file", RESULTS + " SELECT * FROM results")
def scores_file(spark, sf):
    return read_model_scores(spark, write_model_scores(knn_results(spark, sf), scratch_path(spark, "scores")))


@query("c6_mean_accuracy", RESULTS + """ SELECT "Model", round(avg("Accuracy"), 6) AS mean_accuracy FROM results GROUP BY 1""")
def model_means(spark, sf):
    return rounded(mean_accuracy(knn_results(spark, sf)))


@query("c7_compare_models", RESULTS + """ SELECT "Model",
  max("Accuracy") FILTER ("Dataset" = 'Original') AS original_accuracy,
  max("Accuracy") FILTER ("Dataset" = 'Synthetic') AS synthetic_accuracy,
  max("Precision") FILTER ("Dataset" = 'Original') AS original_precision,
  max("Precision") FILTER ("Dataset" = 'Synthetic') AS synthetic_precision FROM results GROUP BY 1""")
def model_comparison(spark, sf):
    return compare_models(knn_results(spark, sf))


def quality_task(spark, sf):
    """Documents with a label: learn ``quality`` from length, language, source and toxicity."""
    rows = labelled_documents(spark, sf).where("quality is not null")
    train, test = train_test_split(rows, "doc_id")
    ready = prepare_variants({"Original": train}, test, "quality", "doc_id")
    return ready.task.prepare(ready.train["Original"]), ready.task.prepare(ready.test)


def _predict(model, **options):
    def job(spark, sf):
        train, test = quality_task(spark, sf)
        return fit_model(model, train, **options)(test)

    return job


query("g1_logistic_regression")(_predict(LOGISTIC))
query("g3_random_forest")(_predict(FOREST))
query("g4_decision_tree")(_predict(TREE))
query("g5_support_vector_machine")(_predict(SVM))


@query("g6_train_all")
def train_all(spark, sf):
    """Three models on both variants of the embeddings, each fitted afresh, scored on the original test rows."""
    tables, test = variants(spark, sf)
    held_out = TASK.prepare(test)
    trained = train_models({v: TASK.prepare(t) for v, t in tables.items()}, (KNN, LOGISTIC, TREE),
                           options={LOGISTIC: {"max_iter": 100}})
    parts = None
    for variant, models in trained.items():
        for model, predict in models.items():
            one = accuracy(confusion(predict(held_out))).select(
                F.lit(variant).alias("variant"), F.lit(model).alias("model"), "accuracy")
            parts = one if parts is None else parts.unionByName(one)
    return rounded(parts)


@query("g10_utility_job")
def utility_job(spark, sf):
    """Customers and their synthetic twin: learn the segment."""
    customer = table(spark, sf, "customer").drop("c_name")
    train, test, made = split_then_synthesise(
        customer, "customer", "c_custkey", output_folder=scratch_path(spark, "synthetic"))
    return run_utility(train, test, "c_mktsegment", "c_custkey", made.table)


# Regions and balance intervals: a label's number is the mean of the distinct ground values below it.
UTILITY_NODE = {"c_nationkey": 2, "c_acctbal": 1}
UTILITY_K = 18


def _variant_scores(variant: str, x: str, known: str) -> str:
    """Cross-validated accuracy on the rows of a variant, and scores on the original test rows."""
    v = variant.lower()
    return f"""{v}_rows AS (SELECT id, label, fold, {x} AS x FROM coded WHERE {known}),
{v}_cv AS (SELECT avg(hit) AS accuracy FROM (SELECT fold, avg((label = prediction)::int) AS hit FROM (
    SELECT q, fold, truth AS label, first(label ORDER BY n DESC, label) AS prediction FROM (
      SELECT q, fold, truth, label, count(*) AS n FROM (
        SELECT a.id AS q, a.fold, a.label AS truth, b.label,
          row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank
        FROM {v}_rows a JOIN {v}_rows b ON a.fold <> b.fold) WHERE rank <= 5 GROUP BY ALL) GROUP BY q, fold, truth) GROUP BY fold)),
{v}_pred AS (SELECT q, truth AS label, first(label ORDER BY n DESC, label) AS prediction FROM (
    SELECT q, truth, label, count(*) AS n FROM (
      SELECT a.id AS q, a.label AS truth, b.label,
        row_number() OVER (PARTITION BY a.id ORDER BY list_distance([a.nat, a.bal], b.x), b.id) AS rank
      FROM held a CROSS JOIN {v}_rows b) WHERE rank <= 5 GROUP BY ALL) GROUP BY q, truth),
{_weighted(f"{v}_w", f"{v}_pred")}"""


VARIANT_SCORES = f"""WITH {LABELS},
base AS (SELECT c_custkey AS id, nat[1]::double AS nat, bal, nat[3] AS g1, bal_labels[2] AS g2, seg[1] AS label,
  {draw('c_custkey', 42)} % 10000 < 2000 AS is_test, {draw('c_custkey', 43)} AS d FROM lab),
nat_cover AS (SELECT g1, avg(DISTINCT nat) AS c1 FROM base GROUP BY g1),
bal_cover AS (SELECT g2, avg(DISTINCT bal) AS c2 FROM base GROUP BY g2),
top AS (SELECT avg(DISTINCT nat) AS t1, avg(DISTINCT bal) AS t2 FROM base),
held AS (SELECT * FROM base WHERE is_test),
cls AS (SELECT g1, g2, count(*) >= {UTILITY_K} AS kept FROM base WHERE NOT is_test GROUP BY g1, g2),
coded AS (SELECT id, label, nat, bal, CASE WHEN kept THEN c1 ELSE t1 END AS x1, CASE WHEN kept THEN c2 ELSE t2 END AS x2,
  (row_number() OVER (PARTITION BY label ORDER BY d, id) - 1) % 5 AS fold
  FROM base JOIN cls USING (g1, g2) JOIN nat_cover USING (g1) JOIN bal_cover USING (g2) CROSS JOIN top WHERE NOT is_test),
{_variant_scores("Original", "[nat, bal]", "true")}, {_variant_scores("Anonymised", "[x1, x2]", "true")}""" + " UNION ALL ".join(
    f"""SELECT '{v}' AS "Dataset", 'KNN' AS "Model", round((SELECT accuracy FROM {v.lower()}_cv), 4) AS "Accuracy",
  round(precision, 4) AS "Precision", round(recall, 4) AS "Recall", round(f1, 4) AS "F1" FROM {v.lower()}_w """
    for v in ("Original", "Anonymised"))


def segments_anonymised(spark, sf):
    """Customers without their names, split; the training rows anonymised on nation and balance."""
    customer = table(spark, sf, "customer").drop("c_name")
    train, test = train_test_split(customer, "c_custkey")
    hierarchies = [h for h in customer_hierarchies(spark, sf) if h.attribute in UTILITY_NODE]
    return train, test, anonymise_at(train, hierarchies, UTILITY_NODE, [KAnonymity(UTILITY_K)])


KINDS = {"c_nationkey": "numerical", "c_acctbal": "numerical", "c_mktsegment": "categorical", "c_custkey": "id"}


@query("e6_variant_scores", VARIANT_SCORES)
def variant_scores(spark, sf):
    """Original and anonymised training rows, tested on original rows: the segment from nation and balance."""
    train, test, anonymised = segments_anonymised(spark, sf)
    return run_utility(train, test, "c_mktsegment", "c_custkey", others={"Anonymised": Generalised.of(anonymised)}, kinds=KINDS)


@query("e6_four_variant_scores")
def four_variant_scores(spark, sf):
    """All four variants with all five models."""
    train, test, anonymised = segments_anonymised(spark, sf)
    tables = variants_for_utility(train, anonymised, "customer", "c_custkey", output_folder=scratch_path(spark, "variants"))
    others = {v: t for v, t in tables.items() if v not in ("Original", "Synthetic")}
    return run_utility(train, test, "c_mktsegment", "c_custkey", tables["Synthetic"], others, ALL_MODELS, kinds=KINDS)


ORIGINAL_ONLY = VARIANT_SCORES.split(", anonymised_rows AS")[0] + """,
scores AS (SELECT round((SELECT accuracy FROM original_cv), 4) AS accuracy, round(precision, 4) AS precision,
  round(recall, 4) AS recall, round(f1, 4) AS f1 FROM original_w)
SELECT 'results' AS step, 'Original / KNN / Accuracy' AS metric, accuracy AS value FROM scores
UNION ALL SELECT 'results', 'Original / KNN / Precision', precision FROM scores
UNION ALL SELECT 'results', 'Original / KNN / Recall', recall FROM scores
UNION ALL SELECT 'results', 'Original / KNN / F1', f1 FROM scores
UNION ALL SELECT 'comparison', 'KNN / original_accuracy', accuracy FROM scores
UNION ALL SELECT 'comparison', 'KNN / original_precision', precision FROM scores
UNION ALL SELECT 'comparison', 'KNN / synthetic_accuracy', NULL UNION ALL SELECT 'comparison', 'KNN / synthetic_precision', NULL
""" + "".join(f"UNION ALL SELECT 'report', '{m}', {v}::double FROM customer\n" for m, v in (
    ("original_rows", "count(*)"), ("processed_rows", "count(*)"), ("original_columns", "max(4)"),
    ("processed_columns", "max(4)"), ("missing_before", "max(0)"), ("missing_after", "max(0)"), ("dropped_rows", "max(0)")))


@query("g11_benchmark_without_synthetic", ORIGINAL_ONLY)
def benchmark_original(spark, sf):
    """The whole benchmark on one variant, from the file to the comparison, as (step, metric, value)."""
    customer = table(spark, sf, "customer").drop("c_name")
    path = write_table(customer, scratch_path(spark, "customer"), "csv", ";")
    return rounded(run_benchmark(spark, path, ";", "c_mktsegment", "c_custkey", enable_synthetic=False).steps())


@query("g11_benchmark_job")
def benchmark_job(spark, sf):
    """Every part executed: report, diagnostic, quality, scores and comparison."""
    path = write_table(table(spark, sf, "customer"), scratch_path(spark, "customer"), "csv", ";")
    return run_benchmark(spark, path, ";", "c_mktsegment", "c_custkey").steps()


@query("g12_one_hot_benchmark_job")
def one_hot_benchmark_job(spark, sf):
    """Parts with all their columns, the names included, as one-hot codes."""
    path = write_table(table(spark, sf, "part"), scratch_path(spark, "part"), "csv", ";")
    return run_one_hot_benchmark(spark, path, ";", "p_type", "p_partkey").steps()
