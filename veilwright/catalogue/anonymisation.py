"""Queries for hierarchies, anonymisation, the search and the loss metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.staging import scratch_path
from ..operators.anonymity import (DistinctLDiversity, EntropyLDiversity, KAnonymity, Roles, anonymise_at,
                                   class_table, frequency_table, generalise, generalised, with_generalised)
from ..operators.hierarchy import (IntervalHierarchy, LookupHierarchy, MapHierarchy, MaskHierarchy, label_column,
                                   levels_report, longitude_hierarchy)
from ..operators.lattice import build_lattice, find_optimum, score_nodes
from ..operators.loss import (ambiguity, average_class_size, discernibility, generalisation_intensity, granularity,
                              non_uniform_entropy, record_squared_error, squared_error)
from ..plans.anonymise import anonymise
from ..sources.tables import load_table, write_anonymised, write_table
from .cleaning import nation_levels
from .registry import query, rounded, table

NODE = {"c_nationkey": 1, "c_acctbal": 1, "c_mktsegment": 0}
MIXED = {"c_nationkey": 2, "c_acctbal": 2, "c_mktsegment": 0}
ROLES = Roles(("c_nationkey", "c_acctbal", "c_mktsegment"), insensitive=("c_custkey", "c_name"))


def customer_hierarchies(spark, sf):
    """nation → region → ``*``; balance in ten intervals, pairs, triples of pairs, ``*``; segment → ``*``."""
    customer = table(spark, sf, "customer")
    segments = customer.select(F.col("c_mktsegment").alias("value")).distinct().withColumn(
        "labels", F.array(F.lit("*")))
    return [
        LookupHierarchy("c_nationkey", nation_levels(spark, sf), 3, True),
        IntervalHierarchy.from_data(customer, "c_acctbal", 10),
        LookupHierarchy("c_mktsegment", segments, 1, True),
    ]


def _number(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '')"


def _interval(step: int, bins: int = 10) -> str:
    """The label of the group of ``step`` base intervals that holds bucket b."""
    low = f"(mn + ((b // {step}) * {step}) * w)"
    last = f"least((b // {step}) * {step} + {step}, {bins})"
    high = f"(CASE WHEN {last} = {bins} THEN mx + 0.000001 ELSE mn + {last} * w END)"
    return f"'[' || {_number(low)} || ', ' || {_number(high)} || '['"


LABELS = f"""edges AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) AS mx,
  (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer),
cut AS (SELECT c.*, e.mn, e.mx, e.w, CAST(least(floor((c_acctbal - mn) / w), 9) AS BIGINT) AS b FROM customer c, edges e),
lab AS (SELECT c_custkey, c_name, c_acctbal AS bal,
  [c_nationkey::varchar, n_name, r_name, '*'] AS nat,
  [c_acctbal::varchar, {_interval(1)}, {_interval(2)}, {_interval(6)}, '*'] AS bal_labels,
  [c_mktsegment, '*'] AS seg
  FROM cut JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _at(node) -> str:
    n, b, s = node["c_nationkey"], node["c_acctbal"], node["c_mktsegment"]
    return f"""gen AS (SELECT c_custkey, c_name, bal, nat[1] AS nat0, bal_labels[1] AS bal0, seg[1] AS seg0,
  nat[{n + 1}] AS g1, bal_labels[{b + 1}] AS g2, seg[{s + 1}] AS g3 FROM lab),
cls AS (SELECT g1, g2, g3, count(*) AS size, count(*) >= 2 AS kept FROM gen GROUP BY g1, g2, g3),
marked AS (SELECT gen.*, size, kept FROM gen JOIN cls USING (g1, g2, g3))"""


AT_NODE = f"WITH {LABELS}, {_at(NODE)}"
AT_MIXED = f"WITH {LABELS}, {_at(MIXED)}"


def customers_at(spark, sf, node=None):
    return anonymise_at(table(spark, sf, "customer"), customer_hierarchies(spark, sf), node or NODE)


def _labels(df, attribute, height, key):
    return df.select(key, *[F.get(col(label_column(attribute)), F.lit(i)).alias(f"level_{i}") for i in range(height + 1)])


@query("d2_lookup_generalisation", f"""WITH {LABELS} SELECT c_custkey, nat[1] AS level_0, nat[2] AS level_1,
  nat[3] AS level_2, nat[4] AS level_3 FROM lab""")
def lookup_labels(spark, sf):
    h = customer_hierarchies(spark, sf)[0]
    return _labels(h.attach(table(spark, sf, "customer")), "c_nationkey", 3, "c_custkey")


@query("d3_equal_width_intervals", f"WITH {LABELS} SELECT c_custkey, b AS bucket, {_interval(1)} AS label FROM cut")
def interval_labels(spark, sf):
    customer = table(spark, sf, "customer")
    h = IntervalHierarchy.from_data(customer, "c_acctbal", 10)
    return h.attach(customer).select(
        "c_custkey", h.bucket(F.col("c_acctbal")).cast("bigint").alias("bucket"), h.label(1).alias("label"))


@query("d3_large_numbers", """WITH x AS (SELECT o_orderkey, o_totalprice * 1e9 AS v FROM orders),
r AS (SELECT min(v) AS mn, max(v) AS mx FROM x)
SELECT o_orderkey, CAST(least(floor((v - mn) / ((mx - mn) / 10.0)), 9) AS BIGINT) AS bucket, v = mx AS largest,
       true AS inside FROM x, r""")
def large_number_intervals(spark, sf):
    """Where the closing margin is lost in the size of the numbers, the largest value still has its interval."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 1e9).alias("v"))
    h = IntervalHierarchy.from_data(orders, "v", 10)
    top = orders.agg(F.max("v")).first()[0]
    return h.attach(orders).select("o_orderkey", h.bucket(F.col("v")).cast("bigint").alias("bucket"),
                                   (F.col("v") == top).alias("largest"), (h.label(1) != "*").alias("inside"))


@query("d10_repeated_value_refused", """SELECT n_regionkey, count(*) AS nations, true AS refused
FROM nation GROUP BY n_regionkey""")
def repeated_value_refused(spark, sf):
    """A hierarchy that lists a value twice would multiply rows: it is refused before any row is touched."""
    nation = table(spark, sf, "nation")
    listed = nation.select(F.col("n_nationkey").cast("string").alias("value"), F.array("n_name", F.lit("*")).alias("labels"))
    twice = LookupHierarchy("n_nationkey", listed.unionByName(listed.limit(1)), 2)
    try:
        generalise(nation, [twice], {"n_nationkey": 1})
        refused = False
    except ValueError:
        refused = True
    return nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations")).withColumn("refused", F.lit(refused))


BANDS = [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0]
BAND_NAMES = ["<5", "5 to 10", "10 to 15", "15 to 20", "20 to 25", "25 to 30", "30 to 35", ">35"]


def _band_case(step: int) -> str:
    arms = []
    for i, _ in enumerate(BAND_NAMES):
        start = (i // step) * step
        last = min(start + step, len(BAND_NAMES)) - 1
        name = BAND_NAMES[start] if start == last else f"{BAND_NAMES[start]} .. {BAND_NAMES[last]}"
        arms.append(f"WHEN l_quantity >= {BANDS[i]} AND l_quantity < {BANDS[i + 1]} THEN '{name}'")
    return "CASE " + " ".join(arms) + " ELSE '*' END"


@query("d4_fixed_bands", f"""SELECT {_band_case(1)} AS band, {_band_case(2)} AS pair, {_band_case(6)} AS six,
  count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def fixed_bands(spark, sf):
    """Quantities of 40 and more lie outside the bands and become ``*``."""
    h = IntervalHierarchy("l_quantity", BANDS, BAND_NAMES)
    return h.attach(table(spark, sf, "lineitem")).groupBy(
        h.label(1).alias("band"), h.label(2).alias("pair"), h.label(3).alias("six")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("d4_longitude_bands", """SELECT CASE WHEN x < -119.0 THEN '<-119' WHEN x < -118.9 THEN '-119 to -118.9'
  WHEN x < -118.8 THEN '-118.9 to -118.8' WHEN x < -118.7 THEN '-118.8 to -118.7' WHEN x < -118.6 THEN '-118.7 to -118.6'
  WHEN x < -118.5 THEN '-118.6 to -118.5' WHEN x < -118.4 THEN '-118.5 to -118.4' WHEN x < -118.3 THEN '-118.4 to -118.3'
  WHEN x < -118.2 THEN '-118.3 to -118.2' WHEN x < -118.1 THEN '-118.2 to -118.1' WHEN x < -118.0 THEN '-118.1 to -118.0'
  ELSE '>-118' END AS band, count(*) AS n FROM (SELECT -119.25 + c_acctbal / 7000.0 AS x FROM customer) GROUP BY 1""")
def longitude_bands(spark, sf):
    """Balances stand in for longitudes around the bands."""
    x = table(spark, sf, "customer").select((F.lit(-119.25) + F.col("c_acctbal") / 7000.0).alias("x"))
    h = longitude_hierarchy("x")
    return h.attach(x).groupBy(h.label(1).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("d5_interval_specification", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 9000.000001
  THEN CAST(least(floor(c_acctbal / 1800.0), 4) AS BIGINT) END AS bucket FROM customer""")
def interval_specification(spark, sf):
    h = IntervalHierarchy.equal("c_acctbal", 0.0, 9000.0, 5)
    return table(spark, sf, "customer").select(
        "c_custkey", h.bucket(F.col("c_acctbal")).cast("bigint").alias("bucket"))


@query("d6_fanout_levels", f"""WITH {LABELS} SELECT c_custkey, bal_labels[2] AS level_1, bal_labels[3] AS level_2,
  bal_labels[4] AS level_3, bal_labels[5] AS level_4 FROM lab""")
def fanout_levels(spark, sf):
    h = customer_hierarchies(spark, sf)[1]
    return _labels(h.attach(table(spark, sf, "customer")), "c_acctbal", 4, "c_custkey").drop("level_0")


@query("d7_groups_per_level", f"""WITH {LABELS} SELECT CAST(0 AS INTEGER) AS level, count(DISTINCT bal) AS "groups" FROM lab
""" + "".join(f"UNION ALL SELECT {i}, count(DISTINCT bal_labels[{i + 1}]) FROM lab\n" for i in range(1, 5)))
def groups_per_level(spark, sf):
    return levels_report(table(spark, sf, "customer"), customer_hierarchies(spark, sf)[1])


KINDS = {"SMALL": "SIZE", "MEDIUM": "SIZE", "LARGE": "SIZE", "STANDARD": "GRADE", "ECONOMY": "GRADE"}


@query("d8_map_hierarchy", """SELECT p_partkey, p_type AS level_0, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE')
  THEN 'SIZE' WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'GRADE' ELSE '*' END AS level_1, '*' AS level_2 FROM part""")
def map_labels(spark, sf):
    h = MapHierarchy("p_type", KINDS)
    return _labels(h.attach(table(spark, sf, "part")), "p_type", 2, "p_partkey")


@query("d9_prefix_mask", """WITH t AS (SELECT p_partkey, lpad(printf('%.1f', round(p_retailprice, 1)), 6, '0') AS s FROM part)
SELECT p_partkey, s[1:5] || '*' AS level_1, s[1:3] || '*.*' AS level_2, s[1:2] || '**.*' AS level_3,
  s[1:1] || '***.*' AS level_4, '****.**' AS level_5 FROM t""")
def mask_labels(spark, sf):
    h = MaskHierarchy("p_retailprice", 4, 1)
    return _labels(h.attach(table(spark, sf, "part")), "p_retailprice", 5, "p_partkey").drop("level_0")


@query("d10_generalise", AT_NODE + """ SELECT c_custkey, c_name, g1 AS c_nationkey, g2 AS c_acctbal,
  g3 AS c_mktsegment FROM gen""")
def generalise_customers(spark, sf):
    customer = table(spark, sf, "customer")
    ROLES.check(customer)
    return generalise(customer, customer_hierarchies(spark, sf), NODE)


@query("d11_k_anonymity", AT_NODE + " SELECT g1, g2, g3, size, kept FROM cls")
def k_anonymity(spark, sf):
    a = customers_at(spark, sf)
    return a.classes.select(*[col(k).alias(f"g{i + 1}") for i, k in enumerate(a.keys)], "size", "kept")


ORDER_CLASSES = """WITH e AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx,
  (max(o_totalprice) - min(o_totalprice)) / 400 AS w FROM orders),
gen AS (SELECT o_orderstatus AS g1, CAST(least(floor((o_totalprice - mn) / w), 399) AS BIGINT) AS bucket,
  o_orderpriority AS s FROM orders, e),
per AS (SELECT g1, bucket, s, count(*) AS n FROM gen GROUP BY 1, 2, 3)"""


def order_classes(spark, sf, models):
    """Orders in 400 price intervals by status; the priority is sensitive."""
    orders = table(spark, sf, "orders")
    status = orders.select(F.col("o_orderstatus").alias("value")).distinct().withColumn("labels", F.array(F.lit("*")))
    prices = IntervalHierarchy.from_data(orders, "o_totalprice", 400)
    hierarchies = [LookupHierarchy("o_orderstatus", status, 1, True), prices]
    cells = with_generalised(frequency_table(orders, hierarchies, ["o_orderpriority"]), hierarchies,
                             {"o_orderstatus": 0, "o_totalprice": 1})
    keys = [generalised("o_orderstatus"), generalised("o_totalprice")]
    low = cells.groupBy(*[col(k) for k in keys]).agg(F.min(prices.bucket(F.col("o_totalprice"))).alias("bucket"))
    classes = class_table(cells, keys, models)
    return classes.join(low, keys).withColumnRenamed(keys[0], "g1").withColumn(
        "bucket", F.col("bucket").cast("bigint"))


@query("d12_distinct_l_diversity", ORDER_CLASSES + """ SELECT g1, bucket, CAST(sum(n) AS BIGINT) AS size, count(s) AS distinct_values,
  sum(n) >= 2 AND count(s) >= 5 AS kept FROM per GROUP BY g1, bucket""")
def distinct_diversity(spark, sf):
    out = order_classes(spark, sf, [KAnonymity(2), DistinctLDiversity("o_orderpriority", 5)])
    return out.select("g1", "bucket", "size", F.col("distinct_o_orderpriority").alias("distinct_values"), "kept")


@query("d13_entropy_l_diversity", ORDER_CLASSES + """ SELECT g1, bucket, CAST(sum(n) AS BIGINT) AS size,
  round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) + 0.0 AS entropy,
  ln(sum(n)) - sum(n * ln(n)) / sum(n) >= ln(4) - 1e-9 AS kept FROM per GROUP BY g1, bucket""")
def entropy_diversity(spark, sf):
    out = order_classes(spark, sf, [EntropyLDiversity("o_orderpriority", 4)])
    return out.select("g1", "bucket", "size", (F.round("entropy_o_orderpriority", 6) + 0.0).alias("entropy"), "kept")


SUPPRESSED = """ SELECT c_custkey, c_name, CASE WHEN kept THEN g1 ELSE '*' END AS c_nationkey,
  CASE WHEN kept THEN g2 ELSE '*' END AS c_acctbal, CASE WHEN kept THEN g3 ELSE '*' END AS c_mktsegment"""


@query("d14_suppress_records", AT_NODE + SUPPRESSED + ", NOT kept AS suppressed FROM marked")
def suppress(spark, sf):
    return customers_at(spark, sf).table(flag="suppressed")


@query("a6_write_anonymised", AT_MIXED + SUPPRESSED + " FROM marked")
def write_customers(spark, sf):
    out = customers_at(spark, sf, MIXED).table()
    path = write_anonymised(out, scratch_path(spark, "anonymised"))
    return load_table(spark, path, ";", out.schema)[0]


NODES = f"""WITH {LABELS},
flat AS (SELECT c_custkey, 1 AS q, unnest(nat) AS label, generate_subscripts(nat, 1) - 1 AS l, nat[1] AS v FROM lab
  UNION ALL SELECT c_custkey, 2, unnest(bal_labels), generate_subscripts(bal_labels, 1) - 1, bal_labels[1] FROM lab
  UNION ALL SELECT c_custkey, 3, unnest(seg), generate_subscripts(seg, 1) - 1, seg[1] FROM lab),
listed AS (SELECT DISTINCT q, l, label, v FROM flat UNION SELECT 1, l, CASE l WHEN 0 THEN n_nationkey::varchar
  WHEN 1 THEN n_name WHEN 2 THEN r_name ELSE '*' END, n_nationkey::varchar
  FROM nation JOIN region ON n_regionkey = r_regionkey, range(4) r(l)),
leaves AS (SELECT q, l, label, count(DISTINCT v) AS leaves FROM listed GROUP BY q, l, label),
sizes AS (SELECT q, count(DISTINCT v) AS domain FROM listed GROUP BY q),
freq AS (SELECT q, l, label, count(*) AS f FROM flat GROUP BY q, l, label),
weight AS (SELECT leaves.q, leaves.l, leaves.label, (leaves - 1) / (domain - 1)::double AS g, log2(f) AS h
  FROM leaves JOIN sizes USING (q) LEFT JOIN freq USING (q, l, label)),
own AS (SELECT sum(h) AS s FROM flat JOIN weight USING (q, l, label) WHERE l = 0),
total AS (SELECT count(*) AS n FROM lab),
nodes AS (SELECT a.l AS a, b.l AS b, c.l AS c FROM range(4) a(l), range(5) b(l), range(2) c(l)),
cls AS (SELECT a, b, c, nat[a + 1] AS g1, bal_labels[b + 1] AS g2, seg[c + 1] AS g3, count(*) AS size
  FROM lab, nodes GROUP BY ALL),
priced AS (SELECT cls.*, w1.g + w2.g + w3.g AS g, w1.h + w2.h + w3.h AS h FROM cls
  JOIN weight w1 ON w1.q = 1 AND w1.l = a AND w1.label = g1 JOIN weight w2 ON w2.q = 2 AND w2.l = b AND w2.label = g2
  JOIN weight w3 ON w3.q = 3 AND w3.l = c AND w3.label = g3),
scored AS (SELECT a, b, c, sum(CASE WHEN size >= 2 THEN size * g ELSE size * 3.0 END) / (any_value(n) * 3.0) AS loss,
  (sum(CASE WHEN size >= 2 THEN size * h ELSE size * 3 * log2(n) END) - any_value(s))
    / (any_value(n) * 3 * log2(any_value(n)) - any_value(s)) AS entropy,
  CAST(sum(CASE WHEN size < 2 THEN size ELSE 0 END) AS BIGINT) AS suppressed,
  count(*) FILTER (size >= 2) AS classes FROM priced, total, own GROUP BY a, b, c)"""


def _scores(spark, sf, objective):
    hierarchies = customer_hierarchies(spark, sf)
    lattice = build_lattice(frequency_table(table(spark, sf, "customer"), hierarchies), hierarchies, objective)
    return score_nodes(lattice, [KAnonymity(2)]).select(
        *[F.get("node", F.lit(i)).cast("bigint").alias(x) for i, x in enumerate("abc")],
        F.round("cost", 6).alias("cost"), "suppressed", "classes")


@query("d15_score_all_nodes", NODES + " SELECT a, b, c, round(loss, 6) AS cost, suppressed, classes FROM scored")
def score_all(spark, sf):
    return _scores(spark, sf, "loss")


@query("d16_entropy_objective", NODES + " SELECT a, b, c, round(entropy, 6) AS cost, suppressed, classes FROM scored")
def score_entropy(spark, sf):
    return _scores(spark, sf, "entropy")


WINNER = NODES + """, won AS (SELECT * FROM scored ORDER BY round({cost}, 9), a + b + c, a, b, c LIMIT 1)
SELECT 'c_nationkey' AS attribute, CAST(a AS INTEGER) AS level FROM won
UNION ALL SELECT 'c_acctbal', b FROM won UNION ALL SELECT 'c_mktsegment', c FROM won"""


@query("d15_optimal_node", WINNER.format(cost="loss"))
def optimal_node(spark, sf):
    return find_optimum(table(spark, sf, "customer"), customer_hierarchies(spark, sf)).levels(spark)


@query("d15_optimal_node_climbing", WINNER.format(cost="loss"))
def optimal_node_climbing(spark, sf):
    """The level-by-level search with roll-up and pruning that large tables take."""
    return find_optimum(table(spark, sf, "customer"), customer_hierarchies(spark, sf), one_job_cells=0).levels(spark)


# Nodes within a suppression limit, with a second model: every class shows two order priorities or more.
LIMITED = NODES.split(",\ncls AS")[0] + """,
cells AS (SELECT a, b, c, nat[a + 1] AS g1, bal_labels[b + 1] AS g2, seg[c + 1] AS g3, c_custkey FROM lab, nodes),
cls AS (SELECT a, b, c, g1, g2, g3, count(*) AS size, count(DISTINCT c_custkey % 7) AS kinds FROM cells GROUP BY ALL),
priced AS (SELECT cls.*, size >= {k} AND kinds >= {l} AS ok, w1.g + w2.g + w3.g AS g FROM cls
  JOIN weight w1 ON w1.q = 1 AND w1.l = a AND w1.label = g1 JOIN weight w2 ON w2.q = 2 AND w2.l = b AND w2.label = g2
  JOIN weight w3 ON w3.q = 3 AND w3.l = c AND w3.label = g3),
scored AS (SELECT a, b, c, sum(CASE WHEN ok THEN size * g ELSE size * 3.0 END) / (any_value(n) * 3.0) AS loss,
  sum(CASE WHEN ok THEN 0 ELSE size END) / any_value(n)::double AS share FROM priced, total GROUP BY a, b, c),
won AS (SELECT * FROM scored WHERE share <= {limit} + 1e-9 ORDER BY round(loss, 9), a + b + c, a, b, c LIMIT 1)"""


def _levels(cte: str) -> str:
    return cte + """ SELECT 'c_nationkey' AS attribute, CAST(a AS INTEGER) AS level FROM won
UNION ALL SELECT 'c_acctbal', b FROM won UNION ALL SELECT 'c_mktsegment', c FROM won"""


def with_group(customer):
    """A sensitive attribute with seven values."""
    return customer.withColumn("group", F.col("c_custkey") % 7)


@query("d15_optimal_node_limit_30", _levels(LIMITED.format(k=3, l=1, limit=0.3)))
def optimal_node_limit(spark, sf):
    """At most 30 percent of the rows may be suppressed."""
    return find_optimum(table(spark, sf, "customer"), customer_hierarchies(spark, sf), [KAnonymity(3)], 0.3).levels(spark)


@query("d15_optimal_node_limit_0", _levels(LIMITED.format(k=2, l=2, limit=0)))
def optimal_node_no_suppression(spark, sf):
    """No row may be suppressed; 2-anonymous and 2-diverse."""
    return find_optimum(with_group(table(spark, sf, "customer")), customer_hierarchies(spark, sf),
                        [KAnonymity(2), DistinctLDiversity("group", 2)], 0.0).levels(spark)


def _limited_job(limit, k, l):  # noqa: E741
    def job(spark, sf):
        customer = with_group(table(spark, sf, "customer"))
        roles = Roles(ROLES.quasi, ("group",), ROLES.insensitive)
        return anonymise(customer, roles, customer_hierarchies(spark, sf),
                         [KAnonymity(k), DistinctLDiversity("group", l)], limit).table(flag="suppressed").drop("group")

    return job


for _name, _limit, _k, _l in (("d14_suppress_limit_30", 0.3, 3, 2), ("d14_suppress_limit_0", 0.0, 2, 2)):
    query(_name, LIMITED.format(k=_k, l=_l, limit=_limit) + f""",
gen AS (SELECT c_custkey, c_name, nat[a + 1] AS g1, bal_labels[b + 1] AS g2, seg[c + 1] AS g3 FROM lab, won),
final AS (SELECT g1, g2, g3, count(*) >= {_k} AND count(DISTINCT c_custkey % 7) >= {_l} AS kept FROM gen GROUP BY g1, g2, g3)
{SUPPRESSED}, NOT kept AS suppressed FROM gen JOIN final USING (g1, g2, g3)""")(_limited_job(_limit, _k, _l))


@query("d27_chosen_levels", WINNER.format(cost="entropy"))
def chosen_levels(spark, sf):
    return find_optimum(
        table(spark, sf, "customer"), customer_hierarchies(spark, sf), objective="entropy").levels(spark)


# Loss metrics at a node with a lookup level, a grouped interval level and a raw attribute.
LEAVES = """, bal_leaves AS (SELECT g2, count(DISTINCT bal) AS l2 FROM gen GROUP BY g2),
bal_domain AS (SELECT count(DISTINCT bal) AS d2 FROM gen),
nat_leaves AS (SELECT r_name AS g1, count(*) AS l1 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
nat_domain AS (SELECT count(*) AS d1 FROM nation),
seg_domain AS (SELECT count(DISTINCT c_mktsegment) AS d3 FROM customer),
rows_ AS (SELECT marked.*, d1, d2, d3, CASE WHEN kept THEN l1 ELSE d1 END AS l1, CASE WHEN kept THEN l2 ELSE d2 END AS l2,
  CASE WHEN kept THEN 1 ELSE d3 END AS l3 FROM marked JOIN bal_leaves USING (g2) JOIN nat_leaves USING (g1),
  nat_domain, bal_domain, seg_domain)"""


@query("d17_ambiguity", AT_MIXED + LEAVES + " SELECT round(avg(l1::double * l2 * l3), 4) AS ambiguity FROM rows_")
def metric_ambiguity(spark, sf):
    return rounded(ambiguity(customers_at(spark, sf, MIXED)), 4)


@query("d18_average_class_size", AT_NODE + """ SELECT round(sum(size) FILTER (kept) / count(*) FILTER (kept), 6)
  AS average_class_size, round(sum(size) / (2.0 * count(*) FILTER (kept)), 6) AS c_avg FROM cls""")
def metric_class_size(spark, sf):
    return rounded(average_class_size(customers_at(spark, sf)))


@query("d19_discernibility", AT_NODE + """ SELECT CAST(sum(CASE WHEN kept THEN size * size
  ELSE size * (SELECT count(*) FROM customer) END) AS DOUBLE) AS discernibility FROM cls""")
def metric_discernibility(spark, sf):
    return discernibility(customers_at(spark, sf))


@query("d20_granularity", AT_MIXED + LEAVES + """
SELECT 'c_nationkey' AS attribute, round(1 - avg((l1 - 1) / (d1 - 1)::double), 6) AS granularity FROM rows_
UNION ALL SELECT 'c_acctbal', round(1 - avg((l2 - 1) / (d2 - 1)::double), 6) FROM rows_
UNION ALL SELECT 'c_mktsegment', round(1 - avg((l3 - 1) / (d3 - 1)::double), 6) FROM rows_""")
def metric_granularity(spark, sf):
    return rounded(granularity(customers_at(spark, sf, MIXED)))


ERRORS = """, errs AS (SELECT q, sum(CASE WHEN kept THEN n * v ELSE n * v + n * (m - mu) * (m - mu) END) AS sse,
  any_value(t) AS sst FROM (
  SELECT 'c_acctbal' AS q, kept, count(*) AS n, var_pop(bal) AS v, avg(bal) AS m,
    (SELECT avg(bal) FROM gen) AS mu, (SELECT count(*) * var_pop(bal) FROM gen) AS t FROM marked GROUP BY g1, g2, g3, kept
  UNION ALL SELECT 'c_nationkey', kept, count(*), var_pop(nat0::int), avg(nat0::int), (SELECT avg(nat0::int) FROM gen),
    (SELECT count(*) * var_pop(nat0::int) FROM gen) FROM marked GROUP BY g1, g2, g3, kept) GROUP BY q)"""


@query("d21_attribute_squared_error", AT_MIXED + ERRORS +
       " SELECT q AS attribute, round(1 - sse / sst, 6) AS squared_error FROM errs")
def metric_squared_error(spark, sf):
    return rounded(squared_error(customers_at(spark, sf, MIXED)).select("attribute", "squared_error"))


@query("d22_record_squared_error", AT_MIXED + ERRORS +
       " SELECT round(1 - avg(sse / sst), 6) AS record_squared_error FROM errs")
def metric_record_error(spark, sf):
    return rounded(record_squared_error(customers_at(spark, sf, MIXED)))


def _entropy_sql(attribute: str, own: str, label: str) -> str:
    return f"""SELECT '{attribute}' AS attribute, round(sum(CASE WHEN kept THEN log2(fl) - log2(fv)
  ELSE log2(n) - log2(fv) END) / sum(log2(n) - log2(fv)), 6) AS non_uniform_entropy FROM (SELECT kept,
  count(*) OVER (PARTITION BY {own}) AS fv, count(*) OVER (PARTITION BY {label}) AS fl, count(*) OVER () AS n FROM marked)"""


@query("d23_non_uniform_entropy", AT_MIXED + " " + " UNION ALL ".join([
    _entropy_sql("c_nationkey", "nat0", "g1"), _entropy_sql("c_acctbal", "bal0", "g2"),
    _entropy_sql("c_mktsegment", "seg0", "g3")]))
def metric_entropy(spark, sf):
    return rounded(non_uniform_entropy(customers_at(spark, sf, MIXED)).select("attribute", "non_uniform_entropy"))


@query("d24_generalisation_intensity", AT_MIXED + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, round(1 - avg(CASE WHEN kept THEN {level} / {height}.0 ELSE 1 END), 6) AS intensity FROM marked"
    for a, level, height in (("c_nationkey", 2, 3), ("c_acctbal", 2, 4), ("c_mktsegment", 0, 1))))
def metric_intensity(spark, sf):
    return rounded(generalisation_intensity(customers_at(spark, sf, MIXED)))


@query("d25_class_statistics", AT_NODE + """ SELECT count(*) AS classes, round(avg(size), 6) AS average_class_size
  FROM cls WHERE kept""")
def class_statistics(spark, sf):
    return rounded(customers_at(spark, sf).class_statistics())


@query("d26_suppression_statistics", AT_NODE + """ SELECT count(*) AS total_rows, count(*) FILTER (NOT kept) AS suppressed,
  round(count(*) FILTER (NOT kept) / count(*)::double, 6) AS suppressed_share,
  printf('%.2f%%', 100.0 * count(*) FILTER (NOT kept) / count(*)) AS suppressed_text FROM marked""")
def suppression_statistics(spark, sf):
    return rounded(customers_at(spark, sf).suppression())


@query("d28_anonymisation_job", NODES + f""", best AS (SELECT a, b, c FROM scored
  ORDER BY round(loss, 9), a + b + c, a, b, c LIMIT 1),
gen AS (SELECT c_custkey, c_name, nat[a + 1] AS g1, bal_labels[b + 1] AS g2, seg[c + 1] AS g3 FROM lab, best),
sized AS (SELECT *, count(*) OVER (PARTITION BY g1, g2, g3) >= 2 AS kept FROM gen) {SUPPRESSED} FROM sized""")
def anonymisation_job(spark, sf):
    out = anonymise(table(spark, sf, "customer"), ROLES, customer_hierarchies(spark, sf))
    path = write_anonymised(out.table(), scratch_path(spark, "anonymised"))
    return load_table(spark, path, ";", out.table().schema)[0]


def _entropy_of(q: int) -> str:
    return f"""SELECT sum(CASE WHEN kept THEN log2(fl) - log2(fv) ELSE log2(n) - log2(fv) END) / sum(log2(n) - log2(fv)) AS v
  FROM (SELECT kept, count(*) OVER (PARTITION BY v{q}) AS fv, count(*) OVER (PARTITION BY g{q}) AS fl, count(*) OVER () AS n FROM pos)"""


def _error_of(x: str) -> str:
    return f"""SELECT sum(CASE WHEN kept THEN n * v ELSE n * v + n * (m - mu) * (m - mu) END) / any_value(t) AS v FROM (
  SELECT kept, count(*) AS n, var_pop({x}) AS v, avg({x}) AS m, (SELECT avg({x}) FROM pos) AS mu,
    (SELECT count(*) * var_pop({x}) FROM pos) AS t FROM pos GROUP BY g1, g2, g3, kept)"""


# All metrics at the node (a, b, c) of ``best``.
ALL_METRICS = """, placed AS (SELECT c_custkey, bal, nat[1] AS v1, bal_labels[1] AS v2, seg[1] AS v3, nat[a + 1] AS g1,
  bal_labels[b + 1] AS g2, seg[c + 1] AS g3, a, b, c FROM lab, best),
groups AS (SELECT g1, g2, g3, count(*) AS size, count(*) >= 2 AS kept FROM placed GROUP BY g1, g2, g3),
pos AS (SELECT p.*, nat_key, size, kept, CASE WHEN kept THEN x1.leaves ELSE s1.domain END AS l1,
  CASE WHEN kept THEN x2.leaves ELSE s2.domain END AS l2, CASE WHEN kept THEN x3.leaves ELSE s3.domain END AS l3,
  s1.domain AS d1, s2.domain AS d2, s3.domain AS d3
  FROM (SELECT *, v1::int AS nat_key FROM placed) p JOIN groups USING (g1, g2, g3)
  JOIN leaves x1 ON x1.q = 1 AND x1.l = a AND x1.label = g1 JOIN leaves x2 ON x2.q = 2 AND x2.l = b AND x2.label = g2
  JOIN leaves x3 ON x3.q = 3 AND x3.l = c AND x3.label = g3
  JOIN sizes s1 ON s1.q = 1 JOIN sizes s2 ON s2.q = 2 JOIN sizes s3 ON s3.q = 3),
entropies AS (""" + " UNION ALL ".join(_entropy_of(q) for q in (1, 2, 3)) + """),
errors AS (""" + " UNION ALL ".join(_error_of(x) for x in ("nat_key", "bal")) + """),
metrics AS (SELECT 'ambiguity' AS metric, avg(l1::double * l2 * l3) AS value FROM pos
UNION ALL SELECT 'average_class_size', sum(size) FILTER (kept) / nullif(count(*) FILTER (kept), 0)::double FROM groups
UNION ALL SELECT 'c_avg', sum(size) / (2.0 * nullif(count(*) FILTER (kept), 0)) FROM groups
UNION ALL SELECT 'discernibility', sum(CASE WHEN kept THEN size * size ELSE size * (SELECT count(*) FROM pos) END)::double FROM groups
UNION ALL SELECT 'granularity', 1 - (avg((l1 - 1) / (d1 - 1)::double) + avg((l2 - 1) / (d2 - 1)::double)
  + avg((l3 - 1) / (d3 - 1)::double)) / 3 FROM pos
UNION ALL SELECT 'non_uniform_entropy', avg(v) FROM entropies
UNION ALL SELECT 'generalisation_intensity', 1 - (avg(CASE WHEN kept THEN a / 3.0 ELSE 1 END)
  + avg(CASE WHEN kept THEN b / 4.0 ELSE 1 END) + avg(CASE WHEN kept THEN c / 1.0 ELSE 1 END)) / 3 FROM pos
UNION ALL SELECT 'classes', count(*) FILTER (kept)::double FROM groups
UNION ALL SELECT 'suppressed', count(*) FILTER (NOT kept)::double FROM pos
UNION ALL SELECT 'suppressed_share', count(*) FILTER (NOT kept) / count(*)::double FROM pos
UNION ALL SELECT 'squared_error', 1 - avg(v) FROM errors UNION ALL SELECT 'record_squared_error', 1 - avg(v) FROM errors)"""
REPORTED = " SELECT metric, round(value::double, 4) AS value FROM metrics"


@query("d28_loss_report", NODES + ", best AS (SELECT 2 AS a, 2 AS b, 0 AS c)" + ALL_METRICS + REPORTED)
def job_metrics(spark, sf):
    """All metrics of the job in one table, at a fixed node."""
    return rounded(anonymise(table(spark, sf, "customer"), ROLES, customer_hierarchies(spark, sf), node=MIXED).metrics(), 4)


@query("d28_file_to_metrics", NODES + """, best AS (SELECT a, b, c FROM scored ORDER BY round(loss, 9), a + b + c, a, b, c LIMIT 1)"""
       + ALL_METRICS + """ SELECT 'metrics' AS step, metric, round(value::double, 4) AS value FROM metrics
UNION ALL SELECT 'levels', 'c_nationkey', a::double FROM best UNION ALL SELECT 'levels', 'c_acctbal', b::double FROM best
UNION ALL SELECT 'levels', 'c_mktsegment', c::double FROM best
UNION ALL SELECT 'table', 'rows', count(*)::double FROM pos UNION ALL SELECT 'table', 'rows_of_stars',
  count(*) FILTER (NOT kept OR (g1 = '*' AND g2 = '*' AND g3 = '*'))::double FROM pos""")
def file_to_metrics(spark, sf):
    """The whole job: a delimited file is read, the best node found, the table written, read back and counted, and every metric
    measured at that node."""
    source = write_table(table(spark, sf, "customer"), scratch_path(spark, "customer"), "csv", ";")
    customer = load_table(spark, source, ";")[0]
    target = scratch_path(spark, "anonymised")
    job = anonymise(customer, ROLES, customer_hierarchies(spark, sf), output=target)
    back = load_table(spark, target, ";", job.table().schema)[0]
    stars = F.col("c_nationkey").eqNullSafe("*") & F.col("c_acctbal").eqNullSafe("*") & F.col("c_mktsegment").eqNullSafe("*")
    counts = back.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(stars, 1)).alias("rows_of_stars"))
    parts = [job.metrics().select(F.lit("metrics").alias("step"), "metric", "value"),
             job.optimum.levels(spark).select(F.lit("levels").alias("step"), F.col("attribute").alias("metric"),
                                              F.col("level").cast("double").alias("value")),
             counts.select(F.lit("table").alias("step"), F.inline(F.array(*[
                 F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in counts.columns])))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)
