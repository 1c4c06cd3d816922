"""What generalisation and suppression cost.

Notation: n rows; a row's class has ``size`` rows; ``leaves`` is the number of ground values below a label and
``domain`` their number below the top; suppressed rows count as fully generalised. Everything is computed from the
frequency table and the class table, not from the base rows.

* ambiguity: mean over rows of the product of leaves over the quasi-identifiers (Goldberger and Tassa 2010)
* average class size n_kept/classes and C_avg = n/(classes·k) (LeFevre et al. 2006)
* discernibility: Σ size² over kept classes + n·suppressed (Bayardo and Agrawal 2005)
* granularity: 1 - mean of (leaves-1)/(domain-1) (Iyengar 2002)
* squared error: 1 - SSE/SST per numeric attribute, a class stands for its mean and a suppressed row for the overall
  mean (Domingo-Ferrer and Mateo-Sanz 2002); record level: the same over z-scored attributes together
* non-uniform entropy: Σ -log2(freq(value)/freq(label)), divided by its value at the top; 0 = nothing lost
  (Gionis and Tassa 2009)
* generalisation intensity ("precision"): 1 - mean of level/height (Sweeney 2002)
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_number, col, field_type
from ..functions.joins import lookup
from ..functions.staging import stage
from .anonymity import Anonymised, KAnonymity, generalised, with_generalised
from .hierarchy import TOP, Hierarchy, label_column


def ground_values(frequency: DataFrame, hierarchies: Sequence[Hierarchy]) -> DataFrame:
    """``(attribute, labels, _n)``: every ground value once, with its labels and its rows (0 if only listed)."""
    parts = F.array(*[
        F.struct(F.lit(h.attribute).alias("attribute"), col(label_column(h.attribute)).alias("labels"))
        for h in hierarchies
    ])
    seen = frequency.select(F.explode(parts).alias("p"), "_n").select("p.attribute", "p.labels", "_n")
    for h in hierarchies:
        listed = h.listed(frequency.sparkSession)
        if listed is None:
            continue
        labels = h.attach(listed.select(F.col("value").alias(h.attribute)))
        seen = seen.unionByName(labels.select(
            F.lit(h.attribute).alias("attribute"), col(label_column(h.attribute)).alias("labels"),
            F.lit(0).cast("bigint").alias("_n"),
        ))
    return seen.groupBy("attribute", "labels").agg(F.sum("_n").alias("_n"))


def label_weights(values: DataFrame, hierarchies: Sequence[Hierarchy]) -> DataFrame:
    """``(attribute, level, label, leaves, rows, domain, total)``. A ``*`` stands for the whole domain."""
    exploded = values.select("attribute", "_n", F.posexplode("labels").alias("level", "label"))
    counted = exploded.groupBy("attribute", "level", "label").agg(
        F.count(F.lit(1)).alias("leaves"), F.sum("_n").alias("rows")
    )
    totals = values.groupBy("attribute").agg(F.count(F.lit(1)).alias("domain"), F.sum("_n").alias("total"))
    out = lookup(counted, totals, ["attribute"], ["domain", "total"])
    whole = (F.col("label") == TOP) & (F.col("level") > 0)
    return out.select(
        "attribute", "level", "label",
        F.when(whole, F.col("domain")).otherwise(F.col("leaves")).alias("leaves"),
        F.when(whole, F.col("total")).otherwise(F.col("rows")).alias("rows"),
        "domain", "total",
    )


def _node_weights(a: Anonymised) -> DataFrame:
    level = reduce(
        lambda out, h: F.when(F.col("attribute") == h.attribute, F.lit(a.node[h.attribute])).otherwise(out),
        a.hierarchies, F.lit(-1),
    )
    # Staged: domain sizes, leaves and entropies all read it, and small sides of joins are seen to be small.
    return stage(label_weights(ground_values(a.frequency, a.hierarchies), a.hierarchies).where(F.col("level") == level),
                 "weights")


def _domain_sizes(weights: DataFrame) -> dict[str, int]:
    return {r["attribute"]: r["domain"] for r in weights.groupBy("attribute").agg(F.max("domain").alias("domain"))
            .collect()}  # one row per quasi-identifier


def classes_with_leaves(a: Anonymised, weights: DataFrame | None = None) -> DataFrame:
    """The class table with ``_leaves_{attribute}`` and ``_domain_{attribute}``; suppressed classes get the domain."""
    weights = weights if weights is not None else _node_weights(a)
    sizes = _domain_sizes(weights)
    out = a.classes
    for h in a.hierarchies:
        name, key = h.attribute, generalised(h.attribute)
        domain = F.lit(sizes.get(name, 1)).cast("double")
        if a.node[name] == 0:
            leaves: Column = F.lit(1.0)
        elif a.node[name] == h.height:
            leaves = domain
        else:
            own = weights.where(F.col("attribute") == name).select(
                F.col("label").alias(key), F.col("leaves").cast("double").alias(f"_l_{name}")
            )
            out = lookup(out, own, [key], [f"_l_{name}"])
            leaves = col(f"_l_{name}")
        out = out.withColumn(f"_leaves_{name}", F.when(F.col("kept"), leaves).otherwise(domain))
        out = out.withColumn(f"_domain_{name}", domain)
    return out


def _k(a: Anonymised) -> int:
    return max([m.k for m in a.models if isinstance(m, KAnonymity)], default=1)


def ambiguity(a: Anonymised, leaves: DataFrame | None = None) -> DataFrame:
    leaves = leaves if leaves is not None else classes_with_leaves(a)
    product = reduce(lambda x, y: x * y, [col(f"_leaves_{q}") for q in a.quasi])
    return leaves.agg((F.sum(F.col("size") * product) / F.sum("size")).alias("ambiguity"))


def average_class_size(a: Anonymised) -> DataFrame:
    kept = F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0))
    classes = F.sum(F.when(F.col("kept"), 1).otherwise(0))
    return a.classes.agg(
        F.try_divide(kept, classes).alias("average_class_size"),
        F.try_divide(F.sum("size"), classes * F.lit(_k(a))).alias("c_avg"),
    )


def discernibility(a: Anonymised) -> DataFrame:
    size = F.col("size").cast("double")
    kept = F.sum(F.when(F.col("kept"), size * size).otherwise(F.lit(0.0)))
    lost = F.sum(F.when(~F.col("kept"), size).otherwise(F.lit(0.0)))
    return a.classes.agg((kept + F.sum(size) * lost).alias("discernibility"))


def granularity(a: Anonymised, leaves: DataFrame | None = None) -> DataFrame:
    """``(attribute, granularity)``; ``loss_report`` takes the mean over the attributes."""
    leaves = leaves if leaves is not None else classes_with_leaves(a)
    parts = [
        F.struct(
            F.lit(q).alias("attribute"),
            F.coalesce(F.try_divide(col(f"_leaves_{q}") - 1, col(f"_domain_{q}") - 1), F.lit(0.0)).alias("share"),
        )
        for q in a.quasi
    ]
    long = leaves.select("size", F.inline(F.array(*parts)))
    return long.groupBy("attribute").agg(
        (F.lit(1.0) - F.sum(F.col("size") * F.col("share")) / F.sum("size")).alias("granularity")
    )


def numeric_quasi(a: Anonymised) -> list[str]:
    return [q for q in a.quasi if isinstance(field_type(a.source, q), T.NumericType)]


def squared_error(a: Anonymised, columns: Sequence[str] | None = None) -> DataFrame:
    """``(attribute, sse, sst, squared_error)`` per numeric quasi-identifier.

    Values are centred on the overall mean first, so that sums of squares lose no digits; per class only three sums
    per attribute are needed and they combine map-side.
    """
    names = list(columns) if columns is not None else numeric_quasi(a)
    if not names:
        raise ValueError("no numeric quasi-identifier")
    freq = a.frequency
    x = {q: as_number(freq, q) for q in names}
    means = freq.agg(*[
        F.try_divide(F.sum(x[q] * F.col("_n")), F.sum(F.when(x[q].isNotNull(), F.col("_n")))).alias(f"m{i}")
        for i, q in enumerate(names)
    ]).first()
    centred = freq
    for i, q in enumerate(names):
        centred = centred.withColumn(f"_x{i}", x[q] - F.lit(means[f"m{i}"]))
    cells = with_generalised(centred, a.hierarchies, a.node)
    sums = []
    for i in range(len(names)):
        sums += [
            F.sum(F.when(F.col(f"_x{i}").isNotNull(), F.col("_n")).otherwise(0)).alias(f"_n{i}"),
            F.sum(F.col(f"_x{i}") * F.col("_n")).alias(f"_s{i}"),
            F.sum(F.col(f"_x{i}") * F.col(f"_x{i}") * F.col("_n")).alias(f"_q{i}"),
        ]
    per_class = cells.groupBy(*[col(k) for k in a.keys]).agg(*sums)
    per_class = lookup(per_class, a.classes, a.keys, ["kept"])  # sums only: no column of the table is left
    parts = []
    for i, q in enumerate(names):
        inside = F.coalesce(
            F.greatest(F.lit(0.0), F.col(f"_q{i}") - F.try_divide(F.col(f"_s{i}") * F.col(f"_s{i}"), F.col(f"_n{i}"))),
            F.lit(0.0),
        )
        parts.append(F.struct(
            F.lit(q).alias("attribute"),
            F.when(F.col("kept"), inside).otherwise(F.coalesce(F.col(f"_q{i}"), F.lit(0.0))).alias("e"),
            F.coalesce(F.col(f"_q{i}"), F.lit(0.0)).alias("t"),
        ))
    return per_class.select(F.inline(F.array(*parts))).groupBy("attribute").agg(
        F.sum("e").alias("sse"), F.sum("t").alias("sst"),
        (F.lit(1.0) - F.try_divide(F.sum("e"), F.sum("t"))).alias("squared_error"),
    )


def record_squared_error(a: Anonymised, columns: Sequence[str] | None = None) -> DataFrame:
    """One number over all numeric quasi-identifiers after z-scoring: 1 - mean of SSE/SST. Constant ones are left out."""
    per_attribute = squared_error(a, columns).where(F.col("sst") > 0)
    return per_attribute.agg((F.lit(1.0) - F.avg(F.col("sse") / F.col("sst"))).alias("record_squared_error"))


def non_uniform_entropy(a: Anonymised, weights: DataFrame | None = None) -> DataFrame:
    """``(attribute, bits_lost, bits_at_top, non_uniform_entropy)``."""
    weights = weights if weights is not None else _node_weights(a)
    cells = with_generalised(a.frequency, a.hierarchies, a.node)
    verdicts = a.classes.select(*[col(k) for k in a.keys], F.col("kept").alias("_kept"))
    cells = lookup(cells, verdicts, a.keys, ["_kept"])
    parts = F.array(*[
        F.struct(F.lit(h.attribute).alias("attribute"), h.label(0).alias("value"),
                 col(generalised(h.attribute)).alias("label"))
        for h in a.hierarchies
    ])
    lost = F.when(~F.col("_kept"), F.col("_n")).otherwise(0)
    values = cells.select(F.col("_n"), lost.alias("lost"), F.inline(parts)).groupBy("attribute", "value", "label").agg(
        F.sum("_n").alias("_n"), F.sum("lost").alias("lost")
    )
    values = lookup(values, weights, ["attribute", "label"], ["rows", "total"])
    own = F.log2(F.col("_n").cast("double"))
    top = F.log2(F.col("total").cast("double")) - own
    here = F.log2(F.col("rows").cast("double")) - own
    return values.groupBy("attribute").agg(
        F.sum((F.col("_n") - F.col("lost")) * here + F.col("lost") * top).alias("bits_lost"),
        F.sum(F.col("_n") * top).alias("bits_at_top"),
    ).withColumn(
        "non_uniform_entropy", F.coalesce(F.try_divide(F.col("bits_lost"), F.col("bits_at_top")), F.lit(0.0))
    )


def generalisation_intensity(a: Anonymised) -> DataFrame:
    """``(attribute, intensity)``: 1 - mean level/height; a suppressed row counts as full height."""
    parts = [
        F.struct(F.lit(h.attribute).alias("attribute"), F.lit(a.node[h.attribute] / h.height).alias("share"))
        for h in a.hierarchies
    ]
    totals = a.classes.agg(
        F.sum("size").alias("_n"), F.sum(F.when(~F.col("kept"), F.col("size")).otherwise(0)).alias("lost")
    )
    return totals.select("_n", "lost", F.inline(F.array(*parts))).select(
        "attribute",
        (F.lit(1.0) - ((F.col("_n") - F.col("lost")) * F.col("share") + F.col("lost")) / F.col("_n")).alias("intensity"),
    )


def attribute_report(a: Anonymised) -> DataFrame:
    """Per quasi-identifier: granularity, non-uniform entropy, intensity and, for numbers, squared error."""
    weights = _node_weights(a)
    out = generalisation_intensity(a)
    out = lookup(out, granularity(a, classes_with_leaves(a, weights)), ["attribute"], ["granularity"])
    out = lookup(out, non_uniform_entropy(a, weights), ["attribute"], ["non_uniform_entropy"])
    if numeric_quasi(a):
        return lookup(out, squared_error(a), ["attribute"], ["squared_error"])
    return out.withColumn("squared_error", F.lit(None).cast("double"))


def loss_report(a: Anonymised) -> DataFrame:
    """All metrics as ``(metric, value)`` rows: quality, class statistics and suppression."""
    weights = _node_weights(a)
    leaves = stage(classes_with_leaves(a, weights), "leaves")

    def rows(df: DataFrame, **names: str) -> DataFrame:
        parts = [F.struct(F.lit(m).alias("metric"), col(c).cast("double").alias("value")) for m, c in names.items()]
        return df.select(F.inline(F.array(*parts)))

    pieces = [
        rows(ambiguity(a, leaves), ambiguity="ambiguity"),
        rows(average_class_size(a), average_class_size="average_class_size", c_avg="c_avg"),
        rows(discernibility(a), discernibility="discernibility"),
        rows(granularity(a, leaves).agg(F.avg("granularity").alias("v")), granularity="v"),
        rows(non_uniform_entropy(a, weights).agg(F.avg("non_uniform_entropy").alias("v")), non_uniform_entropy="v"),
        rows(generalisation_intensity(a).agg(F.avg("intensity").alias("v")), generalisation_intensity="v"),
        rows(a.class_statistics(), classes="classes"),
        rows(a.suppression(), suppressed="suppressed", suppressed_share="suppressed_share"),
    ]
    if numeric_quasi(a):
        errors = squared_error(a)
        pieces.append(rows(errors.agg(F.avg("squared_error").alias("v")), squared_error="v"))
        pieces.append(rows(record_squared_error(a), record_squared_error="record_squared_error"))
    return reduce(DataFrame.unionByName, pieces)
