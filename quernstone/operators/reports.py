"""Gated report tables over one star of predictions (split, method, component, truth, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.records import eligibility, public_count, reportable
from quernstone.operators import bootstrap, metrics
from quernstone.session import stage

METRICS = ("accuracy", "balanced_accuracy", "macro_f1")
#: From best to worst.
STATUSES = ("reportable", "insufficient_components_for_ci", "insufficient_sequences", "privacy_suppressed")


def status_order(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def least_status(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The worst status of each family."""
    return rows.groupBy(*keys).agg(F.max_by(status, status_order(F.col(status))).alias(status))


def gated(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(keys, status, rows, groups): what may be shown of each cell, with small counts hidden."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(group).alias("_c"))
    per = per.withColumn("status", eligibility(F.col("_n"), F.col("_c")))
    private = F.col("status") == "privacy_suppressed"
    return per.select(*keys, "status", public_count(F.col("_n"), 5, private).alias("rows"), public_count(F.col("_c"), 3, private).alias("groups"))


def _long(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))


def summary(rows: DataFrame, keys: list[str], group: str, labels: Sequence[str], domain: str, iterations: int = 2000, seed: int = 2026) -> DataFrame:
    """Each cell's metrics: points where rows suffice, intervals where groups suffice too."""
    cells = gated(rows, keys, group)
    points = _long(metrics.macro(metrics.confusion(rows, keys), keys, labels), keys)
    draws = bootstrap.draw_table(rows, keys, group, domain, iterations, seed)
    bounds = bootstrap.intervals(bootstrap.replicates(rows, draws, keys, group, labels), keys, METRICS)
    joined = cells.join(points, keys).join(bounds, [*keys, "metric"], "left")
    full = F.col("status") == "reportable"
    return joined.select(*keys, "metric", "status", "rows", "groups", reportable(F.col("status"), F.col("value")).alias("value"), F.when(full, F.col("lower")).alias("lower"), F.when(full, F.col("upper")).alias("upper"))


def stratified(rows: DataFrame, keys: list[str], stratum: str, bins: Sequence[str], group: str, labels: Sequence[str]) -> DataFrame:
    """Every bin of every cell, empty ones included, with gated points."""
    grid = rows.select(*keys).distinct().withColumn(stratum, F.explode(F.array(*[F.lit(b) for b in bins])))
    on = [*keys, stratum]
    points = metrics.macro(metrics.confusion(rows, on), on, labels).drop("rows")
    joined = grid.join(gated(rows, on, group), on, "left").join(points, on, "left")
    status = F.coalesce("status", F.lit("privacy_suppressed"))
    shown = [reportable(status, F.col(m)).alias(m) for m in METRICS]
    return joined.select(*on, status.alias("status"), F.coalesce("rows", F.lit("<5")).alias("rows"), F.coalesce("groups", F.lit("<3")).alias("groups"), *shown)


def class_errors(rows: DataFrame, keys: list[str], group: str, labels: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 over the whole cell, gated by the rows of the true class, and the dominant error."""
    table = metrics.confusion(rows, keys)
    each = metrics.per_class(table, keys, labels).withColumnRenamed("label", "truth")
    wrong = metrics.dominant_errors(table, keys, labels)
    on = [*keys, "truth"]
    joined = each.join(gated(rows, on, group), on, "left").join(wrong, on, "left")
    status = F.coalesce("status", F.lit("privacy_suppressed"))
    return joined.select(*on, status.alias("status"), *[reportable(status, F.col(c)).alias(c) for c in ("precision", "recall", "f1", "dominant")])


def comparisons(rows: DataFrame, keys: list[str], pairs: Sequence[tuple[str, str]], group: str, labels: Sequence[str], domain: str, iterations: int = 2000, seed: int = 2026) -> DataFrame:
    """Paired differences of methods: both see the same draw of a cell's groups."""
    draws = bootstrap.draw_table(rows, keys, group, domain, iterations, seed)
    values = bootstrap.replicates(rows, draws, keys, group, labels, ["method"])
    points = metrics.macro(metrics.confusion(rows, [*keys, "method"]), [*keys, "method"], labels).withColumn("iteration", F.lit(-1))
    out = None
    for first, second in pairs:
        bounds = bootstrap.intervals(bootstrap.differences(values, keys, "method", first, second, METRICS), keys, METRICS)
        point = _long(bootstrap.differences(points, keys, "method", first, second, METRICS), keys).withColumnRenamed("value", "difference")
        both = point.join(bounds, [*keys, "metric"]).withColumn("first", F.lit(first)).withColumn("second", F.lit(second))
        out = both if out is None else out.unionByName(both)
    return out


def seed_shifts(summaries: DataFrame, keys: list[str], primary: int) -> DataFrame:
    """Largest shift of lower and upper bounds and of widths between the primary seed and the others."""
    base = summaries.filter(F.col("seed") == primary).select(*keys, F.col("lower").alias("_l"), F.col("upper").alias("_u"))
    other = summaries.filter(F.col("seed") != primary).join(base, keys)
    shifts = [F.round(F.max(F.abs(x)), 15).alias(n) for n, x in (("lower_shift", F.col("lower") - F.col("_l")), ("upper_shift", F.col("upper") - F.col("_u")), ("width_shift", F.col("upper") - F.col("lower") - F.col("_u") + F.col("_l")))]
    return other.groupBy(*keys).agg(*shifts)


def every_dimension(rows: DataFrame, keys: list[str], dimensions: dict[str, tuple[Column, Sequence[str]]], group: str, labels: Sequence[str]) -> DataFrame:
    """``stratified`` over several dimensions from one cube: (keys, dimension, bin, status, rows, groups, metrics).

    Each row counts once in every dimension, in the bin that its column names. The rows are aggregated once, to counts by bin, group
    and cell of the confusion table; all tables come from these counts.
    """
    entries = F.array(*[F.struct(F.lit(name).alias("dimension"), column.alias("bin")) for name, (column, _) in dimensions.items()])
    on = [*keys, "dimension", "bin"]
    cube = stage(rows.select(*keys, F.col(group).alias("_g"), "truth", "predicted", F.inline(entries)).groupBy(*on, "_g", "truth", "predicted").agg(F.count("*").alias("n")), "cube")
    bins = F.array(*[F.struct(F.lit(name).alias("dimension"), F.lit(b).alias("bin")) for name, (_, all_) in dimensions.items() for b in all_])
    grid = cube.select(*keys).distinct().select(*keys, F.inline(bins))
    per = cube.groupBy(*on).agg(F.sum("n").alias("_n"), F.count_distinct("_g").alias("_c")).withColumn("status", eligibility(F.col("_n"), F.col("_c")))
    points = metrics.macro(metrics.confusion(cube, on, "n"), on, labels).drop("rows")
    joined = grid.join(per, on, "left").join(points, on, "left")
    status = F.coalesce("status", F.lit("privacy_suppressed"))
    private = status == "privacy_suppressed"
    shown = [reportable(status, F.col(m)).alias(m) for m in METRICS]
    counts = [public_count(F.coalesce("_n", F.lit(0)), 5, private).alias("rows"), public_count(F.coalesce("_c", F.lit(0)), 3, private).alias("groups")]
    return joined.select(*on, status.alias("status"), *counts, *shown)
