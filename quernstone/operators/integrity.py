"""Checks between tables: references, equal sets, aligned inventories, invariants of rows, numeric replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def references(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """How many rows there are, and how many name a key that ``nodes`` has or hasn't, as one row."""
    known = nodes.select(key).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, key, "left").agg(F.count("*").alias("rows"), F.count("_known").alias("known"), F.count_if(F.col("_known").isNull()).alias("unknown"))


def resolved(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``nodes``; a key that ``nodes`` hasn't is an error when the rows are read."""
    joined = rows.join(nodes.withColumn("_known", F.lit(True)), key, "left")
    wrong = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(wrong)).drop("_known")


def with_group_size(rows: DataFrame, group: str, name: str = "component_size") -> DataFrame:
    """Adds how many rows share the row's group: an aggregation and a join, so a large group needs no single task."""
    return rows.join(rows.groupBy(group).agg(F.count("*").alias(name)), group)


def with_group_sizes(rows: DataFrame, groups: list[str], name: str) -> DataFrame:
    """As ``with_group_size``, for groups of several columns."""
    return rows.join(rows.groupBy(*groups).agg(F.count("*").alias(name)), groups)


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column], identity: str) -> DataFrame:
    """For each ``keys``: rows, rows whose identity came before, and how many rows break each rule."""
    per = rows.groupBy(*keys, identity).agg(F.count("*").alias("_n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    sums = [F.sum(name).alias(name) for name in rules]
    return per.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("repeated"), *sums)


def alignment(rows: DataFrame, keys: list[str], columns: list[str], method: str) -> DataFrame:
    """For each ``keys``: how many distinct entries there are, and how many every method describes alike."""
    methods = rows.groupBy(*keys).agg(F.count_distinct(method).alias("_all"))
    per = rows.groupBy(*keys, *columns).agg(F.count_distinct(method).alias("_k")).join(methods, keys)
    return per.groupBy(*keys).agg(F.count("*").alias("entries"), F.count_if(F.col("_k") == F.col("_all")).alias("aligned"))


def grid(columns: dict[str, Sequence[str]], like: DataFrame) -> DataFrame:
    """Every combination of the given values in their order, numbered from 0: a plan's cells."""
    out = like.sparkSession.range(1).select(F.lit(0).cast("long").alias("cell"))
    for name, values in columns.items():
        each = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_at", name)
        out = out.select("*", each).withColumn("cell", F.col("cell") * len(values) + F.col("_at")).drop("_at")
    return out


def within(first: DataFrame, second: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """(keys, both values, within): whether values of two tables agree; a row in one table only doesn't."""
    both = first.select(*keys, F.col(value).alias("first")).join(second.select(*keys, F.col(value).alias("second")), keys, "full")
    return both.withColumn("within", F.coalesce(F.abs(F.col("first") - F.col("second")) <= most, F.lit(False)))


def numeric_replay(first: DataFrame, second: DataFrame, key: str, vector: str, relative: float = 1e-5, absolute: float = 1e-6) -> DataFrame:
    """How far two matrices are apart, as one row: cells, cells in one only, largest differences, cells out of tolerance."""
    a, b = (x.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("at", name)) for x, name in ((first, "a"), (second, "b")))
    off = F.abs(F.col("a") - F.col("b"))
    return a.join(b, [key, "at"], "full").agg(
        F.count("*").alias("cells"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("single"), F.max(off).alias("max_abs"),
        F.max(F.try_divide(off, F.abs("b"))).alias("max_rel"), F.count_if(off > absolute + relative * F.abs("b")).alias("outside"))


def exposed(rows: DataFrame, status: str, values: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """A public table's faults as one row: rows that may show no value but do, and columns that aren't allowed."""
    shows = F.lit(False)
    for v in values:
        shows = shows | F.col(v).isNotNull()
    hidden = ~F.col(status).isin("reportable", "insufficient_components_for_ci")
    return rows.agg(F.count("*").alias("rows"), F.count_if(hidden).alias("hidden"), F.count_if(hidden & shows).alias("exposed"), F.lit(len(set(rows.columns) - set(allowed))).cast("long").alias("forbidden_columns"))
