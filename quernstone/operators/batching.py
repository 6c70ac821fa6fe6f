"""Deterministic token batches: sequential packing under a padded budget."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(lengths: Iterable[int], budget: int) -> list[int]:
    """Batch numbers of ascending lengths: a batch grows while rows times its longest stay in the budget.

    A length over the budget is a batch of its own.
    """
    batch, rows, out = -1, 0, []
    for n in lengths:
        if batch < 0 or (rows + 1) * n > budget:
            batch, rows = batch + 1, 0
        rows += 1
        out.append(batch)
    return out


def token_batches(rows: DataFrame, length: str, identity: str, budget: int, shards: int = 1) -> DataFrame:
    """Adds ``shard`` and ``batch``. Rows are dealt by hash to ``shards`` folds, each packed in the order (length, id).

    The fold is sequential by definition; one shard is the plain result, more of them bound what a task holds.
    """
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64(identity), F.lit(shards)).cast("int"))
    schema = keyed.withColumn("batch", F.lit(0)).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, identity], kind="stable")
        return pdf.assign(batch=pack(pdf[length].tolist(), budget))

    return keyed.groupBy("shard").applyInPandas(fold, schema)


def batching_statistics(batched: DataFrame, length: str) -> DataFrame:
    """Batches, largest and mean rows, and the share of padded cells that hold tokens, as one row."""
    per = batched.groupBy("shard", "batch").agg(F.count("*").alias("rows"), F.max(length).alias("longest"), F.sum(length).alias("tokens"))
    return per.agg(F.count("*").alias("batches"), F.max("rows").alias("most"), F.avg("rows").alias("mean"), F.try_divide(F.sum("tokens"), F.sum(F.col("rows") * F.col("longest"))).alias("efficiency"))
