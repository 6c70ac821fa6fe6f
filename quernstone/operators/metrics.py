"""Classification metrics from one weighted confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(rows: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, truth, predicted, n): everything below starts from here."""
    n = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(*keys, "truth", "predicted").agg(n.cast("long").alias("n"))


def per_class(table: DataFrame, keys: list[str], labels: Sequence[str]) -> DataFrame:
    """Support, precision, recall and F1 of each label, 0 where undefined; labels without rows are there too."""
    grid = table.select(*keys).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    truth = table.groupBy(*keys, F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    guess = table.groupBy(*keys, F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    on = [*keys, "label"]
    whole = grid.join(truth, on, "left").join(guess, on, "left").na.fill(0, ["support", "hits", "guessed"])
    precision, recall = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("guessed")), F.lit(0.0))
    return whole.select(*on, "support", "hits", "guessed", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro(table: DataFrame, keys: list[str], labels: Sequence[str]) -> DataFrame:
    """Accuracy and macro averages; these divide by the fixed number of labels."""
    k = float(len(labels))
    each = per_class(table, keys, labels)
    return each.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        (F.sum("recall") / k).alias("balanced_accuracy"),
        (F.sum("precision") / k).alias("macro_precision"),
        (F.sum("f1") / k).alias("macro_f1"),
        F.sum("support").alias("rows"),
    )


def dominant_errors(table: DataFrame, keys: list[str], labels: Sequence[str]) -> DataFrame:
    """The most frequent wrong label for each true one; ties go to the earlier in ``labels``."""
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("predicted"))
    wrong = table.filter("truth <> predicted")
    return wrong.groupBy(*keys, "truth").agg(F.min_by("predicted", F.struct(-F.col("n"), order)).alias("dominant"), F.max("n").alias("dominant_n"), F.sum("n").alias("errors"))


def with_fractions(table: DataFrame, keys: list[str]) -> DataFrame:
    """Adds each cell's share of its true label."""
    return table.withColumn("row_fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "truth")))


def agreement(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Both right, only one right, both wrong, of two predictions in one row."""
    a, b = F.col(first) == F.col("truth"), F.col(second) == F.col("truth")
    return rows.groupBy(*keys).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"), F.count("*").alias("rows"))


def without_largest(rows: DataFrame, keys: list[str], group: str, steps: Sequence[int]) -> DataFrame:
    """Copies of ``rows`` without the 0, 1, 3, … largest groups; ties go to the smaller group."""
    sizes = rows.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), group))
    ranked = sizes.withColumn("_rank", rank).drop("_n")
    joined = rows.join(ranked, [*keys, group]).withColumn("removed", F.explode(F.array(*[F.lit(s) for s in steps])))
    return joined.filter(F.col("_rank") > F.col("removed")).drop("_rank")
