"""Places of rows and running sums in one order, without a task that sees a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import stage


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their place (from 0) among the rows of their ``keys`` in ``order``; equal rows get places in some order.

    Rows are dealt to ranges of (keys, order) and numbered inside each range. Where a key goes on in the next range, that range's numbers
    begin with the counts before it, of which there is one for each key and range.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id())
    inside = stage(dealt.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ranks")
    counts = inside.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    # a row for each key and range
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n"))
    a, b = inside.alias("a"), first.select("_range", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_low", "_first").alias("b")
    same = F.col("a._range") == F.col("b._range")
    for i, k in enumerate(keys):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b._k{i}"))
    return a.join(b, same).select(*[F.col(f"a.`{c}`") for c in rows.columns], (F.col("_first") + F.col("a._id") - F.col("b._low")).alias(name))


def running(rows: DataFrame, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in ``order``; equal rows are summed in some order.

    As in ``ranked``, sums run inside ranges, and each range begins with the total of those before it.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
    inside = stage(dealt.withColumn("_id", F.monotonically_increasing_id()), "running")
    # a row for each range
    totals = inside.groupBy("_range").agg(F.sum(value).alias("_t"))
    before = totals.select("_range", (F.sum("_t").over(Window.orderBy("_range")) - F.col("_t")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_range").orderBy("_id"))
    return inside.withColumn("_own", own).join(before, "_range").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_own") + F.col("_before")).alias(name))
