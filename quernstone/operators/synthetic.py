"""A synthetic cohort of labelled sequences in pairs of near relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.records import ALPHABET

LABELS = ("1.1", "2.1", "3.1")


def _residues(token: Column, length: int) -> Column:
    """``length`` residues from the digests of the token and a counter."""
    blocks = -(-length // 32)
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.sha2(F.concat_ws("\n", token, k.cast("string")).cast("binary"), 256)), "")
    def letter(i: Column) -> Column:
        byte = F.conv(F.substr(hexes, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        return F.substr(F.lit(ALPHABET), byte % len(ALPHABET) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), letter), "")


def cohort(spark: SparkSession, components: int = 15, length: int = 120) -> DataFrame:
    """(accession, label, component, member, sequence): the second member differs at every tenth place."""
    base = spark.range(len(LABELS) * components).select((F.col("id") % len(LABELS)).cast("int").alias("l"), F.floor(F.col("id") / len(LABELS)).cast("int").alias("c"))
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), F.col("l"))
    named = base.select(label.alias("label"), F.concat_ws("-", F.lit("component"), "l", "c").alias("component"))
    first = named.withColumn("sequence", _residues(F.concat_ws("\n", "label", "component"), length)).withColumn("member", F.lit(1))
    def moved(c: Column, i: Column) -> Column:
        return F.when(i % 10 == 0, F.substr(F.lit(ALPHABET), F.position(c, F.lit(ALPHABET)) % len(ALPHABET) + 1, F.lit(1))).otherwise(c)
    changed = F.array_join(F.transform(F.split("sequence", ""), moved), "")
    both = first.unionByName(first.withColumn("sequence", changed).withColumn("member", F.lit(2)))
    return both.select(F.concat_ws("-", "component", "member").alias("accession"), "label", "component", "member", "sequence", F.sha2(F.col("sequence").cast("binary"), 256).alias("sequence_sha256"))
