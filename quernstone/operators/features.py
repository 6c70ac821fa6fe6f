"""Sequence features, scaling, and linear models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.records import ALPHABET, once


def composition(sequence: Column, alphabet: str = ALPHABET) -> Column:
    """Relative frequency of each residue, in the alphabet's order; null for an empty sequence."""
    def shares(seq: Column) -> Column:
        return F.when(F.length(seq) > 0, F.array(*[(F.length(seq) - F.length(F.replace(seq, F.lit(a), F.lit("")))) / F.length(seq) for a in alphabet]))

    return once(sequence, shares)


def kmer_counts(rows: DataFrame, keys: list[str], sequence: str, k: int = 3) -> DataFrame:
    """(keys, kmer, n) over all overlapping windows; sequences shorter than ``k`` have none."""
    long = rows.filter(F.length(sequence) >= k)
    windows = F.regexp_extract_all(sequence, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))  # one pass, unlike a substring for each place
    return long.select(*keys, F.explode(windows).alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))


def kmer_frequencies(counts: DataFrame, keys: list[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    return counts.join(totals, keys).select(*keys, "kmer", "n", (F.col("n") / F.col("_n")).alias("frequency"))


def scaler(rows: DataFrame, vector: str) -> DataFrame:
    """(position, mean, scale): population standard deviation, 1 where it is zero."""
    each = rows.select(F.posexplode(F.col(vector).cast("array<double>")).alias("position", "x"))
    found = each.groupBy("position").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"))
    return found.select("position", "mean", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("scale"))


def scaled(rows: DataFrame, vector: str, fitted: DataFrame) -> DataFrame:
    """Applies ``scaler``; its table has one row for each component."""
    whole = fitted.agg(F.array_sort(F.collect_list(F.struct("position", "mean", "scale"))).alias("_s"))
    value = F.zip_with(F.col(vector).cast("array<double>"), "_s", lambda x, s: (x - s["mean"]) / s["scale"])
    return rows.join(F.broadcast(whole)).withColumn(vector, value).drop("_s")  # one row


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; null where there is none."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t)), lambda t: t.isNotNull())
    zero = F.transform(F.get(kept, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def balanced_logistic(train: DataFrame, vector: str, label: str, labels: Sequence[str], c: float = 1.0, most: int = 5000):
    """Multinomial logistic regression with balanced class weights and an L2 penalty 1/C on the whole loss."""
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    n = train.count()
    weighted = train.join(F.broadcast(counts), label).withColumn("_w", F.lit(float(n)) / (F.lit(float(len(labels))) * F.col("_n")))  # a row for each label
    ready = weighted.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), index.cast("double").alias("label"), F.col("_w").alias("weight"))
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=most, tol=1e-6)
    return model.fit(ready)


def predicted(model, rows: DataFrame, vector: str, labels: Sequence[str]) -> DataFrame:
    """Adds ``predicted`` and ``scores`` in the order of ``labels``."""
    ready = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    done = model.transform(ready).withColumn("scores", vector_to_array("probability"))
    name = F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int"))
    return done.withColumn("predicted", name).drop("features", "rawPrediction", "probability", "prediction")


#: Fixed ids of the start and end tokens; residues follow from 4 on in the order of the alphabet.
START, END, FIRST = 0, 2, 4


def residue_tokens(sequence: Column) -> Column:
    """One id a residue between the start and the end token; a letter outside the alphabet is an error."""
    def token(x: Column) -> Column:
        at = F.position(x, F.lit(ALPHABET))
        return F.when(at > 0, at - 1 + FIRST).otherwise(F.raise_error(F.concat(F.lit("not a residue: "), x)))

    letters = F.filter(F.split(sequence, ""), lambda x: x != "")
    return F.concat(F.array(F.lit(START)), F.transform(letters, token), F.array(F.lit(END)))
