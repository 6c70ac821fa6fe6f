"""Bootstrap over whole groups, with draws that depend on nothing but seed and domain.

One generator makes all draws of a cell, but many tasks run it: the stream of 32-bit words is cut into blocks, and a task jumps
ahead to its block. Which words are rejected depends on the words alone, so a first pass counts the accepted words of each
block and running sums say which draw a block begins with. The draws are those of the sequential generator, bit by bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from quernstone.operators.metrics import confusion, macro
from quernstone.operators.ranks import ranked
from quernstone.session import share_code, stage


def entropy(domain: str) -> tuple[int, ...]:
    """The first four big-endian words of the domain's SHA-256."""
    return tuple(int(x) for x in np.frombuffer(hashlib.sha256(domain.encode()).digest()[:16], ">u4"))


def group_draws(groups: int, iterations: int, seed: int, domain: str) -> np.ndarray:
    """Indices of drawn groups, a row for each iteration."""
    rng = np.random.default_rng(np.random.SeedSequence((seed, *entropy(domain))))
    return np.stack([rng.integers(0, groups, size=groups, dtype=np.int64) for _ in range(iterations)])


#: Words of a block.
WORDS = 1 << 20


def words_of(block: int, seed: int, domain: str, words: int = WORDS) -> np.ndarray:
    """The generator's 32-bit words of one block: each 64-bit output gives its lower half first."""
    generator = np.random.PCG64(np.random.SeedSequence((seed, *entropy(domain))))
    generator.advance(block * (words // 2))
    return generator.random_raw(words // 2).astype("<u8").view("<u4")


def accepted(words: np.ndarray, groups: int) -> np.ndarray:
    """The draws from 0 to ``groups`` - 1 that these words give: upper halves of products, without those that would favour some."""
    products = words.astype(np.uint64) * np.uint64(groups)
    fair = (products & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % groups)
    return (products[fair] >> np.uint64(32)).astype(np.int64)


def draw_table(rows: DataFrame, keys: list[str], group: str, domain: str, iterations: int = 2000, seed: int = 2026, words: int = WORDS) -> DataFrame:
    """(keys, iteration, group, times): how often each iteration of each cell takes a group.

    ``domain`` is a template over the keys; groups are numbered in their order within a cell. A task makes one block of
    ``words`` words, so neither memory nor time of a task grows with the groups or iterations. A cell has fewer than 2**32 groups.
    """
    share_code(rows.sparkSession)
    names = stage(ranked(rows.select(*keys, F.col(group).cast("string").alias("group")).distinct(), keys, ["group"], "at"), "draw-names")
    kinds = ", ".join(f"`{k}` {names.schema[k].dataType.simpleString()}" for k in keys) + ", " if keys else ""
    cells = names.groupBy(*keys).agg(F.count("*").alias("groups"))
    wanted, lost = F.col("groups") * iterations, (F.lit(1 << 32) % F.col("groups")) / float(1 << 32)
    # so many words that falling short is out of the question; a shortfall is an error all the same
    need = wanted / (1 - lost) + 12 * F.sqrt(wanted * lost) / (1 - lost) + 100
    each = cells.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(need / words))))
    each = each.repartition(*keys, "block")

    def blocks(pdf: pd.DataFrame):
        for row in pdf.to_dict("records"):
            yield row, accepted(words_of(row["block"], seed, domain.format(**{k: row[k] for k in keys}), words), row["groups"])

    def count(batches):
        for pdf in batches:
            yield pdf.assign(n=np.array([len(drawn) for _, drawn in blocks(pdf)], dtype=np.int64))

    def draw(batches):
        for pdf in batches:
            for row, drawn in blocks(pdf):
                n = row["groups"]
                place = row["first"] + np.arange(len(drawn))
                keep = place < iterations * n
                taken, times = np.unique(place[keep] // n * n + drawn[keep], return_counts=True)
                yield pd.DataFrame({**{k: [row[k]] * len(taken) for k in keys}, "iteration": (taken // n).astype(np.int32), "at": taken % n, "times": times.astype(np.int32)})

    counted = each.mapInPandas(count, f"{kinds}groups long, block long, n long")
    before = Window.partitionBy(*keys).orderBy("block")  # a row for each block
    placed = counted.withColumn("first", F.sum("n").over(before) - F.col("n"))
    short = F.raise_error(F.lit("too few words were made for the draws"))
    last = (F.lead("block").over(before).isNull()) & (F.col("first") + F.col("n") < F.col("groups") * iterations)
    placed = placed.withColumn("first", F.when(last, short.cast("long")).otherwise(F.col("first"))).filter(F.col("first") < F.col("groups") * iterations)
    parts = placed.repartition(*keys, "block").mapInPandas(draw, f"{kinds}iteration int, at long, times int")
    sums = parts.groupBy(*keys, "iteration", "at").agg(F.sum("times").cast("int").alias("times"))
    return sums.join(names, [*keys, "at"]).select(*keys, "iteration", "group", "times")


def replicates(rows: DataFrame, draws: DataFrame, keys: list[str], group: str, labels: Sequence[str], cell: list[str] | None = None) -> DataFrame:
    """Metrics of each iteration: (keys, iteration, accuracy, balanced_accuracy, macro_f1).

    Rows are counted by group and cell of the confusion table first, so the join with the draws has a
    row for each such count and not for each row.
    """
    cell = cell or []
    counts = rows.groupBy(*keys, *cell, F.col(group).cast("string").alias("group"), "truth", "predicted").agg(F.count("*").alias("n"))
    joined = counts.join(draws, [*keys, "group"]).withColumn("weight", F.col("n") * F.col("times"))
    table = confusion(joined, [*keys, *cell, "iteration"], "weight")
    return macro(table, [*keys, *cell, "iteration"], labels)


def intervals(values: DataFrame, keys: list[str], columns: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile bounds, linear between ranks: (keys, metric, lower, upper, iterations)."""
    long = values.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("x")).select(*keys, "x.*")
    found = long.groupBy(*keys, "metric").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("b"), F.count("*").alias("iterations"))
    return found.select(*keys, "metric", F.get("b", 0).alias("lower"), F.get("b", 1).alias("upper"), "iterations")


def differences(values: DataFrame, keys: list[str], by: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """``first`` minus ``second`` of the same iteration, for draws that both share or that are independent."""
    a = values.filter(F.col(by) == first).select(*keys, "iteration", *[F.col(c).alias(f"_{c}") for c in columns])
    b = values.filter(F.col(by) == second).select(*keys, "iteration", *columns)
    return a.join(b, [*keys, "iteration"]).select(*keys, "iteration", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in columns])
