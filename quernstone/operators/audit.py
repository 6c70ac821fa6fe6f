"""Replay comparison, semantic hashes, privacy scans and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.operators.digests import streamed_digest

# Fixed patterns of the public-text scan.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "secret": r"(?i)(token|secret|password|api_key)\s*=",
    "path": r"/(home|Users|root)/[A-Za-z0-9_]+",
    "sha256": r"\b[0-9a-f]{64}\b",
    "long_sequence": r"[ACDEFGHIKLMNPQRSTVWY]{30}",
}


def scan_counts(rows: DataFrame, column: str) -> DataFrame:
    """(rule, rows): how many rows match each rule, in one pass."""
    found = rows.agg(*[F.count_if(F.col(column).rlike(p)).alias(name) for name, p in RULES.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in RULES])
    return found.select(F.inline(pairs))


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' text, tab-separated, null as NA."""
    text = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns])
    return F.sha2(text.cast("binary"), 256)


def semantic_hash(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One digest for each ``keys`` over its rows in any order; memory doesn't grow with a key."""
    return streamed_digest(rows.select(*keys, row_digest([F.col(c) for c in columns]).alias("_d")), keys, ["_d"], "_d", separator=b"\n")


def compare_inventories(first: DataFrame, second: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): same, different, first_only or second_only."""
    a, b = first.select(F.col(key), F.col(digest).alias("_a")), second.select(F.col(key), F.col(digest).alias("_b"))
    status = F.when(F.col("_a").isNull(), "second_only").when(F.col("_b").isNull(), "first_only").when(F.col("_a") == F.col("_b"), "same").otherwise("different")
    return a.join(b, key, "full").select(key, status.alias("status"))


def distribution(column: str) -> list[Column]:
    """count, min, max, mean and exact quantiles, linear between ranks."""
    quantiles = [0.05, 0.25, 0.5, 0.75, 0.95]
    return [F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), *[F.percentile(column, q).alias(f"p{round(q * 100):02d}") for q in quantiles]]


def stage_flow(reasons: DataFrame, column: str, stages: list[tuple[str, list[str]]]) -> DataFrame:
    """(stage_order, stage, rows, removed): rows left after each stage's reasons are taken out."""
    gone: list[str] = []
    counts = [F.count("*").alias("s0")]
    for k, (_, names) in enumerate(stages, 1):
        gone = [*gone, *names]
        counts.append(F.count_if(F.col(column).isNull() | ~F.col(column).isin(*gone)).alias(f"s{k}"))
    whole = reasons.agg(*counts)
    rows = [F.struct(F.lit(k).cast("long").alias("stage_order"), F.lit(n).alias("stage"), F.col(f"s{k}").alias("rows")) for k, n in enumerate(["input", *[s for s, _ in stages]])]
    flow = whole.select(F.inline(F.array(*rows)))
    before = F.lag("rows").over(Window.orderBy("stage_order"))  # one row for each stage
    return flow.withColumn("removed", F.coalesce(before - F.col("rows"), F.lit(0)).cast("long"))


def top_values(rows: DataFrame, column: str, most: int = 100) -> DataFrame:
    """The most frequent values with their rank: a top-k report."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), column).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)).cast("long"))  # at most ``most`` rows
