"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; a document of it should be taken ``target / size of the
source`` times on average. The integral part is taken at once. The fractional parts are rounded in
pairs: mass, measured in words, moves at random from one document of the pair to the other until one
of the two is integral, which keeps both the expectation of each document and the source's total.
Pairs are formed inside small groups of one source; each group leaves at most one fractional
document, and those residuals meet in ever larger groups (a reduction tree) until one per source is
left, which a biased coin settles. A source's words thus differ from its target by less than one
document. All coins come from hashes of the rows, so reruns agree, also after lost executors.

Nulls and edges: a null source is a source of its own and sorts last; null or empty text has size 0
and takes nothing; repeated rows count one by one; an empty table gives an empty result. Columns of
the input other than the three named ones are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.llm.common import M64, size_in_words, with_row_key
from quernstone.session import stage

#: Documents of one source in a group of the tree's lowest level, and groups that meet in one above.
LEAF, FAN_IN = 1000, 64


def source_ranks(totals: DataFrame) -> DataFrame:
    """Adds ``position`` (from 0) of each source by code point, null last, without a global window."""
    spread = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    spread = stage(spread, "sources")
    counts = spread.groupBy("_p").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("a._p") > F.col("b._p"), "left")
    before = before.groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1
    return spread.withColumn("_own", own).join(before, "_p").withColumn("position", (F.col("_before") + F.col("_own")).cast("long")).drop("_p", "_own", "_before")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, stopped at ``most`` sizes, the excess reshared."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = stage(source_ranks(totals).withColumn("weight", weight), "source-ranks")
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    size = float(whole["s"] or 0)
    stopped, level = -1, 0.0
    left, active = share * size, float(whole["w"] or 0)
    cap = F.col("source_size") * F.lit(float(most))
    while True:
        level = left / active if active > 0 else 0.0
        full = cap <= F.col("weight") * F.lit(level)
        now = ranked.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("mass"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if now["n"] == stopped or now["w"] <= 0:
            break
        stopped, left, active = now["n"], share * size - now["mass"], now["w"]
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def _coin(h: int, g: int, level: int) -> float:
    x = (h * 0x9E3779B97F4A7C15 + g * 0xC2B2AE3D27D4EB4F + (level + 1) * 0x165667B19E3779F9) & M64
    x ^= x >> 30
    x = (x * 0xBF58476D1CE4E5B9) & M64
    x ^= x >> 27
    x = (x * 0x94D049BB133111EB) & M64
    x ^= x >> 31
    return (x >> 11) / float(1 << 53)


def round_pairs(size: list[int], share: list[float], h: list[int], level: int) -> tuple[list[float], int]:
    """Pivotal rounding of one group in the given order; the new shares, and the index still fractional or -1."""
    share = list(share)
    held = -1
    for j in range(len(size)):
        if share[j] <= 0 or share[j] >= 1:
            continue
        if held < 0:
            held = j
            continue
        i = held
        a, b, p, q = size[i], size[j], share[i], share[j]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if _coin(h[i], h[j], level) * (up + down) < down:
            full_i, full_j = a * (1 - p) <= b * q, b * q <= a * (1 - p)
            share[i], share[j] = (1.0 if full_i else p + up / a), (0.0 if full_j else q - up / b)
        else:
            none_i, full_j = a * p <= b * (1 - q), b * (1 - q) <= a * p
            share[i], share[j] = (0.0 if none_i else p - down / a), (1.0 if full_j else q + down / b)
        held = i if 0 < share[i] < 1 else j if 0 < share[j] < 1 else -1
    return share, held


def _level(rows: DataFrame, level: int, last: bool) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", "_row", "size"], kind="stable").reset_index(drop=True)
        h = [int(x) & M64 for x in group["_h"]]
        share, held = round_pairs(group["size"].tolist(), group["share"].tolist(), h, level)
        if held >= 0 and last:
            share[held] = 1.0 if _coin(h[held], 0, level + 100) < share[held] else 0.0
        return group.assign(share=share)

    return rows.groupBy("position", "_bucket").applyInPandas(one, rows.schema)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: id, _h (row key), source, size, source_size, target, copies, taken."""
    rows = with_row_key(docs, id_col, text_col)
    rows = stage(rows.select(F.col(id_col).alias("doc_id"), "_h", F.col(source_col).alias("source"), size_in_words(F.col(text_col)).alias("size")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    targets = stage(source_targets(totals, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    known = known.join(targets.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "_source").drop("_source")
    known = known.withColumn("_rate", rate).withColumn("whole", F.floor("_rate").cast("long")).withColumn("share", F.when(F.col("size") > 0, F.col("_rate") - F.col("whole")).otherwise(0.0))
    known = known.withColumn("_row", F.col("_h")).withColumn("_h", F.xxhash64("_h", F.lit(seed)))
    known = known.withColumn("_bucket", F.pmod(F.xxhash64("_h", F.lit(1)), F.ceil(F.col("_docs") / LEAF))).drop("_rate", "weight", "_docs")
    most_docs = totals.agg(F.max("_docs")).first()[0] or 0
    groups, level, done = -(-most_docs // LEAF), 0, []
    while True:
        known = stage(_level(known, level, groups <= 1), f"mix-level{level}")
        if groups <= 1:
            done.append(known)
            break
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(known.filter(~open_))
        known = known.filter(open_).withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN))
        groups, level = -(-groups // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("share")).cast("long")
    return out.select("doc_id", F.col("_row").alias("_h"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    taken = mix(docs, **options).groupBy("doc_id", "_h").agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).withColumn("_null", F.col("doc_id").isNull())
    keyed = with_row_key(docs, id_col, text_col).withColumn("_null", F.col(id_col).isNull())
    taken = taken.select(F.coalesce("doc_id", F.lit(0).cast(taken.schema["doc_id"].dataType)).alias("_id"), F.col("_null"), "_h", "_n", "_rows")
    keyed = keyed.withColumn("_id", F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)))
    joined = keyed.join(taken, ["_id", "_null", "_h"])
    # repeated rows are alike, so only how many copies they get together matters
    spare = F.when(F.col("_rows") > 1, F.row_number().over(Window.partitionBy("_id", "_null", "_h").orderBy(F.lit(1)))).otherwise(1)
    each = F.floor(F.col("_n") / F.col("_rows")) + F.when(spare <= F.col("_n") % F.col("_rows"), 1).otherwise(0)
    repeated = joined.withColumn("_each", each.cast("int")).filter("_each > 0")
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select(*[F.col(f"`{c}`") for c in docs.columns])
