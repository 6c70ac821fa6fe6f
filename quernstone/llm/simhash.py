"""SimHash fingerprints and the search for all fingerprints within a Hamming radius, in DataFrame functions.

Terms are pairs of neighbouring words (the last word alone), hashed to 64 bits; each occurrence votes
for or against every bit, so a term weighs as often as it occurs. The 64 counters lie in pairs in 32
long sums, which one hash aggregation keeps up in generated code: 2**32 terms a text fit.

``near`` finds every pair (query, fingerprint) within ``radius`` bits. The 64 bits form ``radius + 3``
blocks; a pair that differs in at most ``radius`` bits agrees on some three whole blocks, so for each
choice of three there is a table keyed by those bits. A pair is reported by its first table only.

Nulls and edges: null text counts as empty, and empty texts share one fingerprint; ids should be
unique, rows of one id are ordered by a hash of the text and null ids come first; an empty table gives
an empty result; only the id and the text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.common import range_shards
from quernstone.session import stage

SPACE = r"[\x20\x09-\x0D]+"
#: Documents in a bucket of consecutive ids; buckets whose neighbours are found in one window; first rows that may be broadcast.
BUCKET_DOCS, NEIGHBOURS, SMALL = 256, 4096, 50_000
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE)


def votes() -> list[Column]:
    """Aggregates over rows of one term hash ``h`` each."""
    lane = [F.sum(F.shiftright("h", j).bitwiseAND(F.lit(LANES))).alias(f"v{j}") for j in range(32)]
    return [*lane, F.count("h").alias("n")]


def fingerprint() -> Column:
    """The 64 signs of ``votes()`` as a long."""
    out = None
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{j}", 32)
        for count, bit in ((low, j), (high, j + 32)):
            one = 1 << bit
            one = F.when(count * 2 > F.col("n"), F.lit(one if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            out = one if out is None else out.bitwiseOR(one)
    return out


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``fp``: one row for each distinct keys."""
    split = rows.select(*keys, words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    pairs = F.zip_with("_w", F.slice("_w", F.lit(2), F.size("_w")), lambda a, b: F.xxhash64(a, b))
    exploded = split.select(*keys, F.explode(pairs).alias("h"))
    return exploded.groupBy(*keys).agg(*votes()).select(*keys, fingerprint().alias("fp"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) as (bucket, rn, ghost, doc_id, text, next_text) in one shuffle of the texts.

    Consecutive ids share a bucket. The first row of a bucket is also sent, as a ghost, to the bucket
    before it (the very first to the last one), where it follows the last row.
    """
    spark = docs.sparkSession
    ids = stage(docs.select("doc_id", F.xxhash64("text").alias("h")), "simhash-ids")
    shard, _ = range_shards(ids, "doc_id", max(1, ids.count() // BUCKET_DOCS))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(shard(F.col("doc_id"))).cast("int")
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("f"))
    firsts = stage(firsts.select("bucket", F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("first_h")), "simhash-firsts")
    # each bucket's neighbour before it: inside runs of buckets by a window, between runs (one row for each) on the driver
    run = F.floor(F.col("bucket") / NEIGHBOURS)
    ends = firsts.groupBy(run.alias("run")).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.count("*").alias("n")).orderBy("run").collect()
    wrap = spark.createDataFrame([(r["low"], ends[k - 1]["high"]) for k, r in enumerate(ends)], "bucket int, wrap int")
    small = firsts.withColumn("own", F.lag("bucket").over(Window.partitionBy(run).orderBy("bucket"))).join(F.broadcast(wrap), "bucket", "left")
    small = small.select("bucket", "first_id", "first_h", F.coalesce("own", "wrap").alias("before"))
    small = F.broadcast(small) if sum(r["n"] for r in ends) <= SMALL else small
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket).join(small, "bucket")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own = F.struct("bucket", F.lit(False).alias("ghost"))
    sent = rows.withColumn("to", F.explode(F.when(first, F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(own))))
    sent = sent.select("to.bucket", "to.ghost", "doc_id", "h", "text")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")
    return sent.select("bucket", F.row_number().over(order).alias("rn"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp.

    The edited text has the last half of the code points replaced by the first as many of the next
    document by id (after the last: the first).
    """
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = rows.select("bucket", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    plain = F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"), F.lit(None).cast("binary").alias("sha"))
    changed = F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"))
    keys = ["bucket", "rn", "ghost", "doc_id", "n_chars", "kind", "sha"]
    each = both.select("bucket", "rn", "ghost", "doc_id", "n_chars", F.explode(F.array(plain, changed)).alias("x")).select("bucket", "rn", "ghost", "doc_id", "n_chars", "x.kind", "x.sha", "x.body")
    done = fingerprints(each, keys, "body")
    order = Window.partitionBy("bucket").orderBy("rn", "kind")
    lined = done.select("*", F.lead("fp").over(order).alias("edited_fp"), F.lead("sha").over(order).alias("edited_sha"), F.lead("fp", 2).over(order).alias("next_fp"))
    lined = lined.filter((F.col("kind") == 0) & ~F.col("ghost"))
    return lined.select("doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def masks(radius: int) -> list[int]:
    """The bits of each table's key, as signed longs."""
    blocks = radius + 3
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    found = [sum(three) for three in combinations(block, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def near(queries: DataFrame, against: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp, n) for distinct ``queries.fp`` and the rows of ``against`` (distinct fp, n) within ``radius`` bits."""
    tables = masks(radius)

    def keyed(rows: DataFrame, name: str, *more: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])
        return rows.select(F.col("fp").alias(name), *more, F.inline(keys))

    x = F.col("query").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    left, right = keyed(queries, "query").alias("l"), keyed(against, "other", "n").alias("r")
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.bit_count(x) <= radius) & (first == F.col("l.t"))
    return left.join(right, on).select("query", F.col("other").alias("fp"), "n")
