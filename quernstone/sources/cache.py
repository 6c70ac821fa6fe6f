"""A cache of feature vectors, addressed by what they are computed from.

The path names the feature and the digest of its whole configuration, so a changed configuration misses everything and an old one is
still there. Inside, rows are partitioned by the first digits of the content's digest: a run reads only the partitions that
its records can be in, finds its misses by an anti-join, and appends what it computes for them. Vectors are sparse (indices, values),
each with a digest of its own that is compared when it is read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.session import share_code, stage

SCHEMA = "content string, width int, indices array<int>, values array<double>, seal string, shard string"


def configuration_key(config: Mapping[str, object]) -> str:
    """SHA-256 of a configuration in one spelling; what JSON can't hold, and numbers that aren't finite, are errors."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def sparse(vector: Column) -> tuple[Column, Column]:
    """(indices, values) of the cells that aren't zero."""
    cells = F.filter(F.transform(vector.cast("array<double>"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c["x"] != 0)
    return F.transform(cells, lambda c: c["i"].cast("int")), F.transform(cells, lambda c: c["x"])


def dense(width: Column, indices: Column, values: Column) -> Column:
    """The whole vector again."""
    found = F.map_from_arrays(indices, values)
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def _seal(content: Column, width: Column, indices: Column, values: Column) -> Column:
    return F.sha2(F.to_json(F.struct(content.alias("c"), width.alias("w"), indices.alias("i"), values.alias("v"))).cast("binary"), 256)


class FeatureCache:
    """Vectors of one feature and configuration under ``root``."""

    def __init__(self, spark: SparkSession, root: str, feature: str, config: Mapping[str, object]) -> None:
        share_code(spark)
        self.spark, self.key = spark, configuration_key(config)
        self.path = f"{root.rstrip('/')}/feature={feature}/configuration={self.key}"

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _keys(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).select("content", "shard")

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """Cached rows, of ``wanted.content`` only; a vector that doesn't agree with its seal is an error when it is read.

        Two runs that computed the same misses at once leave equal rows; one of them counts.
        """
        if not self._exists():
            return self.spark.createDataFrame([], T.StructType.fromDDL(SCHEMA))
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        if wanted is not None:
            # the shard is in the join, so only partitions that are asked for are opened
            rows = rows.join(wanted.select("content", "shard"), ["content", "shard"], "left_semi").select(rows.columns)
        once = rows.groupBy("content", "shard").agg(F.min(F.struct("width", "indices", "values", "seal")).alias("r")).select("content", "r.*", "shard")
        good = F.col("seal") == _seal(F.col("content"), F.col("width"), F.col("indices"), F.col("values"))
        wrong = F.raise_error(F.concat(F.lit("cached vector does not agree with its digest: "), F.col("content")))
        return once.withColumn("values", F.when(good, F.col("values")).otherwise(wrong.cast("array<double>")))

    def features(self, records: DataFrame, source: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
        """``records`` with width, indices and values of their ``source`` text, and how many distinct texts were hits and misses.

        ``compute`` gets (content, source) of the misses and returns (content, vector). Null texts have null vectors.
        """
        content = F.sha2(F.col(source).cast("binary"), 256)
        keyed = records.withColumn("content", content).withColumn("shard", F.substring("content", 1, 2))
        asked = stage(keyed.filter("content is not null").groupBy("content", "shard").agg(F.min(source).alias(source)), "cache-asked")
        # only the keys of cached rows are read here; their vectors are read, and checked, once
        misses = stage(asked.join(self._keys(), ["content", "shard"], "left_anti"), "cache-misses") if self._exists() else asked
        n = misses.count()
        if n:
            made = compute(misses.select("content", source))
            indices, values = sparse(F.col("vector"))
            new = made.select("content", F.size("vector").alias("width"), indices.alias("indices"), values.alias("values"))
            new = new.withColumn("seal", _seal(*[F.col(c) for c in ("content", "width", "indices", "values")])).withColumn("shard", F.substring("content", 1, 2))
            # files of a run appear when its job commits, so a run that is lost leaves nothing
            new.repartition("shard").write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(self.path)
        found = keyed.join(self.read(asked).select("content", "width", "indices", "values"), "content", "left")
        return found.select(*records.columns, "content", "width", "indices", "values"), {"hits": asked.count() - n, "misses": n}
