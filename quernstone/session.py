"""Session settings that every operator relies on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of whole texts that go to a Python worker at once.
BATCH_ROWS = 2000
#: Buckets of a staged table; beyond them buckets grow instead, and tasks stream through more chunks each.
MOST_BUCKETS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder is used, but only on a local master: on a cluster a
    machine's own folder would be invisible to the others, so that is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def share_code(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package from where the driver has it.

    On a cluster the package is installed on the executors or sent with ``--py-files``.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join([root, *filter(None, [env.get("PYTHONPATH")])])


def staged_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{shared_dir(spark)}/quernstone/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors.

    The path is added to ``held``, for ``unstage`` once no later step reads the table.
    """
    share_code(df.sparkSession)
    path = staged_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, label: str, parts: int, keys: list[str]) -> DataFrame:
    """As ``stage``, but dealt to ``parts`` buckets by ``keys``: later joins and groups on just these keys leave the rows where they are."""
    spark = df.sparkSession
    share_code(spark)
    parts = min(parts, MOST_BUCKETS)
    path = staged_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    dealt = df.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys)
    dealt.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def unstage(spark: SparkSession, held: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    jvm = spark._jvm
    while held:
        at = jvm.org.apache.hadoop.fs.Path(held.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
