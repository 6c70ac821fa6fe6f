"""Writers that don't overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.canonical import csv_line
from quernstone.functions.records import fasta_record


def publish_parquet(rows: DataFrame, path: str, order: list[str] | None = None) -> str:
    """Writes zstd Parquet, sorted by range if asked, and fails where ``path`` exists."""
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ready.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def publish_fasta(rows: DataFrame, path: str, header: str = "header", sequence: str = "sequence", key: str = "accession") -> str:
    """Writes FASTA records in the order of ``key``, wrapped at 60."""
    ready = rows.repartitionByRange(key).sortWithinPartitions(key)
    ready.select(fasta_record(F.col(header), F.col(sequence)).alias("value")).write.mode("errorifexists").text(path)
    return path


def publish_csv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> str:
    """Writes a canonical CSV (see ``functions.canonical``) in the order of ``order``, with a header in each part; fails where ``path`` exists."""
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(csv_line(rows.schema, columns).alias(",".join(columns)))
    # lines are ready: the writer adds the header and line feeds only
    ready.write.mode("errorifexists").option("header", "true").option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000").option("emptyValue", "").csv(path)
    return path
