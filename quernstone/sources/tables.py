"""Schema-checked scans: TSV, Parquet, FASTA, hit tables, JSON manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT_SCHEMA = "query string, target string, fident decimal(7,6), qcov decimal(7,6), tcov decimal(7,6), evalue double, bits double"
RECORD_SCHEMA = "record_id string, name string, description string, taxon string, taxon_id long, label string, sequence string"


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Tab-separated rows of exactly the declared columns; anything else fails the scan. Reads .gz as it is."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header, enforceSchema=False, mode="FAILFAST", quote="")


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType, rows: int | None = None) -> DataFrame:
    """A Parquet table whose columns, their order and types are as declared; optionally of a known row count."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"{path}: columns are {found.schema.simpleString()}, not {want.simpleString()}")
    if rows is not None and (n := found.count()) != rows:
        raise ValueError(f"{path}: {n} rows, not {rows}")
    return found


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, accession, sequence): wrapped lines are joined; ``xx|accession|…`` headers give the middle part."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", r"^>", "")
    header = F.substring_index(text, "\n", 1)
    body = F.regexp_replace(F.substr(text, F.length(header) + 1), r"\s", "")
    first = F.substring_index(header, " ", 1)
    accession = F.when(F.contains(first, F.lit("|")), F.split_part(first, F.lit("|"), F.lit(2))).otherwise(first)
    return records.select(header.alias("header"), accession.alias("accession"), body.alias("sequence")).filter("header <> ''")


def select_fasta(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose accession is in ``wanted.accession``."""
    return records.join(wanted.select("accession").distinct(), "accession", "left_semi")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table; an empty file is a table without hits."""
    return read_tsv(spark, path, HIT_SCHEMA)


def hit_violations(hits: DataFrame) -> DataFrame:
    """Counts of rows out of range and of repeated directed pairs, as one row."""
    pairs = hits.groupBy("query", "target").agg(F.count("*").alias("n"), F.count_if(~F.col("fident").between(0, 1) | ~F.col("qcov").between(0, 1) | ~F.col("tcov").between(0, 1) | (F.col("evalue") < 0) | (F.col("bits") < 0)).alias("bad"))
    return pairs.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_range"), F.count_if(F.col("n") > 1).alias("repeated"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, as a row."""
    return spark.read.option("multiLine", "true").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def null_counts(rows: DataFrame) -> DataFrame:
    """Nulls of each column as one row: file sources can't promise that there are none."""
    return rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns])


def coverage(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """How many keys are in one table only, as one row; both 0 when they cover each other."""
    a, b = first.select(key).distinct().withColumn("_a", F.lit(True)), second.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").agg(F.count_if(F.col("_b").isNull()).alias("first_only"), F.count_if(F.col("_a").isNull()).alias("second_only"))


def read_clusters(spark: SparkSession, path: str, members: DataFrame) -> DataFrame:
    """(representative, member) without a header; every ``members.member`` must be listed, and once."""
    rows = read_tsv(spark, path, "representative string, member string", header=False)
    counts = members.select("member").withColumn("_known", F.lit(True)).join(rows.groupBy("member").count(), "member", "full")
    bad = counts.filter(F.col("_known").isNull() | F.col("count").isNull() | (F.col("count") != 1))
    if (first := bad.orderBy("member").first()) is not None:
        raise ValueError(f"{path}: {first['member']} is unknown, missing, or listed more than once")
    return rows


def read_released(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A released CSV, in which NA is null."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", nullValue="NA")


def read_matrix(spark: SparkSession, path: str, key: str, vector: str, width: int, rows: int | None = None) -> DataFrame:
    """A matrix as rows of (key, vector): of one width, with finite cells and each key once; anything else is an error."""
    found = spark.read.parquet(path)
    cells = F.col(vector).cast("array<double>")
    bad = F.coalesce((F.size(cells) != width) | F.exists(cells, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    per = found.groupBy(key).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    seen = per.agg(F.sum("n").alias("rows"), F.sum("bad").alias("bad"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if seen["bad"] or seen["repeated"] or rows not in (None, seen["rows"]):
        raise ValueError(f"{path}: {seen['rows']} rows, {seen['bad']} bad vectors, {seen['repeated']} repeated keys")
    return found
