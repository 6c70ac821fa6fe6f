"""Scan of tables before release: patterns, and values that are known to be private, over all text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the release scan.
RELEASE_RULES = {
    "accession": r"\b(?:[A-Z][0-9][A-Z0-9]{3}[0-9]|[A-Z][0-9]{4})\b",
    "sequence": r"[ACDEFGHIKLMNPQRSTVWY]{50,}",
    "private_path": r"(?:/Users/|/home/|[A-Za-z]:\\Users\\)",
    "secret": r"(?i)(?:Authorization\s*:|Cookie\s*:|Bearer\s+[A-Za-z0-9._-]+|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})",
    "row_hash": r"\b[0-9a-f]{64}\b",
}
# Fixed names of columns that are never released.
PRIVATE_COLUMNS = ("accession", "query_accession", "nearest_train_accession", "sequence", "sequence_sha256", "true_label_per_record", "predicted_label_per_record")

#: What a known name is made of, and the letters of a known sequence that it is looked up by.
NAME, ANCHOR = r"[A-Za-z0-9_#.:|-]+", 20


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row, column, text): a row for each text that isn't null."""
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in columns])
    return numbered.select("row", F.inline(cells)).filter("text is not null")


def text_columns(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if f.dataType.simpleString() == "string"]


def pattern_leaks(rows: DataFrame, columns: Sequence[str] | None = None, allow_hashes: bool = False) -> DataFrame:
    """(column, rule, rows): how many rows match each rule in each text column, in one pass over the table."""
    columns = list(columns) if columns is not None else text_columns(rows)
    rules = {n: p for n, p in RELEASE_RULES.items() if not (allow_hashes and n == "row_hash")}
    names = [(c, n) for c in columns for n in rules]
    counts = rows.agg(*[F.count_if(F.col(f"`{c}`").rlike(rules[n])).alias(f"c{k}") for k, (c, n) in enumerate(names)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule"), F.col(f"c{k}").alias("rows")) for k, (c, n) in enumerate(names)])))


def known_leaks(rows: DataFrame, names: DataFrame, sequences: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rule, rows): how many rows hold a known name (``names.value``) as a word of its own, or a known sequence inside a run of residues.

    Words of the texts meet the names in a join; windows of residues meet the sequences by their first ``ANCHOR`` letters and are then
    compared whole. So neither side has to fit a task. Sequences shorter than that aren't looked for.
    """
    from quernstone.session import stage

    columns = list(columns) if columns is not None else text_columns(rows)
    cells = stage(_long(rows, columns), "leaks")
    words = cells.select("row", "column", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("value"))
    named = words.hint("merge").join(names.select("value").distinct().hint("merge"), "value").select("row", "column", F.lit("known_name").alias("rule"))
    runs = cells.select("row", "column", F.explode(F.regexp_extract_all("text", F.lit(f"[ACDEFGHIKLMNPQRSTVWY]{{{ANCHOR},}}"), F.lit(0))).alias("run"))
    windows = runs.select("row", "column", "run", F.explode(F.array_distinct(F.regexp_extract_all("run", F.lit(f"(?=(.{{{ANCHOR}}}))"), F.lit(1)))).alias("anchor"))
    known = sequences.select("value").filter(F.length("value") >= ANCHOR).distinct().withColumn("anchor", F.substr("value", F.lit(1), F.lit(ANCHOR)))
    held = windows.hint("merge").join(known.hint("merge"), "anchor").filter(F.contains("run", "value")).select("row", "column", F.lit("known_sequence").alias("rule"))
    found = named.unionByName(held).distinct().groupBy("column", "rule").agg(F.count("*").alias("rows"))
    asked = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule")) for c in columns for n in ("known_name", "known_sequence")])
    every = rows.sparkSession.range(1).select(F.inline(asked))  # a row for each column and rule
    return every.join(found, ["column", "rule"], "left").select("column", "rule", F.coalesce("rows", F.lit(0)).alias("rows"))


def forbidden_columns(rows: DataFrame, allowed: Sequence[str]) -> list[str]:
    """Columns that aren't on the list of a table, or that no table may have whatever its list says."""
    return [c for c in rows.columns if c not in allowed or c.casefold() in PRIVATE_COLUMNS]
