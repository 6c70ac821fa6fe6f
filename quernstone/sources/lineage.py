"""Scans of paged tables whose pages are bound to a manifest: every row knows its page and place, every page is verified."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import share_code

#: One row a page: its file's name, the SHA-256 of the file as it lies there and of its text, and the number of rows.
MANIFEST = "page int, name string, stored_sha256 string, text_sha256 string, rows long"


def _text(content: bytes, name: str) -> bytes:
    return gzip.decompress(content) if name.endswith(".gz") else content


def _page_files(spark: SparkSession, path: str, depth: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv*").load(path)
    parts = F.split(F.col("path"), "/")
    return files.select(F.array_join(F.slice(parts, F.size(parts) - depth, F.lit(depth + 1)), "/").alias("name"), "content")


def page_manifest(spark: SparkSession, path: str, pages: DataFrame, depth: int = 0) -> DataFrame:
    """The manifest of the pages (page, name) that lie under ``path``: each is read once and described.

    ``name`` is a file's name with ``depth`` folders before it.
    """
    share_code(spark)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                text = _text(content, name)
                row = [name, hashlib.sha256(content).hexdigest(), hashlib.sha256(text).hexdigest(), max(text.count(b"\n") - 1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["name", "stored_sha256", "text_sha256", "rows"])

    found = _page_files(spark, path, depth).mapInArrow(describe, "name string, stored_sha256 string, text_sha256 string, rows long")
    return pages.join(found, "name", "left").select("page", "name", "stored_sha256", "text_sha256", "rows")


def _rows_of(content: bytes, about: dict, columns: Sequence[str]) -> list[list[str]]:
    """The cells of a page's lines, after all that the manifest says of it has been found true."""
    where = f"page {about['page']} ({about['name']})"
    if hashlib.sha256(content).hexdigest() != about["stored_sha256"]:
        raise ValueError(f"{where}: the file's digest is another one")
    text = _text(content, about["name"])
    if hashlib.sha256(text).hexdigest() != about["text_sha256"]:
        raise ValueError(f"{where}: the text's digest is another one")
    lines = text.decode("utf-8").split("\n")
    if lines.pop() != "" or "\r" in text.decode("utf-8"):
        raise ValueError(f"{where}: lines must end with a line feed")
    if not lines or lines[0].split("\t") != list(columns):
        raise ValueError(f"{where}: the header is not {list(columns)}")
    cells = [line.split("\t") for line in lines[1:]]
    if wrong := next((k for k, row in enumerate(cells, 1) if len(row) != len(columns)), None):
        raise ValueError(f"{where}: row {wrong} has {len(cells[wrong - 1])} cells")
    if len(cells) != about["rows"]:
        raise ValueError(f"{where}: {len(cells)} rows, not {about['rows']}")
    return cells


def read_pages(spark: SparkSession, path: str, manifest: DataFrame, columns: Sequence[str], depth: int = 0) -> DataFrame:
    """(page, row, *columns) of tab-separated pages with a header, plain or gzipped; rows count from 1, cells are text.

    A file that isn't in the manifest or is missing, another digest of the file or its text, another header or number of cells,
    and another number of rows are errors when the page is read. Pages are read by many tasks, one page at a time.
    """
    share_code(spark)
    files = _page_files(spark, path, depth).withColumn("_there", F.lit(True))
    both = files.join(manifest.hint("merge"), "name", "full")
    schema = "page int, row long, " + ", ".join(f"`{c}` string" for c in columns)
    kinds = pa.schema([("page", pa.int32()), ("row", pa.int64()), *[(c, pa.string()) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                about = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if about["page"] is None or about["content"] is None:
                    raise ValueError(f"{about['name']} is {'not in the manifest' if about['page'] is None else 'missing'}")
                cells = _rows_of(about.pop("content"), about, columns)
                if cells:
                    n = len(cells)
                    yield pa.RecordBatch.from_arrays([pa.array([about["page"]] * n, pa.int32()), pa.array(range(1, n + 1), pa.int64()), *[pa.array(c, pa.string()) for c in zip(*cells)]], schema=kinds)

    return both.select("page", "name", "stored_sha256", "text_sha256", "rows", "content").mapInArrow(run, schema)
