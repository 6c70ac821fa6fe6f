"""Digests of large ordered groups: the hash state moves along the sorted rows, no group is put together as one string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranks import running
from quernstone.session import share_code


def _stream(keys: list[str], separator: bytes, start: bytes, end: bytes):
    """One digest for each run of equal keys; values are fed to it batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, count, last, names = None, 0, None, None

        def closed() -> pa.RecordBatch:
            state.update(end)
            row = dict(zip(keys, last)) | {"digest": state.hexdigest(), "rows": count}
            return pa.RecordBatch.from_pylist([row], schema=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if names is None:
                names = pa.schema([*[batch.schema.field(k) for k in keys], pa.field("digest", pa.string()), pa.field("rows", pa.int64())])
            here = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            values = batch.column("_v").to_pylist()
            low = 0
            while low < len(here):
                high = low + 1
                while high < len(here) and here[high] == here[low]:
                    high += 1
                if state is None or here[low] != last:
                    if state is not None:
                        yield closed()
                    state, count, last = hashlib.sha256(start), 0, here[low]
                state.update((separator if count else b"") + separator.join(values[low:high]))
                count += high - low
                low = high
        if state is not None:
            yield closed()

    return run


def streamed_digest(rows: DataFrame, keys: list[str], order: Sequence[str], value: str | Column, separator: bytes = b"", start: bytes = b"", end: bytes = b"") -> DataFrame:
    """(keys, digest, rows): SHA-256 of ``start``, each key's values in ``order`` with ``separator`` between, and ``end``.

    The sort spills to disk and the digest's state is a few bytes, so memory doesn't grow with a key. A null value counts as
    empty. Without keys there is one digest, over ranges sorted by many tasks and read one after the other. A SHA-256 is
    sequential by definition: a key's bytes pass through one task, but nothing of them is kept. No rows give no digest.
    """
    share_code(rows.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    slim = rows.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(value.cast("binary"), F.lit(b"")).alias("_v"))
    by = [f"_o{i}" for i in range(len(order))]
    if keys:
        dealt = slim.repartition(*keys).sortWithinPartitions(*keys, *by)
    else:
        dealt = slim.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).coalesce(1)
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return dealt.select(*keys, "_v").mapInArrow(_stream(list(keys), separator, start, end), f"{kinds}digest string, rows long")


def _number_bytes(kind: str):
    """The little-endian bytes of each row's numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [np.asarray(v, dtype=kind).tobytes() for v in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s"), batch.column("p"), pa.array(bodies, pa.binary())], names=["s", "p", "v"])

    return run


def _section(rows: DataFrame, section: int, order: str, numbers: Column, kind: str) -> DataFrame:
    return rows.select(F.lit(section).alias("s"), F.col(order).cast("string").alias("p"), numbers.alias("x")).mapInArrow(_number_bytes(kind), "s int, p string, v binary")


def matrix_digest(rows: DataFrame, order: str, columns: int, values: str = "values", indices: str | None = None) -> str:
    """The semantic digest of a matrix of doubles whose rows stand in ``order``.

    A compact JSON header of dtype, shape and storage, then the cells row by row; with ``indices`` (ascending in each row) the matrix is sparse,
    and row bounds, column indices and cells follow each other. All numbers are eight bytes, little-endian.
    """
    n = rows.count()
    storage = "dense" if indices is None else "csr"
    header = f'{{"dtype":"float64","shape":[{n},{columns}],"storage":"{storage}"}}\n'.encode()
    share_code(rows.sparkSession)
    parts = _section(rows, 2, order, F.col(values).cast("array<double>"), "<f8")
    if indices is not None:
        bounds = running(rows.select(F.col(order).cast("string").alias("p"), F.size(values).cast("long").alias("k")), ["p"], "k", "sum")
        zero = rows.sparkSession.range(1).select(F.lit(0).alias("s"), F.lit("").alias("p"), F.unhex(F.lit("0" * 16)).alias("v"))
        parts = zero.unionByName(_section(bounds, 0, "p", F.array("sum"), "<i8")).unionByName(_section(rows, 1, order, F.col(indices).cast("array<long>"), "<i8")).unionByName(parts)
    done = streamed_digest(parts, [], ["s", "p"], "v", start=header).first()
    return done["digest"] if done else hashlib.sha256(header + (b"\0" * 8 if indices is not None else b"")).hexdigest()
