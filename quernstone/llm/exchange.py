"""Exchanges of packed arrays between chunks of documents and buckets of hashes, and the way back.

A task works on chunks: some megabytes of whole documents. For each bucket of the hash space a chunk
sends one row with packed arrays, so a hash costs a few bytes instead of a row. What a bucket finds
returns to the chunk as positions, and the chunk's directory, which travels along, turns positions
into documents. Chunk numbers come from the task and a counter, so a task that runs again sends the
same rows. The number of buckets grows with the corpus, so a bucket fits a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import trimmed

#: Kinds of rows: entries first, then those that need them; directories and settled positions pass through.
INDEX, PROBE, WINDOWS, SETTLED, DIRECTORY = 0, 1, 2, 8, 9
SENT = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in "abcd"]])
BACK = "chunk long, kind int, a binary, b binary, c binary"
BACK_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abc"]])


def chunk_numbers() -> Iterator[int]:
    part = TaskContext.get().partitionId()
    seq = 0
    while True:
        yield (part << 32) | seq
        seq += 1


def pack(ascending: np.ndarray) -> bytes:
    """An array of integers, small where neighbours are near."""
    return zlib.compress(np.diff(ascending.astype(np.int64), prepend=0).astype(np.int32).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32), dtype=np.int64)


def pack_long(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values.astype(np.int64), prepend=0).tobytes(), 1)


def unpack_long(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64))


def sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), SENT_ARROW)], schema=SENT_ARROW)


def back(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), BACK_ARROW)], schema=BACK_ARROW)


def directory(chunk: int, buckets: int, table: pa.Table, starts: np.ndarray) -> tuple:
    """The row that says which documents a chunk holds and where each starts."""
    return (chunk % buckets, DIRECTORY, chunk, table["_i"].to_numpy().tobytes(), table["_h"].to_numpy().tobytes(), starts.astype(np.int64).tobytes(), None)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket present, with the ascending indices of its entries."""
    small = bucket.astype(np.uint16) if len(bucket) == 0 or bucket.max() < 1 << 16 else bucket
    order = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
    for begin, end in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[begin]]), order[begin:end]


def meet(rows: DataFrame, buckets: int, work: Callable) -> DataFrame:
    """Deals sent rows to their buckets and runs ``work`` over each task's rows, sorted by bucket, kind and chunk."""
    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind", "chunk")
    return dealt.mapInArrow(trimmed(work), BACK)


def passed_on(row: dict) -> tuple:
    return (row["chunk"], row["kind"], row["a"], row["b"], row["c"])


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """The rows of each bucket in turn, as dictionaries."""

    def rows():
        for batch in batches:
            for k in range(batch.num_rows):
                yield {c: batch[c][k].as_py() for c in batch.schema.names}

    from itertools import groupby

    yield from groupby(rows(), key=lambda r: r["bucket"])


def documents_of(answers: DataFrame, spread: Callable, schema: str) -> DataFrame:
    """Turns each chunk's answers into rows for its documents: ``spread(i, h, starts, answers)`` gives an Arrow table."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        at = next(r for r in rows if r["kind"] == DIRECTORY)
        i, h, starts = (np.frombuffer(at[c], np.int64) for c in "abc")
        return spread(i, h, starts, [r for r in rows if r["kind"] != DIRECTORY])

    return answers.groupBy("chunk").applyInArrow(run, schema)
