"""Pieces that several operators share: row keys, Arrow buffers, 64-bit mixing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import share_code

#: Words of the contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
M64 = (1 << 64) - 1


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``_h``: with the id it names a row up to exact repeats, and null ids compare equal."""
    share_code(df.sparkSession)  # workers that start from now on find the package
    return df.withColumn("_h", F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.binary()).cast(wide)
    else:
        column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public-domain splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}
#: Values hashed at once: temporaries and the kept powers have at most so many entries, however long a text is.
SLICE = 1 << 18


def powers(base: int) -> np.ndarray:
    """base**0 .. base**SLICE, modulo 2**64; kept between batches."""
    if base not in _POWERS:
        known = np.full(SLICE + 1, base, dtype=np.uint64)
        known[0] = 1
        _POWERS[base] = np.multiply.accumulate(known)
    return _POWERS[base]


#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for ascending starts and ascending ends, independent of where a span lies.

    The sums of values[j] * BASE**j are built slice by slice and read where spans begin and end.
    """
    out, inverse = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    up, down, run = powers(BASE), powers(INVERSE), np.uint64(0)
    for low in range(0, len(values), SLICE):
        part = values[low : low + SLICE]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64, out=sums[1:])
        sums *= np.uint64(pow(BASE, low, 1 << 64))
        sums += run
        a, b = np.searchsorted(start, [low, low + len(part)])
        at = start[a:b] - low
        out[a:b] -= sums[at]
        inverse[a:b] = down[at] * np.uint64(pow(INVERSE, low, 1 << 64))
        a, b = np.searchsorted(end, [low, low + len(part)], side="right")
        out[a:b] += sums[end[a:b] - low]
        run = sums[-1]
    out *= inverse
    return mix64(out)


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _cuts(data: np.ndarray, offsets: np.ndarray, most: int) -> list[int]:
    """Places to cut the bytes at, about ``most`` apart: at white space or where a row begins, so no word is torn."""
    out, n = [0], len(data)
    while n - out[-1] > most + most // 2:
        look = out[-1] + most
        row = int(offsets[np.searchsorted(offsets, look)])
        while look < row:
            found = np.flatnonzero(_white(data[look : min(row, look + (1 << 16))]))
            if len(found):
                look += int(found[0])
                break
            look = min(row, look + (1 << 16))
        out.append(look)
    return [*out, n] if n > out[-1] else out


def segments(data: np.ndarray, offsets: np.ndarray):
    """Segments of the bytes that tear no word: where each begins and ends, and its words' starts and ends."""
    cuts = _cuts(data, offsets, 4 * SLICE)
    for low, high in zip(cuts, cuts[1:]):
        solid = np.zeros(high - low + 2, bool)
        solid[1:-1] = ~_white(data[low:high])
        begins, stops = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = offsets[slice(*np.searchsorted(offsets, [low + 1, high]))] - low
        begins[inner] = solid[1:-1][inner]
        stops[inner - 1] = solid[1:-1][inner - 1]
        yield low, high, np.flatnonzero(begins), np.flatnonzero(stops) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word's bytes, and each row's first word (length rows + 1)."""
    found, first, count = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64), 0
    for low, high, starts, ends in segments(data, offsets):
        rows = slice(*np.searchsorted(offsets, [low, high]))
        first[rows] = count + np.searchsorted(starts, offsets[rows] - low)
        found.append(spans_hash(data[low:high], starts, ends))
        count += len(starts)
    first[offsets == len(data)] = count
    return np.concatenate(found), first


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    out = data.copy()
    for low in range(0, len(out), SLICE):
        part = out[low : low + SLICE]
        part += ((part >= 65) & (part <= 90)).astype(np.uint8) << np.uint8(5)
    return out


#: Ids in the sample that sets range bounds (at most a few times this many reach the driver), and the most bounds.
SAMPLE, COARSE = 20_000, 4096


def range_bounds(ids: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points, the same for the same rows."""
    n = ids.count()
    every = max(1, n // SAMPLE)
    kept = ids.filter(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(every)) == 0)).select(column).distinct()
    sample = sorted(r[0] for r in kept.orderBy(F.xxhash64(column), column).limit(4 * SAMPLE).collect()) if n else []
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def range_shards(ids: DataFrame, column: str, parts: int) -> tuple[Callable[[Column], Column], int]:
    """A function from an integer id to its shard, ascending with the id, and the number of shards, ``parts`` or somewhat more.

    The sample's bounds cut the ids into at most ``COARSE`` ranges; where more shards are asked for, each
    range is cut evenly, so shards don't grow with the table and the driver's part doesn't either.
    """
    coarse = min(parts, COARSE)
    bounds, each = range_bounds(ids, column, coarse), -(-parts // coarse)
    if each == 1 or not bounds:
        return (lambda value: shard_of(value, bounds)), max(parts, 1)
    ends = ids.agg(F.min(column), F.max(column)).first()
    lows, highs = F.lit([ends[0], *bounds]), F.lit([*bounds, ends[1] + 1])

    def shard(value: Column) -> Column:
        own = shard_of(value, bounds)
        low, high = F.get(lows, own).cast("double"), F.get(highs, own).cast("double")
        share = F.least(F.greatest(F.floor((value - low) / (high - low) * each), F.lit(0)), F.lit(each - 1))
        return (own * each + F.coalesce(share, F.lit(0))).cast("int")

    return shard, (len(bounds) + 1) * each


def shard_of(column: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the value: a binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    cuts, top = F.lit(bounds), 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*[F.lit(top >> k) for k in range(top.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(cuts, at + s - 1) <= column), at + s).otherwise(at))


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives freed memory back: workers outlive their tasks, and the JVM beside them needs it."""

    @wraps(run)
    def work(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return work


def chunked(batches, most_bytes: int, text: str = "text"):
    """Record batches gathered until ``most_bytes`` of text, as tables; a row that is longer comes alone."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = strings(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            # rows that still fit, at least one
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1)
            own = int(offsets[end] - offsets[begin])
            if held and size + own > most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(begin, end - begin))
            begin, size = end, size + own
    if held:
        yield pa.Table.from_batches(held)
