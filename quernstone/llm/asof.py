"""Point-in-time feature join: for each question the latest version that was known and alive at its time.

Versions and questions are dealt to ranges of (key, time), so one hot key spreads over many tasks. In each range a
question starts at its latest version (the as-of step) and, while that isn't usable, follows the pointer to the
version before, until one is usable or older than the maximum lifetime. Blocks of versions that hold none that can be
usable are stepped over. A walk that reaches the beginning of its range goes on in the range before, in
the next round; each range keeps for that only the versions within a lifetime of its end. Rounds are written to the
shared folder. Nothing is broadcast, and the driver only counts.

A version is usable at ``t`` when event <= t, arrival <= t < expiry and t - event < lifetime. The latest event wins,
then the latest arrival, the largest tie-breaker (null last), the latest expiry, and the largest carried values.

Nulls and edges: questions with a null key or time, and those without a usable version, get a null result; versions
with a null key, event, arrival or expiry are never usable; repeated versions count once; questions with one key and
time are asked once and all get the answer, so every row of ``asks`` comes back, repeated ones too; empty tables
are no special case; columns of ``asks`` pass through whatever their names are, all but ``out``, which is replaced;
texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import trimmed
from quernstone.session import share_code, stage

#: Rows of a range, and the sizes of the blocks of versions that a walk can step over.
RANGE, BLOCKS = 500_000, (4096, 64)
VERSION, ASK, MARK, OPEN, SETTLED = range(5)


def walk(event: np.ndarray, arrival: np.ndarray, expiry: np.ndarray, first: np.ndarray, start: np.ndarray, t: np.ndarray, life: int) -> np.ndarray:
    """Where each walk ends: the index of a usable version, -1 past the lifetime, -2 at the beginning (before ``first``)."""
    found, at, alive = np.full(len(t), -2, np.int64), start.copy(), np.arange(len(t))
    whole = {}
    for size in BLOCKS:
        n = len(event) // size
        whole[size] = arrival[: n * size].reshape(n, size).min(axis=1, initial=np.iinfo(np.int64).max), expiry[: n * size].reshape(n, size).max(axis=1, initial=np.iinfo(np.int64).min)
    while len(alive := alive[at[alive] >= first[alive]]):
        here, now = at[alive], t[alive]
        old = event[here] <= now - life
        good = ~old & (arrival[here] <= now) & (now < expiry[here])
        found[alive[old]] = -1
        found[alive[good]] = here[good]
        step = np.ones(len(alive), np.int64)
        for size, (known, dead) in whole.items():
            ends = (here % size == size - 1) & (here - size + 1 >= first[alive]) & (step == 1)
            block = here[ends] // size
            step[np.flatnonzero(ends)[(known[block] > now[ends]) | (dead[block] <= now[ends])]] = size
        go = ~old & ~good
        at[alive[go]] -= step[go]
        alive = alive[go]
    return found


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)


def _runs(keys: pa.ChunkedArray) -> np.ndarray:
    """For each row, the first row of its run of equal keys."""
    ids = keys.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.append(True, ids[1:] != ids[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))


def _answers(asks: pa.Table, versions: pa.Table, found: np.ndarray, part: np.ndarray) -> pa.Table:
    """Rows for asks: settled with their version or none, open with the range to look in next."""
    schema = asks.schema
    hit = pa.array(np.maximum(found, 0), mask=found < 0)
    columns = {"_part": pa.array(part, pa.int64()), "_kind": pa.array(np.where(part >= 0, OPEN, SETTLED), pa.int32()), "_k": asks["_k"], "_t": asks["_t"]}
    taken = versions.take(hit) if versions.num_rows else None
    for name in schema.names[4:]:
        columns[name] = taken[name] if taken is not None else pa.nulls(len(found), schema.field(name).type)
    return pa.table([columns[n] for n in schema.names], schema=schema)


def _first_round(life: int):
    """Walks inside a range; passes on open walks, and what later rounds need of this range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        schema = rows.schema
        kind, at, start = _numbers(rows, "_kind"), _numbers(rows, "_t"), _runs(rows["_k"])
        is_version = kind == VERSION
        before = np.cumsum(is_version)  # versions up to each row
        versions, asks, asked = rows.filter(pa.array(is_version)), rows.filter(pa.array(~is_version)), np.flatnonzero(~is_version)
        event, arrival, expiry = (_numbers(versions, c) for c in ("_event", "_arrival", "_expiry"))
        opening = start[asked]
        found = walk(event, arrival, expiry, before[opening] - is_version[opening], before[asked] - 1, at[asked], life)
        goes_on = (found == -2) & (opening == 0) & (at[0] > at[asked] - life) & (part > 0)
        if len(asked):
            yield from _answers(asks, versions, found, np.where(goes_on, part - 1, -1)).to_batches()
        # the end of the last key: its versions that a later question can still reach, and whether its run fills the range
        last, low = start[-1], at[-1] - life
        tail = np.flatnonzero(is_version & (np.arange(len(kind)) >= last) & (at > low))
        reach = at[0] if last == 0 else np.iinfo(np.int64).min
        kept = rows.take(pa.array(tail))
        mark = {"_part": [part], "_kind": [MARK], "_k": [rows["_k"][len(kind) - 1].as_py()], "_t": [int(reach)]}
        yield pa.table([pa.array(mark.get(f.name, [None]), f.type) for f in schema], schema=schema).to_batches()[0]
        own = {"_part": pa.array(np.full(len(tail), part), pa.int64())}
        yield from pa.table([own.get(n, kept[n] if n != "_part" else None) for n in schema.names], schema=schema).to_batches()

    return trimmed(run)


def _next_round(life: int):
    """Goes on with open walks at the end of the range before."""

    def settle(rows: pa.Table) -> pa.Table | None:
        kind, part = _numbers(rows, "_kind"), int(rows["_part"][0].as_py())
        asks, marks, versions = (rows.filter(pa.array(kind == k)) for k in (OPEN, MARK, VERSION))
        if not asks.num_rows:
            return None
        t, before = _numbers(asks, "_t"), part - 1 if part else -1
        if not marks.num_rows:  # nothing lies in this range
            return _answers(asks, versions, np.full(len(t), -2), np.full(len(t), before))
        key = marks["_k"][0]
        same = pc.equal(asks["_k"], key).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        event, arrival, expiry = (_numbers(versions, c) for c in ("_event", "_arrival", "_expiry"))
        start = np.where(same, len(event) - 1, -1)
        found = walk(event, arrival, expiry, np.zeros(len(t), np.int64), start, t, life)
        goes_on = same & (found == -2) & (marks["_t"][0].as_py() > t - life)
        return _answers(asks, versions, found, np.where(goes_on, before, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                if not len(rows):
                    continue
                if held and ids[rows[0]] != part:
                    if (done := settle(pa.Table.from_batches(held))) is not None:
                        yield from done.to_batches()
                    held = []
                part = ids[rows[0]]
                held.append(batch.slice(rows[0], len(rows)))
        if held and (done := settle(pa.Table.from_batches(held))) is not None:
            yield from done.to_batches()

    return trimmed(run)


def as_of(asks: DataFrame, versions: DataFrame, key: str, at: str, tie: str, carry: Sequence[str] = (), event: str = "event", arrival: str = "arrival", expiry: str = "expiry", lifetime: int | None = None, out: str = "version", rows: int = RANGE) -> DataFrame:
    """``asks`` with a struct ``out`` of (event, arrival, expiry, tie, *carry) of the version usable at ``at``, null where there is none.

    Times are whole numbers of one unit. Without ``lifetime`` it is the longest that any version has. ``rows`` is
    about how many rows a range holds.
    """
    spark = asks.sparkSession
    share_code(spark)
    plain = versions.select(F.col(key).alias("_k"), *[F.col(c).cast("long").alias(n) for c, n in ((event, "_event"), (arrival, "_arrival"), (expiry, "_expiry"))], F.col(tie).alias("_tie"), F.struct(*[F.col(c) for c in carry] or [F.lit(True).alias("_")]).alias("_carry"))
    usable = plain.filter("_k is not null and _event is not null and _arrival < _expiry")
    once = usable.groupBy("_k", "_event", "_arrival", "_expiry", "_tie").agg(F.max("_carry").alias("_carry"))
    told = once.select(F.lit(VERSION).alias("_kind"), "_k", F.col("_event").alias("_t"), "_event", "_arrival", "_expiry", "_tie", "_carry")
    asked = asks.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_t")).filter("_k is not null and _t is not null").distinct()
    both = told.unionByName(asked.withColumn("_kind", F.lit(ASK)), allowMissingColumns=True)
    both = stage(both.select(F.lit(0).cast("long").alias("_part"), "_kind", "_k", "_t", "_event", "_arrival", "_expiry", "_tie", "_carry"), "asof-rows")
    whole = both.agg(F.count("*").alias("n"), F.max(F.when(F.col("_kind") == VERSION, F.col("_expiry") - F.col("_event"))).alias("life")).first()
    life = lifetime if lifetime is not None else int(whole["life"] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole["n"] // rows))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in both.schema])
    order = ["_k", "_t", "_kind", "_arrival", "_tie", "_expiry"]
    dealt = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = stage(dealt.mapInArrow(_first_round(life), schema), "asof-round")
    ends, answers = done.filter(F.col("_kind").isin(MARK, VERSION)), done.filter(F.col("_kind") == SETTLED)
    going = done.filter(F.col("_kind") == OPEN)
    while not going.isEmpty():
        # ends of the ranges that are looked into, then the open walks
        wanted = ends.hint("merge").join(going.select("_part").distinct(), "_part", "left_semi")
        meet = wanted.unionByName(going).repartition(parts, "_part").sortWithinPartitions("_part", "_kind", *order[1:2], *order[3:])
        done = stage(meet.select(*schema.names).mapInArrow(_next_round(life), schema), "asof-round")
        answers, going = answers.unionByName(done.filter(F.col("_kind") == SETTLED)), done.filter(F.col("_kind") == OPEN)

    best = F.struct(F.col("_event").alias("event"), F.col("_arrival").alias("arrival"), F.col("_expiry").alias("expiry"), F.col("_tie").alias("tie"), *[F.col(f"_carry.`{c}`").alias(c) for c in carry])
    settled = answers.filter("_event is not null").select("_k", F.col("_t").alias("_at"), best.alias("_best"))
    kept = asks.drop(out)
    found = kept.hint("merge").join(settled.hint("merge"), (kept[key] == settled["_k"]) & (kept[at].cast("long") == settled["_at"]), "left")
    return found.select(*[kept[f"`{c}`"] for c in kept.columns], F.col("_best").alias(out))
