"""Centroid clustering by sort-means over whole numbers.

Each round orders, for every centroid, the others by their distance from it. A vector's scan begins at its previous
centroid and goes through that order until a centroid lies strictly beyond twice the vector's distance from
the previous one: by the triangle inequality no later one can be as near. Distances are compared as squares of whole
numbers, so nothing is rounded and ties (the smaller number wins) are exact.

Vectors travel in blocks: one row holds some thousand vectors as a packed matrix, their ids and their present
centroids. A round is one pass over the blocks without a shuffle of vectors: it writes the blocks with their new
centroids to the shared folder, and sums of whole numbers, one row for each task and centroid, are added up by
Spark; only the centroids (``k`` rows) come to the driver. The tables of earlier rounds are deleted.

Nulls and edges: vectors that are null, of another length than ``dim``, or hold null or non-finite components take no
part, nor do those with a component whose scaled value is beyond 2**27, as their distances needn't fit a long; repeated rows
count as often as they come; null ids are clustered but are never initial centroids unless there are too few others; with
fewer vectors than ``k`` there are fewer centroids; no usable vector gives an empty result; only id and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import trimmed
from quernstone.session import share_code, stage, unstage

BLOCK, LIMIT = 4096, 1 << 27
BLOCKS = "kind int, ids binary, valid binary, width int, vecs binary, own binary, cluster int, n long, sums array<long>"
ARROW = pa.schema([("kind", pa.int32()), ("ids", pa.binary()), ("valid", pa.binary()), ("width", pa.int32()), ("vecs", pa.binary()), ("own", pa.binary()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
KEPT, SUM = 0, 1


def usable(vec: Column, dim: int, scale: int) -> Column:
    """Whether a vector takes part."""
    wide = F.coalesce(F.size(vec), F.lit(-1)) == dim
    return wide & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LIMIT))


def whole(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", d, d)


def neighbour_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by squared distance from it (itself first), and those distances."""
    d = np.stack([squared(centroids, c) for c in centroids])
    rank = np.where(np.eye(len(d), dtype=bool), -1, d)
    order = np.argsort(rank, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, axis=1)


def assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector, scanned from its previous centroid."""
    start = np.empty(len(x), np.int64)
    for c in np.unique(own):
        at = own == c
        start[at] = squared(x[at], centroids[c])
    best, least = own.astype(np.int64), start.copy()
    alive = np.arange(len(x))
    for j in range(1, len(centroids)):
        alive = alive[apart[own[alive], j] <= 4 * start[alive]]  # the others stop: this one lies beyond twice the distance
        if not len(alive):
            break
        tried = order[own[alive], j]
        for c in np.unique(tried):
            rows = alive[tried == c]
            d = squared(x[rows], centroids[c])
            nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = c, d[nearer]
    return best, least


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not x.size or np.abs(x).max() < 1 << 15 else 4
    return width, x.astype(f"<i{width}").tobytes()


def _unpacked(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["vecs"], f"<i{row['width']}").reshape(-1, dim)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _blocks(dim: int):
    """Blocks of vectors, all with centroid 0 as their previous one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column("id")
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                width, vecs = _packed(x)
                own = np.zeros(len(x), np.int32)
                yield _batch([{"kind": KEPT, "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "valid": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "width": width, "vecs": vecs, "own": own.tobytes()}])

    return trimmed(run)


def _round(centroids: np.ndarray):
    """Blocks with their new centroids, then this task's sums for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, apart = neighbour_order(centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row, centroids.shape[1])
                best, _ = assign(x, np.frombuffer(row["own"], np.int32), centroids, order, apart)
                for c in np.unique(best):
                    n[c] += (best == c).sum()
                    sums[c] += x[best == c].sum(axis=0, dtype=np.int64)
                yield _batch([row | {"own": best.astype(np.int32).tobytes()}])
        yield _batch([{"kind": SUM, "cluster": int(c), "n": int(n[c]), "sums": sums[c].tolist()} for c in np.flatnonzero(n)])

    return trimmed(run)


def _last(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, apart = neighbour_order(centroids)
        for batch in batches:
            for row in batch.to_pylist():
                best, d = assign(_unpacked(row, centroids.shape[1]), np.frombuffer(row["own"], np.int32), centroids, order, apart)
                known = np.frombuffer(row["valid"], bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], "<i8"), mask=~known), pa.array(best, pa.int32()), pa.array(d)], names=["id", "cluster", "distance"])

    return trimmed(run)


def sort_means(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of each vector, centroids): ``rounds`` of assignment and means over floor(scale * x), then one assignment.

    Initial centroids are the vectors with the smallest SHA-256 of ``seed:id`` in that order (of repeated ids, the smaller vectors first).
    """
    spark = vectors.sparkSession
    share_code(spark)
    kept = vectors.filter(usable(F.col(vec_col), dim, scale)).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vec_col), scale).alias("vec"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(named.asc_nulls_last(), "id", "vec").limit(k).select("vec").collect()
    centroids = np.array([r["vec"] for r in first], np.int64).reshape(-1, dim)
    if not len(first):
        return kept.select("id", F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance")), []

    held: list[str] = []
    state = stage(kept.mapInArrow(_blocks(dim), BLOCKS), "sort-means", held)
    for _ in range(rounds):
        before, held = held, []
        state = stage(state.mapInArrow(_round(centroids), BLOCKS), "sort-means", held)
        totals = state.filter(F.col("kind") == SUM).groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.get("sums", j).cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)])
        for row in totals.collect():  # a row for each centroid
            centroids[row["cluster"]] = [int(row[f"s{j}"]) // int(row["n"]) for j in range(dim)]
        state = state.filter(F.col("kind") == KEPT)
        unstage(spark, before)
    done = stage(state.mapInArrow(_last(centroids), "id long, cluster int, distance long"), "sort-means-result")
    unstage(spark, held)
    return done, centroids.tolist()


def clusters(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
    done, centroids = sort_means(vectors, id_col=id_col, **options)
    sums = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = {c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids)}
    digest = F.get(F.array(*[F.lit(names[c]) for c in sorted(names)] or [F.lit(None).cast("string")]), F.col("cluster"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    per = sums.crossJoin(F.broadcast(total))  # one row for each centroid, and one in all
    return done.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
