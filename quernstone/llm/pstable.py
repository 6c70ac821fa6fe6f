"""Near duplicates among embeddings by Euclidean p-stable hashing, with exact cosines for every link.

Vectors are compared only with those of the same label and length. Nodes are the distinct vectors, so that copies cost
nothing. Each node gets a bucket in each of ``tables`` tables: ``hashes`` Gaussian projections of its unit vector,
shifted and cut into steps of ``width``. Of unit vectors with cosine 0.93 (0.374 apart) two agree in one hash with probability 0.88,
so with 12 hashes and 24 tables they meet with 0.997; from 0.97 on (0.245 apart) with 0.99999.

A bucket is cut into blocks by a hash of the node, and each pair of blocks is a group of its own, so a hot bucket is
spread over tasks and no group grows with the table. Sketches (signs of 128 more projections) tell first which nodes of a group can have a partner at
all; 40 differing bits are over six standard deviations from what vectors at the threshold have. Only those send their vector to the group.
There all cosines are taken in double precision; a pair that meets in several tables counts in the first of them only,
which is known from the vectors alone. A group emits counts of links and an edge from each node to the first it hangs together
with, so its output grows with its nodes, not with their pairs.

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label link with
nothing; equal rows are links of each other; with repeated ids each row counts as a vector of its own; null ids are linked but never
name a component (a component of null ids only has null); ``kept`` is false for null ids; empty tables give no rows; columns other than id, vector and
label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import mix64, trimmed
from quernstone.operators.graph import components
from quernstone.session import share_code, stage

HASHES, TABLES, WIDTH = 12, 24, 2.5
#: Bits of a sketch, how many may differ, and the nodes of a block.
BITS, DIFFER, BLOCK = 128, 40, 1024
SENT = "bucket long, tab int, node long, sketch binary"
SENT_ARROW = pa.schema([("bucket", pa.int64()), ("tab", pa.int32()), ("node", pa.int64()), ("sketch", pa.binary())])
FOUND = "node long, other long, links long"


class Projections:
    """The fixed random projections for vectors of one length."""

    def __init__(self, dim: int, hashes: int, tables: int, width: float, seed: int = 13) -> None:
        rng = np.random.default_rng([seed, dim, hashes, tables])
        self.lines = rng.standard_normal((dim, hashes * tables))
        self.shift = rng.uniform(0, width, hashes * tables)
        self.signs = rng.standard_normal((dim, BITS))
        self.hashes, self.tables, self.width = hashes, tables, width

    def steps(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the steps, (rows, tables, hashes), computed row by row so that a vector's steps don't depend on its batch."""
        cut = np.stack([u @ self.lines for u in unit]) if len(unit) else np.zeros((0, self.lines.shape[1]))
        return np.floor((cut + self.shift) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.hashes)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit key of each row's bucket in each table."""
        steps, out = self.steps(unit), np.zeros((len(unit), self.tables), np.uint64)
        for j in range(self.hashes):
            out = mix64(out * np.uint64(31) + steps[:, :, j].astype(np.uint64) + np.uint64(1))
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1)


_KNOWN: dict[tuple, Projections] = {}


def projections(*options) -> Projections:
    if options not in _KNOWN:
        _KNOWN[options] = Projections(*options)
    return _KNOWN[options]


def units(vec: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither vanish nor overflow."""
    scaled = vec / np.abs(vec).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _usable(vec: Column, label: Column) -> Column:
    clean = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & clean, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), batch.filter(pa.array(sizes == dim))


def _dealt(*options):
    """A row for each node and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim, batch in _by_dim(whole, "vec"):
                p, unit = projections(dim, *options), units(_matrix(batch.column("vec"), dim))
                # the label's hash goes into the key: labels and lengths never share a bucket but by a collision of 64 bits, and pairs are compared by ``grp`` again
                grp = batch.column("grp").to_numpy().astype(np.uint64)
                keys = mix64(p.keys(unit) ^ grp[:, None])
                n, tables = keys.shape
                sketch = pa.array([s.tobytes() for s in p.sketch(unit)], pa.binary())
                again = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), batch.column("node").take(again), sketch.take(again)], schema=SENT_ARROW)

    return trimmed(run)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and tuple(ids[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(ids[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of_blocks(home: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows on either side of a group of two blocks; in a block with itself both sides are all rows."""
    return np.flatnonzero(home == low), np.flatnonzero(home == high)


_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each group whose sketch is near that of another."""
    for rows in _groups(batches, ["bucket", "tab", "low", "high"]):
        home, low, high = rows["home"].to_numpy(), rows["low"][0].as_py(), rows["high"][0].as_py()
        a, b = _pairs_of_blocks(home, low, high)
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
        near_a, near_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for at in range(0, len(a), 64):
            differ = _ONES[sketch[a[at : at + 64], None, :] ^ sketch[None, b, :]].sum(axis=2, dtype=np.uint16) <= DIFFER
            if low == high:
                differ[np.arange(differ.shape[0]), np.arange(at, at + differ.shape[0])] = False
            near_a[at : at + 64] |= differ.any(axis=1)
            near_b |= differ.any(axis=0)
        keep = np.union1d(a[near_a], b[near_b])
        if len(keep):
            yield from rows.select(["bucket", "tab", "low", "high", "home", "node"]).take(pa.array(keep)).combine_chunks().to_batches()


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of ``linked`` the smallest row it hangs together with (the number of rows where there is none)."""
    rows, columns = np.arange(linked.shape[0]), np.full(linked.shape[1], linked.shape[0])
    rows[~linked.any(axis=1)] = linked.shape[0]
    while True:
        columns = np.minimum(columns, np.where(linked, rows[:, None], linked.shape[0]).min(axis=0, initial=linked.shape[0]))
        now = np.minimum(rows, np.where(linked, columns[None, :], linked.shape[0]).min(axis=1, initial=linked.shape[0]))
        if (now == rows).all():
            return rows, columns
        rows = now


def _linked(cosine: float, *options):
    """Counts of links of each node of a group, and edges that join what they join."""

    def group(rows: pa.Table) -> Iterator[tuple]:
        home, node, copies, grp = (rows[c].to_numpy() for c in ("home", "node", "copies", "grp"))
        low, high, tab = rows["low"][0].as_py(), rows["high"][0].as_py(), rows["tab"][0].as_py()
        lengths = rows["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            own = np.flatnonzero(lengths == dim)
            if len(own) < 2:
                continue
            unit = units(_matrix(rows["vec"].combine_chunks().take(pa.array(own)), int(dim)))
            keys = projections(int(dim), *options).keys(unit)
            a, b = _pairs_of_blocks(home[own], low, high)
            links = np.zeros(len(own), np.int64)
            good = (unit[a] @ unit[b].T >= cosine) & (grp[own][a][:, None] == grp[own][b][None, :])
            if low == high:
                good &= a[:, None] < b[None, :]  # each pair once
            for t in range(tab):
                if not good.any():
                    break
                good &= keys[a, t][:, None] != keys[b, t][None, :]
            if not good.any():
                continue
            np.add.at(links, a, good @ copies[own][b])
            np.add.at(links, b, copies[own][a] @ good)
            for side, roots in zip((a, b), _roots(good)):
                for x in np.flatnonzero(roots < len(a)):
                    if side[x] != a[roots[x]]:
                        yield int(node[own][side[x]]), int(node[own][a[roots[x]]]), 0
            for x in np.flatnonzero(links):
                yield int(node[own][x]), None, int(links[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["bucket", "tab", "low", "high"]):
            found = list(group(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)], names=["node", "other", "links"])

    return trimmed(run)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, hashes: int = HASHES, tables: int = TABLES, width: float = WIDTH, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row of ``vectors``: links are pairs that met with a cosine of at least ``cosine``."""
    spark, options = vectors.sparkSession, (hashes, tables, width)
    share_code(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(_usable(F.col(vec_col), F.col(label_col)), F.col(vec_col)).alias("vec"), F.col(label_col).alias("label"))
    grp = F.when(F.col("vec").isNotNull(), F.xxhash64("label", F.size("vec")))
    rows = rows.withColumn("grp", grp).withColumn("ka", F.xxhash64("vec")).withColumn("kb", F.xxhash64(F.lit(1), "vec"))
    known = rows.filter("vec is not null")
    nodes = known.groupBy("grp", "ka", "kb").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "pstable-nodes")

    dealt = stage(nodes.select("node", "grp", "vec").mapInArrow(_dealt(*options), SENT), "pstable-buckets")
    sizes = dealt.groupBy("bucket", "tab").agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    placed = dealt.hint("merge").join(sizes.hint("merge"), ["bucket", "tab"]).withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", "tab", F.least("home", "with").alias("low"), F.greatest("home", "with").alias("high"), "home", "node", "sketch")
    group = ["bucket", "tab", "low", "high"]
    sieved = placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(trimmed(_plausible), "bucket long, tab int, low int, high int, home int, node long")
    sieved = stage(sieved, "pstable-plausible")
    filled = sieved.hint("merge").join(nodes.hint("merge").select("node", "grp", "copies", "vec"), "node")
    found = filled.repartition(*group).sortWithinPartitions(*group).mapInArrow(_linked(cosine, *options), FOUND)
    found = stage(found, "pstable-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null"), "node", "other", nodes=nodes.select("node"))
    named = nodes.drop("vec").hint("merge").join(joined.hint("merge"), "node").join(links.hint("merge"), "node", "left")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(named.hint("merge").join(least.hint("merge"), "component").select("grp", "ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "pstable-named")
    linked = known.select("id", "grp", "ka", "kb").hint("merge").join(named.hint("merge"), ["grp", "ka", "kb"]).select("id", "n_links", "component_id")
    alone = rows.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
