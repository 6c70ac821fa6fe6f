"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import stage, unstage

#: So few edges, whatever the input, are followed to their end by one task instead of in further rounds.
REST = 1 << 14


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of a bounded rest of edges: each node and one node of its component."""
    above, names = {}, None

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        names = pa.schema([pa.field("node", batch.schema.field("u").type), pa.field("to", batch.schema.field("u").type)])
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            above.setdefault(u, u)
            above.setdefault(v, v)
            above[top(u)] = top(v)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(above, names.field("node").type), pa.array([top(x) for x in above], names.field("to").type)], schema=names)


def _rank(node: str, seed: int) -> Column:
    """The order of nodes in one round: by chance, but the same in every run."""
    return F.struct(F.xxhash64(F.lit(seed), node).alias("h"), F.col(node).alias("node"))


def components(edges: DataFrame, left: str = "left", right: str = "right", nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` with an end other than itself; component is the smallest node.

    Contraction in random order: every node goes over to the first of itself and its neighbours, in an order that each round draws anew, and
    edges between those that are left go into the next round. So rounds shrink (their number grows with the logarithm of the
    largest component, their sum with the edges) until at most ``REST`` edges are left. Joins are on nodes of a round, whose rows are no more than its neighbours: a
    component that holds almost all nodes is no key of a join or a sort, and its smallest node is carried along by
    partial minima. Rounds are written to the shared folder, and then read back from the last to the first. Rows with a null end
    and loops are ignored. With ``nodes`` (node), those without an edge are components of their own.
    """
    spark, held, rounds = edges.sparkSession, [], []
    start = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null and u <> v")
    current = stage(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", held)
    least = None
    while n := current.count():
        seed, before, held = len(rounds), held, []
        if n <= REST:
            kind = current.schema["u"].dataType.simpleString()
            first = current.coalesce(1).mapInArrow(_ends, f"node {kind}, to {kind}")
        else:
            both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            first = both.groupBy("u").agg(F.min(_rank("v", seed)).alias("m")).select(F.col("u").alias("node"), F.least("m", _rank("u", seed))["node"].alias("to"))
        moves = first.withColumn("least", F.col("node")) if least is None else first.join(least, "node")
        moves = stage(moves, "moves")
        rounds.append(moves)
        if n <= REST:
            unstage(spark, before)
            break
        to = moves.select("node", "to")
        over = current.join(to.toDF("u", "a"), "u").join(to.toDF("v", "b"), "v").filter("a <> b")
        current = stage(over.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", held)
        least = moves.groupBy("to").agg(F.min("least").alias("least")).select(F.col("to").alias("node"), "least")
        unstage(spark, before)
    if not rounds:
        found = start.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    else:
        found = None
    for k, moves in reversed(list(enumerate(rounds))):
        ends = moves.groupBy("to").agg(F.min("least").alias("component"))
        if found is not None:
            # those that went on have their component from the round after
            ends = ends.join(found.toDF("to", "later"), "to", "left").select("to", F.coalesce("later", "component").alias("component"))
        found = moves.join(ends, "to").select("node", "component")
        found = stage(found, "labels") if k else found
    if nodes is None:
        return found
    alone = nodes.select("node").filter("node is not null").distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
