"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than ``chunk`` code points is cut into chunks that overlap by ``overlap``. All chunks are
pre-tokenised in parallel. A match of the pattern depends only on what follows its start, so as soon as
two chunks agree on one boundary inside their overlap they agree from there on: that boundary is where
they are stitched, and each chunk's piece from its stitch to the next one is encoded by itself. Matches
within ``MARGIN`` of a cut end aren't trusted, as more text could change them. A document in which some
pair of chunks never agrees is encoded in one piece. Shorter texts are a single piece.

Pre-tokens are encoded by the ranks' merges, with a bounded cache per worker; decoding joins the
tokens' bytes.

Nulls and edges: null text is empty and has no tokens; repeated rows are encoded one by one; an empty
table gives an empty result; only the id and the text are read. Texts must be valid UTF-8.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.common import trimmed
from quernstone.session import stage

CHUNK, OVERLAP, MARGIN = 1 << 16, 1 << 10, 16
#: Pre-tokens kept in a worker's cache; a full cache starts anew.
CACHE = 200_000
#: Bytes of text in an output batch.
BATCH = 1 << 20


class Vocabulary(dict):
    """Pre-token to ids; a missing one is merged by the ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = tuple(self.core.encode_single_piece(piece.encode()))
        if len(piece) <= 64:
            self[piece] = found
        return found

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable([self[p] for p in self.pattern.findall(text)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def _with_ids(batch: pa.RecordBatch, texts: list[str], v: Vocabulary, keep: list[str]) -> Iterator[pa.RecordBatch]:
    begun, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(v.encode(text))
        size += len(text)
        if size >= BATCH or k == len(texts) - 1:
            lengths = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
            flat = np.frombuffer(b"".join([x.tobytes() for x in held]), dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            part = batch.slice(begun, len(held))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], ids], names=[*keep, "ids"])
            begun, held, size = k + 1, [], 0


def _encoded(rows: DataFrame, keep: list[str], path: str, pattern: str) -> DataFrame:
    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            if batch.num_rows:
                yield from _with_ids(batch, batch["text"].to_pylist(), v, keep)

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])
    return rows.mapInArrow(trimmed(run), schema)


def _zones(pattern: str, chunk: int, overlap: int):
    """For each chunk, where its own matches start in its first and last ``overlap`` code points."""

    def run(batches):
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text, k in zip(batch["text"].to_pylist(), batch["k"].to_pylist()):
                starts = np.fromiter((m.start() for m in compiled.finditer(text)), dtype=np.int64)
                at = starts + k * chunk
                heads.append(at[starts < overlap].tolist())
                tails.append(at[(starts >= chunk) & (starts < len(text) - MARGIN)].tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["k"], pa.array(heads, kind), pa.array(tails, kind)], names=["uid", "k", "head", "tail"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = _encoded(rows.filter(F.length("text") <= chunk), ["doc_id"], path, pattern)

    cut = rows.filter(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id()).withColumn("n", F.length("text").cast("long"))
    last = F.floor((F.col("n") - 1) / chunk).cast("int")
    cut = cut.select("uid", "doc_id", "n", last.alias("last"), F.posexplode(F.sequence(F.lit(0), last)).alias("k", "_"), "text")
    cut = cut.select("uid", "doc_id", "n", "last", "k", F.substr("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
    cut = stage(cut.repartition("uid", "k"), "bpe-chunks")
    zones = stage(cut.mapInArrow(_zones(pattern, chunk, overlap), "uid long, k int, head array<long>, tail array<long>"), "bpe-zones")
    order = Window.partitionBy("uid").orderBy("k")
    stitch = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    at = zones.select("uid", "k", stitch.alias("at"))
    at = at.withColumn("next", F.lead("at").over(order)).withColumn("broken", F.max(F.col("at").isNull()).over(Window.partitionBy("uid")))
    placed = cut.join(at, ["uid", "k"])
    end = F.when(F.col("k") == F.col("last"), F.col("n")).otherwise(F.col("next"))
    base = F.col("k").cast("long") * chunk
    spans = placed.filter(~F.col("broken")).select("uid", "doc_id", "k", F.substr("text", (F.col("at") - base + 1).cast("int"), (end - F.col("at")).cast("int")).alias("text"))
    wholes = placed.filter("broken").groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", F.substr("text", F.lit(1), F.lit(chunk)).alias("text")))).alias("parts"))
    wholes = wholes.select("uid", "doc_id", F.lit(0).alias("k"), F.array_join(F.col("parts.text"), "").alias("text"))
    parts = _encoded(spans.unionByName(wholes), ["uid", "doc_id", "k"], path, pattern)
    long_ = parts.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return short.unionByName(long_.select("doc_id", F.flatten(F.col("parts.ids")).alias("ids")))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Replaces nothing and adds ``decoded``, the bytes that the ids stand for; null ids give null."""
    names = rows.columns

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            done = pa.array([v.decode(x.values.to_pylist()) if x.is_valid else None for x in batch[ids_col]], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, done], names=[*names, "decoded"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "decoded binary"])
    return rows.mapInArrow(trimmed(run), schema)
