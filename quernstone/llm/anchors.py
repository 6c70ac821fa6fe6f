"""Removal of repeated word windows, found from fixed-block anchors.

Every document's words are cut into non-overlapping blocks of half a window; any window holds one whole
block of each document it occurs in. The blocks form the index, partitioned by hash; every rolling
window of a block's length in every document probes it. A hit is extended to both sides, as far as a
window reaches: each window around it counts when its own hash, over all its words, occurs at another
place too, and neighbouring ones join to the longest stretches of repeated windows (``repeats``). Pairs
of occurrences aren't extended against each other word by word: a passage that m documents share would
take m * m of them. Hashes travel in packed arrays (see ``exchange``): about five bytes a
probe, of which 31 bits and the bucket tell blocks apart (a false hit only makes more candidates), and
63 bits and the bucket for windows. Texts are dealt once, to a table bucketed by row, where the answers
meet them; one that is longer than a chunk is worked on slice by slice.

Nulls and edges: null text has no words; a document shorter than a window has none; occurrences in the
same document count, overlapping ones too; rows with the same id and text each count as an occurrence
and get equal results; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import exchange as x
from quernstone.llm.common import chunked, hashed_words, segments, spans_hash, strings, trimmed, with_row_key
from quernstone.session import stage, stage_by

CHUNK, BUCKET = 1 << 20, 4_000_000
#: Words worked on at once, bytes of text in a partition, bytes of a text that is cut by segments.
WORDS, PARTITION, LONG = 1 << 18, 32 << 20, 1 << 22
PER_DOC = "_i long, _h long, at binary"


def _spans(first: np.ndarray, hashes: np.ndarray, window: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: where spans of ``length`` words start in documents of at least ``window`` words, their documents, their hashes."""
    counts = np.diff(first)
    for low in range(0, len(hashes), WORDS):
        at = np.arange(low, min(low + WORDS, len(hashes)))
        doc = np.searchsorted(first, at, side="right") - 1
        fits = (at + length <= first[doc + 1]) & (counts[doc] >= window)
        at, doc = at[fits], doc[fits]
        if len(at):
            yield at, doc, spans_hash(hashes[low : low + WORDS + length], at - low, at - low + length)


def _probe(window: int, buckets: int):
    length = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in zip(x.chunk_numbers(), chunked(batches, CHUNK)):
            hashes, first = hashed_words(*strings(table["text"]))
            some = False
            for at, doc, k in _spans(first, hashes, window, length):
                some = True
                block = (at - first[doc]) % length == 0
                bucket, rest = (k % np.uint64(buckets)).astype(np.int64), ((k // np.uint64(buckets)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                for b, own in x.by_bucket(bucket):
                    index, counts = np.unique(rest[own][block[own]], return_counts=True)
                    rows = [(b, x.PROBE, chunk, ((rest[own] << np.uint32(1)) | block[own]).tobytes(), x.pack(at[own]), None, None)]
                    if len(index):
                        rows.append((b, x.INDEX, chunk, ((index << np.uint32(1)) | (counts > 1)).astype(np.uint32).tobytes(), None, None, None))
                    yield x.sent(rows)
            if some:
                yield x.sent([x.directory(chunk, buckets, table, first)])

    return trimmed(run)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes that equal a block at another place."""
    for _, rows in x.buckets_of(batches):
        held, index, many = [], None, None
        for row in rows:
            if row["kind"] == x.INDEX:
                held.append(np.frombuffer(row["a"], np.uint32))
                continue
            if row["kind"] != x.PROBE:
                yield x.back([x.passed_on(row)])
                continue
            if index is None:
                flagged = np.concatenate([*held, np.zeros(0, np.uint32)])
                index, inverse = np.unique(flagged >> np.uint32(1), return_inverse=True)
                many = np.bincount(inverse, weights=1 + (flagged & np.uint32(1)), minlength=len(index)) > 1
            if len(index) == 0:
                continue
            keys = np.frombuffer(row["a"], np.uint32)
            rest, own = keys >> np.uint32(1), (keys & np.uint32(1)).astype(bool)
            place = np.minimum(np.searchsorted(index, rest), len(index) - 1)
            hit = (index[place] == rest) & (many[place] | ~own)
            if hit.any():
                yield x.back([(row["chunk"], x.PROBE, x.pack(x.unpack(row["b"])[hit]), None, None)])


def _spread(i: np.ndarray, h: np.ndarray, starts: np.ndarray, answers: list[dict]) -> pa.Table:
    at = np.sort(np.concatenate([*[x.unpack(r["a"]) for r in answers], np.zeros(0, np.int64)]))
    doc = np.searchsorted(starts, at, side="right") - 1
    own, begin = np.unique(doc, return_index=True)
    found = [x.pack(at[a:b] - starts[d]) for d, a, b in zip(own, begin, np.append(begin[1:], len(at)))]
    return pa.table({"_i": pa.array(i[own]), "_h": pa.array(h[own]), "at": pa.array(found, pa.binary())})


def _candidates(window: int, buckets: int):
    length = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in zip(x.chunk_numbers(), chunked(batches, CHUNK)):
            hashes, first = hashed_words(*strings(table["text"]))
            before = np.zeros(len(hashes) + 1, np.int32)
            for k, at in enumerate(table["at"].to_pylist()):
                before[1 + first[k] + x.unpack(at)] = 1
            np.cumsum(before, out=before)
            some = False
            for at, _, k in _spans(first, hashes, window, window):
                near = before[at + window - length + 1] > before[at]
                at, k = at[near], k[near]
                if len(at) == 0:
                    continue
                some = True
                unique, begin, inverse, counts = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
                several = counts[inverse] > 1
                single = np.sort(begin[counts == 1])
                bucket = (k[single] % np.uint64(buckets)).astype(np.int64)
                rest = k[single] // np.uint64(buckets)
                known = unique[counts > 1]
                known_bucket, known_rest = (known % np.uint64(buckets)).astype(np.int64), known // np.uint64(buckets)
                for b, own in x.by_bucket(bucket):
                    yield x.sent([(b, x.PROBE, chunk, rest[own].tobytes(), x.pack(at[single][own]), None, None)])
                for b, own in x.by_bucket(known_bucket):
                    yield x.sent([(b, x.INDEX, chunk, known_rest[own].tobytes(), None, None, None)])
                if several.any():
                    yield x.sent([(chunk % buckets, x.SETTLED, chunk, x.pack(at[several]), None, None, None)])
            if some:
                yield x.sent([x.directory(chunk, buckets, table, first)])

    return trimmed(run)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate windows whose hash occurs elsewhere; INDEX rows hold hashes that a chunk has twice itself."""
    for _, rows in x.buckets_of(batches):
        known, held = [np.zeros(0, np.uint64)], []
        for row in rows:
            if row["kind"] == x.INDEX:
                known.append(np.frombuffer(row["a"], np.uint64))
            elif row["kind"] == x.PROBE:
                held.append((row["chunk"], np.frombuffer(row["a"], np.uint64), row["b"]))
            else:
                yield x.back([x.passed_on(row)])
        if not held:
            continue
        keys, counts = np.unique(np.concatenate([np.repeat(np.concatenate(known), 2), *[k for _, k, _ in held]]), return_counts=True)
        twice = keys[counts > 1]
        for chunk, own, at in held:
            place = np.minimum(np.searchsorted(twice, own), max(0, len(twice) - 1))
            hit = twice[place] == own if len(twice) else np.zeros(len(own), bool)
            if hit.any():
                yield x.back([(chunk, x.PROBE, x.pack(x.unpack(at)[hit]), None, None)])


def _stretches(at: np.ndarray, window: int) -> np.ndarray:
    """(start, end) of the stretches that windows at ascending places cover."""
    new = np.flatnonzero(np.diff(at, prepend=-window - 1) > window)
    return np.stack([at[new], at[np.append(new[1:], len(at)) - 1] + window], axis=1)


def _without(body: bytes, gone: np.ndarray) -> tuple[int, bytes]:
    """How many words a text has, and those outside the stretches ``gone``, joined by one space."""
    if len(body) < LONG:
        words = body.split()
        keep = np.ones(len(words), bool)
        for start, end in gone.tolist():
            keep[start:end] = False
        return len(words), b" ".join(compress(words, keep) if len(gone) else words)
    data, count, out = np.frombuffer(body, np.uint8), 0, []
    edges = gone.ravel()
    for low, high, starts, ends in segments(data, np.array([0, len(data)])):
        inside = np.searchsorted(edges, np.arange(count, count + len(starts)), side="right") % 2 == 1
        count += len(starts)
        starts, size = starts[~inside], (ends - starts)[~inside]
        spaced = np.cumsum(size + 1)
        text = np.full(spaced[-1] if len(spaced) else 0, 32, np.uint8)
        place = np.arange(size.sum())
        of = np.repeat(np.arange(len(size)), size)
        inner = place - (np.cumsum(size) - size)[of]
        text[(spaced - size - 1)[of] + inner] = data[low:high][starts[of] + inner]
        out.append(text.tobytes())
    return count, b"".join(out)[:-1]


KEPT = "n_words long, n_removed long, kept string, repeats array<struct<start:long,end:long>>"


def _kept(window: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 2), np.int64)
        for batch in batches:
            texts, begin, held, size = batch["text"].cast(pa.binary()), 0, [], 0
            for k, at in enumerate(batch["wins"]):
                body = texts[k].as_py() or b""
                gone = _stretches(x.unpack(at.as_py()), window) if at.is_valid else none
                held.append((*_without(body, gone), gone))
                size += len(body)
                if size > CHUNK or k == batch.num_rows - 1:
                    n, kept, all_gone = zip(*held)
                    columns = [pa.array(n, pa.int64()), pa.array([int((g[:, 1] - g[:, 0]).sum()) for g in all_gone], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                    columns.append(pa.array([[{"start": a, "end": b} for a, b in g.tolist()] for g in all_gone], spans))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(begin, len(held)), *columns], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])
                    begin, held, size = k + 1, [], 0

    return trimmed(run)


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats): ``kept`` are the words left, joined by one space; ``repeats`` the stretches removed."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows = rows.withColumn("_i", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    total, keys = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, ["_i", "_h"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION)
    buckets = max(parts, int(total / 6) // BUCKET)
    rows = stage_by(rows, "anchor-rows", parts, keys)
    hits = x.meet(rows.select(*keys, "text").mapInArrow(_probe(window, buckets), x.SENT), buckets, _hits)
    hits = stage(x.documents_of(hits, _spread, PER_DOC).dropDuplicates(keys), "anchor-hits")
    placed = rows.join(hits, keys, "left")
    sent = placed.filter("at is not null").select(*keys, "text", "at").mapInArrow(_candidates(window, buckets), x.SENT)
    wins = x.documents_of(x.meet(sent, buckets, _repeats), _spread, PER_DOC).dropDuplicates(keys).withColumnRenamed("at", "wins")
    done = placed.join(wins, keys, "left").select("doc_id", "text", "wins")
    return done.mapInArrow(_kept(window), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {KEPT}")
