"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``span // 2`` bytes sets the triggers: in the stretch of every ``span``-byte string
the smallest hash is its trigger. Consecutive strings with one trigger form a phrase, which reaches from
the first of them to the end of the last; phrases overlap by ``span - 1`` bytes, so every string of
``span`` bytes lies in exactly one phrase, and equal strings lie at the same place beside equal triggers.
The corpus is thus a parse (a sequence of phrases) over a dictionary (the distinct phrases).

Corpus order is put together from the two, as far as ``span`` bytes need it. The parse's suffixes are
sorted by their first phrase and then by place: of each phrase that gives its first occurrence, and all
strings of the others start earlier, too. The dictionary's suffixes are sorted by their first ``span``
bytes: a suffix array by prefix doubling, in which equal strings get equal ranks. A string's first place
is then the least, in corpus order, among the first occurrences of the phrases that hold its rank.

Equal strings have equal triggers, so both sorts are done bucket by bucket of the triggers' hashes, and
dictionary phrases whose trigger has no other phrase needn't be sorted. A trigger with more than ``HOT``
phrases (the edge of a passage that very many texts share) would be one bucket's load: its strings are
dealt by their own 64-bit hash instead. Phrases are told apart by 80 bits and the bucket, dictionary
strings by their bytes. Texts longer than a chunk are parsed piece by piece, and the texts are dealt
once, to a table bucketed by row, where the answers meet them.

Nulls and edges: null text is empty; texts shorter than ``span`` have no string; null ids come first;
rows of one id should have one text: repeated rows get equal results, that of their first; an empty
table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import exchange as x
from quernstone.llm.common import chunked, mix64, spans_hash, strings, trimmed, with_row_key
from quernstone.session import stage, stage_by

CHUNK, BUCKET = 1 << 20, 1_000_000
#: Bytes of text in a partition, and of the dictionary in a bucket.
PARTITION, DICTIONARY = 32 << 20, 4 << 20
#: Phrases of one trigger that are sorted as text.
HOT = 5000
LOWEST = -(1 << 63)
#: Bits of a sort key that hold a place; the rest are the upper bits of the hash.
PLACE = np.uint64(31)
PER_DOC = "_i long, _h long, at binary, extra binary, need binary, hot binary, asked long"


class Phrases:
    """The phrases of a chunk: first and last start of a string, trigger's hash, phrase's hash, row."""

    def __init__(self, table: pa.Table, span: int):
        self.data, self.offsets = strings(table["text"])
        found = [self._piece(low, span) for low in range(0, max(1, len(self.data) - span + 1), CHUNK)]
        self.low, self.high, self.s, self.e = (np.concatenate(c) for c in zip(*found))
        self.doc = np.searchsorted(self.offsets, self.low, side="right") - 1

    def _piece(self, low: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The phrases of the strings that start in the ``CHUNK`` bytes from ``low``."""
        data = self.data[low : low + CHUNK + span - 1]
        m, k = len(data), span // 2
        none = np.zeros(0, np.int64)
        if m < span:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        at = np.arange(m - k + 1)
        h = spans_hash(data, at, at + k)
        width = span - k + 1
        key = ((h >> PLACE) << PLACE) | at.astype(np.uint64)
        padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = m - span + 1
        least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        trigger = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
        # a string is valid if it lies in one row
        rows = np.arange(np.searchsorted(self.offsets, low, side="right") - 1, np.searchsorted(self.offsets, low + starts))
        begin, stop = np.maximum(self.offsets[rows] - low, 0), np.minimum(self.offsets[rows + 1] - span + 1 - low, starts)
        edge = np.zeros(starts + 1, np.int8)
        np.add.at(edge, begin[stop > begin], 1)
        np.add.at(edge, stop[stop > begin], -1)
        valid = np.flatnonzero(np.cumsum(edge[:starts], dtype=np.int8))
        if len(valid) == 0:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        new = np.concatenate([[True], (trigger[valid][1:] != trigger[valid][:-1]) | (np.diff(valid) != 1)])
        begin = np.flatnonzero(new)
        first, last = valid[begin], valid[np.append(begin[1:], len(valid)) - 1]
        shape = (trigger[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return first + low, last + low, h[trigger[first]], mix64(spans_hash(data, first, last + span) + shape)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Each position's rank among all by its first ``length`` bytes (zeros follow the end), by prefix doubling."""

    def dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        return rank

    n, known = len(data), min(8, length)
    padded = np.concatenate([data, np.zeros(known, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key = (key << np.uint64(8)) | padded[j : j + n]
    rank = dense(key)
    while known < length:
        step = min(known, length - known)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = dense(rank * (n + 1) + after + 1)
        known += step
    return rank


def _parse(span: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in zip(x.chunk_numbers(), chunked(batches, CHUNK)):
            p = Phrases(table, span)
            if len(p.low) == 0:
                continue
            ids = table["_i"].to_numpy()
            order = np.argsort(ids[p.doc], kind="stable")
            both = mix64(p.s) + p.e
            first = np.zeros(len(both), bool)
            first[order[np.unique(both[order], return_index=True)[1]]] = True
            extra = (p.high - p.low).astype(np.uint8)
            bucket = (p.s % np.uint64(buckets)).astype(np.int64)
            rest = (p.s // np.uint64(buckets)).astype(np.uint32)
            own_first = np.flatnonzero(first)
            for b, k in x.by_bucket(bucket[own_first]):
                k = own_first[k]
                doc, counts = np.unique(p.doc[k], return_counts=True)
                e = np.ascontiguousarray(p.e[k]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                who = x.pack_long(ids[doc])
                head = np.array([len(k), len(doc), len(who)], np.int64).tobytes()
                yield x.sent([(b, x.PROBE, chunk, rest[k].tobytes() + e, x.pack(p.low[k]), extra[k].tobytes(), head + who + counts.astype(np.uint32).tobytes())])
            if not first.all():
                yield x.sent([(chunk % buckets, x.SETTLED, chunk, x.pack(p.low[~first]), extra[~first].tobytes(), None, None)])
            yield x.sent([x.directory(chunk, buckets, table, p.offsets)])

    return trimmed(run)


def _wide(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _order(hot: int):
    """Which phrase occurrences have an earlier one, and which first ones share a trigger with other phrases (or with very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in x.buckets_of(batches):
            s, e, who, at, extra, of, chunks = [], [], [], [], [], [], []
            for row in rows:
                if row["kind"] != x.PROBE:
                    yield x.back([x.passed_on(row)])
                    continue
                n, docs, size = np.frombuffer(row["d"][:24], np.int64)
                ids, counts = x.unpack_long(row["d"][24 : 24 + size]), np.frombuffer(row["d"][24 + size :], np.uint32)
                s.append(np.frombuffer(row["a"][: 4 * n], np.uint32))
                e.append(_wide(row["a"][4 * n :]))
                who.append(np.repeat(ids, counts))
                at.append(x.unpack(row["b"]))
                extra.append(np.frombuffer(row["c"], np.uint8))
                of.append(np.full(n, len(chunks)))
                chunks.append(row["chunk"])
            if not s:
                continue
            s, e, who, at, extra, of = map(np.concatenate, (s, e, who, at, extra, of))
            order = np.lexsort((of, at, who, e, s))
            new_s = np.concatenate([[True], np.diff(s[order].astype(np.int64)) != 0])
            new = new_s | np.concatenate([[True], e[order][1:] != e[order][:-1]])
            group = np.cumsum(new_s) - 1
            phrases = np.bincount(group, weights=new)[group]
            status = np.zeros(len(s), np.int8)
            status[order] = np.where(~new, 1, np.where(phrases > hot, 3, np.where(phrases > 1, 2, 0)))
            told = np.flatnonzero(status)
            for c, k in x.by_bucket(of[told]):
                k = told[k]
                gone, open_, many = (k[status[k] == v] for v in (1, 2, 3))
                gone = gone[np.argsort(at[gone])]
                yield x.back([(chunks[c], x.PROBE, x.pack(at[gone]), extra[gone].tobytes(), x.pack(np.sort(at[open_])))])
                if len(many):
                    yield x.back([(chunks[c], x.WINDOWS, None, None, x.pack(np.sort(at[many])))])

    return run


def _spread(i: np.ndarray, h: np.ndarray, starts: np.ndarray, answers: list[dict]) -> pa.Table:
    none = np.zeros(0, np.int64)
    at = np.concatenate([*[x.unpack(r["a"]) for r in answers if r["a"]], none])
    extra = np.concatenate([*[np.frombuffer(r["b"] or b"", np.uint8) for r in answers], np.zeros(0, np.uint8)])
    need, hot = (np.sort(np.concatenate([*[x.unpack(r["c"]) for r in answers if r["c"] and (r["kind"] == x.WINDOWS) == w], none])) for w in (False, True))
    order = np.argsort(at, kind="stable")
    at = at[order]
    extra = extra[order] if len(extra) else extra
    own = np.unique(np.searchsorted(starts, np.concatenate([at, need, hot]), side="right") - 1)
    out = []
    for d in own:
        a, b = np.searchsorted(at, [starts[d], starts[d + 1]])
        asked = [some[slice(*np.searchsorted(some, [starts[d], starts[d + 1]]))] - starts[d] for some in (need, hot)]
        out.append((x.pack(at[a:b] - starts[d]), extra[a:b].tobytes(), *[x.pack(some) if len(some) else None for some in asked], sum(map(len, asked))))
    columns = list(zip(*out)) or [()] * 5
    packed = {n: pa.array(list(c), pa.binary()) for n, c in zip(("at", "extra", "need", "hot"), columns)}
    return pa.table({"_i": pa.array(i[own]), "_h": pa.array(h[own]), **packed, "asked": pa.array(list(columns[4]), pa.int64())})


def _dictionary(span: int, buckets: int):
    """Sends the text of the phrases asked for, and of hot triggers each string's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in zip(x.chunk_numbers(), chunked(batches, CHUNK)):
            p = Phrases(table, span)
            if len(p.low) == 0:
                continue
            ids = table["_i"].to_numpy()
            need, hot = (np.concatenate([p.offsets[k] + x.unpack(at) for k, at in enumerate(table[c].to_pylist()) if at] or [np.zeros(0, np.int64)]) for c in ("need", "hot"))
            kept = np.flatnonzero(np.isin(p.low, need))
            bucket = (p.s[kept] % np.uint64(buckets)).astype(np.int64)
            for b, k in x.by_bucket(bucket):
                k = kept[k]
                size = p.high[k] - p.low[k] + span
                begin = np.cumsum(size) - size
                body = p.data[np.repeat(p.low[k] - begin, size) + np.arange(size.sum())].tobytes()
                yield x.sent([(b, x.PROBE, chunk, body, (p.high[k] - p.low[k]).astype(np.uint8).tobytes(), x.pack(p.low[k]), x.pack_long(ids[p.doc[k]]))])
            many = np.flatnonzero(np.isin(p.low, hot))
            if len(many):
                count = p.high[many] - p.low[many] + 1
                at = np.repeat(p.low[many] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                who, h = ids[np.repeat(p.doc[many], count)], spans_hash(p.data, at, at + span)
                order = np.lexsort((at, who))
                first = np.zeros(len(at), bool)
                first[order[np.unique(h[order], return_index=True)[1]]] = True
                if not first.all():
                    yield x.sent([(chunk % buckets, x.SETTLED, chunk, x.pack(at[~first]), None, None, None)])
                single = np.flatnonzero(first)
                for b, k in x.by_bucket((h[single] % np.uint64(buckets)).astype(np.int64)):
                    k = single[k]
                    yield x.sent([(b, x.WINDOWS, chunk, h[k].tobytes(), None, x.pack(at[k]), x.pack_long(who[k]))])
            yield x.sent([x.directory(chunk, buckets, table, p.offsets)])

    return trimmed(run)


def _later(key: np.ndarray, who: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Indices of those entries that have an equal key earlier in corpus order."""
    order = np.lexsort((of, at, who, key))
    return np.sort(order[1:][key[order][1:] == key[order][:-1]])


def _suffixes(span: int):
    """Sorts the suffixes of a bucket's phrases; all but the first of equal ones repeat an earlier string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in x.buckets_of(batches):
            texts, sizes, who, at, hashes, chunks = [], [], {x.PROBE: [], x.WINDOWS: []}, {x.PROBE: [], x.WINDOWS: []}, [], {x.PROBE: [], x.WINDOWS: []}
            for row in rows:
                kind = row["kind"]
                if kind not in who:
                    yield x.back([x.passed_on(row)])
                    continue
                if kind == x.PROBE:
                    texts.append(np.frombuffer(row["a"], np.uint8))
                    sizes.append(np.frombuffer(row["b"], np.uint8).astype(np.int64))
                else:
                    hashes.append(np.frombuffer(row["a"], np.uint64))
                who[kind].append(x.unpack_long(row["d"]))
                at[kind].append(x.unpack(row["c"]))
                chunks[kind].append(row["chunk"])
            for kind in (x.PROBE, x.WINDOWS):
                if not chunks[kind]:
                    continue
                of = np.repeat(np.arange(len(chunks[kind])), [len(a) for a in at[kind]])
                ids, place = np.concatenate(who[kind]), np.concatenate(at[kind])
                if kind == x.PROBE:
                    more = np.concatenate(sizes)
                    size, count = more + span, more + 1
                    phrase = np.repeat(np.arange(len(more)), count)
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    key = suffix_ranks(np.concatenate(texts), span)[(np.cumsum(size) - size)[phrase] + step]
                    of, ids, place = of[phrase], ids[phrase], place[phrase] + step
                    several = np.flatnonzero((np.bincount(key) > 1)[key])
                    told = several[_later(key[several], ids[several], place[several], of[several])]
                else:
                    told = _later(np.concatenate(hashes), ids, place, of)
                for c, k in x.by_bucket(of[told]):
                    yield x.back([(chunks[kind][c], x.PROBE, x.pack(np.sort(place[told[k]])), None, None)])

    return run


def _kept(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            begin, held, counts, size = 0, [], [], 0
            for k in range(batch.num_rows):
                body = texts[k].as_py() or b""
                length, gone = len(body), np.zeros((2, 0), np.int64)
                at, wins = batch["at"][k].as_py(), batch["wins"][k].as_py()
                if at is not None or wins is not None:
                    start = np.concatenate([x.unpack(a) for a in (at, wins) if a is not None])
                    end = start + span
                    if at is not None:
                        more = np.frombuffer(batch["extra"][k].as_py(), np.uint8)
                        end[: len(more)] += more
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])[: len(start)])
                    gone = np.stack([start[new], end[np.append(new[1:], len(end)) - 1]]) if len(start) else gone
                    left = zip([0, *gone[1].tolist()], [*gone[0].tolist(), length])
                    body = b"".join([body[a:b] for a, b in left])
                held.append(body)
                counts.append((length, int((gone[1] - gone[0]).sum()), gone.shape[1]))
                size += length
                if size > CHUNK or k == batch.num_rows - 1:
                    n, r, s = zip(*counts)
                    columns = [batch["doc_id"].slice(begin, len(held)), *[pa.array(c, pa.int64()) for c in (n, r, s)], pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                    begin, held, counts, size = k + 1, [], [], 0

    return trimmed(run)


def remove_repeats(docs: DataFrame, span: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of ``docs``; ``span`` is at most 400."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows = rows.withColumn("_i", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    total, keys = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, ["_i", "_h"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION)
    buckets = max(parts, int(total * 4 // span) // BUCKET)
    rows = stage_by(rows, "parse-rows", parts, keys)

    def once(found: DataFrame) -> DataFrame:
        """One of each repeated row, or a row's copy would count as an earlier text; sorted, so a task that runs again cuts the same chunks."""
        return found.dropDuplicates(keys).sortWithinPartitions(*keys)

    parsed = x.meet(once(rows.select(*keys, "text")).mapInArrow(_parse(span, buckets), x.SENT), buckets, _order(HOT))
    told = stage(x.documents_of(parsed, _spread, PER_DOC), "parse-answers")
    placed = rows.join(told, keys, "left")
    size = (told.agg(F.sum("asked")).first()[0] or 0) * (span + span // 4)
    buckets = max(parts, size // DICTIONARY)
    asked = once(placed.filter("asked > 0").select(*keys, "text", "need", "hot")).mapInArrow(_dictionary(span, buckets), x.SENT)
    wins = x.documents_of(x.meet(asked, buckets, _suffixes(span)), _spread, PER_DOC).select(*keys, F.col("at").alias("wins"))
    done = placed.join(wins, keys, "left").select("doc_id", "text", "at", "extra", "wins")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return done.mapInArrow(_kept(span), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
