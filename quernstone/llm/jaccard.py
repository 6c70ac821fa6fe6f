"""Jaccard join of word-shingle sets by PartEnum signatures.

A document's set is its distinct shingles of ``words`` words, lower-cased in A-Z. Sets of equal content
count as one. Sizes form bands in which the largest is at most the smallest divided by the threshold;
linked sets lie in one band or in neighbours, so a set signs for its own band and the next. In a
band with largest size r, linked sets differ in at most k = 2 r (1 - t) / (1 + t) shingles. The shingle
domain is cut into parts, each part into cells, and the content of every choice of all but a few cells
of a part is a signature: linked sets agree on some choice in at least e + 1 parts (see ``Band``). A
signature without shingles says little; it is given only by sets that have such in more than e parts,
since with at most e of them some agreed signature has content. e is set by the band, not by the data.

Sets that share a signature are candidates. Each signature has one star, which all sets that have it are in, so
every linked pair lies in some star; stars of different pivots stay apart. Signatures are dealt to buckets by
band, so two sets meet in few buckets. Most sets of a star only have a passage in common with others, so before any text is sent, sets
are compared by sketches: the parity of how many shingles fall on each of some bits (``sketches``). Sets
differ in at least as many shingles as sketches in bits, so no linked pair is missed; the sets that sketches
leave together, over all stars, make one group. Stars over ``SKETCHED`` sets, in which comparing all sketches would
grow with the square, go on as groups without it. A group is cut into blocks of bounded size, each with
the group's witnesses, a few of its sets. Inside a block all pairs are compared exactly, by matrix products
of incidence columns. Across blocks, sets that the links so far leave in different components are compared
by their differences from the group's centre, the witness with most links to others: linked sets must share
some of these, so each set gives the rarest few of its differences (``_prefixes``), sets with one in common
meet in a join, and the size of the common difference settles the pair. Components are taken of verified
links only. No link is lost, no group has to fit one task, and no text is sent for pairs of blocks.

Nulls and edges: null text, or text without words, is an empty set, linked with nothing: its component
is its own id; fewer words than a shingle count as one; repeated rows are copies; a null id never is a
component's smallest id unless all are null; only the id and the text are read. Texts of any length are
hashed slice by slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.common import chunked, hashed_words, lower_ascii, mix64, spans_hash, strings, trimmed, with_row_key
from quernstone.llm.exchange import chunk_numbers
from quernstone.operators.graph import components
from quernstone.session import stage

#: Bytes of text worked on at once, signatures in a bucket, sets and shingles in a block of a star.
CHUNK, BUCKET, BLOCK, BLOCK_SHINGLES = 1 << 20, 3_000_000, 512, 1_000_000
#: Signatures of a bucket that are sorted together.
TOGETHER = 1 << 19
#: Shingles that a signature of a band's smallest set should hold on average.
LEAST_CONTENT = 7
#: Rows whose number fits beside 48 bits of hash; entries worked on at once.
ROWS, STEP = 1 << 16, 1 << 20
#: Sets and shingles of a star whose sketches are compared; sketch bits for each shingle that linked sets may differ in, and the most.
SKETCHED, SKETCHED_SHINGLES, SPREAD, MOST_BITS = 4096, 4_000_000, 8, 1 << 20
#: Sets (about) of a star that choose its centre and tell which differences from it are common.
WITNESSES = 32


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of all rows, ascending by row, and their rows."""
    if len(column) > ROWS:
        firsts = range(0, len(column), ROWS)
        h, row = zip(*[shingle_sets(column.slice(k, ROWS), words) for k in firsts])
        return np.concatenate(h), np.concatenate([r + k for r, k in zip(row, firsts)])
    data, offsets = strings(column)
    hashes, first = hashed_words(lower_ascii(data), offsets)
    counts = np.diff(first)
    few = np.flatnonzero((counts > 0) & (counts < words))
    # a row's shingles start at each of its words but the last few
    keys = [(few.astype(np.uint64) << np.uint64(48)) | (spans_hash(hashes, first[few], first[few + 1]) >> np.uint64(16))]
    for low in range(0, len(hashes), STEP):
        part = hashes[low : low + STEP + words - 1]
        at = np.arange(min(STEP, len(hashes) - low))
        row = np.searchsorted(first, at + low, side="right") - 1
        full = at + low + words <= first[row + 1]
        at, row = at[full], row[full]
        found = (row.astype(np.uint64) << np.uint64(48)) | (spans_hash(part, at, at + words) >> np.uint64(16))
        found.sort()
        keys.append(found[np.diff(found, prepend=~found[:1]) != 0])
    keyed = np.concatenate(keys)
    keyed.sort()
    keyed = keyed[np.diff(keyed, prepend=~keyed[:1]) != 0]
    return keyed & np.uint64((1 << 48) - 1), (keyed >> np.uint64(48)).astype(np.int64)


def set_keys(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit keys of each row's set."""
    size = np.bincount(row, minlength=n)
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for low in range(0, len(h), STEP):
        part, of = h[low : low + STEP], row[low : low + STEP]
        np.add.at(a, of, mix64(part))
        np.add.at(b, of, mix64(part ^ np.uint64(0xA5A5A5A5A5A5)))
    return size, a, b


def sketches(h: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> pa.Array:
    """For each row, the parity of its shingles on each of some bits, as bytes; their number is a power of two and grows with the set."""
    k = 2 * size * (100 - percent) // (100 + percent) + 1
    bits = np.clip(1 << np.ceil(np.log2(SPREAD * k)).astype(np.int64), 64, MOST_BITS)
    first = np.concatenate([[0], np.cumsum(bits)])
    odd = np.zeros(int(first[-1]), bool)
    for low in range(0, len(h), STEP):
        part, of = h[low : low + STEP], row[low : low + STEP]
        at = first[of] + (mix64(part ^ np.uint64(0x3C6EF372FE94)) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
        np.logical_xor.at(odd, at, True)
    packed = np.packbits(odd, bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(first // 8), pa.py_buffer(packed)]).cast(pa.binary())


class Band:
    """How sets of one band sign: ``parts`` first-level parts of the shingle domain, each cut into ``cells``.

    A linked pair differs in at most k shingles, so at least ``spare + 1`` parts hold at most ``loose``
    differences each, and in these some choice of ``cells - loose`` cells is equal. The cheapest numbers
    are taken that leave ``LEAST_CONTENT`` shingles in a signature of the band's smallest set.
    """

    def __init__(self, percent: int, low: int, high: int):
        k = 2 * (100 - percent) * high // (100 + percent)
        least = max(1, math.ceil(low * percent / 100))
        best = None
        for loose in range(0, min(k, 6) + 1):
            for cells in range(loose + 1, loose + 6 if loose else 2):
                choices, base, spare = math.comb(cells, loose), -(-(k + 1) // (loose + 1)), 0
                for _ in range(20):
                    parts = base + spare
                    content = least / parts * (cells - loose) / cells
                    empty = parts * choices * math.exp(-content)
                    if parts == 1 or spare >= empty + 3 * math.sqrt(empty):
                        break
                    spare += 1
                cost = parts * choices
                if cost <= 6 * k + 60:
                    rank = (content < LEAST_CONTENT, cost if content >= LEAST_CONTENT else -content)
                    if best is None or rank < best[0]:
                        best = (rank, parts, spare, loose, cells)
        _, self.parts, self.spare, self.loose, self.cells = best
        self.choices = [list(c) for c in combinations(range(self.cells), self.cells - self.loose)]


class Bands:
    """The bands up to a size, and the one after."""

    def __init__(self, percent: int, largest: int):
        self.ends, self.bands = [0], [None]
        low = 1
        while self.ends[-1] < largest or len(self.ends) < 3:
            high = max(low, low * 100 // percent)
            self.ends.append(high)
            self.bands.append(Band(percent, low, high))
            low = high + 1
        self.bands.append(Band(percent, low, max(low, low * 100 // percent)))

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.ends), size)

    def signed(self, sets: dict[int, int]) -> np.ndarray:
        """At most how many signatures are given for each band, from how many sets each has; a set signs for its own band and the next."""
        out = np.zeros(len(self.bands))
        for number, n in sets.items():
            for k in (number, number + 1):
                out[k] += n * self.bands[k].parts * len(self.bands[k].choices)
        return out


def signatures(h: np.ndarray, row: np.ndarray, size: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit signatures, their rows and the bands they are given for; rows of size 0 have none."""
    out, rows, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own = bands.of(size)
    numbers = np.unique(own[size > 0])
    if len(numbers) > 1:
        order = np.argsort(own[row], kind="stable")
        h, row = h[order], row[order]
    cuts = np.searchsorted(own[row], [*numbers, len(bands.ends) + 1])
    place = np.zeros(len(size), np.uint64)
    for number, first, last in zip(numbers, cuts, cuts[1:]):
        doc = np.flatnonzero((own == number) & (size > 0))
        place[doc] = np.arange(len(doc))
        pair = bands.bands[number : number + 2]
        sums = [np.zeros(len(doc) * band.parts * band.cells, np.uint64) for band in pair]
        some = [np.zeros(len(x), bool) for x in sums]
        for low in range(first, last, STEP):
            part, of = h[low : min(last, low + STEP)], place[row[low : min(last, low + STEP)]]
            where, content = mix64(part ^ np.uint64(0x5851F42D4C95)), mix64(part)
            for k, band in enumerate(pair):
                parts, cells = np.uint64(band.parts), np.uint64(band.cells)
                slot = ((of * parts + where % parts) * cells + where // parts % cells).astype(np.int64)
                np.add.at(sums[k], slot, content)
                some[k][slot] = True
        for step, (band, total, filled) in enumerate(zip(pair, sums, some)):
            total, filled = total.reshape(-1, band.cells), filled.reshape(-1, band.cells)
            tag = np.tile(np.arange(band.parts, dtype=np.uint64), len(doc)) + np.uint64((int(number) + step) << 32)
            chosen = np.stack([total[:, c].sum(axis=1, dtype=np.uint64) for c in band.choices], axis=1)
            solid = np.stack([filled[:, c].any(axis=1) for c in band.choices], axis=1)
            weak = (~solid.all(axis=1)).reshape(len(doc), band.parts).sum(axis=1) > band.spare
            keep = solid | np.repeat(weak, band.parts)[:, None]
            chosen += mix64(mix64(tag)[:, None] + np.arange(len(band.choices), dtype=np.uint64)[None, :])
            out.append(mix64(chosen[keep]))
            rows.append(np.repeat(doc, keep.reshape(len(doc), -1).sum(axis=1)))
            tags.append(np.full(len(rows[-1]), number + step))
    return np.concatenate(out), np.concatenate(rows), np.concatenate(tags)


SIGNED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "sets", "sizes", "counts")]])


def _sign(words: int, percent: int, largest: int, starts: np.ndarray):
    """Packed signatures by bucket. The bands lie one after the other on a line of buckets, from ``starts`` on, and a signature falls on
    a place of its band's stretch, so a set's signatures, and those two sets share, lie in the few buckets of two bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, largest)
        for chunk, rows in zip(chunk_numbers(), chunked(batches, CHUNK)):
            h, row = shingle_sets(rows["text"], words)
            size, a, _ = set_keys(h, row, rows.num_rows)
            once = np.zeros(rows.num_rows, bool)
            once[np.unique(a, return_index=True)[1]] = True  # equal sets of a chunk sign once
            once &= size > 0
            kept = once[row]
            sig, of, tag = signatures(h[kept], row[kept], np.where(once, size, 0), bands)
            place = (sig >> np.uint64(40)).astype(np.float64) / (1 << 24)
            bucket = (starts[tag] + (starts[tag + 1] - starts[tag]) * place).astype(np.int64)
            order = np.argsort(bucket * rows.num_rows + of, kind="stable")
            sig, of, bucket = sig[order], of[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for begin, end in zip(cuts, np.append(cuts[1:], len(bucket))):
                own, counts = np.unique(of[begin:end], return_counts=True)
                keys = np.ascontiguousarray(sig[begin:end]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                packed = [keys, a[own].tobytes(), size[own].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([bucket[begin]], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([x]) for x in packed]], schema=SIGNED)

    return trimmed(run)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts all sets that have a signature in common into one star, as (pivot, set); rows come sorted by bucket and chunk.

    The pivot is the first set seen, of those seen at once the largest: chunks come in one order to all
    buckets, so the signatures of a group of like sets mostly have one pivot. A set's main star in a bucket is that
    of the pivot it first meets most often. Once a second set has a signature, the main star of most of its holders, if there
    is such, is taken for it, and only the others make rows.
    """
    none = np.zeros(0, np.uint64)
    # by signature, ascending: its star, and whether two sets have it; by set, ascending: its main star
    bucket, known, pivots, several, seen, mains = None, none, none, np.zeros(0, bool), none, none
    held, size = [], 0

    def flush():
        nonlocal known, pivots, several, seen, mains, held, size
        keys, sets, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
        held, size = [], 0
        order = np.lexsort((sets, -sizes, keys))
        keys, sets = keys[order], sets[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        group = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(keys)))
        own, pivot = keys[begin], sets[begin]
        at = np.searchsorted(known, own)
        old = np.zeros(len(own), bool)
        inside = at < len(known)
        old[inside] = known[at[inside]] == own[inside]
        pivot[old] = pivots[at[old]]
        used = np.zeros(len(own), bool)
        used[old] = several[at[old]]

        names = np.unique(sets)
        names = names[~np.isin(names, seen, assume_unique=True)]
        main = names.copy()
        meets = np.flatnonzero(pivot[group] != sets)
        meets = meets[np.isin(sets[meets], names)]
        if len(meets):
            pairs, times = np.unique(np.stack([sets[meets], pivot[group[meets]]], axis=1), axis=0, return_counts=True)
            best = np.lexsort((pairs[:, 1], -times, pairs[:, 0]))
            best = best[np.diff(pairs[best, 0], prepend=~pairs[best[:1], 0]) != 0]
            main[np.searchsorted(names, pairs[best, 0])] = pairs[best, 1]
        put = np.searchsorted(seen, names)
        seen, mains = np.insert(seen, put, names), np.insert(mains, put, main)

        mine, theirs = mains[np.searchsorted(seen, sets)], mains[np.searchsorted(seen, pivot)]
        shares = np.logical_or.reduceat(sets != pivot[group], begin)
        # votes of the holders for their main stars, that of the first holder too, where a star is yet to be chosen
        open_, waits = np.flatnonzero((shares & ~used)[group]), np.flatnonzero(shares & ~used & old)
        voted, votes = np.append(group[open_], waits), np.append(mine[open_], theirs[waits])
        by = np.lexsort((votes, voted))
        voted, votes = voted[by], votes[by]
        run = np.flatnonzero((np.diff(voted, prepend=-1) != 0) | (np.diff(votes, prepend=~votes[:1]) != 0))
        most = 2 * np.diff(run, append=len(voted)) > np.bincount(voted, minlength=len(own))[voted[run]]
        first = pivot.copy()
        pivot[voted[run[most]]] = votes[run[most]]
        outvoted = waits[(pivot[waits] != first[waits]) & (pivot[waits] != theirs[waits])]
        used |= shares
        # the known signatures stay sorted; only the new ones are put between them
        pivots[at[old]], several[at[old]] = pivot[old], used[old]
        known, pivots, several = (np.insert(x, at[~old], y[~old]) for x, y in ((known, own), (pivots, pivot), (several, used)))
        star = pivot[group]
        joins = used[group] & (star != sets) & (star != mine)
        other = main != names
        left, right = np.concatenate([star[joins], main[other], pivot[outvoted]]), np.concatenate([sets[joins], names[other], first[outvoted]])
        pairs = np.unique(np.stack([left, right], axis=1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left", "right"])

    for batch in batches:
        for b, keys, sets, sizes, counts in zip(batch["bucket"].to_pylist(), *[batch[c] for c in ("keys", "sets", "sizes", "counts")]):
            if held and (b != bucket or size > TOGETHER):
                yield flush()
            if b != bucket:
                bucket, known, pivots, several, seen, mains = b, none, none, np.zeros(0, bool), none, none
            raw = np.frombuffer(keys.as_buffer(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            times = np.frombuffer(counts.as_buffer(), np.uint32)
            held.append((wide.view(np.uint64).ravel(), np.repeat(np.frombuffer(sets.as_buffer(), np.uint64), times), np.repeat(np.frombuffer(sizes.as_buffer(), np.uint32), times).astype(np.int64)))
            size += len(raw)
    if held:
        yield flush()


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common."""
    m, size = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    h, at = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    of = np.repeat(np.arange(m), size)
    several = np.bincount(at, minlength=len(h)) > 1
    column = np.cumsum(several) - 1
    keep = several[at]
    of, at = of[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    common, columns = np.zeros((m, m), np.int64), int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(1, (2 << 20) // max(1, m)))
    for begin in range(0, columns, max(1, width)):
        a, b = np.searchsorted(at, [begin, begin + width])
        block = np.zeros((m, width), np.float32)
        block[of[a:b], at[a:b] - begin] = 1
        common += (block @ block.T).astype(np.int64)
    np.fill_diagonal(common, size)
    return common


def links(common: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of which sets link, from what they have in common."""
    size = np.diag(common)
    return (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (common > 0)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index of a symmetric matrix."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] >= 0:
            continue
        root[k], todo = k, [k]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & (root < 0))
            root[new] = k
            todo.extend(new.tolist())
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], content: str = "text") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by ``keys``, of about ``CHUNK`` bytes of ``content``, and where each group begins and the last ends."""
    held, size = [], 0

    def table(last: bool):
        nonlocal held, size
        rows = pa.Table.from_batches(held)
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            column = rows[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        begin = np.flatnonzero(new)
        stop = rows.num_rows if last else int(begin[-1])
        held, size = rows.slice(stop).to_batches(), 0
        return rows.slice(0, stop), np.unique(np.append(begin[begin <= stop], stop))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch[content].nbytes
            if size >= CHUNK:
                rows, begin = table(False)
                if rows.num_rows:
                    yield rows, begin
    if held:
        yield table(True)


def near(size: np.ndarray, sketch: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of which sets may link, from sizes and sketches (of 64-bit words): all that do, and few others.

    A sketch of twice as many bits, halved by an exclusive or of its halves, is the sketch of fewer bits.
    """
    words, m = np.array([len(x) for x in sketch]), len(sketch)
    out = np.zeros((m, m), bool)
    for width in np.unique(words):
        own, wide = np.flatnonzero(words == width), np.flatnonzero(words >= width)
        table = np.stack([np.bitwise_xor.reduce(sketch[k].reshape(-1, width), axis=0) for k in wide])
        mine = np.searchsorted(wide, own)
        columns = max(1, (1 << 18) // int(width))
        for low in range(0, len(wide), columns):
            part, names = table[low : low + columns], wide[low : low + columns]
            rows = max(1, (1 << 18) // (int(width) * len(part)))
            for begin in range(0, len(own), rows):
                ours = own[begin : begin + rows]
                apart = np.bitwise_count(table[mine[begin : begin + rows], None] ^ part[None]).sum(axis=2, dtype=np.int64)
                apart = np.maximum(apart, np.abs(size[ours][:, None] - size[names][None, :]))  # sets differ at least as much as their sizes
                out[np.ix_(ours, names)] = (100 + percent) * apart <= (100 - percent) * (size[ours][:, None] + size[names][None, :])
    return out | out.T


def _near(percent: int):
    """(left, right) that hang together the sets of a star that may link; rows come sorted by star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _groups(batches, ["star"], "sketch"):
            node, size, sketch = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["sketch"].to_pylist()
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(begin, begin[1:]):
                root = a + _roots(near(size[a:b], [np.frombuffer(x, np.uint64) for x in sketch[a:b]], percent))
                hung = np.flatnonzero(root != np.arange(a, b))
                left.append(node[root[hung]])
                right.append(node[a + hung])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["left", "right"])

    return trimmed(run)


def _prefixes(sets: list[np.ndarray], common: np.ndarray, witness: np.ndarray, own: np.ndarray, percent: int) -> Iterator[tuple]:
    """For each own set of a block: (index, differences from the centre, f, whether linked with it, how many of them to give).

    With x = |A d B| and t = percent / 100, A and B link when (100 + percent) x <= (100 - percent) (|A| + |B|).
    For differences from a centre C, x = |dA| + |dB| - 2 c where c is what they have in common; so with
    f(A) = (100 + percent) |dA| - (100 - percent) |A| they link when 2 (100 + percent) c >= f(A) + f(B). As |dA| is at
    least how far the sizes of A and C are apart, f is never below f(C) = -g, and A links with C when
    f(A) <= g. Two sets need be compared only if one, A, doesn't link with C, so f(A) > g and c >= 1. A set
    that must share c of its d differences shares one of the first d - c + 1 in any order that all sets
    agree on; here the rarest among the witnesses come first. So many are given as any partner may call for.
    All blocks have the same witnesses, hence the same centre and order.
    """
    seers = np.flatnonzero(witness)
    among = common[np.ix_(seers, seers)]
    apart = np.diag(among)[:, None] + np.diag(among)[None, :] - 2 * among
    centre = sets[seers[np.lexsort((apart.sum(axis=1), -links(among, percent).sum(axis=1)))[0]]]
    differ = {k: np.setxor1d(sets[k], centre, assume_unique=True) for k in np.flatnonzero(own | witness)}
    seen, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *[differ[k] for k in seers]]), return_counts=True)
    twice, g = 2 * (100 + percent), (100 - percent) * len(centre)
    for k in np.flatnonzero(own):
        d = differ[k]
        at = np.minimum(np.searchsorted(seen, d), max(0, len(seen) - 1))
        often = np.where(seen[at] == d, times[at], 0) if len(seen) else np.zeros(len(d), int)
        f = (100 + percent) * len(d) - (100 - percent) * len(sets[k])
        linked = f <= g
        least = max(1, -(-(f + g + 1 if linked else f - g) // twice))
        yield k, d[np.lexsort((d, often))], f, linked, max(0, len(d) + 1 - least)


VERIFIED = "left long, right long, star long, n int, f long, linked boolean, given int, differ array<long>"
VERIFIED_ARROW = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("star", pa.int64()), ("n", pa.int32()), ("f", pa.int64()), ("linked", pa.bool_()), ("given", pa.int32()), ("differ", pa.list_(pa.int64()))])


def _verify(words: int, percent: int):
    """Links inside blocks as (left, right), and for stars of several blocks each own set's differences, with right null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _groups(batches, ["star", "block"]):
            h, row = shingle_sets(rows["text"], words)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            sets = [h[a:b] for a, b in zip(cut, cut[1:])]
            star, blocks, node, witness, own = (rows[c].to_numpy() for c in ("star", "blocks", "node", "witness", "own"))
            out = []
            for a, b in zip(begin, begin[1:]):
                once = a + np.unique(node[a:b], return_index=True)[1]  # repeated rows are one set
                part, names = [sets[k] for k in once], node[once]
                common = shared(part)
                root = _roots(links(common, percent))
                out += [(int(x), int(y), None, None, None, None, None, None) for x, y in zip(names, names[root]) if x != y]
                if blocks[a] > 1:
                    found = _prefixes(part, common, witness[once], own[once], percent)
                    out += [(int(names[k]), None, int(star[a]), len(part[k]), int(f), bool(linked), int(given), d.astype(np.int64)) for k, d, f, linked, given in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), VERIFIED_ARROW)], schema=VERIFIED_ARROW)

    return trimmed(run)


def _across(verified: DataFrame, percent: int) -> DataFrame:
    """Links (left, right) between sets of different blocks of a star whose components differ so far.

    Two sets meet at a difference they share only if enough of their differences follow it to reach what
    they must have in common; of linked sets that holds for the first one they share.
    """
    sets = verified.filter("right is null").drop("right").withColumnRenamed("left", "node")
    label = components(verified.filter("right is not null").select("left", "right")).withColumnRenamed("component", "label")
    sets = sets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("d", F.size("differ"))
    torn = sets.groupBy("star").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("star")
    sets = stage(sets.join(torn, "star"), "jaccard-apart")
    each = sets.select("star", "node", "label", "linked", "f", "d", F.posexplode(F.slice("differ", 1, F.col("given"))).alias("at", "e"))
    x, y = each.filter("not linked").alias("x"), each.alias("y")
    need = F.ceil((F.col("x.f") + F.col("y.f")) / (2 * (100 + percent)))
    reached = (F.col("x.at") + need <= F.col("x.d")) & (F.col("y.at") + need <= F.col("y.d"))
    once = F.col("y.linked") | (F.col("x.node") < F.col("y.node"))
    on = (F.col("x.star") == F.col("y.star")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.label") != F.col("y.label")) & once & reached
    pairs = x.join(y, on).select(F.col("x.star").alias("star"), F.col("x.node").alias("left"), F.col("y.node").alias("right")).distinct()
    for side in ("left", "right"):
        pairs = pairs.join(sets.select("star", F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("differ").alias(f"d_{side}")), ["star", side])
    apart = F.size("d_left") + F.size("d_right") - 2 * F.size(F.array_intersect("d_left", "d_right"))
    return pairs.filter((100 + percent) * apart.cast("long") <= (100 - percent) * (F.col("n_left") + F.col("n_right")).cast("long")).select("left", "right")


def _candidates(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(star, node, n): the groups that sketches leave, and stars too large for them as they are."""
    small = (F.col("m") <= SKETCHED) & (F.col("shingles") <= SKETCHED_SHINGLES)
    sizes = members.groupBy("star").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).filter("m > 1").select("star", small.alias("small"))
    sized = stage(members.join(sizes, "star"), "jaccard-sized")
    sent = sized.filter("small").join(nodes.select("node", "sketch"), "node").select("star", "node", "n", "sketch").repartition("star").sortWithinPartitions("star")
    groups = components(stage(sent.mapInArrow(_near(percent), "left long, right long"), "jaccard-near"))
    whole = groups.select(F.col("component").alias("star"), "node").join(nodes.select("node", "n"), "node").select("star", "node", "n")
    return whole.unionByName(sized.filter("not small").select("star", "node", "n"))


def _described(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunked(batches, CHUNK):
            h, row = shingle_sets(rows["text"], words)
            size, a, b = set_keys(h, row, rows.num_rows)
            got = [rows["doc_id"].combine_chunks(), rows["_h"].combine_chunks(), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), sketches(h, row, size, percent)]
            yield pa.RecordBatch.from_arrays(got, names=["doc_id", "_h", "n", "ka", "kb", "sketch"])

    return trimmed(run)


def _linked(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _h, n, ka, kb) for each row of ``docs``, and (ka, kb, n, rep_id, rep, component) for each set with shingles."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    known = stage(rows.select("doc_id", "_h", "text").mapInArrow(_described(words, percent), f"doc_id {id_type}, _h long, n long, ka long, kb long, sketch binary"), "jaccard-sets")
    largest = int(known.agg(F.max("n")).first()[0] or 0)
    bands = Bands(percent, largest)
    band = F.size(F.filter(F.array(*[F.lit(x) for x in bands.ends]), lambda x: x < F.col("n")))
    signed = bands.signed({r["band"]: r["count"] for r in known.filter("n > 0").groupBy(band.alias("band")).count().collect()})
    starts = np.concatenate([[0], np.cumsum(signed / BUCKET)])
    buckets = int(starts[-1]) + 1

    signed = rows.select("text").mapInArrow(_sign(words, percent, largest, starts), "bucket int, chunk long, keys binary, sets binary, sizes binary, counts binary")
    stars = signed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(trimmed(_stars), "left long, right long")
    stars = stage(stars.distinct(), "jaccard-stars")

    # one node for each distinct set; a node's number is fixed once the table is written
    nodes = known.filter("n > 0").groupBy("ka", "kb", "n").agg(F.min("doc_id").alias("rep_id"), F.min(F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("i"), F.col("_h").alias("h"))).alias("rep"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    members = stars.select(F.col("left").alias("star"), F.col("right").alias("ka")).unionByName(stars.select(F.col("left").alias("star"), F.col("left").alias("ka")).distinct())
    # written once, as it is read both for the sizes of stars and for the sets in them
    members = _candidates(stage(members.join(nodes.select("ka", "node", "n"), "ka").drop("ka"), "jaccard-joined"), nodes, percent)
    members = stage(members.join(nodes.select("node", F.col("rep.i").alias("_i"), F.col("rep.h").alias("_h")), "node"), "jaccard-members")
    sizes = stage(members.groupBy("star").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("node").alias("least")), "jaccard-sizes")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    witness = (F.col("blocks") > 1) & ((F.pmod(F.xxhash64("node", F.lit(7)), F.col("m")) < WITNESSES) | (F.col("node") == F.col("least")))
    placed = members.join(sizes, "star").withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.select("star", "blocks", "home", "node", witness.alias("witness"), "_i", "_h")
    # the same plan at every size: texts are dealt by row, however few of them are wanted
    texts = rows.hint("merge").join(placed, rows["doc_id"].eqNullSafe(placed["_i"]) & (rows["_h"] == placed["_h"]))
    everywhere = F.when(F.col("witness"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    texts = texts.select("star", "blocks", "home", "node", "witness", "text", F.explode(everywhere).alias("block")).withColumn("own", F.col("block") == F.col("home"))
    dealt = texts.select("star", "block", "blocks", "node", "witness", "own", "text").repartition("star", "block").sortWithinPartitions("star", "block", "node")
    verified = stage(dealt.mapInArrow(_verify(words, percent), VERIFIED), "jaccard-verified")
    found = verified.filter("right is not null").select("left", "right")
    if not verified.filter("right is null").isEmpty():
        found = found.unionByName(_across(verified, percent))
    return known, nodes.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _h, n_shingles, component_id) for each row of ``docs``."""
    known, best = _linked(docs, words, percent, id_col, text_col)
    smallest = best.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    named = best.join(smallest, "component").select("ka", "kb", "n", "component_id")
    linked = known.filter("n > 0").join(named, ["ka", "kb", "n"]).select("doc_id", "_h", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(known.filter("n = 0").select("doc_id", "_h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents: that with the smallest id (of repeated rows, one).

    Ids needn't be unique: of unlinked documents that share an id, or have none, each keeps its row. Null and
    empty texts are linked with nothing, so of those only repeated rows go. Columns pass through as they are.
    """
    known, best = _linked(docs, words, percent, id_col, text_col)
    keep = best.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.i").alias("_id"), F.col("rep.h").alias("_k"))
    keep = keep.unionByName(known.filter("n = 0").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k")).distinct())
    keyed = with_row_key(docs, id_col, text_col)
    kept = keyed.join(keep, keyed[id_col].eqNullSafe(keep["_id"]) & (keyed["_h"] == keep["_k"]))
    one = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_k").orderBy(F.lit(1)))).filter("_n = 1")
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])
