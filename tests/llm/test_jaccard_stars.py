"""Stars of sets that share signatures: complete, and few rows for many buckets and signatures."""

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest


def _rows(chunks):
    """Packed rows of one bucket: for each chunk, {set: its signatures}."""
    from quernstone.llm.jaccard import SIGNED

    out = []
    for number, sets in enumerate(chunks):
        names = sorted(sets)
        raw = np.concatenate([np.array(sorted(sets[k]), np.uint64) for k in names]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        packed = [raw, np.array(names, np.uint64).tobytes(), np.full(len(names), 9, np.uint32).tobytes(), np.array([len(sets[k]) for k in names], np.uint32).tobytes()]
        out.append(pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([number], pa.int64()), *[pa.array([x]) for x in packed]], schema=SIGNED))
    return out


def _pairs(chunks):
    from quernstone.llm.jaccard import _stars

    return [(int(a), int(b)) for batch in _stars(iter(_rows(chunks))) for a, b in zip(batch["left"].to_pylist(), batch["right"].to_pylist())]


@pytest.mark.parametrize("together", [1, 40, 1 << 19])
def test_holders_of_a_signature_share_a_star(together, monkeypatch):
    from quernstone.llm import jaccard

    monkeypatch.setattr(jaccard, "TOGETHER", together)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sets = {k: set(rng.choice(90, rng.integers(1, 9), replace=False).tolist()) for k in range(1, 61)}
        chunks = [{k: sets[k] for k in rng.choice(60, 12, replace=False) + 1} for _ in range(9)]  # some sets come in several chunks
        stars, holders = defaultdict(set), defaultdict(set)
        for a, b in _pairs(chunks):
            stars[a] |= {a, b}
        for k in set().union(*chunks):
            for s in sets[k]:
                holders[s].add(k)
        assert all(any(h <= star for star in stars.values()) for h in holders.values() if len(h) > 1)


def test_like_sets_make_one_row_each(monkeypatch):
    """Each of 40 copies lacks some signatures, so no set has all of them; each one is still in one star only."""
    from quernstone.llm import jaccard

    monkeypatch.setattr(jaccard, "TOGETHER", 1)
    rng = np.random.default_rng(5)
    pairs = _pairs([{k: set(np.flatnonzero(rng.random(200) < 0.7).tolist())} for k in range(1, 41)])
    assert len(pairs) == 39


def test_signatures_of_a_set_lie_in_few_buckets(monkeypatch):
    from quernstone.llm import jaccard

    monkeypatch.setattr(jaccard, "chunk_numbers", lambda: itertools.count())
    size = np.array([30, 60, 120, 240, 480, 960])
    texts = [" ".join(f"w{k}x{i}" for i in range(n + 3)) for k, n in enumerate(size)]
    bands = jaccard.Bands(85, 960)
    signed = bands.signed({int(b): 1 for b in bands.of(size)})
    starts = np.concatenate([[0], np.cumsum(signed / signed.sum() * 60)])
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    rows = [r for out in jaccard._sign(4, 85, 960, starts)(iter([batch])) for r in out.to_pylist()]
    assert len({r["bucket"] for r in rows}) >= 50 and max(r["bucket"] for r in rows) <= 60
    per_set = np.bincount(np.unique(np.concatenate([np.frombuffer(r["sets"], np.uint64) for r in rows]), return_inverse=True)[1])
    assert len(per_set) == 6 and per_set.sum() < 100  # 6 sets in each of 60 buckets before
