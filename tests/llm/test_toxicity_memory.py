"""The chain is fitted beside the driver, block by block."""

import tracemalloc

import numpy as np

from quernstone.llm import toxicity


def _peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_features_of_training_rows_stay_off_the_driver(spark):
    """400 texts of 800 words have some 1.4 million features; the driver gets weights only."""
    rng = np.random.default_rng(5)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (4000, 7))]
    data = [(k, " ".join([*rng.choice(words, 800), *(["zzoxic"] if k % 5 == 0 else [])])) for k in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    chain, peak = _peak_mb(lambda: toxicity.train(docs, labels, ["quality", "toxic"]))
    assert peak < 12, peak
    again = toxicity.train(docs.repartition(7), labels, ["quality", "toxic"])
    assert chain.cut == again.cut
    for a, b in zip(chain.models, again.models, strict=True):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.earlier, b.earlier) and a.intercept == b.intercept
    toxic = {r["doc_id"] for r in toxicity.score(docs, chain).filter("is_toxic").collect()}
    assert {k for k in range(400) if k % 5 == 0} <= toxic


def test_blocks_change_no_weight_and_bound_temporaries(monkeypatch):
    """Rows of 0 to 8,000 features, one longer than a block: any block size fits the same chain."""
    rng = np.random.default_rng(6)
    ids = [np.unique(rng.integers(0, 30_000, n)).astype(np.int32) for n in [0, 1, 8000, *rng.integers(0, 8000, 300)]]
    counts = [rng.integers(1, 4, len(x)).astype(np.int32) for x in ids]
    y = {"a": (rng.random(len(ids)) < 0.4).astype(float), "b": (rng.random(len(ids)) < 0.2).astype(float)}
    y["b"][5] = np.nan
    fold = rng.integers(0, toxicity.FOLDS, len(ids))
    found = []
    for size in (5000, 1 << 30):
        monkeypatch.setattr(toxicity, "BLOCK", size, raising=False)
        found.append(_peak_mb(lambda: toxicity.fit_chain(ids, counts, y, fold)))
    (small, peak), (whole, most) = found
    assert small.cut == whole.cut
    for a, b in zip(small.models, whole.models, strict=True):
        assert np.array_equal(a.weights, b.weights) and np.array_equal(a.earlier, b.earlier) and a.intercept == b.intercept
    assert peak < 0.7 * most, (peak, most)
