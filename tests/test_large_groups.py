"""Draws, ranks, digests and caches: equal to the plain way, whatever the blocks and ranges."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("groups,words", [(1, 64), (7, 64), (1000, 512), (97, 1 << 20)])
def test_draws_in_blocks_are_those_of_one_generator(spark, groups, words):
    from quernstone.operators.bootstrap import draw_table, group_draws

    rows = spark.range(groups).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), F.format_string("g%06d", "id").alias("g"))
    drawn = draw_table(rows.unionByName(rows), ["k"], "g", "x:{k}", 5, words=words).collect()
    for k in "ab":
        found = np.zeros((5, groups), int)
        for r in drawn:
            if r["k"] == k:
                found[r["iteration"], int(r["group"][1:])] += r["times"]
        assert found.tolist() == [np.bincount(d, minlength=groups).tolist() for d in group_draws(groups, 5, 2026, f"x:{k}")]


def test_rejected_words_depend_on_the_words_alone():
    from quernstone.operators.bootstrap import accepted, words_of

    groups = 3_000_000_000  # three words in ten are rejected
    made = np.concatenate([accepted(words_of(b, 7, "d", 256), groups) for b in range(8)])
    from quernstone.operators.bootstrap import entropy

    rng = np.random.default_rng(np.random.SeedSequence((7, *entropy("d"))))
    assert 500 < len(made) < 2048
    assert made.tolist() == rng.integers(0, groups, size=len(made), dtype=np.int64).tolist()


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_and_running_sums(spark, parts):
    from quernstone.operators.ranks import ranked, running

    rng = np.random.default_rng(1)
    rows = [(["hot", None, "x"][int(rng.integers(0, 3)) if k % 3 else 0], int(k), int(rng.integers(-5, 9))) for k in rng.permutation(400)]
    frame = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    got = {(r["k"], r["o"]): r["place"] for r in ranked(frame, ["k"], ["o"], "place", parts).collect()}
    for key in ("hot", None, "x"):
        own = sorted(o for k, o, _ in rows if k == key)
        assert [got[key, o] for o in own] == list(range(len(own)))
    sums = {r["o"]: r["s"] for r in running(frame, ["o"], "v", "s", parts).collect()}
    values = [v for _, _, v in sorted(rows, key=lambda r: r[1])]
    assert [sums[o] for o in range(400)] == np.cumsum(values).tolist()
    assert ranked(frame.limit(0), ["k"], ["o"], "place").collect() == running(frame.limit(0), ["o"], "v", "s").collect() == []


def test_streamed_digests(spark):
    from quernstone.operators.digests import streamed_digest

    rows = [("a", k, f"v{k}") for k in range(5000)] + [(None, 1, "é"), (None, 2, None), ("b", 1, "")]
    frame = spark.createDataFrame(rows, "k string, o int, v string").repartition(7)
    got = {r["k"]: (r["digest"], r["rows"]) for r in streamed_digest(frame, ["k"], ["o"], "v", separator=b"\n", end=b"\n").collect()}
    for key in ("a", None, "b"):
        values = [v or "" for k, _, v in sorted(rows, key=lambda r: r[1]) if k == key]
        assert got[key] == (hashlib.sha256(("\n".join(values) + "\n").encode()).hexdigest(), len(values))
    whole = streamed_digest(frame.filter("k = 'a'"), [], ["o"], "v", start=b"head").first()
    assert whole["digest"] == hashlib.sha256(b"head" + b"".join(b"v%d" % k for k in range(5000))).hexdigest()
    assert streamed_digest(frame.limit(0), ["k"], ["o"], "v").collect() == []


def test_matrix_digest(spark):
    from quernstone.operators.digests import matrix_digest

    rng = np.random.default_rng(0)
    m = rng.random((50, 13)) * (rng.random((50, 13)) < 0.3)
    m[7] = 0
    rows = [(f"{i:03d}", m[i].tolist(), np.flatnonzero(m[i]).tolist(), m[i][m[i] != 0].tolist()) for i in range(50)]
    frame = spark.createDataFrame(rows, "id string, whole array<double>, at array<int>, x array<double>").repartition(6)
    head = '{"dtype":"float64","shape":[50,13],"storage":"%s"}\n'
    assert matrix_digest(frame, "id", 13, "whole") == hashlib.sha256((head % "dense").encode() + m.astype("<f8").tobytes()).hexdigest()
    bounds = np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]).astype("<i8")
    at = np.concatenate([np.flatnonzero(r) for r in m]).astype("<i8")
    assert matrix_digest(frame, "id", 13, "x", "at") == hashlib.sha256((head % "csr").encode() + bounds.tobytes() + at.tobytes() + m[m != 0].astype("<f8").tobytes()).hexdigest()


def test_cache_computes_only_misses(spark, tmp_path):
    from quernstone.operators.features import composition
    from quernstone.sources.cache import FeatureCache, dense

    asked = []

    def compute(misses):
        asked.append(sorted(r["s"] for r in misses.collect()))
        return misses.select("content", composition(F.col("s")).alias("vector"))

    rows = spark.createDataFrame([(1, "ACDA"), (2, "WYWY"), (3, "ACDA"), (4, None)], "id int, s string")
    more = spark.createDataFrame([(5, "KKKK"), (6, "ACDA")], "id int, s string")
    first = FeatureCache(spark, str(tmp_path), "aac", {"alphabet": 20, "order": "ac"})
    found, use = first.features(rows, "s", compute)
    assert use == {"hits": 0, "misses": 2} and asked == [["ACDA", "WYWY"]]
    got = {r["id"]: (r["width"], r["indices"], r["values"]) for r in found.collect()}
    assert got == {1: (20, [0, 1, 2], [0.5, 0.25, 0.25]), 2: (20, [18, 19], [0.5, 0.5]), 3: (20, [0, 1, 2], [0.5, 0.25, 0.25]), 4: (None, None, None)}
    # the same configuration in another order of keys hits; only what is new is computed
    again, use = FeatureCache(spark, str(tmp_path), "aac", {"order": "ac", "alphabet": 20}).features(rows.unionByName(more), "s", compute)
    assert use == {"hits": 2, "misses": 1} and asked[1:] == [["KKKK"]]
    whole = {r["id"]: r["d"] for r in again.select("id", dense(F.col("width"), F.col("indices"), F.col("values")).alias("d")).collect()}
    assert whole[5] == [0.0] * 8 + [1.0] + [0.0] * 11 and len(whole) == 6
    # another configuration shares nothing
    _, use = FeatureCache(spark, str(tmp_path), "aac", {"alphabet": 21, "order": "ac"}).features(rows, "s", compute)
    assert use == {"hits": 0, "misses": 2}
    # nothing new: nothing is computed
    before = len(asked)
    assert first.features(more, "s", compute)[1] == {"hits": 2, "misses": 0} and len(asked) == before
    # a changed cell is found when it is read
    kept = first.read().collect()
    spoiled = spark.createDataFrame([tuple(r) for r in kept], first.read().schema).withColumn("values", F.transform("values", lambda x: x + 1))
    spoiled.write.mode("overwrite").partitionBy("shard").parquet(first.path)
    with pytest.raises(Exception, match="does not agree with its digest"):
        first.features(rows, "s", compute)[0].collect()


def test_more_buckets_than_spark_allows(spark, monkeypatch):
    from quernstone import session

    rows = spark.range(100).withColumn("t", F.col("id") % 7)
    monkeypatch.setattr(session, "MOST_BUCKETS", 3)
    made = session.stage_by(rows, "wide", 1_000_000, ["t"])
    assert sorted(r["id"] for r in made.collect()) == list(range(100))


def test_cached_vectors_are_read_once(spark, tmp_path, monkeypatch):
    """Misses are found by keys: vectors of cached rows are read for the result alone."""
    from quernstone.operators.features import composition
    from quernstone.sources.cache import FeatureCache

    cache = FeatureCache(spark, str(tmp_path), "aac", {"alphabet": 20})
    reads, whole = [], FeatureCache.read
    monkeypatch.setattr(FeatureCache, "read", lambda self, wanted=None: reads.append(1) or whole(self, wanted))
    rows = spark.createDataFrame([(1, "ACDA"), (2, "WYWY")], "id int, s string")
    for want in ({"hits": 0, "misses": 2}, {"hits": 2, "misses": 0}):
        found, use = cache.features(rows, "s", lambda x: x.select("content", composition(F.col("s")).alias("vector")))
        assert use == want and found.count() == 2
    assert len(reads) == 2
