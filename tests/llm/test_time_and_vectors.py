"""Point-in-time join, centroid clustering and embedding near duplicates against brute force on messy rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest


# ---- point-in-time join ----

VERSIONS = "doc_id long, source string, event long, arrival long, expiry long, size long, version string, text string"


def expected_version(asks_row, versions, life):
    key, t = asks_row
    if key is None or t is None:
        return None
    can = [v for v in versions if v[1] == key and None not in v[2:5] and v[2] <= t and v[3] <= t < v[4] and t - v[2] < life]
    rank = lambda v: (v[2], v[3], v[0] is not None, v[0] or 0, v[4], v[5] is not None, v[5] or 0)
    return max(can, key=rank, default=None)


def messy_versions(seed, n=700):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        event = int(rng.integers(0, 400))
        source = "hot" if rng.random() < 0.5 else [None, "", "s1", "s2", "é"][int(rng.integers(0, 5))]
        out.append((int(rng.integers(0, 500)), source, event, event + int(rng.integers(-60, 300)), event + int(rng.integers(-5, 120)), int(rng.integers(0, 9)), "v", "x"))
    out += out[:40] + [out[3]] * 200
    out += [(None, "s1", 50, 40, 160, 1, "v", None), (7, "s1", None, 1, 2, 1, "v", ""), (8, "s1", 1, None, 2, 1, "v", ""), (9, "hot", 1, 1, None, None, "v", "")]
    # the same place in the order: the larger id, then the later expiry, then the larger value wins
    out += [(600, "tie", 10, 5, 50, 1, "v", ""), (601, "tie", 10, 5, 40, 2, "v", ""), (601, "tie", 10, 5, 60, 3, "v", ""), (601, "tie", 10, 5, 60, 4, "v", "")]
    return out


@pytest.mark.parametrize("rows,life", [(15, None), (15, 60), (100_000, None)])
def test_as_of_against_brute_force(spark, rows, life):
    from quernstone.llm.asof import as_of

    versions = messy_versions(3)
    rng = np.random.default_rng(8)
    asks = [(int(k), ["hot", "hot", "s1", "s2", "", "é", None, "nowhere", "tie"][int(rng.integers(0, 9))], int(rng.integers(-5, 520)), "mine", 1) for k in range(600)]
    asks += [asks[0]] * 150 + [(1, "hot", None, "mine", 1)]
    schema = "doc_id long, source string, t long, version string, event int"  # names that clash
    made = as_of(spark.createDataFrame(asks, schema).repartition(3), spark.createDataFrame(versions, VERSIONS).repartition(5), key="source", at="t", tie="doc_id", carry=["size"], lifetime=life, rows=rows)
    assert made.columns == ["doc_id", "source", "t", "event", "version"]
    got = Counter((r["doc_id"], r["source"], r["t"], r["event"], None if r["version"] is None else tuple(r["version"])) for r in made.collect())
    longest = life if life is not None else max(v[4] - v[2] for v in versions if None not in v[2:5])
    want = Counter()
    for a in asks:
        best = expected_version((a[1], a[2]), versions, longest + (life is None))
        want[(a[0], a[1], a[2], a[4], best and (best[2], best[3], best[4], best[0], best[5]))] += 1
    assert got == want


def test_as_of_walks_over_many_ranges(spark):
    """Only the oldest of a thousand versions is usable, so each walk goes back through all ranges."""
    from quernstone.llm.asof import as_of

    versions = [(k, "a", k, 10_000 if k else 0, 20_000, k, "v", "") for k in range(1000)]
    asks = [(1, "a", 999, "x", 1), (2, "a", 1500, "x", 1), (3, "b", 1500, "x", 1)]
    made = as_of(spark.createDataFrame(asks, "doc_id long, source string, t long, version string, event int"), spark.createDataFrame(versions, VERSIONS), key="source", at="t", tie="doc_id", rows=100)
    assert {r["doc_id"]: r["version"] and r["version"]["tie"] for r in made.collect()} == {1: 0, 2: 0, 3: None}


def test_as_of_empty_tables(spark):
    from quernstone.llm.asof import as_of

    none, asks = spark.createDataFrame([], VERSIONS), spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, t long")
    assert [r["version"] for r in as_of(asks, none, key="source", at="t", tie="doc_id").collect()] == [None]
    assert as_of(asks.limit(0), none, key="source", at="t", tie="doc_id").collect() == []


def test_block_steps_agree_with_single_steps():
    from quernstone.llm.asof import walk

    rng = np.random.default_rng(2)
    n = 9000
    event = np.sort(rng.integers(0, 500, n))
    arrival, expiry = event + rng.integers(0, 400, n) * (rng.random(n) < 0.999), event + rng.integers(1, 300, n) * (rng.random(n) < 0.02)
    t = rng.integers(0, 800, 200)
    start = np.searchsorted(event, t, side="right") - 1
    first = rng.integers(0, 300, 200)
    for k, found in enumerate(walk(event, arrival, expiry, first, start, t, 250)):
        at = start[k]
        while at >= first[k] and event[at] > t[k] - 250 and not arrival[at] <= t[k] < expiry[at]:
            at -= 1
        assert found == (-2 if at < first[k] else -1 if event[at] <= t[k] - 250 else at)


# ---- centroid clustering ----

VECTORS = "vec_id long, embedding array<float>, label int, distance string"


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and max(abs(x) for x in v) * 1024 <= 1 << 27]
    digest = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    centroids = [list(v) for _, v in sorted(kept, key=digest)[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min(range(len(d)), key=lambda c: (d[c], c)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    done = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in done:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in done)


def messy_vectors(seed, dim, n=300):
    rng = np.random.default_rng(seed)
    hubs = rng.standard_normal((5, dim))
    rows = [(k, [float(x) for x in hubs[k % 5] * rng.choice([1, 1, 0.25]) + 0.3 * rng.standard_normal(dim)]) for k in range(n)]
    rows += [rows[0]] * 100 + [(rows[1][0], rows[2][1]), (None, rows[3][1]), (901, None), (902, []), (903, [0.0] * dim), (904, [float("nan")] * dim), (905, [1.0] * (dim - 1)), (906, [None] + [1.0] * (dim - 1)), (907, [float("inf")] * dim), (908, [1e30] * dim), (909, [90000.0] + [-0.5] * (dim - 1))]
    return rows


@pytest.mark.parametrize("k,dim", [(8, 6), (3, 64), (1, 6)])
def test_sort_means_against_brute_force(spark, k, dim):
    from quernstone.llm.centroids import clusters

    rows = messy_vectors(4, dim)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(6)
    assert Counter(tuple(r) for r in clusters(frame, k=k, rounds=5, dim=dim).collect()) == brute_clusters(rows, k, 5, dim)


def test_sort_means_ties_few_and_none(spark):
    from quernstone.llm.centroids import clusters

    # a vector halfway between two centroids, and centroids that coincide or stay empty
    rows = [(k, [float(x)]) for k, x in enumerate([0, 0, 2, 2, 1, 1, 4, -3, -3])]
    for k in (2, 4, 20):
        frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)
        assert Counter(tuple(r) for r in clusters(frame, k=k, rounds=4, dim=1).collect()) == brute_clusters(rows, k, 4, 1)
    assert clusters(spark.createDataFrame([(1, None, 1, "x")], VECTORS)).collect() == []
    assert clusters(spark.createDataFrame([], VECTORS)).collect() == []


def test_scan_stops_early_but_never_too_early():
    from quernstone.llm.centroids import assign, neighbour_order, squared

    rng = np.random.default_rng(6)
    centroids = rng.integers(-50, 50, (12, 3))
    centroids[5] = centroids[2]
    x = rng.integers(-60, 60, (4000, 3))
    order, apart = neighbour_order(centroids)
    assert (order[:, 0] == np.arange(12)).all()
    best, d = assign(x, rng.integers(0, 12, 4000).astype(np.int32), centroids, order, apart)
    every = np.stack([squared(x, c) for c in centroids], axis=1)
    assert (best == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


# ---- embedding near duplicates ----

def brute_links(rows, cosine):
    def unit(v, label):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        a = a / np.abs(a).max()
        return a / np.linalg.norm(a)

    u, n = [unit(v, label) for _, v, label in rows], len(rows)
    top, links = list(range(n)), [0] * n

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(n):
        for b in range(a + 1, n):
            if u[a] is not None and u[b] is not None and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= cosine:
                links[a] += 1
                links[b] += 1
                top[root(a)] = root(b)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return Counter((rows[k][0], links[k], least.get(root(k)), rows[k][0] is not None and rows[k][0] == least.get(root(k))) for k in range(n))


def near_vectors(seed, n=260, dim=16):
    """Chains, dense groups, copies, scaled copies, and vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in rng.standard_normal(dim)], int(k % 3)) for k in range(n)]
    for k in range(0, 60):
        base = np.array(rows[k][1])
        rows.append((1000 + k, [float(x) for x in base + np.linalg.norm(base) / math.sqrt(dim) * rng.uniform(0.02, 0.2) * rng.standard_normal(dim)], rows[k][2]))
    hub = rng.standard_normal(dim)
    rows += [(2000 + k, [float(x) for x in hub + 0.08 * rng.standard_normal(dim)], 1) for k in range(120)]
    rows += [(3000 + k, rows[5][1], rows[5][2]) for k in range(90)] + [(3200, [x * 1e-30 for x in rows[5][1]], rows[5][2]), (3201, [x * 1e30 for x in rows[5][1]], rows[5][2]), (3202, rows[5][1], 7), (3203, rows[5][1], None)]
    rows += [rows[7], (rows[7][0], rows[8][1], 0), (None, rows[9][1], rows[9][2]), (None, [1.0, 0.0], 0), (4000, None, 1), (4001, [], 1), (4002, [0.0] * dim, 1), (4003, [0.0] * dim, 1), (4004, [float("nan")] * dim, 1), (4005, [None] * dim, 1), (4006, [float("inf")] * dim, 1), (4007, [1.0, 0.0], 0)]
    return rows


@pytest.mark.parametrize("block", [1024, 30])
def test_stable_links_against_brute_force(spark, block):
    from quernstone.llm.pstable import near_duplicates

    rows = near_vectors(9)
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(5)
    got = Counter(tuple(r) for r in near_duplicates(frame, tables=64, block=block).collect())
    assert got == brute_links(rows, 0.93)


def test_stable_links_find_nearly_all_at_the_threshold(spark):
    from quernstone.llm.pstable import near_duplicates

    rng = np.random.default_rng(1)
    rows, dim = [], 64
    for k in range(400):  # pairs with cosines from 0.931 to 0.95
        a = rng.standard_normal(dim)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(dim)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.931, 0.95)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = sum(r["n_links"] for r in got.collect()) / 2
    assert found >= 0.98 * 400


def test_stable_links_empty(spark):
    from quernstone.llm.pstable import near_duplicates

    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    alone = spark.createDataFrame([(1, None, 1), (None, None, None)], "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(r) for r in near_duplicates(alone).collect()) == Counter([(1, 0, 1, True), (None, 0, None, False)])


# ---- registered queries ----

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_as_of_features", "op12_sort_means", "op13_stable_links"])
def test_registered(spark, name):
    import duckdb

    from quernstone.llm.entry import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want.fetchall())
