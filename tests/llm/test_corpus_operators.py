"""Archives, repeats, near duplicates, neighbours and the pipeline against brute force on messy rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, at int, node string, _x string"


def words(rng, n, vocabulary=400):
    return [f"w{int(k)}" for k in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared passages, near copies, exact copies, repeats inside a text, and odd rows."""
    rng = np.random.default_rng(5)
    passages = [" ".join(words(rng, n)) for n in (34, 35, 36, 50, 80, 120)]
    out = []
    for k in range(150):
        parts = [" ".join(words(rng, int(rng.integers(0, 60)))) for _ in range(3)]
        if k % 3 == 0:
            parts.insert(1, passages[int(rng.integers(0, 6))])
        if k % 10 == 0:
            parts += [passages[3], passages[3]]
        out.append("\n".join(parts))
    for k in range(0, 60, 2):
        copy = out[k].split(" ")
        for _ in range(int(rng.integers(0, 4))):
            copy[int(rng.integers(0, len(copy)))] = "changed"
        out.append(" ".join(copy))
    out += [out[1]] * 4 + [None, "", "   \n", "one", "one two three", "ONE two THREE", "é" * 120 + "x" + "é" * 120, "ab" * 400, "w1 " * 300]
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[k], 1, "n", "x") for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


def test_anchor_repeats(spark, docs, corpus):
    from quernstone.llm.anchors import remove_repeats

    split = {i: (t or "").split() for i, t, *_ in corpus}
    for window in (35, 8):
        count = Counter(tuple(w[k : k + window]) for w in split.values() for k in range(len(w) - window + 1))
        got = {r["doc_id"]: r for r in remove_repeats(docs, window).collect()}
        assert len(got) == len(corpus)
        removed = 0
        for i, w in split.items():
            gone = np.zeros(len(w), bool)
            for k in range(len(w) - window + 1):
                if count[tuple(w[k : k + window])] > 1:
                    gone[k : k + window] = True
            removed += gone.sum()
            assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), gone.sum())
            assert got[i]["kept"] == " ".join(x for x, g in zip(w, gone) if not g)
        assert removed > 1000
    assert remove_repeats(docs.limit(0)).count() == 0
    twice = docs.limit(20).unionByName(docs.limit(20))
    assert remove_repeats(twice).count() == 40


def test_parse_repeats(spark, docs, corpus):
    from quernstone.llm.prefix_parse import remove_repeats

    for span in (100, 30):
        got = {r["doc_id"]: r for r in remove_repeats(docs, span).collect()}
        seen, total = set(), 0
        for i, t, *_ in sorted(corpus):
            body = (t or "").encode()
            gone = np.zeros(len(body), bool)
            for k in range(len(body) - span + 1):
                if body[k : k + span] in seen:
                    gone[k : k + span] = True
                seen.add(body[k : k + span])
            total += gone.sum()
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(body), gone.sum(), runs), i
            assert bytes(got[i]["kept"]) == np.frombuffer(body, np.uint8)[~gone].tobytes()
        assert total > 5000
    assert remove_repeats(docs.limit(0)).count() == 0
    missing = spark.createDataFrame([(None, "z" * 150), (1, "z" * 150), (1, "z" * 150)], "doc_id long, text string")
    # the null id comes first; both rows of the repeated id get the result of its first
    found = sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(missing).collect())
    assert found == [(0, 149), (1, 150), (1, 150)]


@pytest.mark.parametrize("parts", [1, 4])
def test_parse_repeats_of_repeated_rows(spark, parts):
    """A row's copy is no earlier text: whole rows that repeat keep what a single one would keep."""
    from quernstone.llm.prefix_parse import remove_repeats

    rng = np.random.default_rng(11)
    a, b, c, d = (" ".join(words(rng, 60, 10**6)) for _ in range(4))
    single = [(1, a), (2, b + a + c), (3, d[:150] + b), (None, d), (None, "short")]

    def result(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df).collect())

    want = result(single)
    assert {k[0]: k[2] for k in want}[1] == 0 and sum(k[2] for k in want) > 300
    assert result(single * 3) == Counter({k: 3 * n for k, n in want.items()})


def brute_components(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter()
        for s in sets[i]:
            common.update(holders[s])
            holders[s].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_components(spark, docs, corpus, block, monkeypatch):
    from quernstone.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", block)
    for size, percent in ((4, 85), (5, 80)):
        want = brute_components(corpus, size, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, size, percent).collect()}
        assert got == want
        assert len({c for _, c in want.values()}) < len(want) - 10
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sketched", [4096, 2])
def test_jaccard_chains_across_blocks(spark, sketched, monkeypatch):
    """A long chain of near copies, each linked only with its neighbours; also where stars are too large for sketches."""
    from quernstone.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SKETCHED", sketched)
    rng = np.random.default_rng(6)
    base, rows = words(rng, 100, 10**6), []
    for k in range(40):
        base = base[3:] + words(rng, 3, 10**6)
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows, 4, 85)
    assert {c for _, c in got.values()} == {0}


def test_parse_repeats_of_hot_triggers(spark, docs, corpus, monkeypatch):
    """Triggers with very many phrases are told apart by their strings' hashes, to the same end."""
    from quernstone.llm import prefix_parse

    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    want = sorted(tuple(r) for r in prefix_parse.remove_repeats(docs, 30).select(*columns).collect())
    monkeypatch.setattr(prefix_parse, "HOT", 1)
    assert sorted(tuple(r) for r in prefix_parse.remove_repeats(docs, 30).select(*columns).collect()) == want


def test_suffix_ranks():
    from quernstone.llm.prefix_parse import suffix_ranks

    rng = np.random.default_rng(13)
    for _ in range(50):
        data, length = rng.integers(97, 100, int(rng.integers(1, 200))).astype(np.uint8), int(rng.integers(1, 40))
        whole = bytes(data) + bytes(length)
        heads = [whole[k : k + length] for k in range(len(data))]
        place = {x: k for k, x in enumerate(sorted(set(heads)))}
        assert suffix_ranks(data, length).tolist() == [place[x] for x in heads]


def test_texts_longer_than_a_chunk(spark):
    """A text of several chunks, its second half a copy of its first, beside a short one."""
    from quernstone.llm import anchors, jaccard, prefix_parse

    rng = np.random.default_rng(14)
    half = words(rng, 200_000, 10**6)
    text = " ".join(half) + " "
    assert len(text) > 1.2 * prefix_parse.CHUNK
    df = spark.createDataFrame([(1, text + text), (2, "w1 w2 w3 w4 w5")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in prefix_parse.remove_repeats(df).collect()}
    assert (got[1]["n_bytes"], got[1]["n_removed"], got[1]["n_spans"]) == (2 * len(text), len(text), 1) and bytes(got[1]["kept"]) == text.encode()
    got = {r["doc_id"]: r for r in anchors.remove_repeats(df).collect()}
    assert (got[1]["n_words"], got[1]["n_removed"], got[1]["kept"]) == (400_000, 400_000, "") and got[2]["n_removed"] == 0
    assert [tuple(x) for x in got[1]["repeats"]] == [(0, 200_000), (200_000, 400_000)] or [tuple(x) for x in got[1]["repeats"]] == [(0, 400_000)]
    every = half + half
    got = {r["doc_id"]: r["n_shingles"] for r in jaccard.jaccard_components(df).collect()}
    assert got == {1: len({tuple(every[k : k + 4]) for k in range(len(every) - 3)}), 2: 2}


def test_kept_words_by_segments(monkeypatch):
    from quernstone.llm import anchors

    rng = np.random.default_rng(15)
    for _ in range(100):
        body = "  ".join(words(rng, int(rng.integers(0, 40)))).encode()
        edges = np.sort(rng.choice(41, 4, replace=False)).reshape(2, 2)
        edges = edges[edges[:, 1] <= len(body.split())]
        found = []
        for long in (1 << 22, 0):
            monkeypatch.setattr(anchors, "LONG", long)
            found.append(anchors._without(body, edges))
        assert found[0] == found[1]


def test_shingle_sets_of_more_rows_than_16_bits():
    """A long run of null and empty texts is one chunk, however many rows it has."""
    import pyarrow as pa

    from quernstone.llm.jaccard import shingle_sets

    texts = ["a b c d e", *[None, ""] * 70_000, "f g h i j k"]
    texts[65_536], texts[131_072] = "one two", "f g h i"
    for column in (pa.array(texts), pa.chunked_array([texts[:100_000], texts[100_000:]])):
        h, row = shingle_sets(column, 4)
        assert row.tolist() == [0, 0, 65_536, 131_072, *[len(texts) - 1] * 3]
        assert len(set(h.tolist())) == 6 and h[3] in h[4:]


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_sketches_miss_no_link(percent):
    """Sets of many sizes, linked ones among them with sketches of different lengths, and far ones that share half."""
    import pyarrow as pa

    from quernstone.llm.jaccard import links, near, shared, sketches

    rng = np.random.default_rng(percent)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 2, 5, 17, 60, 61, 150, 400, 1200):
        base = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        sets.append(base)
        for cut in (1, n // 12, n // 6, n // 2):
            fresh = rng.integers(0, 1 << 48, cut, dtype=np.uint64)
            sets += [base[cut:], np.unique(np.concatenate([base, fresh])), np.unique(np.concatenate([base[cut:], fresh]))]
    size = np.array([len(x) for x in sets])
    found = sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size, percent).to_pylist()
    assert len({len(x) for x in found}) > 4 and pa.array(found).null_count == 0
    may = near(size, [np.frombuffer(x, np.uint64) for x in found], percent)
    must = links(shared(sets), percent)
    assert not (must & ~may).any() and must.sum() > 2 * len(sets)
    large = size > 50
    assert (may & ~must)[np.ix_(large, large)].sum() < must[np.ix_(large, large)].sum()


def test_bands_cover_all_linked_sizes():
    from quernstone.llm.jaccard import Bands

    bands = Bands(85, 2000)
    sizes = np.arange(1, 2000)
    own = bands.of(sizes)
    for s in sizes[:1600]:
        assert own[s * 100 // 85 - 1] - own[s - 1] in (0, 1)


def test_deduplicate_keeps_one_of_each(spark, docs, corpus):
    from quernstone.llm.jaccard import deduplicate

    want = {c for _, c in brute_components(corpus, 5, 80).values()}
    got = deduplicate(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert sorted(ids) == sorted(want)
    twice = deduplicate(docs.unionByName(docs))
    assert sorted(r["doc_id"] for r in twice.select("doc_id").collect()) == sorted(want)


def test_deduplicate_keeps_unlinked_rows_of_one_id(spark):
    """Null ids and ids given twice: only linked or repeated rows go."""
    from quernstone.llm.jaccard import deduplicate

    rng = np.random.default_rng(12)
    a, b, c, d, e = (" ".join(words(rng, 80, 10**6)) for _ in range(5))
    near = a.split(" ")[:-1] + ["changed"]
    data = [(None, a), (None, " ".join(near)), (None, b), (None, b), (None, c), (None, None), (None, ""), (None, ""), (7, d), (7, e), (8, d), (9, c), (10, None), (10, "")]
    got = Counter((r["doc_id"], r["text"]) for r in deduplicate(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect())
    first = (None, a) if (None, a) in got else (None, " ".join(near))
    assert got == Counter([first, (None, b), (9, c), (None, None), (None, ""), (7, d), (7, e), (10, None), (10, "")])


def test_warc_round_trip(spark, tmp_path):
    from quernstone.llm.warc import read_warc, write_warc

    rng = np.random.default_rng(7)
    long = ["<p>" + "x" * int(n) + "é</p>" for n in rng.integers(100, 4000, 20)]
    data = [(int(k), None if k % 11 == 0 else f"http://h/{k}\r\n", [None, "", "short", *long][int(rng.integers(0, 23))], "w") for k in rng.permutation(300)]
    data += [(None, "http://none", "y" * 200, "w"), (None, None, "y" * 200, "w"), (5, "http://again", "z" * 200, "w"), (5, "http://again", "z" * 200, "w")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, payload string").repartition(3)
    manifests = []
    for k in range(2):
        path = f"file://{tmp_path}/a{k}"
        manifest = write_warc(df, path, roll_bytes=20_000)
        manifests.append(sorted(tuple(r) for r in manifest.collect()))
    assert manifests[0] == manifests[1] and len(manifests[0]) > 4
    got = read_warc(spark, path).collect()
    assert len(got) == len(data)
    firsts = {}
    for i, _, body, _ in data:
        b = (body or "").encode()
        if len(b) >= 100 and i is not None:
            firsts[b] = min(firsts.get(b, i), i)
    bodies = Counter((i, (body or "").encode()) for i, _, body, _ in data)
    seen = Counter()
    for r in got:
        key = next(b for i, b in bodies if i == r["page_id"] and hashlib.sha256(b).hexdigest() == r["payload_digest"])
        seen[r["page_id"], key] += 1
        assert r["payload_bytes"] == len(key)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == key and r["refers_to"] is None
            assert len(key) < 100 or r["page_id"] in (firsts.get(key), None)
        else:
            assert r["payload"] is None and r["refers_to"] == firsts.get(key)
    assert seen == bodies
    empty = write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_neighbours_recall(spark):
    from pyspark.sql import functions as F

    from quernstone.llm.ann import nearest

    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:760] = x[3]
    data = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [None] * 24), (5200, [1.0]), (5250, [])]
    df = spark.createDataFrame([(*r, "c") for r in data + odd], "vec_id long, embedding array<float>, node string")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, 1500, 50):
        s = y @ y[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        found += len(set(best.tolist()) & {i for i, _ in got[q]})
        total += 5
        assert all(abs(s[i] - v) < 1e-9 for i, v in got[q])
    assert found / total >= 0.9
    assert [i for i, _ in got[700]] == [3, 701, 702, 703, 704]
    assert set(got) == set(range(0, 1500, 50))
    few = nearest(df.filter("vec_id < 3 or vec_id = 5200"), F.col("vec_id") == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_leaves_a_bad_neighbourhood(spark):
    """Nodes on an arc, each listing only those beside it: the way to the query's like leads over nodes farther than all it lists."""
    from quernstone.llm.ann import ROW, _block, search

    degrees = [0, 10, 20, 30, 180, 5, 4]
    links = {0: [1, 2], 1: [0, 2], 2: [1, 3], 3: [2, 4], 4: [3, 5], 5: [4, 6], 6: [5]}
    x = np.array([[np.cos(np.radians(d)), np.sin(np.radians(d))] for d in degrees], np.float32)
    graph = [(int(_block(np.array([n]), 4)[0]), 0, n, np.array(to, np.int64).tobytes(), (x[to] @ x[n]).astype(np.float32).tobytes(), x[n].tobytes()) for n, to in links.items()]
    found = search(spark.createDataFrame(graph, ROW), 4, spark.createDataFrame([(0,)], "node long")).first()
    assert list(found["near"]) == [0, 6, 5, 1, 2, 3, 4]


def test_pipeline_stage_by_stage(spark):
    import os
    import re

    import corpus_pipeline as p
    from quernstone.session import table

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    docs = table(spark, at, "documents")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, work in p.STAGES[:-1]:
        docs = work(spark, docs, at).cache()
        assert docs.columns == columns
        kept[name] = docs.toPandas()
    assert 0 < len(kept["toxicity"]) <= before
    rows = [(int(i), t) for i, t in zip(kept["toxicity"]["doc_id"], kept["toxicity"]["text"])]
    assert sorted(kept["ngram_jaccard_join"]["doc_id"]) == sorted({c for _, c in brute_components(rows, 5, 80).values()})
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "") for t in kept["pii"]["text"])
    done = p.STAGES[-1][1](spark, docs, at)
    assert done.count() == len(kept["mixing"])


def test_range_shards_cut_ranges_evenly(spark, monkeypatch):
    """More shards than bounds: they ascend with the id, and are even where ids lie evenly in a range."""
    from pyspark.sql import functions as F

    from quernstone.llm import common

    monkeypatch.setattr(common, "COARSE", 4)
    ids = spark.range(-500, 3500).unionByName(spark.range(100_000, 100_500)).repartition(3)
    shard, parts = common.range_shards(ids, "id", 40)
    got = ids.select("id", shard(F.col("id")).alias("s")).orderBy("id").collect()
    own = [r["s"] for r in got]
    assert own == sorted(own) and 0 <= own[0] and own[-1] < parts
    held = Counter(own)
    assert max(held[s] for s in range(30)) <= 114 and max(held.values()) <= 1125 and len(held) > 30
