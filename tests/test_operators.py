"""Operators against hand-made values."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quernstone.functions import records as r
from quernstone.operators import bootstrap, dedup, features, graph, hits, metrics, splits, synthetic
from quernstone.sources import sinks, tables


def rows(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns).collect())


def test_sequence_reasons(spark):
    values = [(None,), ("  ",), ("ab1",), ("acd",), (" acdef\n",), ("A" * 9,)]
    df = spark.createDataFrame(values, "s string").select(r.sequence_reason(F.col("s"), 4, 8).alias("x"))
    assert [x[0] for x in df.collect()] == ["missing", "missing", "invalid_characters", "too_short", None, "too_long"]


def test_label_parts(spark):
    values = ["1.2.3.4", " 1.2.3.4; ", "", None, "1.1.1.1;2.2.2.2", "1.2.3.-", "1.2", "x"]
    reason, label = r.label_parts(F.col("v"))
    got = spark.createDataFrame([(v,) for v in values], "v string").select(reason, label).collect()
    assert [tuple(x) for x in got] == [(None, "1.2"), (None, "1.2"), ("missing_label", None), ("missing_label", None), ("multiple_labels", None), ("incomplete_label", None), ("incomplete_label", None), ("malformed_label", None)]


@pytest.mark.parametrize("value,name", [(0.0, "0.00-0.20"), (0.2, "0.20-0.30"), (0.3, "0.30-0.40"), (0.5, "0.50-0.70"), (0.7, "0.70-1.00"), (1.0, "0.70-1.00")])
def test_identity_edges(spark, value, name):
    assert spark.range(1).select(r.identity_bin(F.lit(value), F.lit(False))).first()[0] == name


def test_eligibility_precedence(spark):
    cases = [(4, 9, "privacy_suppressed"), (9, 2, "privacy_suppressed"), (19, 12, "insufficient_sequences"), (20, 9, "insufficient_components_for_ci"), (20, 10, "reportable")]
    df = spark.createDataFrame([(n, c) for n, c, _ in cases], "n long, c long").select(r.eligibility(F.col("n"), F.col("c")))
    assert [x[0] for x in df.collect()] == [s for *_, s in cases]


def test_dedup_rejects_whole_conflicts(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "y", "a"), (4, "y", "b"), (5, "z", "c")], "id long, seq string, label string")
    kept, bad = dedup.split_conflicts(dedup.sequence_groups(df, ["seq"], "label", "id"))
    assert rows(kept, "canonical_id", "duplicate_count") == [(1, 2), (5, 1)]
    assert rows(bad, "seq", "labels") == [("y", 2)]


HIT = "query string, target string, fident double, qcov double, tcov double, evalue double, bits double"


def test_best_hits_and_fallback(spark):
    found = spark.createDataFrame([("q1", "t2", 0.5, 0.9, 0.9, 1e-5, 10.0), ("q1", "t1", 0.5, 0.9, 0.9, 1e-5, 10.0), ("q1", "t3", 0.4, 0.9, 0.9, 1e-9, 50.0)], HIT)
    asked = spark.createDataFrame([("q1",), ("q2",)], "query string")
    assert rows(hits.nearest_train(asked, found), "query", "target", "no_match") == [("q1", "t1", False), ("q2", None, True)]
    targets = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "b"), ("t4", "a")], "target string, label string")
    assert rows(hits.nearest_label(asked, found, targets, "label"), "query", "predicted") == [("q1", "b"), ("q2", "a")]


def test_best_pairs_are_undirected_and_inclusive(spark):
    found = spark.createDataFrame([("b", "a", 0.3, 0.8, 0.8, 1e-3, 1.0), ("a", "b", 0.4, 0.8, 0.8, 1e-3, 1.0), ("a", "a", 1.0, 1.0, 1.0, 0.0, 9.0), ("a", "c", 0.9, 0.79, 1.0, 0.0, 9.0)], HIT)
    assert rows(hits.best_pairs(found), "left", "right", "fident") == [("a", "b", 0.4)]


def test_lineage_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "x")], "k long, p string, q string")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "x")], "k long, p string, q string")
    assert rows(hits.lineage_diff(old, new, "k", ["p", "q"]), "k", "status", "changed_fields") == [(1, "same", ""), (2, "changed", "q"), (3, "removed", ""), (4, "added", "")]


def test_components_of_a_path_a_cycle_and_nothing(spark):
    path = [(k, k + 1) for k in range(30)]
    edges = spark.createDataFrame([*path, (100, 101), (101, 102), (102, 100), (7, 7), (None, 5)], "left long, right long")
    got = dict(rows(graph.components(edges), "node", "component"))
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_whole_components_against_union_find(spark, tmp_path):
    import hashlib
    import random
    from collections import Counter

    from quernstone.plans.queries import QUERIES

    rng = random.Random(3)
    lines = [(rng.randrange(60), rng.randrange(40), float(rng.randrange(1, 51)), rng.randrange(1, 8)) for _ in range(110)]
    lines += [(70, 50, 35.0, 7), (71, 50, 25.0, 6), (72, 50, 15.0, 5), (73, 51, 14.0, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(80).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(60).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    want, sizes, names, label = [], [], [], lambda n: "1" if n == 1 else "2-4" if n <= 4 else "5-9" if n <= 9 else "10-19" if n <= 19 else "20+"
    for percent in (70, 50, 30):
        parent = {n: n for n in [*range(1, 160, 2), *range(0, 120, 2)]}

        def find(n):
            return n if parent[n] == n else find(parent[n])

        for o, part, quantity, _ in lines:
            if quantity * 2 >= percent:
                a, b = find(o * 2 + 1), find(part * 2)
                parent[max(a, b)] = min(a, b)
        of = {n: find(n) for n in parent}
        want += [(percent, n, c) for n, c in of.items()]
        n_of = Counter(of.values())
        bins = Counter(label(n) for n in n_of.values())
        sizes += [(percent, k, v, sum(n for n in n_of.values() if label(n) == k)) for k, v in bins.items()]
        for c, n in n_of.items():
            own = sorted(hashlib.sha256(str(m).encode()).hexdigest() for m in of if of[m] == c)
            names.append((percent, c, "component-" + hashlib.sha256("".join(h + "\n" for h in own).encode()).hexdigest(), n))
    at = str(tmp_path)
    assert rows(QUERIES["components_whole"](spark, at), "percent", "node", "component") == sorted(want)
    assert {k for _, k, *_ in sizes} >= {"1", "20+"}
    assert rows(QUERIES["component_sizes_whole"](spark, at), "percent", "bin", "components", "nodes") == sorted(sizes)
    assert rows(QUERIES["component_id_whole"](spark, at), "percent", "component", "name", "n") == sorted(names)
    fine = {p: len({c for q, _, c in want if q == p}) for p in (70, 50)}
    assert rows(QUERIES["nested_check_whole"](spark, at), "percent", "fine_components", "torn") == [(50, fine[50], 0), (70, fine[70], 0)]


def test_apportionment(spark):
    totals = [0, 1, 2, 3, 4, 5, 6, 9, 10, 12]
    want = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 1, 0), (3, 1, 1), (4, 1, 1), (6, 2, 1), (7, 2, 1), (8, 2, 2)]
    assert [splits.counts_of(n) for n in totals] == want
    many = spark.range(200).select("id", F.array(*splits.apportioned(F.col("id"))).alias("c")).collect()
    assert [tuple(r["c"]) for r in sorted(many)] == [splits.counts_of(n) for n in range(200)]
    df = spark.createDataFrame([(n,) for n in totals], "n long").select(*splits.apportioned(F.col("n")))
    assert [tuple(x) for x in df.collect()] == want
    assert tuple(spark.createDataFrame([(3,)], "n long").select(*splits.repaired(F.col("n"))).first()) == (1, 1, 1)


def test_greedy_placement():
    import hashlib

    def hashes(name):
        return tuple(hashlib.sha256("\n".join(["42", name, *more]).encode()).hexdigest() for more in ([], *[[s] for s in splits.SPLITS]))

    for order in ("bac", "abc", "cba"):
        got = splits.place_groups([(x, {"1.1": 1}, hashes(x)) for x in order])
        assert got == [("a", "validation", Fraction(3)), ("c", "train", Fraction(3, 2)), ("b", "test", Fraction(3))]


def test_grouped_split_keeps_groups_whole(spark):
    df = synthetic.cohort(spark)
    assert df.count() == 90 and df.select("component").distinct().count() == 45
    done = splits.grouped_split(df, "label", "component")
    assert rows(splits.crossings(done, "component"), "crossings") == [(0,)]
    assert splits.crossings(splits.random_split(df, "accession", "sequence_sha256", "label"), "component").first()[0] > 0


def test_metrics_divide_by_all_labels(spark):
    data = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("d", "d")]
    table = metrics.confusion(spark.createDataFrame([("x", *p) for p in data], "k string, truth string, predicted string"), ["k"])
    got = metrics.macro(table, ["k"], "abcde").first()
    assert got["accuracy"] == pytest.approx(0.8) and got["macro_precision"] == pytest.approx((1 + 0.5 + 1 + 1) / 5)
    assert got["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 1 + 1) / 5)


def test_dominant_error_ties_by_label_order(spark):
    table = metrics.confusion(spark.createDataFrame([("k", "a", "c"), ("k", "a", "b"), ("k", "a", "a")], "k string, truth string, predicted string"), ["k"])
    assert metrics.dominant_errors(table, ["k"], ["c", "b", "a"]).first()["dominant"] == "c"


def test_bootstrap_draws():
    assert bootstrap.group_draws(3, 3, 2026, "random:macro_f1:majority").tolist() == [[1, 2, 0], [0, 1, 0], [0, 1, 1]]


def test_bootstrap_repeats_whole_groups(spark):
    data = [("s", g, t, t) for g, t in zip("aabccc", "xyxyxy")]
    df = spark.createDataFrame(data, "k string, g string, truth string, predicted string")
    draws = bootstrap.draw_table(df, ["k"], "g", "random:macro_f1:majority", 3)
    assert rows(draws, "iteration", "group", "times") == [(0, "a", 1), (0, "b", 1), (0, "c", 1), (1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "b", 2)]
    values = bootstrap.replicates(df, draws, ["k"], "g", ["x", "y"])
    assert [v["rows"] for v in values.orderBy("iteration").collect()] == [6, 5, 4]


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_diff", "split_gap", "performance_summary", "model_comparisons", "seed_diagnostics"])
def test_bootstrap_queries_draw_2000_times(spark, monkeypatch, name):
    from quernstone.plans import queries

    cells = [(s, k, f"g{k % 9}", "BUILDING", m, "BUILDING" if k % (2 + len(m)) else "MACHINERY") for s in "OF" for k in range(30) for m in "ab"]
    rows_ = spark.createDataFrame(cells, "split string, id long, component string, truth string, method string, predicted string")
    monkeypatch.setattr(queries, "long_star", lambda spark, sf_dir: rows_)
    drawn, draw = [], bootstrap.draw_table

    def noted(*args, **kwargs):
        drawn.append(draw(*args, **kwargs))
        return drawn[-1]

    monkeypatch.setattr(bootstrap, "draw_table", noted)
    queries.QUERIES[name](spark, "")
    assert len(drawn) == (3 if name == "seed_diagnostics" else 1)
    assert all(d.agg(F.count_distinct("iteration")).first()[0] == 2000 for d in drawn)


def test_features(spark):
    df = spark.createDataFrame([(1, "AACD"), (2, "AC"), (3, "")], "id long, s string")
    got = [x[0] for x in df.select(features.composition(F.col("s"), "ACD")).collect()]
    assert got == [[0.5, 0.25, 0.25], [0.5, 0.5, 0.0], None]
    assert rows(features.kmer_counts(df, ["id"], "s"), "id", "kmer", "n") == [(1, "AAC", 1), (1, "ACD", 1)]
    pooled = spark.range(1).select(features.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(9.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1), F.lit(0), F.lit(1)))).first()[0]
    assert pooled == [2.0, 3.0]


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("query\ttarget\tfident\tqcov\ttcov\tevalue\tbits\nq\tt\t0.5\t0.9\t0.9\t1e-5\t10\nq\tt\t1.5\t0.9\t0.9\t1e-5\t10\n")
    assert tables.hit_violations(tables.read_hits(spark, str(tmp_path / "h.tsv"))).first().asDict() == {"out_of_range": 1, "repeated": 1}
    df = spark.createDataFrame([("a1", "xx|a1|E", "ACD" * 30), ("b2", "b2 text", "A")], "accession string, header string, sequence string")
    sinks.publish_fasta(df, str(tmp_path / "f"))
    back = tables.read_fasta(spark, str(tmp_path / "f"))
    assert rows(back, "accession", "sequence") == [("a1", "ACD" * 30), ("b2", "A")]
    with pytest.raises(Exception):
        sinks.publish_fasta(df, str(tmp_path / "f"))
    sinks.publish_parquet(df, str(tmp_path / "p"), ["accession"])
    assert tables.read_parquet(spark, str(tmp_path / "p"), "accession string, header string, sequence string", 2).count() == 2
    with pytest.raises(ValueError):
        tables.read_parquet(spark, str(tmp_path / "p"), "accession string")
    cells = spark.createDataFrame([(1, -0.0, None, True), (2, 0.1, 'a,"b"', False), (3, -1e-16, "c", None), (4, 2.5, "NA", True), (5, 1 / 3, "", None)], "k int, a double, b string, c boolean")
    sinks.publish_csv(cells, str(tmp_path / "c"), ["k", "a", "b", "c"], ["k"])
    lines = [line for part in sorted((tmp_path / "c").glob("part-*")) for line in part.read_text().split("\n")[:-1] if line != "k,a,b,c"]
    assert lines == ["1,0,NA,true", '2,0.1,"a,""b""",false', "3,0,c,NA", "4,2.5,NA,true", "5,0.333333333333333,,NA"]
    import random

    from quernstone.functions.canonical import fixed_point

    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 0.5, 1e-16, 10.0, 120.0, -1e-15, 0.9999999999999999, 1e15, *[rng.choice([-1, 1, 3]) * rng.random() for _ in range(300)], *[k / 97 for k in range(97)]]
    shown = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", fixed_point(F.col("v")).alias("t")).collect()
    for k, got in shown:
        want = f"{values[k]:.15f}".rstrip("0").rstrip(".")
        assert got == ("0" if want == "-0" else want)
    with pytest.raises(Exception, match="finite"):
        sinks.publish_csv(spark.createDataFrame([(1, float("nan"))], "k int, a double"), str(tmp_path / "n"), ["k", "a"], ["k"])


def test_streaming_ingest(spark, tmp_path):
    from quernstone.streaming.ingest import validated

    source = tmp_path / "in"
    spark.createDataFrame([("ACD" * 20,), ("acd" * 20,), ("AX",)], "s string").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(source))
    stream = spark.readStream.schema("s string, at timestamp").parquet(str(source))
    done = validated(stream, "s", "at").writeStream.format("memory").queryName("valid").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert spark.table("valid").count() == 1


def test_token_batches(spark):
    from quernstone.operators.batching import batching_statistics, pack, token_batches

    assert pack([2, 3, 3, 5, 9, 12], 10) == [0, 0, 0, 1, 2, 3]
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 5), (4, 12)], "id long, n long")
    done = token_batches(df, "n", "id", 10)
    assert rows(done, "id", "batch") == [(1, 0), (2, 0), (3, 1), (4, 2)]
    got = batching_statistics(done, "n").first()
    assert (got["batches"], got["most"]) == (3, 2) and got["efficiency"] == pytest.approx(22 / 23)


def test_paged_download():
    import gzip

    from quernstone.sources.paged import Page, delay, download

    pages = {
        "https://h/1": [Page(503), Page(200, {"link": '<https://h/2>; rel="next"', "x-total-results": "3"}, b"a\tb\r\n1\t2\r\n3\t4\r\n")],
        "https://h/2": [Page(200, {"x-total-results": "3"}, b"a\tb\n5\t6\n")],
    }
    waits = []
    body, counts = download(lambda u: pages[u].pop(0), "https://h/1", ["a", "b"], waits.append)
    assert gzip.decompress(body) == b"a\tb\n1\t2\n3\t4\n5\t6\n" and counts == [2, 1] and waits == [1.0]
    assert delay(3, 1.0, 60.0, Page(429, {"retry-after": "9"})) == 9.0 and delay(9, 1.0, 60.0, None) == 60.0
    with pytest.raises(ValueError, match="circle"):
        download(lambda u: Page(200, {"link": f'<{u}>; rel="next"'}, b"a\n1\n"), "https://h/1", ["a"])
    with pytest.raises(ValueError, match="another host"):
        download(lambda u: Page(200, {"link": '<https://g/2>; rel="next"'}, b"a\n1\n"), "https://h/1", ["a"])


def test_bundle_never_replaces(tmp_path):
    from quernstone.sources.bundle import publish

    publish(tmp_path / "b", {"x/y.txt": b"1"})
    assert (tmp_path / "b/x/y.txt").read_bytes() == b"1"
    with pytest.raises(FileExistsError):
        publish(tmp_path / "b", {"z": b"2"})
    with pytest.raises(ValueError):
        publish(tmp_path / "c", {"../z": b"2"})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b"]


def test_similar_finds_all_pairs(spark):
    import itertools
    import random

    from quernstone.operators import search

    rng = random.Random(3)
    base = ["".join(rng.choice("ACDEF") for _ in range(60)) for _ in range(8)]
    data = [(k, b[:rng.randrange(20, 60)] + "".join(rng.choice("ACDEF") for _ in range(rng.randrange(0, 30)))) for k, b in enumerate(base * 6)] + [(99, "ACD"), (100, "")]
    words = {i: {s[k : k + 5] for k in range(len(s) - 4)} for i, s in data}
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if words[a] & words[b] and 100 * len(words[a] & words[b]) >= 30 * len(words[a] | words[b])}
    df = spark.createDataFrame(data, "id long, sequence string")
    assert set(rows(search.similar(df), "query", "target")) == want and len(want) > 50
    halves = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    assert {tuple(sorted(p)) for p in rows(search.similar(*halves), "query", "target")} == {p for p in want if p[0] % 2 != p[1] % 2}


def test_references_and_resolution(spark):
    from quernstone.operators import integrity

    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    nodes = spark.createDataFrame([(1, "x"), (2, "y")], "k long, n string")
    assert rows(integrity.references(facts, nodes, "k"), "rows", "known", "unknown") == [(3, 2, 1)]
    assert rows(integrity.resolved(facts.filter("k < 3"), nodes, "k"), "k", "n") == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="unknown k"):
        integrity.resolved(facts, nodes, "k").collect()
    near = integrity.numeric_replay(spark.createDataFrame([(1, [1.0, 2.0])], "k long, v array<double>"), spark.createDataFrame([(1, [1.0, 2.1, 3.0])], "k long, v array<double>"), "k", "v").first()
    assert (near["cells"], near["single"], near["outside"]) == (3, 1, 1) and abs(near["max_abs"] - 0.1) < 1e-12


def test_canonical_text(spark, tmp_path):
    from decimal import Decimal

    from quernstone.functions import canonical as text

    assert spark.range(1).select(text.exact_decimal(F.lit("0.123456").cast("decimal(10,8)"))).first()[0] == Decimal("0.123456")
    with pytest.raises(Exception, match="digits would be lost"):
        spark.range(1).select(text.exact_decimal(F.lit("0.1234567").cast("decimal(10,8)"))).collect()
    released = tmp_path / "r.csv"
    released.write_text("a,b\n1,NA\n2,0.5\n")
    assert rows(tables.read_released(spark, str(released), "a int, b double"), "a", "b") == [(1, None), (2, 0.5)]
    clusters = tmp_path / "c.tsv"
    clusters.write_text("a\ta\na\tb\n")
    known = spark.createDataFrame([("a",), ("b",)], "member string")
    assert tables.read_clusters(spark, str(clusters), known).count() == 2
    with pytest.raises(ValueError):
        tables.read_clusters(spark, str(clusters), known.limit(1))
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "k long, v array<float>").write.parquet(str(tmp_path / "m"))
    assert tables.read_matrix(spark, str(tmp_path / "m"), "k", "v", 2, 2).count() == 2
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "m"), "k", "v", 3)


@pytest.mark.parametrize("rest, kind", [(0, "long"), (100, "long"), (1 << 14, "string")])
def test_components_of_a_large_star_and_paths(spark, rest, kind, monkeypatch):
    """Joins meet no more rows of a node than it has neighbours in the input, though one component holds nearly all nodes."""
    import random
    from collections import Counter

    monkeypatch.setattr(graph, "REST", rest)
    rng = random.Random(4)
    tree = [(rng.randrange(max(0, k - 20), k), k) for k in range(1, 1500)]  # one component of low degree
    edges = tree + [(2000 + k, 2001 + k) for k in range(0, 90) if k % 30] + [(5, 5), (None, 3), (2500, 2501), (2501, 2500)]
    staged, kept = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label, *held: staged.append((label, out := kept(df, label, *held))) or out)
    name = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"{x:05d}")
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"left {kind}, right {kind}")
    got = dict(rows(graph.components(frame), "node", "component"))
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(2000):
        if not any(root[a] != root[b] for a, b in edges if a is not None and a != b):
            break
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {name(k): name(v) for k, v in root.items()}
    first = next(out for label, out in staged if label == "moves")
    degree = Counter(x for e in edges for x in e)
    most = Counter(r["to"] for r in first.collect()).most_common(1)[0][1]
    assert rest == 1 << 14 or most <= max(degree.values()) + 1
    assert len([label for label, _ in staged if label == "moves"]) < 16
