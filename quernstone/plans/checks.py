"""Queries for search, references, inventories, invariants and gates, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import records as r
from quernstone.operators import clusters, dedup, features, graph, hits, integrity, leaks, metrics, reports, search, splits
from quernstone.plans import queries as q
from quernstone.plans.queries import query
from quernstone.session import stage, table

BOTH = q.SPLIT.rstrip() + ",\n" + q.RECORDS.removeprefix("WITH ")

# ---- search ----

KMERS = """, v AS (SELECT doc_id, seq FROM judged WHERE reason IS NULL), k AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(seq) - 3), lambda i: substring(seq, i, 5))) AS w FROM v), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1)
"""


def sequences(spark, sf_dir) -> DataFrame:
    return q.judged(spark, sf_dir).filter(F.col("reason").isNull()).select(F.col("doc_id").alias("id"), F.col("seq").alias("sequence"))


@query(q.RECORDS + KMERS + ", c AS (SELECT a.doc_id AS query, b.doc_id AS target, count(*) AS shared FROM k a JOIN k b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL) SELECT query, target, shared, round(shared / (x.n + y.n - shared), 6) AS identity FROM c JOIN n x ON c.query = x.doc_id JOIN n y ON c.target = y.doc_id WHERE 100 * shared >= 30 * (x.n + y.n - shared)")
def self_search(spark, sf_dir):
    """All pairs of valid sequences over the threshold, each once."""
    return search.similar(sequences(spark, sf_dir)).withColumn("identity", F.round("identity", 6))


@query(BOTH + KMERS.replace(", k AS", ", words AS").replace("FROM k ", "FROM words ") + ", pairs AS (SELECT a.doc_id AS query, b.doc_id AS target, count(*) AS shared FROM words a JOIN words b ON a.w = b.w JOIN assigned s ON s.doc_id = a.doc_id AND s.split = 'test' JOIN assigned t ON t.doc_id = b.doc_id AND t.split = 'train' GROUP BY ALL) SELECT query, target, shared, round(shared / (x.n + y.n - shared), 6) AS identity FROM pairs c JOIN n x ON c.query = x.doc_id JOIN n y ON c.target = y.doc_id WHERE 100 * shared >= 30 * (x.n + y.n - shared)")
def cross_search(spark, sf_dir):
    """Test sequences against those of the training split."""
    split = q.assigned(spark, sf_dir).select(F.col("doc_id").alias("id"), "split")
    rows = sequences(spark, sf_dir).join(split, "id")
    test, train = (rows.filter(F.col("split") == s).drop("split") for s in ("test", "train"))
    return search.similar(test, train).withColumn("identity", F.round("identity", 6))


def candidates(spark, sf_dir) -> DataFrame:
    """Distinct valid sequences under their canonical ids, as exact deduplication keeps them."""
    kept, _ = dedup.split_conflicts(q.sequence_groups(spark, sf_dir))
    return kept.select(F.col("canonical_id").alias("id"), F.col("seq").alias("sequence"))


def hit_values(hits: DataFrame) -> DataFrame:
    return hits.select("query", "target", *[F.round(c, 6).alias(c) for c in ("fident", "qcov", "tcov")], "evalue", F.round("bits", 6).alias("bits"))


@query()
def alignment_search(spark, sf_dir):
    """All pairs of candidates with a qualifying local alignment, each once; tests hold it against full dynamic programming."""
    return hit_values(search.search(stage(candidates(spark, sf_dir), "candidates")))


def candidate_split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(id, sequence, label) of the candidates in the test and in the training split."""
    rows = candidates(spark, sf_dir).join(q.assigned(spark, sf_dir).select(F.col("doc_id").alias("id"), "split", F.col("lang").alias("label")), "id")
    rows = stage(rows, "candidate-split")
    return rows.filter("split = 'test'").drop("split"), rows.filter("split = 'train'").drop("split")


@query()
def alignment_audit(spark, sf_dir):
    """The nearest training sequence of each test sequence by alignment, and whether the labels agree; also those without a hit."""
    test, train = candidate_split(spark, sf_dir)
    best = hits.nearest_train(test.select(F.col("id").alias("query"), "label"), search.search(test, train))
    named = best.join(train.select(F.col("id").alias("target"), F.col("label").alias("train_label")), "target", "left")
    return named.select("query", "target", *[F.round(c, 6).alias(c) for c in ("fident", "qcov", "tcov", "bits")], "no_match", (F.col("label") == F.col("train_label")).alias("same_label"))


@query()
def alignment_classifier(spark, sf_dir):
    """The label of each test sequence's nearest training sequence (by bits), else the training split's majority label."""
    test, train = candidate_split(spark, sf_dir)
    named = train.select(F.col("id").alias("target"), "label")
    found = hits.nearest_label(test.select(F.col("id").alias("query")), search.search(test, train), named, "label")
    return found.select("query", "target", "predicted")


@query()
def native_clusters(spark, sf_dir):
    """(representative, member) of the candidates by representative clustering."""
    return clusters.representative_clusters(stage(candidates(spark, sf_dir), "candidates"))


@query()
def native_against_strict(spark, sf_dir):
    """How far the representative clusters and the components of all qualifying pairs agree, as one row."""
    rows = stage(candidates(spark, sf_dir), "candidates")
    strict = graph.components(search.search(rows), "query", "target", rows.select(F.col("id").alias("node")))
    return clusters.membership_equality(clusters.representative_clusters(rows), strict.select("component", F.col("node").alias("member")))


EQUAL = """, a AS (SELECT source AS a, doc_id AS member FROM documents WHERE doc_id % 50 <> 7), b AS (SELECT CASE WHEN source = 'src1' AND doc_id % 2 = 0 THEN 'other' ELSE source || lower(lang) END AS b, doc_id AS member FROM documents WHERE doc_id % 60 <> 11),
j AS (SELECT a, b, coalesce(a.member, b.member) AS member FROM a FULL JOIN b ON a.member = b.member), c AS (SELECT a, b, count(*) AS n FROM j GROUP BY ALL),
ra AS (SELECT a, sum(n) AS n, count(b) AS k FROM c WHERE a IS NOT NULL GROUP BY a), rb AS (SELECT b, sum(n) AS n, count(a) AS k FROM c WHERE b IS NOT NULL GROUP BY b)"""


@query("WITH " + EQUAL[2:] + " SELECT (SELECT count(*) FROM j) AS members, (SELECT count(*) FROM j WHERE a IS NULL OR b IS NULL) AS single, (SELECT count(*) FROM ra) AS first_groups, (SELECT count(*) FROM ra WHERE k > 1) AS first_torn, (SELECT count(*) FROM rb) AS second_groups, (SELECT count(*) FROM rb WHERE k > 1) AS second_torn, (SELECT count(*) FROM c JOIN ra USING (a) JOIN rb USING (b) WHERE c.n = ra.n AND c.n = rb.n) AS equal")
def membership_equality(spark, sf_dir):
    """Two partitions of the documents, with members missing on either side and groups torn apart."""
    docs = table(spark, sf_dir, "documents")
    a = docs.filter("doc_id % 50 <> 7").select("source", F.col("doc_id").alias("member"))
    other = F.when((F.col("source") == "src1") & (F.col("doc_id") % 2 == 0), "other").otherwise(F.concat("source", F.lower("lang")))
    return clusters.membership_equality(a, docs.filter("doc_id % 60 <> 11").select(other.alias("b"), F.col("doc_id").alias("member")))


# ---- all strata of one star ----

IDENTITY_BINS = ("no_hit", *[f"{low:.2f}-{high:.2f}" for low, high in zip(r.IDENTITY_EDGES, r.IDENTITY_EDGES[1:])])
DIMENSIONS = {"all": ("all",), "identity": IDENTITY_BINS, "length": tuple(f"{low}-{high}" for low, high in r.LENGTH_BINS), "component_size": tuple(name for *_, name in r.SIZE_BINS)}
STRATA = q.NEAREST.rstrip() + ",\n" + q.STAR.removeprefix("WITH ").rstrip() + f""", sized AS (SELECT o_orderkey AS id, count(*) OVER (PARTITION BY o_custkey) AS size, 50 + o_orderkey * 13 % 951 AS len FROM orders),
x AS (SELECT split, method, component, truth, predicted, unnest([{{'dimension': 'all', 'bin': 'all'}}, {{'dimension': 'identity', 'bin': CASE WHEN no_match THEN 'no_hit' WHEN fident < 0.2 THEN '0.00-0.20' WHEN fident < 0.3 THEN '0.20-0.30' WHEN fident < 0.4 THEN '0.30-0.40' WHEN fident < 0.5 THEN '0.40-0.50' WHEN fident < 0.7 THEN '0.50-0.70' ELSE '0.70-1.00' END}},
 {{'dimension': 'length', 'bin': CASE WHEN len < 200 THEN '50-199' WHEN len < 400 THEN '200-399' WHEN len < 600 THEN '400-599' WHEN len < 800 THEN '600-799' ELSE '800-1000' END}}, {{'dimension': 'component_size', 'bin': CASE WHEN size = 1 THEN '1' WHEN size <= 4 THEN '2-4' WHEN size <= 9 THEN '5-9' WHEN size <= 19 THEN '10-19' ELSE '20+' END}}], recursive := true) FROM long JOIN near ON id = query JOIN sized USING (id)),
bins AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, '{b}' AS bin" for d, bs in DIMENSIONS.items() for b in bs)}), cells AS (SELECT * FROM (SELECT DISTINCT split, method FROM x) CROSS JOIN bins),
n AS (SELECT split, method, dimension, bin, count(*) AS n, count(DISTINCT component) AS c, count(*) FILTER (truth = predicted) / count(*) AS accuracy FROM x GROUP BY ALL),
ft AS (SELECT split, method, dimension, bin, truth AS label, count(*) AS support, count(*) FILTER (truth = predicted) AS hits FROM x GROUP BY ALL), fp AS (SELECT split, method, dimension, bin, predicted AS label, count(*) AS guessed FROM x GROUP BY ALL),
f AS (SELECT split, method, dimension, bin, sum(2 * coalesce(hits, 0) / (coalesce(support, 0) + coalesce(guessed, 0))) / 5 AS macro_f1 FROM ft FULL JOIN fp USING (split, method, dimension, bin, label) GROUP BY ALL),
told AS (SELECT *, CASE WHEN n IS NULL OR n < 5 OR c < 3 THEN 'privacy_suppressed' WHEN n < 20 THEN 'insufficient_sequences' WHEN c < 10 THEN 'insufficient_components_for_ci' ELSE 'reportable' END AS status FROM cells LEFT JOIN n USING (split, method, dimension, bin) LEFT JOIN f USING (split, method, dimension, bin))
"""


@query(STRATA + "SELECT split, method, dimension, bin, status, CASE WHEN coalesce(n, 0) < 5 THEN '<5' WHEN status <> 'privacy_suppressed' THEN CAST(n AS VARCHAR) END AS rows, CASE WHEN coalesce(c, 0) < 3 THEN '<3' WHEN status <> 'privacy_suppressed' THEN CAST(c AS VARCHAR) END AS components, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN round(accuracy, 9) END AS accuracy, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN round(macro_f1, 9) END AS macro_f1 FROM told")
def strata_tables(spark, sf_dir):
    """Predictions, holders and nearest hits as one star; its metrics by identity, length and component size, every bin of every cell."""
    near = q.nearest(spark, sf_dir).select(F.col("query").alias("id"), "fident", "no_match")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.lit(50) + F.col("o_orderkey") * 13 % 951).alias("length"))
    sized = integrity.with_group_size(orders, "o_custkey").drop("o_custkey")
    rows = q.long_star(spark, sf_dir).join(near, "id").join(sized, "id")
    columns = {"all": F.lit("all"), "identity": r.identity_bin(F.col("fident"), F.col("no_match")), "length": r.length_bin(F.col("length")), "component_size": r.size_bin(F.col("component_size"))}
    done = reports.every_dimension(rows, q.CELL, {d: (columns[d], bins) for d, bins in DIMENSIONS.items()}, "component", q.SEGMENTS)
    return done.select(*q.CELL, "dimension", "bin", "status", "rows", F.col("groups").alias("components"), F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


# ---- published text ----

@query("WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 97 / 97.0::DOUBLE END AS rate, s_suppkey % 3 = 0 AS flag, CASE WHEN s_suppkey % 7 = 0 THEN concat(s_name, ',', '\"x\"') WHEN s_suppkey % 11 <> 0 THEN s_name END AS name FROM supplier) SELECT s_suppkey, concat_ws(',', s_suppkey, CASE WHEN rate IS NULL THEN 'NA' ELSE regexp_replace(printf('%.15f', rate), '\\.?0+$', '') END, flag, CASE WHEN name IS NULL THEN 'NA' WHEN contains(name, ',') THEN concat('\"', replace(name, '\"', '\"\"'), '\"') ELSE name END) AS line FROM v")
def canonical_csv(spark, sf_dir):
    """Lines of a canonical CSV with nulls, fractions, flags and text to be quoted."""
    from quernstone.functions.canonical import csv_line

    k = F.col("s_suppkey")
    name = F.when(k % 7 == 0, F.concat("s_name", F.lit(',"x"'))).when(k % 11 != 0, F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").select(k, F.when(k % 5 != 0, (k % 97) / 97.0).alias("rate"), (k % 3 == 0).alias("flag"), name.alias("name"))
    return rows.select("s_suppkey", csv_line(rows.schema, rows.columns).alias("line"))


# ---- paged scans ----

@query("SELECT CAST(p_partkey % 8 AS INTEGER) AS page, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS row, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def page_scan(spark, sf_dir):
    """Parts as gzipped pages under a manifest, scanned with the page and row of each record."""
    from quernstone.session import staged_path
    from quernstone.sources.lineage import page_manifest, read_pages

    columns, path = ["p_partkey", "p_name", "p_brand"], staged_path(spark, "pages")
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 8).cast("int").alias("page"), *columns)
    parts.repartition("page").sortWithinPartitions("page", "p_partkey").write.partitionBy("page").option("sep", "\t").option("header", "true").option("compression", "gzip").option("quote", "\u0000").option("extension", "tsv").csv(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv*").load(path).select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"))
    pages = files.select(F.regexp_extract("name", "page=([0-9]+)/", 1).cast("int").alias("page"), "name")
    return read_pages(spark, path, page_manifest(spark, path, pages, depth=1), columns, depth=1)


# ---- caches and vectors ----

@query(q.RECORDS + """, d AS (SELECT DISTINCT seq FROM records WHERE seq <> ''), u AS (SELECT count(*) FILTER (seq IN (SELECT seq FROM records WHERE doc_id % 2 = 0)) AS hits, count(*) AS n FROM d)
SELECT doc_id, CASE WHEN seq <> '' THEN 20 END AS width, CASE WHEN seq <> '' THEN len(list_distinct(list_filter(string_split(seq, ''), lambda x: contains('ACDEFGHIKLMNPQRSTVWY', x)))) END AS cells, hits, n - hits AS misses FROM records CROSS JOIN u""")
def feature_cache(spark, sf_dir):
    """Compositions of all records, half of which a run before has cached: how many distinct sequences are hits and misses."""
    from quernstone.session import staged_path
    from quernstone.sources.cache import FeatureCache

    rows = q.records(spark, sf_dir).select("doc_id", F.when(F.col("seq") != "", F.col("seq")).alias("seq"))
    cache = FeatureCache(spark, staged_path(spark, "features"), "aac", {"alphabet": r.ALPHABET, "version": 1})

    def compute(misses: DataFrame) -> DataFrame:
        return misses.select("content", features.composition(F.col("seq")).alias("vector"))

    cache.features(rows.filter("doc_id % 2 = 0"), "seq", compute)
    found, use = cache.features(rows, "seq", compute)
    return found.select("doc_id", "width", F.when(F.col("width").isNotNull(), F.size("indices")).cast("long").alias("cells"), F.lit(use["hits"]).cast("long").alias("hits"), F.lit(use["misses"]).cast("long").alias("misses"))


def token_states():
    """An encoder for checks: each token's id, and its place modulo 7 where it isn't padding."""
    import numpy as np

    return lambda ids, mask: np.stack([ids, np.arange(ids.shape[1]) % 7 * mask], axis=2).astype(float)


@query(q.RECORDS + """, v AS (SELECT doc_id, seq FROM judged WHERE reason IS NULL), p AS (SELECT doc_id, unnest(string_split(seq, '')) AS x, generate_subscripts(string_split(seq, ''), 1) AS i FROM v)
SELECT doc_id, round(avg(instr('ACDEFGHIKLMNPQRSTVWY', x) + 3), 9) AS first, round(avg(i % 7), 9) AS second FROM p GROUP BY doc_id""")
def embedding_extraction(spark, sf_dir):
    """A mean vector over the residues of each valid sequence, by an encoder that can be checked."""
    from quernstone.operators.embedding import extract

    rows = q.judged(spark, sf_dir).filter(F.col("reason").isNull()).select("doc_id", "seq")
    made = extract(rows, "doc_id", "seq", token_states)
    return made.select("doc_id", F.round(F.get("vector", 0), 9).alias("first"), F.round(F.get("vector", 1), 9).alias("second"))


# ---- references and inventories ----

@query(q.HITS + "SELECT count(*) AS rows, count(p.p_partkey) AS known, count(*) - count(p.p_partkey) AS unknown FROM good g LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_partkey % 7 <> 0) p ON g.target = p.p_partkey")
def unknown_targets(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")).filter(F.col("target") % 7 != 0)
    return integrity.references(q.good_hits(spark, sf_dir), parts, "target")


@query("SELECT count(*) FILTER (b.k IS NULL) AS first_only, count(*) FILTER (a.k IS NULL) AS second_only FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) b ON a.k = b.k")
def set_equality(spark, sf_dir):
    from quernstone.sources.tables import coverage

    return coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS component_size FROM customer")
def component_metadata(spark, sf_dir):
    return integrity.with_group_size(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@query(q.STAR + "SELECT split, count(*) AS entries, count(*) FILTER (k = 2) AS aligned FROM (SELECT split, id, truth, count(DISTINCT method) AS k FROM long GROUP BY ALL) GROUP BY split")
def inventory_alignment(spark, sf_dir):
    return integrity.alignment(q.long_star(spark, sf_dir), ["split"], ["id", "truth"], "method")


@query("SELECT CAST(3 * m + s AS BIGINT) AS cell, ['a', 'b'][m + 1] AS method, ['F', 'O', 'P'][s + 1] AS split FROM range(2) x(m), range(3) y(s)")
def planned_cells(spark, sf_dir):
    return integrity.grid({"method": ["a", "b"], "split": ["F", "O", "P"]}, table(spark, sf_dir, "region"))


@query(q.STAR + ", g AS (SELECT m AS method, s AS split FROM (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(['F', 'O', 'P']) AS s)), n AS (SELECT method, split, count(*) AS rows, count(DISTINCT id) AS ids FROM long GROUP BY ALL) SELECT coalesce(g.method, n.method) AS method, coalesce(g.split, n.split) AS split, coalesce(rows, 0) AS rows, coalesce(ids, 0) AS ids, g.method IS NULL AS stray FROM g FULL JOIN n ON g.method = n.method AND g.split = n.split")
def cell_inventory(spark, sf_dir):
    """Rows and ids of every planned cell, empty ones too; cells that aren't planned are stray."""
    planned = integrity.grid({"method": ["a", "b"], "split": ["F", "O", "P"]}, table(spark, sf_dir, "region")).drop("cell").withColumn("_planned", F.lit(True))
    seen = q.long_star(spark, sf_dir).groupBy("method", "split").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))
    both = planned.join(seen, ["method", "split"], "full")
    return both.select("method", "split", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("ids", F.lit(0)).alias("ids"), F.col("_planned").isNull().alias("stray"))


#: Records that lack some members of the split and disagree about others.
STRAY = BOTH.rstrip() + ", stray AS (SELECT doc_id, reason, CASE WHEN doc_id % 37 = 0 THEN 'xx' ELSE lang END AS lang FROM judged WHERE doc_id % 41 <> 0)\n"


@query(STRAY + "SELECT s.split, count(*) AS rows, count(*) FILTER (j.doc_id IS NULL) AS missing, count(*) FILTER (j.doc_id IS NOT NULL AND j.reason IS NULL) AS valid, count(*) FILTER (j.lang <> s.lang) AS label_differs FROM assigned s LEFT JOIN stray j ON s.doc_id = j.doc_id GROUP BY ALL")
def split_members(spark, sf_dir):
    """The split's members among the records: how many are missing or valid, and how many labels differ; the records have faults of each kind."""
    k = F.col("doc_id")
    own = q.judged(spark, sf_dir).filter(k % 41 != 0).select("doc_id", "reason", F.when(k % 37 == 0, "xx").otherwise(F.col("lang")).alias("_lang"), F.lit(True).alias("_known"))
    joined = q.assigned(spark, sf_dir).join(own, "doc_id", "left")
    return joined.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_known").isNull()).alias("missing"), F.count_if(F.col("_known") & F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("_lang") != F.col("lang")).alias("label_differs"))


@query(STRAY + ", d AS (SELECT doc_id, CASE WHEN doc_id % 47 = 0 THEN 'other' ELSE sha256(coalesce(text, '')) END AS h, CASE WHEN doc_id % 53 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 43 <> 0) SELECT count(*) AS rows, count(*) FILTER (d.doc_id IS NULL) AS not_in_cohort, count(*) FILTER (j.doc_id IS NULL) AS not_in_records, count(*) FILTER (length(t.text) <> d.n_chars) AS length_differs, count(*) FILTER (sha256(coalesce(t.text, '')) <> d.h) AS hash_differs FROM assigned s LEFT JOIN d ON s.doc_id = d.doc_id LEFT JOIN stray j ON s.doc_id = j.doc_id LEFT JOIN documents t ON s.doc_id = t.doc_id")
def bundle_check(spark, sf_dir):
    """Split, cohort, records and texts joined; what is missing or doesn't agree. Cohort and records have faults of each kind."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    cohort = docs.filter(k % 43 != 0).select("doc_id", F.when(k % 47 == 0, "other").otherwise(digest).alias("_h"), F.when(k % 53 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.lit(True).alias("_d"))
    records = q.judged(spark, sf_dir).filter(k % 41 != 0).select("doc_id", F.lit(True).alias("_j"))
    whole = q.assigned(spark, sf_dir).join(cohort, "doc_id", "left").join(records, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    return whole.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_d").isNull()).alias("not_in_cohort"), F.count_if(F.col("_j").isNull()).alias("not_in_records"),
        F.count_if(F.length("text") != F.col("n_chars")).alias("length_differs"), F.count_if(digest != F.col("_h")).alias("hash_differs"))


@query(q.SPLIT + "SELECT doc_id, split, CASE WHEN split = 'train' THEN lang END AS label FROM assigned WHERE split <> 'validation'")
def train_labels(spark, sf_dir):
    """Labels of the training split only; the test split's stay hidden."""
    rows = q.assigned(spark, sf_dir).filter("split <> 'validation'")
    return rows.select("doc_id", "split", F.when(F.col("split") == "train", F.col("lang")).alias("label"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey AS holder, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS predicted FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT c_custkey AS holder, c_mktsegment AS truth FROM customer WHERE c_custkey % 59 <> 0)
SELECT count(*) AS predictions, count(truth) AS labelled, count(*) - count(truth) AS unlabelled, count(*) FILTER (predicted = truth) AS correct, (SELECT count(*) FROM l ANTI JOIN p USING (holder)) AS unused FROM p LEFT JOIN l USING (holder)""")
def delayed_labels(spark, sf_dir):
    """Labels of another table join sealed predictions afterwards; some predictions have none, and some labels have no prediction."""
    sealed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("holder"), F.get(F.array(*[F.lit(x) for x in q.SEGMENTS]), (F.col("o_orderkey") % 5).cast("int")).alias("predicted"))
    labels = table(spark, sf_dir, "customer").filter("c_custkey % 59 <> 0").select(F.col("c_custkey").alias("holder"), F.col("c_mktsegment").alias("truth"))
    joined = sealed.join(labels, "holder", "left")
    unused = labels.join(sealed, "holder", "left_anti").agg(F.count("*").alias("unused"))
    done = joined.agg(F.count("*").alias("predictions"), F.count("truth").alias("labelled"), F.count_if(F.col("truth").isNull()).alias("unlabelled"), F.count_if(F.col("predicted") == F.col("truth")).alias("correct"))
    return done.crossJoin(F.broadcast(unused))  # one row each


# ---- invariants and gates ----

#: Predictions with faults: repeated rows, unknown labels, missing labels, wrong flags and scores that aren't numbers.
FAULTY = q.STAR + """, marked AS (SELECT split, method, id, truth, CASE WHEN id % 89 = 0 THEN 'OTHER' WHEN id % 97 = 0 THEN NULL ELSE predicted END AS predicted FROM long),
told AS (SELECT *, CASE WHEN id % 83 = 0 THEN NOT coalesce(truth = predicted, false) ELSE coalesce(truth = predicted, false) END AS correct, CASE WHEN id % 79 = 0 THEN 'NaN'::DOUBLE ELSE id / 7.0 END AS score FROM marked),
faulty AS (SELECT * FROM told UNION ALL SELECT * FROM told WHERE id % 101 = 0)
"""


def faulty_predictions(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    predicted = F.when(k % 89 == 0, "OTHER").when(k % 97 == 0, F.lit(None)).otherwise(F.col("predicted"))
    told = q.long_star(spark, sf_dir).select(*q.CELL, "id", "truth", predicted.alias("predicted"))
    right = F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False))
    told = told.withColumn("correct", F.when(k % 83 == 0, ~right).otherwise(right)).withColumn("score", F.when(k % 79 == 0, float("nan")).otherwise(k / 7.0))
    return told.unionByName(told.filter(k % 101 == 0))


@query(FAULTY + f"SELECT split, method, count(*) AS rows, count(*) - count(DISTINCT id) AS repeated, count(*) FILTER (NOT list_contains({q.NAMES}, predicted)) AS unknown_label, count(*) FILTER (truth IS NULL OR predicted IS NULL) AS null_label, count(*) FILTER (correct <> coalesce(truth = predicted, false)) AS wrong_flag, count(*) FILTER (NOT isfinite(score)) AS not_finite FROM faulty GROUP BY ALL")
def prediction_invariants(spark, sf_dir):
    """How many predictions break each rule; the input has faults of each kind."""
    right = F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False))
    rules = {"unknown_label": ~F.col("predicted").isin(*q.SEGMENTS), "null_label": F.col("truth").isNull() | F.col("predicted").isNull(), "wrong_flag": F.col("correct") != right, "not_finite": F.isnan("score") | (F.abs("score") == float("inf"))}
    return integrity.violations(faulty_predictions(spark, sf_dir), q.CELL, rules, "id")


@query(q.NEAREST + """, faulty AS (SELECT status, query, no_match, CASE WHEN no_match AND query % 5 = 0 THEN 0.5 WHEN NOT no_match AND query % 7 = 0 THEN NULL WHEN query % 11 = 0 THEN 1.5 ELSE fident END AS fident, CASE WHEN NOT no_match AND query % 13 = 0 THEN NULL ELSE bits END AS bits FROM near UNION ALL SELECT status, query, no_match, fident, bits FROM near WHERE query % 17 = 0)
SELECT status, count(*) AS rows, count(*) - count(DISTINCT query) AS repeated, count(*) FILTER (no_match AND (fident IS NOT NULL OR bits IS NOT NULL)) AS no_hit_with_values, count(*) FILTER (NOT no_match AND (fident IS NULL OR bits IS NULL)) AS hit_without_values, count(*) FILTER (fident NOT BETWEEN 0 AND 1) AS out_of_range FROM faulty GROUP BY status""")
def nearest_invariants(spark, sf_dir):
    """As for predictions: rows without a hit that have values, hits without, values out of range, repeated queries."""
    k, none = F.col("query"), F.col("no_match")
    near = q.nearest(spark, sf_dir).select("status", "query", "no_match", "fident", "bits")
    fident = F.when(none & (k % 5 == 0), 0.5).when(~none & (k % 7 == 0), F.lit(None)).when(k % 11 == 0, 1.5).otherwise(F.col("fident"))
    faulty = near.withColumn("fident", fident).withColumn("bits", F.when(none | (k % 13 != 0), F.col("bits"))).unionByName(near.filter(k % 17 == 0))
    some, both = F.col("fident").isNotNull() | F.col("bits").isNotNull(), F.col("fident").isNotNull() & F.col("bits").isNotNull()
    return integrity.violations(faulty, ["status"], {"no_hit_with_values": none & some, "hit_without_values": ~none & ~both, "out_of_range": ~F.col("fident").between(0, 1)}, "query")


@query(q.STAR + q.STRATA + "SELECT count(*) AS rows, count(*) FILTER (status IN ('privacy_suppressed', 'insufficient_sequences')) AS hidden, count(*) FILTER (status IN ('privacy_suppressed', 'insufficient_sequences') AND n % 3 = 0) AS exposed, CAST(2 AS BIGINT) AS forbidden_columns FROM judged")
def privacy_gate(spark, sf_dir):
    """A table in which some suppressed strata show a value, and with two columns that it may not have."""
    rows = q.long_star(spark, sf_dir).withColumn("stratum", F.col("component") % 13)
    per = rows.groupBy(*q.CELL, "truth", "stratum").agg(F.count("*").alias("n"), F.count_distinct("component").alias("c"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    status = r.eligibility(F.col("n"), F.col("c"))
    rate = F.col("hits") / F.col("n")
    told = per.withColumn("status", status).withColumn("accuracy", F.when(F.col("n") % 3 == 0, rate).otherwise(r.reportable(F.col("status"), rate)))
    public = told.select(*q.CELL, "truth", "stratum", "status", "accuracy", F.col("n").alias("accession"), F.col("c").alias("scratch"))
    return integrity.exposed(public, "status", ["accuracy"], ["split", "method", "truth", "stratum", "status", "accuracy"])


#: Public rows with leaks of each kind, by the key's remainder.
LEAKY = """WITH leaky AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'see P12345.' WHEN c_custkey % 13 = 0 THEN concat('x ', repeat('ACDEFGHIKL', 6)) WHEN c_custkey % 17 = 0 THEN 'at /home/me' WHEN c_custkey % 19 = 0 THEN 'Authorization : no' WHEN c_custkey % 23 = 0 THEN sha256(c_name)
 WHEN c_custkey % 29 = 0 THEN concat('from Supplier#', lpad(CAST(c_custkey % 40 AS VARCHAR), 9, '0')) WHEN c_custkey % 31 = 0 THEN concat('KK', repeat(substr('ACDEFGHIKLMNPQRSTVWY', CAST(c_custkey % 4 + 1 AS INTEGER), 5), 5), 'KK') ELSE c_mktsegment END AS note FROM customer),
names AS (SELECT s_name AS value FROM supplier WHERE s_suppkey % 2 = 0), runs AS (SELECT DISTINCT repeat(substr('ACDEFGHIKLMNPQRSTVWY', CAST(s_suppkey % 2 + 1 AS INTEGER), 5), 5) AS value FROM supplier)
"""


def leaky(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, residues = F.col("c_custkey"), F.lit(r.ALPHABET)
    note = (
        F.when(k % 11 == 0, "see P12345.").when(k % 13 == 0, "x " + "ACDEFGHIKL" * 6).when(k % 17 == 0, "at /home/me").when(k % 19 == 0, "Authorization : no").when(k % 23 == 0, F.sha2(F.col("c_name").cast("binary"), 256))
        .when(k % 29 == 0, F.concat(F.lit("from Supplier#"), F.lpad((k % 40).cast("string"), 9, "0"))).when(k % 31 == 0, F.concat(F.lit("KK"), F.repeat(F.substr(residues, (k % 4 + 1).cast("int"), F.lit(5)), 5), F.lit("KK"))).otherwise(F.col("c_mktsegment"))
    )
    suppliers = table(spark, sf_dir, "supplier")
    runs = suppliers.select(F.repeat(F.substr(residues, (F.col("s_suppkey") % 2 + 1).cast("int"), F.lit(5)), 5).alias("value")).distinct()
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_name").alias("name"), note.alias("note")), suppliers.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("value")), runs


@query(LEAKY + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{n}' AS rule, count(*) FILTER (regexp_matches({c}, '{p}')) AS rows FROM leaky" for c in ("name", "note") for n, p in leaks.RELEASE_RULES.items()) + "".join(f" UNION ALL SELECT '{c}', 'known_name', count(DISTINCT k) FROM (SELECT k, unnest(regexp_extract_all({c}, '[A-Za-z0-9_#.:|-]+')) AS value FROM leaky) SEMI JOIN names USING (value) UNION ALL SELECT '{c}', 'known_sequence', count(DISTINCT k) FROM leaky JOIN runs ON contains({c}, value)" for c in ("name", "note")) + ")")
def release_scan(spark, sf_dir):
    """Patterns and known names and sequences over all text columns of a table with leaks of each kind."""
    rows, names, runs = leaky(spark, sf_dir)
    return leaks.pattern_leaks(rows).unionByName(leaks.known_leaks(rows, names, runs))


@query(q.CLASSES + """, m AS (SELECT split, method, sum(hits) / sum(support) AS accuracy FROM rates GROUP BY ALL), rel AS (SELECT split, method, round(accuracy, 6) + CASE WHEN split = 'F' AND method = 'b' THEN 0.001 ELSE 0 END AS released FROM m WHERE NOT (split = 'P' AND method = 'a') UNION ALL SELECT 'X', 'a', 0.5)
SELECT split, method, round(accuracy, 9) AS first, round(released, 9) AS second, coalesce(abs(accuracy - released) <= 0.000001, false) AS within FROM m FULL JOIN rel USING (split, method)""")
def regression_gate(spark, sf_dir):
    """Recomputed accuracies against a released table that is rounded, off in one cell, without another, and has one too many."""
    from quernstone.sources.tables import read_released
    from quernstone.session import staged_path

    first = stage(metrics.macro(q.conf(spark, sf_dir), q.CELL, q.SEGMENTS).select(*q.CELL, "accuracy"), "recomputed")
    off = F.when((F.col("split") == "F") & (F.col("method") == "b"), 0.001).otherwise(0.0)
    released = first.filter("not (split = 'P' and method = 'a')").select(*q.CELL, (F.round("accuracy", 6) + off).alias("accuracy"))
    path = staged_path(spark, "released")
    released.unionByName(spark.createDataFrame([("X", "a", 0.5)], released.schema)).write.option("header", "true").csv(path)
    done = integrity.within(first, read_released(spark, path, "split string, method string, accuracy double"), q.CELL, "accuracy", 1e-6)
    return done.select(*q.CELL, F.round("first", 9).alias("first"), F.round("second", 9).alias("second"), "within")


@query("""WITH c AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS a FROM embeddings), d AS (SELECT a, a * (1 + 0.000005 * (vec_id % 4)) AS b FROM c)
SELECT count(*) AS cells, CAST(0 AS BIGINT) AS single, round(max(abs(a - b)), 12) AS max_abs, round(max(abs(a - b) / nullif(abs(b), 0)), 12) AS max_rel, count(*) FILTER (abs(a - b) > 0.000001 + 0.00001 * abs(b)) AS outside FROM d""")
def numeric_replay(spark, sf_dir):
    """Vectors against a run that is slightly off for three rows in four."""
    first = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    second = first.withColumn("v", F.transform("v", lambda x: x * (1 + F.lit(0.000005) * (F.col("vec_id") % 4))))
    done = integrity.numeric_replay(first, second, "vec_id", "v")
    return done.select("cells", "single", F.round("max_abs", 12).alias("max_abs"), F.round("max_rel", 12).alias("max_rel"), "outside")


# ---- summaries ----

SAME = q.NEAREST + """, named AS (SELECT n.*, p.p_brand AS train_label, concat('Brand#', own // 5 + 1, own % 5 + 1) AS test_label FROM near n LEFT JOIN part p ON n.target = p.p_partkey)
"""


def named_nearest(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("train_label"))
    own = F.col("query") % 25
    return q.nearest(spark, sf_dir).join(parts, "target", "left").withColumn("test_label", F.concat(F.lit("Brand#"), F.floor(own / 5) + 1, own % 5 + 1))


@query(SAME + """, every AS (SELECT o.o_orderstatus AS status, count(*) AS hits, count(*) FILTER (g.fident >= 0.7) AS over70, count(*) FILTER (g.fident >= 0.5) AS over50, count(*) FILTER (g.fident >= 0.3) AS over30 FROM good g JOIN orders o ON g.query = o.o_orderkey GROUP BY 1)
SELECT status, hits, over70, over50, over30, rows, no_match, same_label, different_label FROM every JOIN (SELECT status, count(*) AS rows, count(*) FILTER (no_match) AS no_match, count(*) FILTER (train_label = test_label) AS same_label, count(*) FILTER (train_label <> test_label) AS different_label FROM named GROUP BY status) USING (status)""")
def leakage_audit(spark, sf_dir):
    """Exceedances over all hits, and labels over best hits; without a match a label is neither the same nor different."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderstatus").alias("status"))
    every = q.good_hits(spark, sf_dir).join(orders, "query").groupBy("status").agg(F.count("*").alias("hits"), *[F.count_if(F.col("fident") >= t / 100).alias(f"over{t}") for t in (70, 50, 30)])
    same = F.col("train_label") == F.col("test_label")
    best = named_nearest(spark, sf_dir).groupBy("status").agg(F.count("*").alias("rows"), F.count_if("no_match").alias("no_match"), F.count_if(same).alias("same_label"), F.count_if(~same).alias("different_label"))
    return every.join(best, "status")


@query(SAME + """, m AS (SELECT p_brand AS majority FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT status, count(*) AS rows, count(*) FILTER (NOT no_match) AS hits, round(count(*) FILTER (NOT no_match) / count(*), 9) AS hit_rate, round(count(*) FILTER (no_match) / count(*), 9) AS no_hit_rate, count(*) FILTER (no_match AND test_label = majority) AS no_hit_correct, round(min(fident), 6) AS least, round(avg(fident), 6) AS mean, round(max(fident), 6) AS most, """ + ", ".join(f"round(quantile_cont(fident, {p}), 6) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95)) + " FROM named CROSS JOIN m GROUP BY status")
def nearest_distribution(spark, sf_dir):
    """Hit and no-hit rates, fallbacks that are right, and the distribution of identities."""
    from quernstone.operators.hits import majority

    rows = named_nearest(spark, sf_dir).crossJoin(F.broadcast(majority(table(spark, sf_dir, "part"), "p_brand").select("majority")))  # one row
    hit, n = F.count_if(~F.col("no_match")), F.count("*")
    return rows.groupBy("status").agg(
        n.alias("rows"), hit.alias("hits"), F.round(hit / n, 9).alias("hit_rate"), F.round((n - hit) / n, 9).alias("no_hit_rate"), F.count_if(F.col("no_match") & (F.col("test_label") == F.col("majority"))).alias("no_hit_correct"),
        F.round(F.min("fident"), 6).alias("least"), F.round(F.avg("fident"), 6).alias("mean"), F.round(F.max("fident"), 6).alias("most"), *[F.round(F.percentile("fident", p), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95)])


@query(q.WHOLE + ", s AS (SELECT percent, component, count(*) AS n FROM w GROUP BY ALL), e AS (SELECT p AS percent, count(DISTINCT (l_orderkey, l_partkey)) AS edges FROM lineitem JOIN (SELECT unnest([70, 50, 30]) AS p) ON l_quantity * 2 >= p GROUP BY ALL) SELECT percent, CAST(sum(n) AS BIGINT) AS nodes, any_value(edges) AS edges, count(*) AS components, count(*) FILTER (n = 1) AS singletons, max(n) AS largest FROM s JOIN e USING (percent) GROUP BY percent")
def discovery_counts(spark, sf_dir):
    sizes = q.all_components(spark, sf_dir).groupBy("percent", "component").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.lit(p) for p in q.IDENTITIES]))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", levels.alias("percent")).filter(F.col("l_quantity") * 2 >= F.col("percent"))
    edges = lines.groupBy("percent").agg(F.count_distinct("l_orderkey", "l_partkey").alias("edges"))
    per = sizes.groupBy("percent").agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))
    return per.join(edges, "percent").select("percent", "nodes", "edges", "components", "singletons", "largest")


CLASSED = ", k AS (SELECT o_orderkey * 2 + 1 AS node, o_orderstatus AS class FROM orders UNION ALL SELECT p_partkey * 2, p_brand FROM part), s AS (SELECT percent, component, count(*) AS n FROM w GROUP BY ALL)"


@query(q.WHOLE + CLASSED + " SELECT percent, class, count(*) AS nodes, count(DISTINCT component) AS components, count(*) FILTER (n = 1) AS singletons, max(n) AS largest FROM w JOIN k USING (node) JOIN s USING (percent, component) GROUP BY ALL")
def discovery_classes(spark, sf_dir):
    """For each identity and class of nodes: nodes, components that hold some, singletons, and the largest component with one."""
    found = integrity.with_group_sizes(stage(q.all_components(spark, sf_dir), "components"), ["percent", "component"], "n")
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2 + 1).alias("node"), F.col("o_orderstatus").alias("class"))
    classes = orders.unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("node"), F.col("p_brand").alias("class")))
    per = found.join(classes, "node").groupBy("percent", "class")
    return per.agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


@query(q.NODES + "SELECT count(*) AS nodes, count(*) FILTER (NOT coalesce(qualifies, false)) AS without_self_hit, count(*) FILTER (any_hit AND NOT coalesce(qualifies, false)) AS unqualified FROM (SELECT s_suppkey, bool_or(h.query IS NOT NULL) AS any_hit, bool_or(g.query IS NOT NULL) AS qualifies FROM supplier LEFT JOIN hits h ON h.query = s_suppkey AND h.target = s_suppkey LEFT JOIN good g ON g.query = s_suppkey AND g.target = s_suppkey GROUP BY s_suppkey)")
def self_hits(spark, sf_dir):
    """Nodes whose own qualifying hit is missing, before hits become undirected pairs: without any, and with one that doesn't qualify."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return hits.self_hit_counts(nodes, q.node_hits(spark, sf_dir))


@query(q.WHOLE + "SELECT percent, count(*) AS components, count(*) FILTER (least <> component) AS wrong_representative, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(n) - sum(d) AS BIGINT) AS repeated FROM (SELECT percent, component, min(node) AS least, count(*) AS n, count(DISTINCT node) AS d FROM w GROUP BY ALL) GROUP BY percent")
def partition_invariants(spark, sf_dir):
    """Each node in one component, each component named by its smallest node."""
    per = q.all_components(spark, sf_dir).groupBy("percent", "component").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.count_distinct("node").alias("d"))
    return per.groupBy("percent").agg(F.count("*").alias("components"), F.count_if(F.col("least") != F.col("component")).alias("wrong_representative"), F.sum("n").alias("nodes"), F.sum(F.col("n") - F.col("d")).alias("repeated"))


@query("SELECT lang, count(*) AS rows, count(DISTINCT source) AS groups, least(count(*), 200) AS capped, concat_ws(',', CASE WHEN count(*) < 100 THEN 'too_few_rows' END, CASE WHEN count(DISTINCT source) < 10 THEN 'too_few_groups' END) AS reasons FROM documents GROUP BY lang")
def class_eligibility(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("groups"))
    reasons = F.concat_ws(",", F.when(F.col("rows") < 100, "too_few_rows"), F.when(F.col("groups") < 10, "too_few_groups"))
    return per.select("lang", "rows", "groups", F.least(F.col("rows"), F.lit(200)).alias("capped"), reasons.alias("reasons"))


@query("""WITH p AS (SELECT lang, least(count(*), 200) AS capped, count(DISTINCT source) AS groups, count(*) AS rows FROM documents GROUP BY 1), chosen AS (SELECT lang FROM p WHERE rows >= 20 ORDER BY capped DESC, groups DESC, lang LIMIT 2),
k AS (SELECT doc_id, lang, source, sha256(concat_ws(chr(10), '42', CAST(doc_id AS VARCHAR))) AS key FROM documents SEMI JOIN chosen USING (lang)), i AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY key, doc_id) > 1 AS INTEGER) AS later FROM k),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY later, key, doc_id) AS place FROM i) SELECT doc_id, lang, source, place FROM z WHERE place <= 200""")
def cohort_selection(spark, sf_dir):
    """Eligible classes are ranked, the first ones selected, and each sampled up to its cap, all its groups first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    chosen = splits.ranked_classes(docs, "lang", "source", cap=200, least=20, keep=2).filter("selected").select("lang")
    return splits.capped_sample(docs.join(chosen, "lang", "left_semi"), "doc_id", "lang", "source", 200).select("doc_id", "lang", "source", "place")


@query(q.CHANGED + "SELECT 'old' AS lineage, p_brand, count(*) AS n FROM old GROUP BY ALL UNION ALL SELECT 'new', p_brand, count(*) FROM new GROUP BY ALL")
def tagged_union(spark, sf_dir):
    old, new = (x.withColumn("lineage", F.lit(n)) for x, n in zip(q.lineages(spark, sf_dir), ("old", "new")))
    return old.unionByName(new).groupBy("lineage", "p_brand").agg(F.count("*").alias("n"))


@query(q.CLASSES + ", m AS (SELECT split, method, sum(hits) / sum(support) AS acc, sum(f1) / 5 AS f1 FROM rates GROUP BY ALL) SELECT split, round(max(acc) FILTER (method = 'a'), 9) AS accuracy_a, round(max(acc) FILTER (method = 'b'), 9) AS accuracy_b, round(max(f1) FILTER (method = 'a'), 9) AS macro_f1_a, round(max(f1) FILTER (method = 'b'), 9) AS macro_f1_b FROM m GROUP BY split")
def figure_series(spark, sf_dir):
    """One series a method, by split."""
    done = metrics.macro(q.conf(spark, sf_dir), q.CELL, q.SEGMENTS)
    return done.groupBy("split").agg(*[F.round(F.max(F.when(F.col("method") == m, F.col(c))), 9).alias(f"{c}_{m}") for c in ("accuracy", "macro_f1") for m in ("a", "b")])


# ---- features ----

PLACE = f"strpos('{r.ALPHABET}', {{x}}) - 1"


def _place(letter):
    return F.position(letter, F.lit(r.ALPHABET)) - 1


@query(q.RECORDS + ", w AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i, 3))) AS m, length(seq) - 2 AS all_ FROM judged WHERE reason IS NULL) SELECT doc_id, CAST(400 * (" + PLACE.format(x="m[1]") + ") + 20 * (" + PLACE.format(x="m[2]") + ") + " + PLACE.format(x="m[3]") + " AS BIGINT) AS at, round(count(*) / any_value(all_), 12) AS frequency FROM w GROUP BY doc_id, m")
def kmer3_rows(spark, sf_dir):
    """Each valid sequence's sparse vector over the 8,000 words of three letters."""
    valid = sequences(spark, sf_dir).withColumn("_all", F.length("sequence") - 2)
    words = F.transform(F.sequence(F.lit(1), F.col("_all")), lambda i: F.substr("sequence", i, F.lit(3)))
    each = valid.select(F.col("id").alias("doc_id"), "_all", F.explode(words).alias("m")).groupBy("doc_id", "_all", "m").agg(F.count("*").alias("n"))
    at = 400 * _place(F.substr("m", F.lit(1), F.lit(1))) + 20 * _place(F.substr("m", F.lit(2), F.lit(1))) + _place(F.substr("m", F.lit(3), F.lit(1)))
    return each.select("doc_id", at.cast("long").alias("at"), F.round(F.col("n") / F.col("_all"), 12).alias("frequency"))


@query(q.RECORDS + ", t AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) + 1), lambda i: (" + PLACE.format(x="substring(seq, i, 1)") + " + 4) * i)) AS x, length(seq) AS n FROM judged WHERE reason IS NULL) SELECT doc_id, CAST(any_value(n) + 2 AS BIGINT) AS n_tokens, CAST(sum(x) AS BIGINT) AS checksum FROM t GROUP BY doc_id")
def residue_tokens(spark, sf_dir):
    """Token ids of each valid sequence between a start and an end token: how many, and a checksum of ids by place."""
    rows = sequences(spark, sf_dir).select(F.col("id").alias("doc_id"), features.residue_tokens(F.col("sequence")).alias("t"))
    inner = F.slice("t", F.lit(2), F.size("t") - 2)
    weighted = F.aggregate(F.transform(inner, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), weighted.alias("checksum"))
