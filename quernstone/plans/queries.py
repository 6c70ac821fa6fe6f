"""One query for each operator over the standard tables, and the same in DuckDB's SQL.

Records are ``documents`` with a residue sequence made of their letters; hits are made from
``lineitem``; predictions from ``orders``; vectors are ``embeddings``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import records as r
from quernstone.operators import audit, batching, bootstrap, dedup, features, graph, hits, metrics, reports, splits, synthetic
from quernstone.operators.digests import streamed_digest
from quernstone.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- records ----

RECORDS = """WITH letters AS (SELECT doc_id, lang, source, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS l FROM documents),
records AS (SELECT doc_id, lang, source, CASE WHEN source IN ('src1', 'src2') THEN l ELSE regexp_replace(l, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') END AS seq FROM letters),
judged AS (SELECT *, CASE WHEN seq = '' THEN 'missing' WHEN regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'invalid_characters' WHEN length(seq) < 50 THEN 'too_short' WHEN length(seq) > 1000 THEN 'too_long' END AS reason, sha256(seq) AS h FROM records)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    seq = r.once(letters, lambda x: F.when(F.col("source").isin("src1", "src2"), x).otherwise(F.regexp_replace(x, f"[^{r.ALPHABET}]", "")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", seq.alias("seq"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("reason", r.sequence_reason(F.col("seq"))).withColumn("h", r.sequence_hash(F.col("seq")))


@query(RECORDS + "SELECT doc_id, reason, CAST(length(seq) AS BIGINT) AS n, CASE WHEN reason IS NULL THEN h END AS sequence_sha256 FROM judged")
def seq_validate(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "reason", F.length("seq").cast("long").alias("n"), F.when(F.col("reason").isNull(), F.col("h")).alias("sequence_sha256"))


@query(RECORDS + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY 1")
def reject_counts(spark, sf_dir):
    return judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(RECORDS + """, c AS (SELECT count(*) AS s0, count(*) FILTER (reason IS NULL OR reason <> 'missing') AS s1, count(*) FILTER (reason IS NULL OR reason NOT IN ('missing', 'invalid_characters')) AS s2, count(*) FILTER (reason IS NULL) AS s3 FROM judged)
SELECT CAST(0 AS BIGINT) AS stage_order, 'input' AS stage, s0 AS rows, CAST(0 AS BIGINT) AS removed FROM c UNION ALL SELECT 1, 'present', s1, s0 - s1 FROM c UNION ALL SELECT 2, 'in_alphabet', s2, s1 - s2 FROM c UNION ALL SELECT 3, 'in_bounds', s3, s2 - s3 FROM c""")
def stage_flow(spark, sf_dir):
    return audit.stage_flow(judged(spark, sf_dir), "reason", [("present", ["missing"]), ("in_alphabet", ["invalid_characters"]), ("in_bounds", ["too_short", "too_long"])])


LABELS = """WITH raw AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 17 = 0 THEN 'invalid' WHEN l_orderkey % 13 = 0 THEN '  ' WHEN l_orderkey % 11 = 0 THEN '1.1.1.1; 2.2.2.2' WHEN l_orderkey % 10 = 0 THEN concat(l_linenumber, '.', l_suppkey % 12, '.', l_partkey % 7, '.-') ELSE concat(' ', l_linenumber, '.', l_suppkey % 12, '.', l_partkey % 7, '.', CAST(l_quantity AS INTEGER), ';') END AS v FROM lineitem),
parts AS (SELECT *, list_filter(list_transform(string_split(v, ';'), lambda x: trim(x)), lambda x: x <> '') AS p FROM raw),
parsed AS (SELECT CASE WHEN len(p) = 0 THEN 'missing_label' WHEN len(p) > 1 THEN 'multiple_labels' WHEN regexp_matches(p[1], '^[0-9]+(\\.[0-9]+){3}$') THEN NULL WHEN regexp_matches(p[1], '^[0-9]+(\\.([0-9]+|-)){0,3}$') THEN 'incomplete_label' ELSE 'malformed_label' END AS reason, CASE WHEN len(p) = 1 AND regexp_matches(p[1], '^[0-9]+(\\.[0-9]+){3}$') THEN concat(split_part(p[1], '.', 1), '.', split_part(p[1], '.', 2)) END AS label FROM parts)
"""


def parsed_labels(spark, sf_dir):
    k, line = F.col("l_orderkey"), F.col("l_linenumber").cast("string")
    first = [line, (F.col("l_suppkey") % 12).cast("string"), (F.col("l_partkey") % 7).cast("string")]
    full = F.concat(F.lit(" "), F.concat_ws(".", *first, F.col("l_quantity").cast("int").cast("string")), F.lit(";"))
    v = F.when(k % 17 == 0, "invalid").when(k % 13 == 0, "  ").when(k % 11 == 0, "1.1.1.1; 2.2.2.2").when(k % 10 == 0, F.concat_ws(".", *first, F.lit("-"))).otherwise(full)
    reason, label = r.label_parts(F.col("v"))
    return table(spark, sf_dir, "lineitem").select(v.alias("v")).select(reason.alias("reason"), label.alias("label"))


@query(LABELS + "SELECT reason, label, count(*) AS n FROM parsed GROUP BY ALL")
def label_parse(spark, sf_dir):
    return parsed_labels(spark, sf_dir).groupBy("reason", "label").agg(F.count("*").alias("n"))


@query(LABELS + "SELECT label, count(*) AS n, row_number() OVER (ORDER BY CAST(split_part(label, '.', 1) AS INTEGER), CAST(split_part(label, '.', 2) AS INTEGER), label) AS place FROM parsed WHERE label IS NOT NULL GROUP BY label")
def label_numeric_order(spark, sf_dir):
    from pyspark.sql.window import Window

    counts = parsed_labels(spark, sf_dir).filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*r.label_order(F.col("label")))).cast("long"))  # a row for each label


GROUPS = RECORDS + """, groups AS (SELECT h, seq, min(doc_id) AS canonical_id, min(source) AS label, count(*) AS duplicate_count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members, count(DISTINCT source) AS labels FROM judged WHERE reason IS NULL GROUP BY h, seq)
"""


def sequence_groups(spark, sf_dir):
    valid = judged(spark, sf_dir).filter(F.col("reason").isNull())
    return dedup.sequence_groups(valid, ["h", "seq"], "source", "doc_id")


@query(GROUPS + "SELECT canonical_id, h, label, duplicate_count, members FROM groups WHERE labels = 1")
def dedup_candidates(spark, sf_dir):
    kept, _ = dedup.split_conflicts(sequence_groups(spark, sf_dir))
    return kept.select("canonical_id", "h", "label", "duplicate_count", F.array_join("members", ",").alias("members"))


@query(GROUPS + "SELECT h, duplicate_count, labels, members FROM groups WHERE labels > 1")
def conflict_groups(spark, sf_dir):
    _, bad = dedup.split_conflicts(sequence_groups(spark, sf_dir))
    return bad.select("h", "duplicate_count", "labels", F.array_join("members", ",").alias("members"))


@query(GROUPS + "SELECT duplicate_count, CASE WHEN labels = 1 THEN 'kept' ELSE 'conflict' END AS outcome, count(*) AS groups FROM groups GROUP BY ALL")
def dedup_groups(spark, sf_dir):
    groups = sequence_groups(spark, sf_dir)
    return groups.groupBy("duplicate_count", F.when(F.col("labels") == 1, "kept").otherwise("conflict").alias("outcome")).agg(F.count("*").alias("groups"))


@query(RECORDS + "SELECT lang, count(*) AS n, CAST(min(length(seq)) AS BIGINT) AS least, CAST(max(length(seq)) AS BIGINT) AS most, round(avg(length(seq)), 6) AS mean, " + ", ".join(f"round(quantile_cont(length(seq), {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM records GROUP BY lang")
def length_summary(spark, sf_dir):
    done = records(spark, sf_dir).withColumn("n", F.length("seq").cast("long")).groupBy("lang").agg(*audit.distribution("n"))
    return done.select("lang", "n", "least", "most", F.round("mean", 6).alias("mean"), *[F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def class_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS rank FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def top_sources(spark, sf_dir):
    return audit.top_values(table(spark, sf_dir, "documents"), "source", 10)


@query(RECORDS + "SELECT doc_id, concat('>rec|', doc_id, '|', source, chr(10), regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), CASE WHEN length(seq) % 60 = 0 AND seq <> '' THEN '' ELSE chr(10) END) AS record FROM records")
def fasta_lines(spark, sf_dir):
    header = F.concat_ws("|", F.lit("rec"), F.col("doc_id").cast("string"), "source")
    return records(spark, sf_dir).select("doc_id", F.concat(r.fasta_record(header, F.col("seq")), F.lit("\n")).alias("record"))


@query(RECORDS + "SELECT doc_id, CAST(length(seq) AS DOUBLE) AS length_feature, " + ", ".join(f"round((length(seq) - length(replace(seq, '{a}', ''))) / length(seq), 9) AS aac_{a.lower()}" for a in r.ALPHABET) + " FROM records WHERE seq <> ''")
def aac(spark, sf_dir):
    valid = records(spark, sf_dir).filter("seq <> ''").withColumn("f", features.composition(F.col("seq")))
    return valid.select("doc_id", F.length("seq").cast("double").alias("length_feature"), *[F.round(F.get("f", k), 9).alias(f"aac_{a.lower()}") for k, a in enumerate(r.ALPHABET)])


@query(RECORDS + """, w AS (SELECT lang, unnest(list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i, 3))) AS kmer FROM records WHERE length(seq) >= 3)
SELECT lang, kmer, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 12) AS frequency FROM w GROUP BY lang, kmer""")
def kmer3(spark, sf_dir):
    counts = features.kmer_counts(records(spark, sf_dir), ["lang"], "seq")
    return features.kmer_frequencies(counts, ["lang"]).withColumn("frequency", F.round("frequency", 12))


# ---- hits ----

HITS = """WITH hits AS (SELECT l_orderkey AS query, l_partkey AS target, round(l_quantity * 2 / 100, 6) AS fident, round(1 - 3 * l_discount, 6) AS qcov, round(1 - 3 * l_tax, 6) AS tcov, CASE WHEN l_linenumber = 7 THEN 0.01 ELSE l_linenumber / 10000 END AS evalue, l_extendedprice AS bits FROM lineitem),
good AS (SELECT * FROM hits WHERE qcov >= 0.8 AND tcov >= 0.8 AND evalue <= 0.001 AND fident BETWEEN 0 AND 1 AND bits >= 0)
"""


def hit_table(spark, sf_dir) -> DataFrame:
    evalue = F.when(F.col("l_linenumber") == 7, 0.01).otherwise(F.col("l_linenumber") / 10000)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.round(F.col("l_quantity") * 2 / 100, 6).alias("fident"),
        F.round(1 - 3 * F.col("l_discount"), 6).alias("qcov"), F.round(1 - 3 * F.col("l_tax"), 6).alias("tcov"), evalue.alias("evalue"), F.col("l_extendedprice").alias("bits"))


def good_hits(spark, sf_dir) -> DataFrame:
    return hit_table(spark, sf_dir).filter(r.qualifies())


@query(HITS + "SELECT query, target, fident, qcov, tcov, bits FROM good")
def hit_pairs(spark, sf_dir):
    return good_hits(spark, sf_dir).select("query", "target", "fident", "qcov", "tcov", "bits")


NODES = HITS.replace("SELECT l_orderkey AS query", "SELECT l_suppkey AS query")


def node_hits(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.col("l_suppkey"))
    evalue = F.when(F.col("l_linenumber") == 7, 0.01).otherwise(F.col("l_linenumber") / 10000)
    return lines.select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"), F.round(F.col("l_quantity") * 2 / 100, 6).alias("fident"), F.round(1 - 3 * F.col("l_discount"), 6).alias("qcov"), F.round(1 - 3 * F.col("l_tax"), 6).alias("tcov"), evalue.alias("evalue"), F.col("l_extendedprice").alias("bits"))


@query(NODES + """, keyed AS (SELECT *, least(query, target) AS "left", greatest(query, target) AS "right" FROM good WHERE query <> target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY fident DESC, least(qcov, tcov) DESC, bits DESC, evalue, query, target, qcov DESC, tcov DESC) AS k FROM keyed)
SELECT "left", "right", fident, bits FROM ranked WHERE k = 1""")
def best_pair(spark, sf_dir):
    return hits.best_pairs(node_hits(spark, sf_dir)).select("left", "right", "fident", "bits")


NEAREST = HITS + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fident DESC, least(qcov, tcov) DESC, bits DESC, evalue, query, target) AS k FROM good) WHERE k = 1),
near AS (SELECT o.o_orderkey AS query, o.o_orderstatus AS status, b.target, b.fident, b.bits, b.target IS NULL AS no_match, o.o_orderkey % 25 AS own FROM orders o LEFT JOIN best b ON o.o_orderkey = b.query)
"""


def nearest(spark, sf_dir) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderstatus").alias("status"))
    return hits.nearest_train(asked, good_hits(spark, sf_dir))


@query(NEAREST + "SELECT query, target, fident, bits, no_match FROM near")
def nearest_train(spark, sf_dir):
    return nearest(spark, sf_dir).select("query", "target", "fident", "bits", "no_match")


@query(NEAREST + "SELECT status, count(*) AS n, count(*) FILTER (no_match) AS no_match, count(*) FILTER (fident >= 0.7) AS over70, count(*) FILTER (fident >= 0.5) AS over50, count(*) FILTER (fident >= 0.3) AS over30, round(quantile_cont(fident, 0.5), 6) AS median, round(quantile_cont(fident, 0.9), 6) AS p90, round(avg(fident), 6) AS mean FROM near GROUP BY status")
def nearest_summary(spark, sf_dir):
    return nearest(spark, sf_dir).groupBy("status").agg(
        F.count("*").alias("n"), F.count_if("no_match").alias("no_match"), *[F.count_if(F.col("fident") >= t).alias(f"over{round(t * 100)}") for t in (0.7, 0.5, 0.3)],
        F.round(F.percentile("fident", 0.5), 6).alias("median"), F.round(F.percentile("fident", 0.9), 6).alias("p90"), F.round(F.avg("fident"), 6).alias("mean"))


@query(HITS + "SELECT o.o_orderstatus AS status, count(*) AS hits, count(*) FILTER (g.fident >= 0.7) AS violations FROM good g JOIN orders o ON g.query = o.o_orderkey GROUP BY 1")
def leakage_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderstatus").alias("status"))
    return good_hits(spark, sf_dir).join(orders, "query").groupBy("status").agg(F.count("*").alias("hits"), F.count_if(F.col("fident") >= 0.7).alias("violations"))


@query(HITS + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, evalue, fident DESC, qcov DESC, tcov DESC, target) AS k FROM good) WHERE k = 1),
m AS (SELECT p_type AS majority FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1))
SELECT o.o_orderkey AS query, b.target, coalesce(p.p_type, m.majority) AS predicted FROM orders o LEFT JOIN best b ON o.o_orderkey = b.query LEFT JOIN part p ON b.target = p.p_partkey CROSS JOIN m""")
def nearest_classifier(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), "p_type")
    return hits.nearest_label(asked, good_hits(spark, sf_dir), parts, "p_type").select("query", "target", "predicted")


@query(NEAREST + "SELECT CASE WHEN no_match THEN 'no_hit' WHEN fident < 0.2 THEN '0.00-0.20' WHEN fident < 0.3 THEN '0.20-0.30' WHEN fident < 0.4 THEN '0.30-0.40' WHEN fident < 0.5 THEN '0.40-0.50' WHEN fident < 0.7 THEN '0.50-0.70' ELSE '0.70-1.00' END AS bin, count(*) AS n FROM near GROUP BY 1")
def identity_bins(spark, sf_dir):
    return nearest(spark, sf_dir).groupBy(r.identity_bin(F.col("fident"), F.col("no_match")).alias("bin")).agg(F.count("*").alias("n"))


# ---- graph ----

#: Identities whose components are asked for; a line's identity is twice its quantity in hundredths.
IDENTITIES = (70, 50, 30)


def whole_components(spark, sf_dir, percent: int) -> DataFrame:
    """Components of all orders and parts by every line at or over the identity; those without such a line are single."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") * 2 >= percent)
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2 + 1).alias("node"))
    nodes = orders.unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("node")))
    edges = lines.select((F.col("l_orderkey") * 2 + 1).alias("left"), (F.col("l_partkey") * 2).alias("right"))
    return graph.components(edges, nodes=nodes).select(F.lit(percent).alias("percent"), "node", "component")


#: Labels sink along the edges until none changes; {p} is the identity.
LABELLED = """e{p} AS (SELECT l_orderkey * 2 + 1 AS a, l_partkey * 2 AS b FROM lineitem WHERE l_quantity * 2 >= {p} UNION SELECT l_partkey * 2, l_orderkey * 2 + 1 FROM lineitem WHERE l_quantity * 2 >= {p}),
cc{p}(node, component) USING KEY (node) AS (SELECT node, node AS component FROM nodes UNION SELECT u.node, min(v.component) FROM recurring.cc{p} u JOIN e{p} ON e{p}.a = u.node JOIN cc{p} v ON e{p}.b = v.node WHERE v.component < u.component GROUP BY u.node)"""
WHOLE = "WITH RECURSIVE nodes AS (SELECT o_orderkey * 2 + 1 AS node FROM orders UNION ALL SELECT p_partkey * 2 FROM part),\n" + ",\n".join(LABELLED.format(p=p) for p in IDENTITIES) + ",\nw AS (" + " UNION ALL ".join(f"SELECT {p} AS percent, node, component FROM cc{p}" for p in IDENTITIES) + ")\n"


def all_components(spark, sf_dir) -> DataFrame:
    out = None
    for percent in IDENTITIES:
        one = whole_components(spark, sf_dir, percent)
        out = one if out is None else out.unionByName(one)
    return out


@query(WHOLE + "SELECT percent, node, component FROM w")
def components_whole(spark, sf_dir):
    """Every node's component at each identity; nodes without an edge are single."""
    return all_components(spark, sf_dir)


@query(WHOLE + ", s AS (SELECT percent, component, count(*) AS n FROM w GROUP BY ALL) SELECT percent, CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' ELSE '20+' END AS bin, count(*) AS components, CAST(sum(n) AS BIGINT) AS nodes FROM s GROUP BY ALL")
def component_sizes_whole(spark, sf_dir):
    sizes = all_components(spark, sf_dir).groupBy("percent", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("percent", r.size_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("components"), F.sum("n").alias("nodes"))


@query(WHOLE + ", h AS (SELECT percent, component, sha256(CAST(node AS VARCHAR)) AS h FROM w) SELECT percent, component, concat('component-', sha256(concat(string_agg(h, chr(10) ORDER BY h), chr(10)))) AS name, count(*) AS n FROM h GROUP BY ALL")
def component_id_whole(spark, sf_dir):
    nodes = all_components(spark, sf_dir).withColumn("h", F.sha2(F.col("node").cast("string").cast("binary"), 256))
    named = streamed_digest(nodes, ["percent", "component"], ["h"], "h", separator=b"\n", end=b"\n")
    return named.select("percent", "component", F.concat(F.lit("component-"), "digest").alias("name"), F.col("rows").alias("n"))


@query(WHOLE + ", k AS (SELECT f.percent, f.component, count(DISTINCT c.component) AS k FROM w f JOIN w c ON f.node = c.node AND c.percent = CASE f.percent WHEN 70 THEN 50 WHEN 50 THEN 30 END GROUP BY ALL) SELECT percent, count(*) AS fine_components, count(*) FILTER (k > 1) AS torn FROM k GROUP BY percent")
def nested_check_whole(spark, sf_dir):
    """How many components of each identity are torn apart at the next lower one."""
    found, out = {p: whole_components(spark, sf_dir, p) for p in IDENTITIES}, None
    for fine, coarse in zip(IDENTITIES, IDENTITIES[1:]):
        per = found[fine].join(found[coarse].select("node", F.col("component").alias("coarse")), "node").groupBy("percent", "component").agg(F.count_distinct("coarse").alias("k"))
        one = per.groupBy("percent").agg(F.count("*").alias("fine_components"), F.count_if(F.col("k") > 1).alias("torn"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- splits ----

SPLIT = """WITH m AS (SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS h FROM documents),
keyed AS (SELECT *, sha256(concat_ws(chr(10), '42', CAST(doc_id AS VARCHAR), h)) AS k FROM m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id, h) AS place, count(*) OVER (PARTITION BY lang) AS n FROM keyed),
f AS (SELECT *, n * 14 // 20 AS f0, n * 3 // 20 AS f1, n * 14 % 20 AS r0, n * 3 % 20 AS r1 FROM ranked),
c AS (SELECT *, f0 + CASE WHEN (CASE WHEN r1 > r0 THEN 2 ELSE 0 END) < n - f0 - 2 * f1 THEN 1 ELSE 0 END AS c0, f1 + CASE WHEN (CASE WHEN r0 >= r1 THEN 1 ELSE 0 END) < n - f0 - 2 * f1 THEN 1 ELSE 0 END AS c1 FROM f),
assigned AS (SELECT doc_id, lang, source, CASE WHEN place <= c0 THEN 'train' WHEN place <= c0 + c1 THEN 'validation' ELSE 'test' END AS split FROM c)
"""


def assigned(spark, sf_dir) -> DataFrame:
    members = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return splits.random_split(members, "doc_id", "h", "lang").select("doc_id", "lang", "source", "split")


@query(SPLIT + "SELECT * FROM assigned")
def random_split(spark, sf_dir):
    return assigned(spark, sf_dir)


@query(SPLIT + "SELECT lang, split, count(*) AS n FROM assigned GROUP BY ALL")
def split_counts(spark, sf_dir):
    return assigned(spark, sf_dir).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query(SPLIT + "SELECT count(*) FILTER (k > 1) AS crossings, count(*) AS groups FROM (SELECT source, count(DISTINCT split) AS k FROM assigned GROUP BY 1)")
def crossings(spark, sf_dir):
    return splits.crossings(assigned(spark, sf_dir), "source")


@query(SPLIT + ", t AS (SELECT count(*) AS total, count(DISTINCT lang) AS l FROM assigned) SELECT split, count(*) AS rows, count(DISTINCT lang) AS labels, round(count(*) / any_value(total) - CASE WHEN split = 'train' THEN 0.7 ELSE 0.15 END, 6) AS deviation, count(DISTINCT lang) = any_value(l) AS complete FROM assigned CROSS JOIN t GROUP BY split")
def split_validation(spark, sf_dir):
    return splits.split_report(assigned(spark, sf_dir), "lang")


@query("""WITH p AS (SELECT lang, count(*) AS rows, count(DISTINCT source) AS groups FROM documents GROUP BY 1), e AS (SELECT *, least(rows, 200) AS capped, rows >= 100 AS eligible FROM p),
k AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY capped DESC, groups DESC, lang) END AS rank FROM e) SELECT lang, rows, groups, CAST(capped AS BIGINT) AS capped, eligible, rank, coalesce(rank <= 2, false) AS selected FROM k""")
def class_rank(spark, sf_dir):
    return splits.ranked_classes(table(spark, sf_dir, "documents"), "lang", "source", cap=200, least=100, keep=2)


@query("""WITH k AS (SELECT doc_id, lang, source, sha256(concat_ws(chr(10), '42', CAST(doc_id AS VARCHAR))) AS key FROM documents), i AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY key, doc_id) > 1 AS INTEGER) AS later FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY later, key, doc_id) AS place FROM i) SELECT doc_id, lang, source, place FROM p WHERE place <= 150""")
def capped_sample(spark, sf_dir):
    return splits.capped_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", "lang", "source", 150)


@query()
def grouped_split(spark, sf_dir):
    """Whole sources, placed greedily; tests hold the fold against hand-made cases."""
    return splits.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source")


# ---- predictions ----

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NAMES = "['" + "', '".join(SEGMENTS) + "']"
STAR = f"""WITH star AS (SELECT o.o_orderstatus AS split, o.o_orderkey AS id, o.o_custkey % 97 AS component, c.c_mktsegment AS truth,
 CASE WHEN o.o_orderkey % 3 = 0 THEN c.c_mktsegment ELSE {NAMES}[CAST((o.o_orderkey * 7 + o.o_custkey) % 5 + 1 AS INTEGER)] END AS a,
 CASE WHEN o.o_orderkey % 4 = 0 THEN c.c_mktsegment ELSE {NAMES}[CAST((o.o_orderkey + o.o_custkey * 3) % 4 + 1 AS INTEGER)] END AS b
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
long AS (SELECT split, id, component, truth, 'a' AS method, a AS predicted FROM star UNION ALL SELECT split, id, component, truth, 'b', b FROM star),
conf AS (SELECT split, method, truth, predicted, count(*) AS n FROM long GROUP BY ALL)
"""
CLASSES = STAR + f""", grid AS (SELECT split, method, unnest({NAMES}) AS label FROM (SELECT DISTINCT split, method FROM conf)),
t AS (SELECT split, method, truth AS label, sum(n) AS support, sum(n) FILTER (truth = predicted) AS hits FROM conf GROUP BY ALL), g AS (SELECT split, method, predicted AS label, sum(n) AS guessed FROM conf GROUP BY ALL),
per AS (SELECT split, method, label, CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(coalesce(guessed, 0) AS BIGINT) AS guessed FROM grid LEFT JOIN t USING (split, method, label) LEFT JOIN g USING (split, method, label)),
rates AS (SELECT *, coalesce(hits / nullif(guessed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(support + guessed, 0), 0) AS f1 FROM per)
"""


def star(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("truth"))
    names = F.array(*[F.lit(x) for x in SEGMENTS])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = F.when(k % 3 == 0, F.col("truth")).otherwise(F.get(names, ((k * 7 + c) % 5).cast("int")))
    b = F.when(k % 4 == 0, F.col("truth")).otherwise(F.get(names, ((k + c * 3) % 4).cast("int")))
    joined = table(spark, sf_dir, "orders").join(customers, "o_custkey")
    return joined.select(F.col("o_orderstatus").alias("split"), k.alias("id"), (c % 97).alias("component"), "truth", a.alias("a"), b.alias("b"))


def long_star(spark, sf_dir) -> DataFrame:
    both = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("predicted")) for m in ("a", "b")])
    return star(spark, sf_dir).select("split", "id", "component", "truth", F.inline(both))


CELL = ["split", "method"]


def conf(spark, sf_dir) -> DataFrame:
    return metrics.confusion(long_star(spark, sf_dir), CELL)


@query(STAR + "SELECT *, round(n / sum(n) OVER (PARTITION BY split, method, truth), 9) AS row_fraction FROM conf")
def confusion(spark, sf_dir):
    return metrics.with_fractions(conf(spark, sf_dir), CELL).withColumn("row_fraction", F.round("row_fraction", 9))


@query(CLASSES + "SELECT split, method, label, support, hits, guessed, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rates")
def per_class(spark, sf_dir):
    done = metrics.per_class(conf(spark, sf_dir), CELL, SEGMENTS)
    return done.select("split", "method", "label", "support", "hits", "guessed", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(CLASSES + "SELECT split, method, round(sum(hits) / sum(support), 9) AS accuracy, round(sum(recall) / 5, 9) AS balanced_accuracy, round(sum(precision) / 5, 9) AS macro_precision, round(sum(f1) / 5, 9) AS macro_f1, CAST(sum(support) AS BIGINT) AS rows FROM rates GROUP BY ALL")
def macro_metrics(spark, sf_dir):
    done = metrics.macro(conf(spark, sf_dir), CELL, SEGMENTS)
    return done.select(*CELL, *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_precision", "macro_f1")], "rows")


@query("SELECT c_mktsegment AS majority, (SELECT count(*) FROM customer) AS rows FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def majority(spark, sf_dir):
    return hits.majority(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(STAR + f"SELECT split, method, truth, first(predicted ORDER BY n DESC, list_position({NAMES}, predicted)) AS dominant, max(n) AS dominant_n, CAST(sum(n) AS BIGINT) AS errors FROM conf WHERE truth <> predicted GROUP BY ALL")
def dominant_error(spark, sf_dir):
    return metrics.dominant_errors(conf(spark, sf_dir), CELL, SEGMENTS)


@query(STAR + "SELECT split, count(*) FILTER (a = truth AND b = truth) AS both, count(*) FILTER (a = truth AND b <> truth) AS first_only, count(*) FILTER (a <> truth AND b = truth) AS second_only, count(*) FILTER (a <> truth AND b <> truth) AS neither, count(*) AS rows FROM star GROUP BY split")
def agreement(spark, sf_dir):
    return metrics.agreement(star(spark, sf_dir), ["split"], "a", "b")


@query(STAR + """, sizes AS (SELECT split, method, component, count(*) AS n FROM long GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY split, method ORDER BY n DESC, component) AS k FROM sizes)
SELECT l.split, l.method, CAST(r.removed AS INTEGER) AS removed, count(*) AS rows, round(count(*) FILTER (truth = predicted) / count(*), 9) AS accuracy FROM long l JOIN ranked USING (split, method, component) CROSS JOIN (SELECT unnest([0, 1, 3, 5]) AS removed) r WHERE k > r.removed GROUP BY ALL""")
def influence(spark, sf_dir):
    rest = metrics.without_largest(long_star(spark, sf_dir), CELL, "component", (0, 1, 3, 5))
    return rest.groupBy(*CELL, "removed").agg(F.count("*").alias("rows"), F.round(F.count_if(F.col("truth") == F.col("predicted")) / F.count("*"), 9).alias("accuracy"))


@query(CLASSES + """, m AS (SELECT split, method, sum(hits) / sum(support) AS acc, sum(recall) AS rec, sum(f1) AS f1 FROM rates GROUP BY ALL), d AS (SELECT x.split, sign(round(x.acc - y.acc, 9)) AS s1, sign(round(x.rec - y.rec, 9)) AS s2, sign(round(x.f1 - y.f1, 9)) AS s3 FROM m x JOIN m y ON x.split = y.split AND x.method = 'a' AND y.method = 'b')
SELECT split, CASE WHEN s1 = s2 AND s2 = s3 THEN CASE WHEN s1 > 0 THEN 'positive' WHEN s1 < 0 THEN 'negative' ELSE 'zero' END ELSE 'mixed' END AS concordance FROM d""")
def sign_concordance(spark, sf_dir):
    done = metrics.macro(conf(spark, sf_dir), CELL, SEGMENTS)
    columns = ("accuracy", "balanced_accuracy", "macro_f1")
    wide = done.groupBy("split").agg(*[F.round(F.max(F.when(F.col("method") == "a", F.col(c))) - F.max(F.when(F.col("method") == "b", F.col(c))), 9).alias(c) for c in columns])
    return wide.select("split", r.concordance(*[F.col(c) for c in columns]).alias("concordance"))


STRATA = """, strata AS (SELECT split, method, truth, component % 13 AS stratum, count(*) AS n, count(DISTINCT component) AS c, count(*) FILTER (truth = predicted) AS hits FROM long GROUP BY ALL),
judged AS (SELECT *, CASE WHEN n < 5 OR c < 3 THEN 'privacy_suppressed' WHEN n < 20 THEN 'insufficient_sequences' WHEN c < 10 THEN 'insufficient_components_for_ci' ELSE 'reportable' END AS status FROM strata)
"""


@query(STAR + STRATA + "SELECT split, method, truth, stratum, status, CASE WHEN n < 5 THEN '<5' WHEN status = 'privacy_suppressed' THEN NULL ELSE CAST(n AS VARCHAR) END AS rows, CASE WHEN c < 3 THEN '<3' WHEN status = 'privacy_suppressed' THEN NULL ELSE CAST(c AS VARCHAR) END AS components, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN round(hits / n, 9) END AS accuracy FROM judged")
def suppressed_strata(spark, sf_dir):
    rows = long_star(spark, sf_dir).withColumn("stratum", F.col("component") % 13)
    per = rows.groupBy(*CELL, "truth", "stratum").agg(F.count("*").alias("n"), F.count_distinct("component").alias("c"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    per = per.withColumn("status", r.eligibility(F.col("n"), F.col("c")))
    private = F.col("status") == "privacy_suppressed"
    return per.select(*CELL, "truth", "stratum", "status", r.public_count(F.col("n"), 5, private).alias("rows"), r.public_count(F.col("c"), 3, private).alias("components"), r.reportable(F.col("status"), F.round(F.col("hits") / F.col("n"), 9)).alias("accuracy"))


METRICS = ("accuracy", "balanced_accuracy", "macro_f1")


def _replicates(spark, sf_dir, keys: list[str], domain: str) -> DataFrame:
    rows = long_star(spark, sf_dir)
    draws = bootstrap.draw_table(rows, keys, "component", domain)
    return bootstrap.replicates(rows, draws, keys, "component", SEGMENTS, [c for c in CELL if c not in keys])


@query()
def bootstrap_ci(spark, sf_dir):
    return bootstrap.intervals(_replicates(spark, sf_dir, CELL, "{split}:{method}"), CELL, METRICS)


@query()
def paired_diff(spark, sf_dir):
    """Both methods see the same draw of a split."""
    values = _replicates(spark, sf_dir, ["split"], "paired:{split}")
    return bootstrap.intervals(bootstrap.differences(values, ["split"], "method", "a", "b", METRICS), ["split"], METRICS)


@query()
def split_gap(spark, sf_dir):
    """Two splits, drawn independently."""
    values = _replicates(spark, sf_dir, CELL, "gap:{method}:{split}")
    return bootstrap.intervals(bootstrap.differences(values, ["method"], "split", "O", "F", METRICS), ["method"], METRICS)


@query()
def performance_summary(spark, sf_dir):
    """Gated metrics of each split and method with intervals."""
    return reports.summary(long_star(spark, sf_dir), CELL, "component", SEGMENTS, "summary:{split}:{method}")


BINS = [str(k) for k in range(14)]


@query(STAR + """, b AS (SELECT *, CAST(component % 13 AS VARCHAR) AS bin FROM long), grid AS (SELECT split, method, unnest(list_transform(range(14), lambda k: CAST(k AS VARCHAR))) AS bin FROM (SELECT DISTINCT split, method FROM b)),
g AS (SELECT split, method, bin, count(*) AS n, count(DISTINCT component) AS c, count(*) FILTER (truth = predicted) / count(*) AS accuracy FROM b GROUP BY ALL),
j AS (SELECT *, CASE WHEN n < 5 OR c < 3 THEN 'privacy_suppressed' WHEN n < 20 THEN 'insufficient_sequences' WHEN c < 10 THEN 'insufficient_components_for_ci' ELSE 'reportable' END AS st FROM g)
SELECT split, method, bin, coalesce(st, 'privacy_suppressed') AS status, CASE WHEN n IS NULL OR n < 5 THEN '<5' WHEN st = 'privacy_suppressed' THEN '<5' ELSE CAST(n AS VARCHAR) END AS rows, CASE WHEN st IN ('reportable', 'insufficient_components_for_ci') THEN round(accuracy, 9) END AS accuracy FROM grid LEFT JOIN j USING (split, method, bin)""")
def stratified_summary(spark, sf_dir):
    rows = long_star(spark, sf_dir).withColumn("bin", (F.col("component") % 13).cast("string"))
    done = reports.stratified(rows, CELL, "bin", BINS, "component", SEGMENTS)
    return done.select(*CELL, "bin", "status", "rows", F.round("accuracy", 9).alias("accuracy"))


@query(CLASSES + f""", gate AS (SELECT split, method, truth, count(*) AS n, count(DISTINCT component) AS c FROM long GROUP BY ALL),
st AS (SELECT *, CASE WHEN n < 5 OR c < 3 THEN 'privacy_suppressed' WHEN n < 20 THEN 'insufficient_sequences' WHEN c < 10 THEN 'insufficient_components_for_ci' ELSE 'reportable' END AS status FROM gate),
wrong AS (SELECT split, method, truth, first(predicted ORDER BY n DESC, list_position({NAMES}, predicted)) AS dominant FROM conf WHERE truth <> predicted GROUP BY ALL),
every AS (SELECT r.split, r.method, r.label AS truth, coalesce(status, 'privacy_suppressed') AS status, precision, recall, f1, dominant FROM rates r LEFT JOIN st s ON r.split = s.split AND r.method = s.method AND r.label = s.truth LEFT JOIN wrong w ON r.split = w.split AND r.method = w.method AND r.label = w.truth)
SELECT split, method, truth, status, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN round(precision, 9) END AS precision, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN round(recall, 9) END AS recall, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN round(f1, 9) END AS f1, CASE WHEN status IN ('reportable', 'insufficient_components_for_ci') THEN dominant END AS dominant FROM every""")
def class_errors(spark, sf_dir):
    """Per-class rates gated by the true class; the rates themselves are those of ``per_class``."""
    done = reports.class_errors(long_star(spark, sf_dir), CELL, "component", SEGMENTS)
    return done.select(*CELL, "truth", "status", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "dominant")


@query()
def model_comparisons(spark, sf_dir):
    return reports.comparisons(long_star(spark, sf_dir), ["split"], [("a", "b")], "component", SEGMENTS, "compare:{split}")


@query()
def seed_diagnostics(spark, sf_dir):
    """How far interval bounds move between three seeds."""
    rows, out = long_star(spark, sf_dir), None
    for seed in (2026, 3407, 42):
        one = reports.summary(rows, CELL, "component", SEGMENTS, "seeds:{split}:{method}", seed=seed).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return reports.seed_shifts(out, [*CELL, "metric"], 2026)


@query(STAR + STRATA + ", o AS (SELECT split, method, status, CASE status WHEN 'reportable' THEN 1 WHEN 'insufficient_components_for_ci' THEN 2 WHEN 'insufficient_sequences' THEN 3 ELSE 4 END AS k FROM judged) SELECT split, method, arg_max(status, k) AS status FROM o GROUP BY ALL")
def least_status(spark, sf_dir):
    rows = long_star(spark, sf_dir).withColumn("stratum", F.col("component") % 13)
    return reports.least_status(reports.gated(rows, [*CELL, "truth", "stratum"], "component"), CELL)


@query("WITH RECURSIVE " + RECORDS.removeprefix("WITH ") + """, o AS (SELECT row_number() OVER (ORDER BY length(seq), h) AS k, CAST(length(seq) AS BIGINT) AS n FROM judged),
f AS (SELECT k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held, n FROM o WHERE k = 1 UNION ALL SELECT o.k, CASE WHEN (f.held + 1) * o.n > 20000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.held + 1) * o.n > 20000 THEN 1 ELSE f.held + 1 END, o.n FROM f JOIN o ON o.k = f.k + 1),
b AS (SELECT batch, count(*) AS rows, max(n) AS longest, sum(n) AS tokens FROM f GROUP BY batch)
SELECT count(*) AS batches, max(rows) AS most, round(avg(rows), 9) AS mean, round(sum(tokens) / sum(rows * longest), 9) AS efficiency FROM b""")
def token_batches(spark, sf_dir):
    """Records in batches under a padded budget, packed in one order by length and hash: a sequential fold over (length, hash)."""
    rows = judged(spark, sf_dir).select("h", F.length("seq").cast("long").alias("n"))
    done = batching.batching_statistics(batching.token_batches(rows, "n", "h", 20_000), "n")
    return done.select("batches", "most", F.round("mean", 9).alias("mean"), F.round("efficiency", 9).alias("efficiency"))


# ---- lineage and text ----

CHANGED = """WITH old AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey % 50 <> 3), new AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 20 = 1 THEN 'Brand#new' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 30 = 1 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_partkey % 40 <> 5)
"""


def lineages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    parts, k = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey")
    new = parts.filter(k % 40 != 5).withColumn("p_brand", F.when(k % 20 == 1, "Brand#new").otherwise(F.col("p_brand"))).withColumn("p_type", F.when(k % 30 == 1, F.lit(None)).otherwise(F.col("p_type")))
    return parts.filter(k % 50 != 3), new


@query(CHANGED + "SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_brand IS DISTINCT FROM n.p_brand OR o.p_type IS DISTINCT FROM n.p_type THEN 'changed' ELSE 'same' END AS status, CASE WHEN o.p_partkey IS NULL OR n.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.p_brand IS DISTINCT FROM n.p_brand THEN 'p_brand' END, CASE WHEN o.p_type IS DISTINCT FROM n.p_type THEN 'p_type' END) END AS changed_fields FROM old o FULL JOIN new n ON o.p_partkey = n.p_partkey")
def regen_diff(spark, sf_dir):
    return hits.lineage_diff(*lineages(spark, sf_dir), "p_partkey", ["p_name", "p_brand", "p_type"])


@query(CHANGED + "SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(n.c, 0) - coalesce(o.c, 0) AS delta FROM (SELECT p_brand, count(*) AS c FROM old GROUP BY 1) o FULL JOIN (SELECT p_brand, count(*) AS c FROM new GROUP BY 1) n ON o.p_brand = n.p_brand")
def class_deltas(spark, sf_dir):
    old, new = (x.groupBy("p_brand").agg(F.count("*").alias(c)) for x, c in zip(lineages(spark, sf_dir), ("o", "n")))
    return old.join(new, "p_brand", "full").select("p_brand", (F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0))).alias("delta"))


HASHED = """, d AS (SELECT {k} AS k, sha256(concat_ws(chr(9), CAST(p_partkey AS VARCHAR), p_name, p_brand, coalesce(p_type, 'NA'))) AS x FROM {t})
SELECT k AS p_type_group, sha256(string_agg(x, chr(10) ORDER BY x)) AS digest, count(*) AS rows FROM d GROUP BY k"""


@query(CHANGED + HASHED.format(k="p_partkey % 10", t="old"))
def semantic_hash(spark, sf_dir):
    old, _ = lineages(spark, sf_dir)
    return audit.semantic_hash(old.withColumn("p_type_group", F.col("p_partkey") % 10), ["p_type_group"], ["p_partkey", "p_name", "p_brand", "p_type"])


@query(CHANGED + """, x AS (SELECT p_partkey, sha256(concat_ws(chr(9), p_name, p_brand, coalesce(p_type, 'NA'))) AS h FROM old), y AS (SELECT p_partkey, sha256(concat_ws(chr(9), p_name, p_brand, coalesce(p_type, 'NA'))) AS h FROM new)
SELECT CASE WHEN x.h IS NULL THEN 'second_only' WHEN y.h IS NULL THEN 'first_only' WHEN x.h = y.h THEN 'same' ELSE 'different' END AS status, count(*) AS n FROM x FULL JOIN y ON x.p_partkey = y.p_partkey GROUP BY 1""")
def replay_compare(spark, sf_dir):
    a, b = (x.select("p_partkey", audit.row_digest([F.col(c) for c in ("p_name", "p_brand", "p_type")]).alias("h")) for x in lineages(spark, sf_dir))
    return audit.compare_inventories(a, b, "p_partkey", "h").groupBy("status").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in audit.RULES.items()) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, {n} AS rows FROM p" for n in audit.RULES))
def privacy_scan(spark, sf_dir):
    return audit.scan_counts(table(spark, sf_dir, "documents"), "text")


# ---- vectors ----

@query("SELECT CAST(position - 1 AS INTEGER) AS position, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS scale FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS position FROM embeddings) GROUP BY 1")
def scaler_stats(spark, sf_dir):
    done = features.scaler(table(spark, sf_dir, "embeddings"), "embedding")
    return done.select("position", F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


@query("SELECT vec_id, CAST(k AS INTEGER) AS position, round((a0 + a2 + a4 + a6) / 4, 9) AS pooled FROM (SELECT vec_id, unnest(range(8)) AS k, unnest(embedding[1:8])::DOUBLE AS a0, unnest(embedding[17:24])::DOUBLE AS a2, unnest(embedding[33:40])::DOUBLE AS a4, unnest(embedding[49:56])::DOUBLE AS a6 FROM embeddings)")
def residue_mean_pool(spark, sf_dir):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding").cast("array<double>"), t * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.when(t % 2 == 0, 1).otherwise(0))
    pooled = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(features.mean_pool(tokens, mask)).alias("position", "pooled"))
    return pooled.withColumn("pooled", F.round("pooled", 9))


@query()
def logistic_pred(spark, sf_dir):
    """Balanced multinomial logistic regression on the scaled vectors of the training split."""
    names = [str(k) for k in range(10)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("truth"), F.sha2(F.col("vec_id").cast("string").cast("binary"), 256).alias("h"))
    split = splits.random_split(rows, "vec_id", "h", "truth")
    train = split.filter("split = 'train'")
    ready = features.scaled(split, "embedding", features.scaler(train, "embedding"))
    model = features.balanced_logistic(ready.filter("split = 'train'"), "embedding", "truth", names)
    return features.predicted(model, ready, "embedding", names).select("vec_id", "split", "truth", "predicted")


# ---- the synthetic cohort ----

@query()
def synthetic_demo(spark, sf_dir):
    """Generation, both kinds of split, composition features, a linear model, and metrics for each split kind."""
    rows = synthetic.cohort(spark).withColumn("features", features.composition(F.col("sequence")))
    done = []
    for kind in ("random", "grouped"):
        split = splits.random_split(rows, "accession", "sequence_sha256", "label") if kind == "random" else splits.grouped_split(rows, "label", "component")
        model = features.balanced_logistic(split.filter("split = 'train'"), "features", "label", synthetic.LABELS)
        guess = features.predicted(model, split.filter("split = 'test'"), "features", synthetic.LABELS).withColumnRenamed("label", "truth").withColumn("kind", F.lit(kind))
        crossed = splits.crossings(split, "component").withColumn("kind", F.lit(kind))
        done.append(metrics.macro(metrics.confusion(guess, ["kind"]), ["kind"], synthetic.LABELS).join(crossed, "kind"))
    return done[0].unionByName(done[1])


from quernstone.plans import checks  # noqa: E402, F401  its queries are registered beside these
