"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.session import table


#: Chain order of the labels at hand.
CATEGORIES = ["quality", "toxic"]


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), CATEGORIES))
    return scored.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("is_toxic").alias("toxic"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.warc import archive_path, read_warc, write_warc

    path = archive_path(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, payload_bytes >= 100 AND row_number() OVER w > 1 AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r
"""

WORDS = """w AS (SELECT doc_id, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

OP6_SQL = "WITH " + WORDS.format(text="coalesce(text, '')") + """,
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 33), lambda i: {'i': i, 'h': sha256(array_to_string(ws[i:i + 34], ' '))}), recursive := true) FROM w WHERE len(ws) >= 35),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1), g AS (SELECT DISTINCT doc_id, i + o AS pos, true AS gone FROM p SEMI JOIN r USING (h) CROSS JOIN range(35) t(o)),
k AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w),
j AS (SELECT doc_id, count(*) AS n, count(gone) AS m, string_agg(x, ' ' ORDER BY pos) FILTER (gone IS NULL) AS kept FROM k LEFT JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN j USING (doc_id)
"""

OP9_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents), n AS (SELECT *, length(hx) // 2 AS n FROM d),
p AS (SELECT doc_id, unnest(list_transform(range(0, n - 99), lambda i: {'i': i, 'h': md5(substring(hx, CAST(2 * i + 1 AS INTEGER), 200))}), recursive := true) FROM n WHERE n >= 100),
r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
s AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 AS joined FROM r), t AS (SELECT *, count(*) FILTER (NOT coalesce(joined, false)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM t GROUP BY ALL), h AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
k AS (SELECT h.doc_id, count(*) AS spans, sum(b - a) AS gone, string_agg(substring(hx, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS kept, max(b) AS last FROM h JOIN n USING (doc_id) GROUP BY h.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(hx, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)
"""

OP10_SQL = "WITH RECURSIVE " + WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """,
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT l AS a, r AS b FROM c JOIN n y ON l = y.doc_id JOIN n z ON r = z.doc_id WHERE 100 * c >= 85 * (y.n + z.n - c)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.node, min(v.component) FROM recurring.cc u JOIN both_ways ON a = u.node JOIN cc v ON b = v.node WHERE v.component < u.component GROUP BY u.node)
SELECT doc_id, n AS n_shingles, component AS component_id FROM n JOIN cc ON doc_id = node
"""


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from quernstone.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("_h")


def op5_simhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.simhash import as_hex, likeness, near, with_edits
    from quernstone.session import stage

    done = stage(with_edits(table(spark, sf_dir, "documents")), "simhash")
    asks = F.col("doc_id") % 50 == 0
    found = near(done.filter(asks).select("fp").distinct(), done.groupBy("fp").agg(F.count("*").alias("n")))
    counts = found.groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("_near"))
    columns = [as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next")]
    # n_near: for ids divisible by 50, how many other documents' fingerprints are within three bits
    return done.join(counts, "fp", "left").select("doc_id", "n_chars", "edited_sha256", *columns, F.when(asks, F.col("_near")).alias("n_near"))


def op6_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.anchors import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.pii import find_pii, joined

    base = ("email", "ip", "card", "phone")
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    kept = joined(F.filter("pii", lambda s: s["kind"].isin(*base)))
    return found.select("doc_id", "pii").select("doc_id", *counts, F.sha2(kept.cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op8_descent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_parse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.prefix_parse import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _digest_numbers(column):
    from pyspark.sql import functions as F

    digest = F.sha2(column.cast("string").cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(n) for k, n in enumerate("abcd")]


def op11_as_of_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.asof import as_of

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    event = F.col("a") % 200000
    versions = docs.select("*", *_digest_numbers(F.col("doc_id"))).select(
        "doc_id", "source", "n_chars", "lang", event.alias("event"), (event - 60 + F.col("b") % 1200).alias("arrival"), (event + F.col("c") % 900).alias("expiry"))
    # a label asks about its document's source; of a repeated id the smallest source counts
    sources = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    labels = table(spark, sf_dir, "labels").select("doc_id")
    asks = labels.hint("merge").join(sources.hint("merge"), "doc_id", "left").select("doc_id", "source", *_digest_numbers(F.col("doc_id"))).select("doc_id", "source", (F.col("d") % 200000).alias("t"))
    found = as_of(asks, versions, key="source", at="t", tie="doc_id", carry=["n_chars", "lang"], lifetime=900)
    age = F.col("t") - F.col("version.event")
    fresh = age <= 20
    status = F.when(F.col("version").isNull(), "none").when(fresh, "fresh").otherwise("stale")
    return found.select("doc_id", "t", F.col("version.tie").alias("version_id"), age.alias("age"), status.alias("status"), F.when(fresh, F.col("version.n_chars")).alias("n_chars"), F.when(fresh, F.col("version.lang")).alias("lang"))


OP11_SQL = """WITH h AS (SELECT doc_id, source, n_chars, lang, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents),
p AS (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 200000 AS event, CAST('0x' || substr(x, 9, 8) AS BIGINT) % 1200 AS b, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 900 AS c FROM h),
v AS (SELECT doc_id AS version_id, source, n_chars, lang, event, event - 60 + b AS arrival, event + c AS expiry FROM p WHERE source IS NOT NULL),
s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
q AS (SELECT row_number() OVER () AS row, l.doc_id, s.source, CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 200000 AS t FROM labels l LEFT JOIN s ON l.doc_id = s.doc_id),
j AS (SELECT q.*, version_id, event, v.n_chars, v.lang, row_number() OVER (PARTITION BY q.row ORDER BY event DESC NULLS LAST, arrival DESC, version_id DESC) AS k FROM q LEFT JOIN v ON q.source = v.source AND v.event BETWEEN q.t - 900 AND q.t AND v.arrival <= q.t AND q.t < v.expiry)
SELECT doc_id, t, version_id, t - event AS age, CASE WHEN event IS NULL THEN 'none' WHEN t - event > 20 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN t - event <= 20 THEN n_chars END AS n_chars, CASE WHEN t - event <= 20 THEN lang END AS lang FROM j WHERE k = 1
"""


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.centroids import clusters

    return clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def _rounds(n: int) -> str:
    """Rounds of assignment and means in SQL: c0 are the initial centroids (cluster, i, x), a{r} the assignments by them."""
    out = []
    for r in range(n + 1):
        out.append(f"a{r} AS (SELECT row, cluster, distance FROM (SELECT v.row, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN c{r} c ON v.i = c.i GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)")
        if r < n:
            out.append(f"m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (row) GROUP BY ALL)")
            out.append(f"c{r + 1} AS (SELECT c.cluster, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster AND c.i = m.i)")
    return ",\n".join(out)


OP12_SQL = """WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT row, generate_subscripts(embedding, 1) AS i, CAST(floor(unnest(CAST(embedding AS DOUBLE[])) * 1024) AS BIGINT) AS x FROM e),
f AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cluster FROM e QUALIFY cluster < 8),
c0 AS (SELECT cluster, i, x FROM f JOIN v USING (row)),
""" + _rounds(10).replace(" AS (SELECT", " AS MATERIALIZED (SELECT") + """,
n AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY cluster),
s AS (SELECT cluster, sum(distance) AS own FROM a10 GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(own) FROM s) AS BIGINT) AS inertia, centroid_sha256 FROM a10 a JOIN e USING (row) JOIN s USING (cluster) JOIN n USING (cluster)
"""


def op13_stable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.pstable import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


OP13_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
cc(node, component) USING KEY (node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT u.node, min(w.component) FROM recurring.cc u JOIN l ON l.a = u.node JOIN cc w ON l.b = w.node WHERE w.component < u.component GROUP BY u.node)
SELECT m.vec_id, coalesce(n, 0) AS n_links, component AS component_id, m.vec_id = component AS kept FROM embeddings m JOIN cc ON m.vec_id = node LEFT JOIN n ON m.vec_id = a
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity_chain, op2_warc_round_trip, op3_bpe_round_trip, op4_mix_sources, op5_simhash_edits, op6_anchor_repeats, op7_pii_spans, op8_descent_neighbours, op9_parse_repeats, op10_jaccard_components, op11_as_of_features, op12_sort_means, op13_stable_links]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_round_trip": OP2_SQL, "op6_anchor_repeats": OP6_SQL, "op9_parse_repeats": OP9_SQL, "op10_jaccard_components": OP10_SQL, "op11_as_of_features": OP11_SQL, "op12_sort_means": OP12_SQL, "op13_stable_links": OP13_SQL}
