"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of ``documents``. Documents judged toxic go; of each group of near duplicates the
smallest id stays; personal data is replaced by its kind; sources are mixed to their targets, so a
document can come up to twice or, in a source above its target, not at all; the last stage encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import encode
from quernstone.llm.entry import CATEGORIES
from quernstone.llm.jaccard import deduplicate
from quernstone.llm.mixing import mixture
from quernstone.llm.pii import redact
from quernstone.llm.toxicity import reject, train
from quernstone.session import stage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain calls toxic."""
    return reject(docs, train(docs, table(spark, sf_dir, "labels"), CATEGORIES))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return deduplicate(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars`` follows the new text."""
    done = redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words come near its target."""
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row."""
    import public_tokenizers

    ids = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("mixing", mixing), ("bpe", tokens)]

#: SQL can't express these stages; tests go through them stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
