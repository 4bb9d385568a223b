"""A training corpus in five stages, each a table written for the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the
last return the columns of ``docs``. Extra columns pass through, an empty table
gives an empty one, and null and empty texts are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, toxicity
from tessera.llm.bpe_stream import bpe_digests
from tessera.llm.ngram_join import ngram_links
from tessera.llm.source_mixing import mix_sources, repeat_documents
from tessera.llm.substring_dedup import substring_dedup

#: SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold stay.

    Copies and rows that repeat an id are scored alike; null and empty texts
    have the score of a text without known words.
    """
    fitted = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, fitted).where(F.col("score") < toxicity.THRESHOLD).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the n-gram join connect, the one with the smallest id stays.

    Rows are told apart by id and text: of rows that repeat an id with different
    texts each is judged by its own text, and of rows that repeat both one
    stays. A null id stays only if its text is linked with no other id. Texts
    without words link with nothing and stay. Most rows that stay are known by
    marks of the others, so only texts that the marks name are shuffled to be
    compared with them.
    """
    links = ngram_links(docs)
    others = common.materialize(links.where(~F.col("doc").eqNullSafe(F.col("component"))).select("doc", "key").distinct(), "others")
    again = common.materialize(links.groupBy("doc", "key").count().where("count > 1").select("doc", "key"), "again")
    common.discard(links)

    doc, key = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])

    def same(few: DataFrame):
        return doc.eqNullSafe(few["doc"]) & key.eqNullSafe(few["key"])

    marks = common.Marks(others.union(again), "doc", "key")
    named = marks.maybe(docs, doc, key)
    others, again = common.small(others), common.small(again)
    once = named.join(others, same(others), "left_anti").join(again, same(again), "left_anti")
    repeated = named.join(again, same(again), "left_semi").join(others, same(others), "left_anti")
    return marks.surely_not(docs, doc, key).unionByName(once).unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document that has them; all documents stay, those with null or repeated ids too."""
    return substring_dedup(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks; a null source is one of its own, texts without words have no size."""
    return repeat_documents(mix_sources(docs)).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row of the mix; a null text is empty."""
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("source_mixing", mixed),
    ("bpe_encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each over what the one before wrote."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return docs
