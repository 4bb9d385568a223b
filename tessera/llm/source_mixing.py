"""Mix sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Sources up to this number are broadcast; more are joined.
BROADCAST_SOURCES = 50_000


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``sized (source, size)``.

    Sources in code point order, null last, take the weights in turn. Together
    the targets are ``share`` times all sizes; one stops at ``cap`` times its
    source's size, and what is above goes to the others by weight. In order of
    cap by weight, the sources before the first that stays below its cap are
    the ones at their cap, which a running sum finds: the level that is left for
    the others rises up to there and falls beyond.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sums.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(cap))
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: adds ``size``, ``source_size``, ``target`` and ``copies``.

    Sizes are numbers of words. A source's rate is its target by its size; a
    document is taken floor(rate) times, and once more if a number drawn from a
    hash of seed and id is below the fraction. So reruns agree, rows that repeat
    an id are taken alike, and only sums by source are shuffled. Null and empty
    texts have size 0; a source of size 0 has target and copies 0. Null sources
    are a source of their own, null ids one id. An input column of a new name
    gives way. An empty table gives an empty result.
    """
    docs = docs.select([c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")])
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    targets = materialize(source_targets(sized.select(F.col(source).alias("source"), "size"), weights, share, cap), "targets")
    side = targets.withColumnRenamed("source", "mixed_source")
    side = F.broadcast(side) if targets.count() <= BROADCAST_SOURCES else side
    joined = sized.join(side, sized[source].eqNullSafe(F.col("mixed_source")), "left").drop("mixed_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    drawn = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(2**48)
    return joined.withColumn("copies", (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long"))


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix_sources`` as often as its ``copies`` say."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
  SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS highest FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN highest IS NULL THEN cap ELSE least(cap, highest * w) END AS target FROM found
), rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS drawn
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rates
"""
