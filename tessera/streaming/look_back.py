"""Records that are corrected for some days: a stream keeps the newest version of each, and forgets those that are too old.

The days that a run looks back are the stream's watermark: state of older event
times is dropped, and so are versions that come later than that. Each batch
gives the keys that changed, and an upsert rewrites the partitions of their days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import partitions


def latest_versions(rows: DataFrame, key: str, at: str, version: str, days: int) -> DataFrame:
    """The newest version of each key by event day, as a stream in update mode; of equal versions the largest record.

    ``at`` is the event time, which versions of a key share, or at least its day.
    """
    rest = [c for c in rows.columns if c not in (key, version)]
    newest = F.max(F.struct(version, *rest)).alias("_newest")
    kept = rows.withWatermark(at, f"{days} days").groupBy(key, F.window(at, "1 day")).agg(newest)
    return kept.select(key, "_newest.*")


def keep_latest(spark: SparkSession, path: str, schema: str, key: str, at: str, version: str, days: int, out: str, state: str, files: int = 1) -> None:
    """Read the JSON files that came since the last call, ``files`` a batch, into the table at ``out`` by day.

    ``state`` is the checkpoint, so a file counts once; a batch that is run again
    upserts the same rows again.
    """

    def store(batch: DataFrame, _: int) -> None:
        dated = batch.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
        partitions.upsert(spark, out, dated, [key], "day")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    newest = latest_versions(rows, key, at, version, days)
    newest.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
