"""Daily files as a stream: records whose key is new are appended, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import partitions

#: The partition of records without a day.
UNKNOWN = "unknown"


def append_once(spark: SparkSession, path: str, schema: str, key: str, by: str, out: str, state: str) -> None:
    """Read the files that came since the last call and add records with new keys to the table at ``out``, by day.

    ``by`` is the last column of the schema, the day. ``state`` is the
    checkpoint, so a file counts once. Of records that repeat a key within a
    batch the first one by file and line stays; of keys that the table has, the
    old record does, wherever it is: keys alone are read to know. Only days with
    new records are rewritten, and a batch that is run again adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "_file", "_line")]
        first = batch.withColumn("_line", F.monotonically_increasing_id()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_file", "_line")).alias("_r"))
        new = first.select(key, *[F.col("_r")[c].alias(c) for c in rest if c != by], F.coalesce(F.col("_r")[by], F.lit(UNKNOWN)).alias(by))
        partitions.upsert(spark, out, new, [key], by, keep_old=True)

    rows = spark.readStream.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    rows.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
