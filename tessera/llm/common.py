"""Helpers shared by the training-data operators: inputs, scratch tables, batches."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master whose session names no shared folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/tessera-scratch"

#: Tables of at most so many bytes, as written, are broadcast to a join.
SMALL = 1 << 20
#: Bits of a table of marks: at most so many (16 MB), and of one of its rows.
MARKS, CHUNK = 1 << 27, 1 << 16
#: Bytes of one Arrow batch: texts may be long, and two workers share an executor.
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(df: DataFrame) -> DataFrame:
    """The same rows; from now on their session sends Arrow batches of bounded bytes, whatever a row holds."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; deleted when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or LOCAL_SCRATCH).rstrip('/')}/tessera/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table outlives any executor. It stays until ``discard`` or the end of
    the driver, since results that read it are evaluated later.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended: then the folder is the cluster's to clean
        return


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more, so its space is free for the next."""
    path = _paths.pop(df, None)
    if path:
        _delete(df.sparkSession, path)


def _delete_all() -> None:
    while _written:
        _delete(*_written.pop())


atexit.register(_delete_all)


def written_bytes(df: DataFrame) -> int:
    """Size on disk of a table of ``materialize``."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(_paths[df])
    return where.getFileSystem(conf).getContentSummary(where).getLength()


def small(df: DataFrame) -> DataFrame:
    """A table of ``materialize``, broadcast to its joins if it is small as written."""
    return F.broadcast(df) if written_bytes(df) <= SMALL else df


class Marks:
    """A bit for the hash of each row of a table, 16 bits a row: tells rows of another table that can't be in it without a shuffle of theirs.

    ``rows`` should be a table of ``materialize`` or cheap to read again. A row
    in the table always has its bit; one that isn't has another's in one of 16
    cases, more often where ``MARKS`` bounds the bits. Nulls are hashed as values.
    """

    def __init__(self, rows: DataFrame, *columns: Column | str):
        self.bits = min(MARKS, max(CHUNK, power_of_two(16 * rows.count())))
        at = self._at(columns)
        set_bits = rows.select(F.shiftright(at, 6).alias("word"), (at.bitwiseAND(F.lit(63))).cast("int").alias("bit")).select("word", F.expr("shiftleft(1L, bit)").alias("bits"))
        every = rows.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = set_bits.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        listed = F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"]
        self.table = materialize(words.groupBy(F.shiftright("word", 10).alias("chunk")).agg(listed.alias("words")), "marks")

    def _at(self, columns: tuple[Column | str, ...]) -> Column:
        return F.xxhash64(*columns).bitwiseAND(F.lit(self.bits - 1))

    def _joined(self, df: DataFrame, columns: tuple[Column | str, ...], how: str) -> DataFrame:
        at = self._at(columns)
        word = F.get(self.table["words"], F.shiftright(at, 6).bitwiseAND(F.lit(CHUNK // 64 - 1)).cast("int"))
        held = (F.shiftright(at, 16) == self.table["chunk"]) & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return df.join(F.broadcast(self.table), held, how)

    def maybe(self, df: DataFrame, *columns: Column) -> DataFrame:
        """Rows that may be in the table, all that are among them; ``columns`` of ``df`` are compared with those given at first."""
        return self._joined(df, columns, "left_semi")

    def surely_not(self, df: DataFrame, *columns: Column) -> DataFrame:
        """The other rows."""
        return self._joined(df, columns, "left_anti")

    def discard(self) -> None:
        discard(self.table)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A text column as strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n``."""
    return 1 << max(0, int(n - 1).bit_length())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
