"""Keyed tables in partitions, such as years: an upsert reads and rewrites only those that it touches.

The rows of the touched partitions are first put together beside the table.
Then a note says where they are, and only then they replace their partitions. A
run that ends early leaves either no note, and the table as it was, or a note,
which the next call carries out again; so an upsert is never half done, and
files of other partitions are never written.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.stores import exists, remove

_PENDING, _STAGED = "_pending", "_staged"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, of a schema that ends with the partition column; empty if there is none."""
    recover(spark, path)
    return spark.read.schema(schema).parquet(path) if exists(spark, f"{path}/*=*") else spark.createDataFrame([], schema)


def recover(spark: SparkSession, path: str) -> bool:
    """Carry out an upsert that was noted but not ended; whether there was one."""
    if not exists(spark, f"{path}/{_PENDING}/_SUCCESS"):
        return False
    note = spark.read.schema("staged string, by string, schema string, emptied array<string>").json(f"{path}/{_PENDING}").first()
    _replace(spark, path, note.staged, note.by, note.schema, note.emptied)
    return True


def _replace(spark: SparkSession, path: str, staged: str, by: str, schema: str, emptied: list[str]) -> None:
    if exists(spark, f"{staged}/_SUCCESS"):
        rows = spark.read.schema(schema).parquet(staged)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for value in emptied:
        remove(spark, f"{path}/{by}={value}")
    remove(spark, f"{path}/{_PENDING}")
    remove(spark, staged)


def _noted(spark: SparkSession, path: str, staged: str, by: str, schema: str, emptied: list[str]) -> None:
    row = spark.range(1).select(F.lit(staged).alias("staged"), F.lit(by).alias("by"), F.lit(schema).alias("schema"), F.array(*[F.lit(v) for v in emptied]).cast("array<string>").alias("emptied"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/{_PENDING}")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], by: str, keep_old: bool = False) -> None:
    """Rows of ``new`` replace those of the same keys, or with ``keep_old`` are added where the keys are new.

    ``by`` is the partition column, the last one of ``new``, a string without
    nulls. A key whose partition changes leaves its old one, which is rewritten
    too: its place is found by reading keys only. ``new`` has each key once. An
    empty ``new`` changes nothing; a table that isn't there is made.
    """
    recover(spark, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    staged = f"{path}/{_STAGED}/{uuid.uuid4().hex}"
    there = exists(spark, f"{path}/*=*")
    old = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    if keep_old:
        new = new.join(old.select(keys), same(new, old), "left_anti")
    new.write.mode("overwrite").partitionBy(by).parquet(f"{staged}-new")
    new = spark.read.schema(schema).parquet(f"{staged}-new")
    held = old.select(*keys, by)
    touched = new.select(by).union(held.join(new.select(keys), same(held, new), "left_semi").select(by) if not keep_old else held.select(by).limit(0)).distinct()
    values = [r[0] for r in touched.collect()]  # partitions, not rows
    if values:
        before = old.where(F.col(by).isin(values))
        merged = before.join(new.select(keys), same(before, new), "left_anti").select(new.columns).unionByName(new)
        merged.repartition(by, F.pmod(F.xxhash64(*keys), F.lit(8))).write.mode("overwrite").partitionBy(by).parquet(staged)
        emptied = [v for v in values if exists(spark, f"{path}/{by}={v}") and not exists(spark, f"{staged}/{by}={v}")]
        _noted(spark, path, staged, by, schema, emptied)
        _replace(spark, path, staged, by, schema, emptied)
    remove(spark, f"{staged}-new")
