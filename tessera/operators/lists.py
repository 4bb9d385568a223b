"""Lists of a parent's children in blocks: a parent with many children has many rows, none of which is large.

Children are dealt by ranges of parent and order, so a parent's children lie in
as many ranges as they fill; within a range they are cut after ``SIZE``. Blocks of
a parent are numbered in order, with gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 1_000
_SUB_BITS = 31


def blocks(children: DataFrame, keys: list[str], order: list[str], value: Column, name: str, size: int = SIZE) -> DataFrame:
    """``keys, block, name``: values of each parent in order, at most ``size`` in a row; null values stay, ties are in any order."""
    rows = children.select(*keys, F.struct(*order, value.alias("_v")).alias("_x")).repartitionByRange(*keys, *[F.col("_x")[c] for c in order])
    parted = rows.withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*[F.col("_x")[c].asc_nulls_first() for c in order]))
    cut = parted.withColumn("_place", place).withColumn("_sub", F.floor((F.col("_place") - 1) / size))
    listed = F.array_sort(F.collect_list(F.struct("_place", F.col("_x")["_v"].alias("v"))))
    held = cut.groupBy(*keys, "_part", "_sub").agg(F.transform(listed, lambda x: x["v"]).alias(name))
    return held.select(*keys, (F.shiftleft(F.col("_part").cast("long"), _SUB_BITS) + F.col("_sub")).alias("block"), name)


def rows_of(blocked: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """``keys, block, at, value``: one row a child, in order of block and place in it."""
    return blocked.select(*keys, "block", F.posexplode(name).alias("at", value))


def joined_to(parents: DataFrame, blocked: DataFrame, key: str, name: str) -> DataFrame:
    """Each parent with its blocks; one without children has one empty block."""
    empty = F.array().cast(blocked.schema[name].dataType)
    return parents.join(blocked, key, "left").withColumns({name: F.coalesce(name, empty), "block": F.coalesce("block", F.lit(0).cast("long"))})


def whole(blocked: DataFrame, keys: list[str], name: str, *others: str) -> DataFrame:
    """One row a parent with its whole list, and columns that its blocks share: for parents whose lists are known to be short."""
    lists = F.array_sort(F.collect_list(F.struct("block", name)))
    return blocked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in others], F.flatten(F.transform(lists, lambda x: x[name])).alias(name))
