"""Lookups, first matches and merges of keyed collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import lists


def lookup(df: DataFrame, side: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join on ``key``; missing values of the side get their default."""
    out = df.join(side, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def first_match(df: DataFrame, side: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join to the first row of each key on the side, by ascending columns, nulls first."""
    rest = [c for c in side.columns if c != key]
    first = side.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return df.join(first.select(key, *[F.col("_first")[c].alias(c) for c in rest]), key, "left")


def either_key(df: DataFrame, keys: list[str], side: DataFrame, side_key: str, row: list[str]) -> DataFrame:
    """Match by any of several keys, each row its smallest hit: an equi-join on the distinct keys, not an OR.

    ``row`` names the columns that tell rows apart; rows alike in them are one.
    """
    exploded = df.select(*row, F.explode(F.array_distinct(F.array(*keys))).alias(side_key))
    found = exploded.join(side, side_key)
    rest = [c for c in side.columns if c != side_key]
    best = found.groupBy(*row).agg(F.min(F.struct(side_key, *rest)).alias("_hit"))
    return best.select(*row, *[F.col("_hit")[c].alias(c) for c in (side_key, *rest)])


def flagged(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """All rows, each with whether its key is among ``keys``: semi-join and anti-join in one pass."""
    known = keys.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def coalesced_key(first: Column, second: Column, pattern: str) -> Column:
    """A key from the first text; from the second only if the first holds none."""
    key = lambda c: F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
    return F.coalesce(key(first), key(second))


def map_by_key(df: DataFrame, texts: list[str], pattern: str, row: list[str], side: DataFrame, side_text: str, order: list[str], hot: int = 1_000_000) -> DataFrame:
    """Rows with the first hit of their key on the side, under ``hit``; rows without a key or hit stay, with null.

    A key is what the pattern finds in the first text that holds one, even if
    the side lacks it and would have that of a later text. The side's first row
    of a key, by ``order``, is its hit. Keys of more than ``hot`` rows, which are
    few, are split: their rows by a digest of the columns ``row``, their hit copied.
    """
    found = lambda c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    keyed = df.withColumn("_key", F.coalesce(*[found(c) for c in texts]))
    rest = F.struct(*side.columns)
    hits = side.withColumn("_key", found(side_text)).where("_key is not null").groupBy("_key").agg(F.min_by(rest, F.struct(*order)).alias("hit"))
    many = keyed.where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("_key", F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    left = keyed.join(F.broadcast(many), "_key", "left").withColumn("_salt", F.pmod(F.xxhash64(*row), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = hits.join(F.broadcast(many), "_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, ["_key", "_salt"], "left").withColumnRenamed("_key", "key").drop("_salt")


def attach_children(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str], name: str, size: int = lists.SIZE) -> DataFrame:
    """Each parent with its children in order, a row for each block of them; one without any has an empty list."""
    return lists.joined_to(parents, nest(children, key, order, columns, name, size), key, name)


def prepend_new(old: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """Only new keys are added, before the old rows: their positions are negative, in the order they come in."""
    fresh = new.join(old.select(key), key, "left_anti")
    count = F.broadcast(fresh.agg(F.count(F.lit(1)).alias("_n")))
    return fresh.crossJoin(count).withColumn(position, F.col(position) - F.col("_n")).drop("_n").unionByName(old)


def date_index(sessions: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``day`` and the session it belongs to: the first that starts then, else the first that ends then."""
    days = sessions.select(F.posexplode(F.array(start, end)).alias("_which", "day"), name).where("day is not null")
    return days.groupBy("day").agg(F.min_by(name, F.struct("_which", name)).alias(name))


def merge_repeated(df: DataFrame, key: str, order: str, header: list[str], children: str, size: int = lists.SIZE) -> DataFrame:
    """Rows of one key as one: the first one's header, and the children of all in order, a row for each block of rows."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*header), order).alias("_head"))
    held = lists.blocks(df, [key], [order], F.col(children), children, size).withColumn(children, F.flatten(children))
    return held.join(first, key).select(key, "block", *[F.col("_head")[c].alias(c) for c in header], children)


def full_outer(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both by key; where the right has the key its values win, null ones too."""
    r = right.select(F.col(key), F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = left.join(r, key, "full")
    return out.select(key, *[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Only new keys are added."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def range_label(value: Column, bounds: list[tuple[str, str]], below: str) -> Column:
    """The label of the highest bound that the value reaches; bounds are ISO dates."""
    out = F.lit(below)
    for start, label in sorted(bounds):
        out = F.when(value >= F.lit(start).cast("date"), label).otherwise(out)
    return out


def nest(children: DataFrame, key: str, order: str, columns: list[str], name: str, size: int = lists.SIZE) -> DataFrame:
    """``key, block, name``: children in order, at most ``size`` in a row."""
    return lists.blocks(children, [key], [order], F.struct(order, *columns), name, size)


def unnest(parents: DataFrame, key: str, name: str) -> DataFrame:
    """One row per child; a parent without children has none."""
    return parents.select(key, F.explode(name).alias("_c")).select(key, "_c.*")


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
