"""Grouped rates, trends, distributions and quantiles, parameterised by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import lists
from tessera.operators.selection import at_ranks, joined, quantiles


def safe_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole``, half-even; 0 when the whole is 0."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def rate_by_group(df: DataFrame, group: Column, hit: Column, at_least: int = 1, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``grp, total, hits, rate`` of the groups with ``at_least`` rows; sentinel groups are left out."""
    rows = df.select(group.alias("grp"), hit.alias("hit"))
    if exclude:
        rows = rows.where(~F.col("grp").isin(*exclude))
    out = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"))
    return out.where(F.col("total") >= at_least).withColumn("rate", safe_pct(F.col("hits"), F.col("total")))


def value_distribution(df: DataFrame, value: Column, missing: str = "unknown") -> DataFrame:
    """``value, n``: how often each value occurs; null has a label of its own."""
    return df.groupBy(F.coalesce(value.cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def monthly_trend(df: DataFrame, day: Column, hit: Column) -> DataFrame:
    """``month, total, hits``; months without rows do not appear, rows without a date do not count."""
    return df.where(day.isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits"))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The middle value of each group, of an even number the upper one: an exact order statistic, not interpolated."""
    return at_ranks(df, keys, value, {name: lambda n: F.floor(n / 2)})


def floor_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], least: int = 5) -> DataFrame:
    """The values at floor(n * share) in order; null in groups with fewer than ``least`` values."""
    out = at_ranks(df, keys, value, {name: lambda n, q=q: F.floor(n * q) for name, q in shares.items()})
    return out.withColumns({name: F.when(F.col("n") >= least, F.col(name)) for name in shares})


def cohesion(df: DataFrame, group: Column, option: Column, counted: tuple[str, ...]) -> DataFrame:
    """Share of the most frequent counted option by group, of all counted ones; ``total`` counts every row."""
    each = [F.count_if(option == o) for o in counted]
    out = df.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("total"), F.greatest(*each).alias("most"), sum(each[1:], each[0]).alias("counted"))
    return out.select("grp", "total", F.when(F.col("counted") > 0, F.floor(100.0 * F.col("most") / F.col("counted") + 0.5)).otherwise(0).cast("long").alias("rate"))


def snapshot_delta(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """First and last value of each entity, and the change; no change with a single row."""
    key = F.struct(*order)
    out = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"))
    return out.withColumn("delta", F.when(F.col("n") > 1, F.bround(F.col("last_value") - F.col("first_value"), 2)))


def share_or_null(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole``, half-even; null when the whole is 0."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def first_present(value: Column, order: Column) -> Column:
    """The first value that isn't null, in the given order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def modal_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, modal, total``: the most frequent value of each key, of equally frequent ones the one met first; nulls don't count as values."""
    pairs = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("_n", -F.col("_first"))))
    return pairs.groupBy(key).agg(best.alias("modal"), F.sum("_n").alias("total"))


#: How a name may end with a party, and the group of those who have none.
NAMED_PARTY, UNAFFILIATED = r"-\s*(?:deputat|senator)\s+([A-ZĂÎȘȚŞŢ]{2,})", "Neafiliat"


def top_actors(df: DataFrame, key: str, name: str, party: str, order: str, n: int) -> DataFrame:
    """``key, name, party, total`` of the ``n`` keys with most rows, ties by key; rows without a key or name don't count.

    The name is the first one; the party is the most frequent one apart from the
    unaffiliated, of equally frequent ones the one met first, else the one that
    the name ends with, else the unaffiliated.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(name) != "")).withColumn("_p", F.when(F.col(party) != UNAFFILIATED, F.col(party)))
    modal = modal_value(rows, key, "_p", order)
    first = rows.groupBy(key).agg(F.min_by(name, order).alias("name"))
    in_name = F.nullif(F.regexp_extract("name", NAMED_PARTY, 1), F.lit(""))
    out = modal.join(first, key).select(key, "name", F.coalesce("modal", in_name, F.lit(UNAFFILIATED)).alias("party"), "total")
    return out.orderBy(F.desc("total"), key).limit(n)


def group_stats(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], **others: Column) -> DataFrame:
    """``keys, n``, exact quantiles of a value and other aggregates; ``n`` counts all rows, quantiles those with a value.

    Quantiles come from ranges of values, so a group of any size is in no task as a whole.
    """
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in others.items()])
    found = quantiles(df, keys, value, shares).drop("n")
    return joined(rows, found, keys, "left") if keys else rows.join(found, how="left")


def two_groups(df: DataFrame, group: Column, wanted: tuple[str, str], size: Column) -> DataFrame:
    """``grp, n, items, several`` of two groups: rows, their list sizes in sum, and rows with more than one item."""
    rows = df.select(group.alias("grp"), F.coalesce(size, F.lit(0)).alias("size")).where(F.col("grp").isin(*wanted))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items"), F.count_if(F.col("size") > 1).alias("several"))


def roster(df: DataFrame, group: str, name: str, role: str, order: str, chair: str = "president", size: int = lists.SIZE) -> DataFrame:
    """``group, block, chair, members``: the last chair by order, and the names of all others in order, a row for each block.

    A name that a group lists again counts once, where it stands first. A group
    of chairs only has an empty block.
    """
    once = df.groupBy(group, name).agg(F.min_by(role, order).alias(role), F.min(order).alias(order))
    leads = F.coalesce(F.col(role) == chair, F.lit(False))
    chairs = once.groupBy(group).agg(F.max_by(name, F.when(leads, F.col(order))).alias("chair"))
    members = lists.blocks(once.where(~leads), [group], [order], F.col(name), "members", size)
    return lists.joined_to(chairs, members, group, "members")
