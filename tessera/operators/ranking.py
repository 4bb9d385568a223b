"""Percentiles, leaderboards and positions, with explicit tie-breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.selection import share_below, with_positions


def context(df: DataFrame, value: str, groups: dict[str, list[str]]) -> DataFrame:
    """Adds ``pct, rank, n`` of a value in each of some groupings, named before: per cent strictly below, place from the top, size.

    ``groups`` maps a name to the columns of its group. Equal values share a
    place; null values and rows whose group column is null have none.
    """
    for name, keys in groups.items():
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
        asked = f"_{name}_value"
        df = with_positions(df.withColumn(asked, F.when(known, F.col(value))), keys, asked, "_below", "_above", f"{name}_n")
        df = df.withColumns({f"{name}_pct": share_below(F.col("_below"), F.col(f"{name}_n")), f"{name}_rank": (F.col("_above") + 1)}).drop("_below", "_above", asked)
    return df


def leaderboard(df: DataFrame, value: str, tie: str, n: int = 15, descending: bool = True, where: Column | None = None) -> DataFrame:
    """The first ``n`` rows by value, ties by key; nulls never lead."""
    rows = df.where(F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & where)
    return rows.orderBy(F.col(value).desc() if descending else F.col(value).asc(), tie).limit(n)


def top_n_per_type(df: DataFrame, kind: str, order: list[Column], n: int, cap: int) -> DataFrame:
    """The first ``n`` rows of each kind, then the first ``cap`` of all of them."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    return ranked.where(F.col("rn") <= n).orderBy(*order).limit(cap)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with row numbers; reads no more than it skips and shows."""
    ordered = df.orderBy(*order).limit(number * size)
    return ordered.withColumn("rn", F.row_number().over(Window.orderBy(*order))).where(F.col("rn") > (number - 1) * size)


def below_all(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds how many rows of the whole table have a strictly smaller value, and ``total``; null values have none."""
    return with_positions(df, [], value, name, "_above", "total").drop("_above")


def first_of_step(df: DataFrame, group: str, step: str, value: str, key: str, name: str) -> DataFrame:
    """Adds whether a row, from the highest value of its group down, is the first of a step below the one before it.

    ``step`` falls with the value, ties go by key. Steps of a group are few, so
    each is reduced to its first row, and no group is put in order.
    """
    first = df.groupBy(group, step).agg(F.max_by(key, F.struct(value, -F.col(key))).alias("_first"))
    below = first.withColumn("_top", F.max(step).over(Window.partitionBy(group))).where(F.col(step) < F.col("_top"))
    return df.join(below.select(group, F.col("_first").alias(key), F.lit(True).alias(name)), [group, key], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def neighbours(df: DataFrame, order: list[Column], selected: Column, reach: int = 5) -> DataFrame:
    """The rows around the selected one in an order, ``reach`` on either side, with their ``offset``.

    Meant for short lists, such as the days of sessions: all rows are put in one order.
    """
    numbered = df.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    centre = F.broadcast(numbered.where(selected).agg(F.min("_rn").alias("_at")))
    return numbered.crossJoin(centre).withColumn("offset", F.col("_rn") - F.col("_at")).where(F.abs("offset") <= reach).drop("_rn", "_at")


def ordered(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, with their place."""
    return page(df, order, 1, n)


def by_number(name: str, descending: bool = True) -> Column:
    """Order by a number; nulls are last in both directions."""
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def null_as(name: str, value: float) -> Column:
    """Descending order in which null counts as a value."""
    return F.coalesce(F.col(name), F.lit(value)).desc()


def listed_order(name: str, values: list[str]) -> Column:
    """Order in which values are listed; others follow."""
    out = F.lit(len(values))
    for k, v in reversed(list(enumerate(values))):
        out = F.when(F.col(name) == v, k).otherwise(out)
    return out.asc()


def romanian(name: str) -> Column:
    """Alphabetical order of Romanian, whatever the case."""
    return F.collate(F.col(name), "ro_CI").asc_nulls_last()


def view(df: DataFrame, metric: str, tie: str, n: int, descending: bool = True, per: str | None = None, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows as a page shows them: active groups, a metric (per head with ``per``), its direction; ``metric`` and place ``rn``.

    The parameters are the page's state. Rows without the metric come last.
    """
    for column, wanted in (groups or {}).items():
        df = df.where(F.col(column).isin(*wanted))
    shown = F.col(metric) if per is None else F.when(F.col(per) > 0, F.bround(F.col(metric) / F.col(per), 3))
    return ordered(df.withColumn("metric", shown), [by_number("metric", descending), F.col(tie).asc()], n)
