"""Exact positions and quantiles of groups of any size, without a group in one task.

Values are counted first, then dealt to ranges whose bounds are rough quantiles
of all values. Sums of ranges, a few for each group, tell which range holds a
wanted rank; only those ranges are put in order, each on its own. A group that
holds most rows spreads over most ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 200


def _range_of(value: str, bounds: list[float]) -> Column:
    """How many bounds a value reaches, by halving; as one text, which is quicker to build than hundreds of columns."""

    def halve(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN `{value}` < {bounds[middle]!r}D THEN {halve(low, middle)} ELSE {halve(middle + 1, high)} END"

    return F.expr(halve(0, len(bounds)))


def _counted(df: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """``keys, _v, _c, _part``: how often each value of a group occurs, and its range; null values have none."""
    bounds = sorted(set(df.approxQuantile(value, [k / parts for k in range(1, parts)], 1 / parts))) if parts > 1 else []
    bounds = [b for b in bounds if isfinite(b)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return counts.withColumn("_part", _range_of("_v", bounds))


def _ranges(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _part, _before, _s, n``: a row for each range that a group has values in, at most ``parts`` for a group."""
    sums = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    before = F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, "_part", "_s", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("n"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """By keys of which null is one, the left side's columns kept."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    return left.join(named, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], parts: int = PARTS) -> DataFrame:
    """``keys, n`` and the values at given ranks of each group, from 0; ``ranks`` gives a rank from ``n``.

    Nulls don't count; a rank outside the group gives null. Without keys the
    table is one group, of which all is null if it has no values.
    """
    counts = _counted(df, keys, value, parts)
    ranges = _ranges(counts, keys)
    within = lambda low, high: reduce(lambda a, b: a | b, [(r(F.col("n")) >= low) & (r(F.col("n")) < high) for r in ranks.values()])
    needed = ranges.where(within(F.col("_before"), F.col("_before") + F.col("_s")))
    order = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined(counts, needed, [*keys, "_part"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(order))
    at = lambda r: (r(F.col("n")) < F.col("_upto")) & (r(F.col("n")) >= F.col("_upto") - F.col("_c"))
    found = placed.groupBy(*keys).agg(*[F.min(F.when(at(r), F.col("_v"))).alias(name) for name, r in ranks.items()])
    sizes = ranges.groupBy(*keys).agg(F.first("n").alias("n"))
    return joined(sizes, found, keys, "left") if keys else sizes.join(found)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """``keys, n`` and quantiles with linear interpolation between neighbours; null where a group has no values."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    place = lambda q: lambda n: F.lit(q) * (n - 1)
    for name, q in shares.items():
        ranks[f"_{name}_low"] = lambda n, q=q: F.floor(place(q)(n))
        ranks[f"_{name}_high"] = lambda n, q=q: F.ceil(place(q)(n))
    out = at_ranks(df, keys, value, ranks, parts)
    between = lambda name, q: F.col(f"_{name}_low") + (place(q)(F.col("n")) - F.floor(place(q)(F.col("n")))) * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))
    return out.select(*keys, "n", *[between(name, q).alias(name) for name, q in shares.items()])


def with_positions(df: DataFrame, keys: list[str], value: str, below: str = "below", above: str = "above", size: str = "n", parts: int = PARTS) -> DataFrame:
    """Adds how many rows of a row's group are strictly below and above it, and how many have a value; null for null values.

    The group's values are ordered range by range and joined back by value.
    """
    counts = _counted(df, keys, value, parts)
    order = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranges = _ranges(counts, keys).drop("_s")
    upto = F.col("_before") + F.sum("_c").over(order)
    placed = joined(counts, ranges, [*keys, "_part"]).withColumn("_upto", upto)
    found = placed.select(*keys, F.col("_v").alias(value), (F.col("_upto") - F.col("_c")).alias(below), (F.col("n") - F.col("_upto")).alias(above), F.col("n").alias(size))
    return joined(df, found, [*keys, value], "left")


def share_below(below: Column, size: Column) -> Column:
    """Per cent of a group below, rounded half-even."""
    return F.bround(100.0 * below / size, 0).cast("int")
