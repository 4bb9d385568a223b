"""Facets: filters over several dimensions, counts under them, and columns derived for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.mappings import bill_status_facet, clean_group
from tessera.functions.text import contains_any


def facet_filter(df: DataFrame, any_of: dict[str, list] | None = None, all_of: dict[str, list] | None = None, search: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows that satisfy every dimension.

    Of ``any_of``, a plain column must be one of the values, an array must hold
    one; of ``all_of``, an array must hold them all. ``search`` is a text that
    one of the columns contains, whatever the case. Dimensions without values
    don't filter.
    """
    for name, values in (any_of or {}).items():
        if values:
            array = df.schema[name].dataType.typeName() == "array"
            df = df.where(F.arrays_overlap(name, F.array(*map(F.lit, values))) if array else F.col(name).isin(*values))
    for name, values in (all_of or {}).items():
        if values:
            df = df.where(F.size(F.array_except(F.array(*map(F.lit, values)), F.col(name))) == 0)
    if search and search[1]:
        df = df.where(contains_any([F.col(c) for c in search[0]], search[1]))
    return df


def _labelled(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("dim"), v.alias("value")))


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``dim, value, n``: how many rows have each value of each dimension, in one pass; of an array, each value once."""
    pairs = []
    for name in columns:
        array = df.schema[name].dataType.typeName() == "array"
        values = F.array_distinct(F.transform(name, lambda x: x.cast("string"))) if array else F.array(F.col(name).cast("string"))
        pairs.append(_labelled(name, values))
    every = df.select(F.explode(F.concat(*[F.coalesce(p, F.array().cast("array<struct<dim:string,value:string>>")) for p in pairs])).alias("f"))
    return every.where("f.value is not null").groupBy(F.col("f.dim").alias("dim"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def keep_children(df: DataFrame, children: str, kind: str, wanted: list[str]) -> DataFrame:
    """Children of wanted kinds only; a parent left with none stays, with an empty list."""
    return df.withColumn(children, F.filter(children, lambda x: x[kind].isin(*wanted)))


def passed_by_votes(for_: Column, against: Column) -> Column:
    """Passed: more votes for than against."""
    return F.coalesce(for_, F.lit(0)) > F.coalesce(against, F.lit(0))


def passed_by_presence(for_: Column, present: Column) -> Column:
    """Passed: more votes for than half of those present."""
    return F.coalesce(for_, F.lit(0)) > F.coalesce(present, F.lit(0)) / 2


def any_positive(*values: Column) -> Column:
    """Whether one of the numbers is above zero; null counts as zero."""
    out = F.lit(False)
    for v in values:
        out = out | (F.coalesce(v, F.lit(0)) > 0)
    return out


def only_from(count: Column, least: int, value: Column) -> Column:
    """A value that is shown from a number of records on."""
    return F.when(count >= least, value)


def gain_and_loss(change: Column) -> tuple[Column, Column]:
    """A change as two columns, of which one is null."""
    return F.when(change > 0, change), F.when(change < 0, -change)


def top_share(pct_from_bottom: Column) -> Column:
    """``top x%`` of a percentile, at least 1."""
    return F.concat(F.lit("top "), F.greatest(F.lit(1), 100 - pct_from_bottom).cast("string"), F.lit("%"))


def thousands(value: Column) -> Column:
    """A number in short: 1.2M, 3.4k, or as it is."""
    size = F.abs(value)
    short = lambda by, mark: F.concat(F.bround(value / by, 1).cast("string"), F.lit(mark))
    return F.when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "k")).otherwise(F.bround(value, 0).cast("long").cast("string"))


def first_date_event(*dated: tuple[str, Column]) -> Column:
    """``label, at`` of the first date that isn't null, by priority."""
    label = F.lit(None).cast("string")
    for name, day in reversed(dated):
        label = F.when(day.isNotNull(), name).otherwise(label)
    return F.struct(label.alias("label"), F.coalesce(*[day for _, day in dated]).alias("at"))


#: Sets of item types by the name that pages give them.
TYPE_SETS = {
    "bills": ["proiect_lege", "propunere_legislativa", "reexaminare"],
    "hotarari": ["proiect_hotarare"],
    "motions": ["motiune_simpla", "motiune_cenzura", "angajare_raspundere"],
    "procedural": [
        "informare", "informare_casete", "prezentare", "alocutiuni", "alocutiune", "interventie", "moment_reculegere", "mesaj", "declaratie", "dezbateri_politice",
        "dezbateri", "alegere", "numire", "constituire", "vacantare", "solicitare", "sedinta_solemna", "vot", "raport",
    ],
}


def in_set(kind: Column, name: str) -> Column:
    """Whether a type belongs to a named set; null belongs to none, and every type to ``all``."""
    return F.lit(True) if name == "all" else F.coalesce(kind.isin(*TYPE_SETS[name]), F.lit(False))


def shown_value(df: DataFrame, name: str) -> Column:
    """A value as boards show it: with two decimals, half-even, if it is a floating number, else as it is."""
    return F.bround(name, 2) if df.schema[name].dataType.typeName() in ("double", "float") else F.col(name)


def _year(day: Column, missing: str) -> Column:
    return F.coalesce(F.nullif(F.substring(day.cast("string"), 1, 4), F.lit("")), F.lit(missing))


def bill_facets(law: Column, stage: Column, day: Column, initiator: Column, urgent: Column) -> Column:
    """``kind, year, status, initiator, procedure`` under which the search finds a bill."""
    return F.struct(F.lit("proiect").alias("kind"), _year(day, "?").alias("year"), bill_status_facet(law, stage).alias("status"), F.coalesce(F.nullif(initiator, F.lit("")), F.lit("necunoscut")).alias("initiator"), F.when(urgent, "urgenta").otherwise("ordinara").alias("procedure"))


def question_facets(day: Column, group: Column, answered: Column) -> Column:
    """``kind, year, group, answer`` under which the search finds a question."""
    return F.struct(F.lit("interpelare").alias("kind"), _year(day, "necunoscut").alias("year"), clean_group(group).alias("group"), F.when(answered, "primit").otherwise("nu").alias("answer"))


def motion_facets(kind: Column, outcome: Column, day: Column) -> Column:
    """``kind, type, outcome, year`` under which the search finds a motion."""
    return F.struct(F.lit("motiune").alias("kind"), kind.alias("type"), outcome.alias("outcome"), _year(day, "necunoscut").alias("year"))
