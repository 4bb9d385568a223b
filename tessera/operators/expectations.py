"""What a table should be like, as rules; all rules of a table are figured out in two passes, one of them over keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Filled:
    """At least a share of rows have the field: neither null nor empty text, empty list or 0."""

    field: str
    least: float
    severity: str = ERROR
    empty: Column | None = None

    def name(self) -> str:
        return f"filled:{self.field}"

    def figure(self, df: DataFrame) -> Column:
        kind = df.schema[self.field].dataType.typeName()
        c = F.col(self.field)
        blank = {"string": c == "", "array": F.size(c) == 0}.get(kind, c == 0 if kind in ("integer", "long", "double", "float", "short") or kind.startswith("decimal") else F.lit(False))
        return F.coalesce(F.count_if(c.isNotNull() & ~blank) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))

    def verdict(self, figure: Column) -> Column:
        return figure >= self.least


@dataclass(frozen=True)
class Known:
    """Values of the field, where there are any, start with one of some prefixes; the figure counts rows that don't."""

    field: str
    prefixes: tuple[str, ...]
    severity: str = WARNING

    def name(self) -> str:
        return f"known:{self.field}"

    def figure(self, df: DataFrame) -> Column:
        c = F.col(self.field)
        known = F.lit(False)
        for p in self.prefixes:
            known = known | c.startswith(p)
        return F.count_if((c != "") & ~known).cast("double")

    def verdict(self, figure: Column) -> Column:
        return figure == 0


@dataclass(frozen=True)
class Between:
    """Values of the field lie in a range; null ones don't count. Of ``None`` the number of rows lies in it."""

    field: str | None
    low: float
    high: float
    severity: str = ERROR

    def name(self) -> str:
        return f"between:{self.field or 'rows'}"

    def figure(self, df: DataFrame) -> Column:
        if self.field is None:
            return F.count(F.lit(1)).cast("double")
        return F.count_if(~F.col(self.field).between(self.low, self.high)).cast("double")

    def verdict(self, figure: Column) -> Column:
        return figure.between(self.low, self.high) if self.field is None else figure == 0


@dataclass(frozen=True)
class Stated:
    """There are as many rows as the table's envelope states; the figure is the difference."""

    count: int | None
    severity: str = ERROR

    def name(self) -> str:
        return "stated:rows"

    def figure(self, df: DataFrame) -> Column:
        return (F.count(F.lit(1)) - F.lit(self.count).cast("long")).cast("double")

    def verdict(self, figure: Column) -> Column:
        return F.coalesce(figure == 0, F.lit(False))


@dataclass(frozen=True)
class Unique:
    """No two rows share a key of some fields; with ``whole`` keys with a null or empty part don't count. The figure counts keys that repeat."""

    fields: tuple[str, ...]
    whole: bool = False
    severity: str = ERROR

    def name(self) -> str:
        return f"unique:{'+'.join(self.fields)}"


Rule = Filled | Known | Between | Stated | Unique


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule, severity, figure, ok`` for each rule; an empty table has all fields filled and no repeated keys.

    Rules over rows are one aggregate. Keys of all rules that need them are
    dealt out together, by rule and digest of the key, and counted in one shuffle.
    """
    over_rows, over_keys = [r for r in rules if not isinstance(r, Unique)], [r for r in rules if isinstance(r, Unique)]
    parts = []
    row = lambda r, figure: F.struct(F.lit(r.name()).alias("rule"), F.lit(r.severity).alias("severity"), figure.alias("figure"), r.verdict(figure).alias("ok"))
    if over_rows:
        figures = df.agg(*[r.figure(df).cast("double").alias(f"f{k}") for k, r in enumerate(over_rows)])
        parts.append(figures.select(F.inline(F.array(*[row(r, F.col(f"f{k}")) for k, r in enumerate(over_rows)]))))
    if over_keys:
        def key(k: int, r: Unique) -> Column:
            values = [F.col(f).cast("string") for f in r.fields]
            missing = F.lit(False)
            for v in values:
                missing = missing | F.coalesce(v == "", F.lit(True))
            digest = F.sha2(F.to_json(F.array(*values), {"ignoreNullFields": "false"}), 256)
            return F.when(~missing if r.whole else F.lit(True), F.struct(F.lit(k).alias("k"), digest.alias("key")))

        keyed = df.select(F.explode(F.array_compact(F.array(*[key(k, r) for k, r in enumerate(over_keys)]))).alias("x")).select("x.*")
        repeated = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counts = repeated.agg(*[F.count_if(F.col("k") == k).cast("double").alias(f"f{k}") for k in range(len(over_keys))])
        shown = [F.struct(F.lit(r.name()).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"f{k}").alias("figure"), (F.col(f"f{k}") == 0).alias("ok")) for k, r in enumerate(over_keys)]
        parts.append(counts.select(F.inline(F.array(*shown))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
