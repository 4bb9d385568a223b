import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import aggregates, joins, selection


def test_medians_and_quantiles(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", v) for v in (7, 7, 7, 9, 9, None)] + [("c", None)], "g string, v int")
    assert {r.g: r.m for r in aggregates.upper_median(rows, ["g"], "v", "m").collect()} == {"a": 3, "b": 7}
    assert {r.g: r.q for r in aggregates.floor_quantiles(rows, ["g"], "v", {"q": 0.75}).collect()} == {"a": None, "b": 9}
    assert selection.quantiles(rows.where("g = 'a'"), [], "v", {"l": 0.25}).first().l == 1.75


def test_cohesion(spark):
    rows = spark.createDataFrame([("A", "yes")] * 3 + [("A", "no")] + [("A", "absent")] * 2 + [("B", "absent")], "p string, o string")
    out = {r.grp: (r.total, r.rate) for r in aggregates.cohesion(rows, F.col("p"), F.col("o"), ("yes", "no", "abstain")).collect()}
    assert out == {"A": (6, 75), "B": (1, 0)}


def test_snapshot_delta(spark):
    rows = spark.createDataFrame([(1, 1, 10.0), (1, 2, 25.0), (2, 1, 7.0)], "e int, o int, v double")
    out = {r.e: (r.n, r.delta) for r in aggregates.snapshot_delta(rows, "e", ["o"], "v").collect()}
    assert out == {1: (2, 15.0), 2: (1, None)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in joins.upsert(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {tuple(r) for r in joins.append_new(old, new, "k").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in joins.full_outer(old, new, "k", ["v"]).collect()} == {(1, "a"), (2, None), (3, "c")}
    assert joins.same_rows(old, old.orderBy("v")) and not joins.same_rows(old, new)


def test_text(spark):
    one = spark.createDataFrame([("Ștefan  Țuțea", "1.234,56", "3/4", "31.02.2024", "5.3.2024")], "n string, a string, f string, d string, e string")
    out = one.select(text.name_key(F.col("n")).alias("n"), text.slug(F.col("n")).alias("s"), text.amount(F.col("a")).alias("a"), text.fraction(F.col("f")).alias("f"), dates.day_first_date(F.col("d")).alias("d"), dates.day_first_date(F.col("e")).alias("e")).first()
    assert (out.n, out.s, out.a, out.f, out.d, out.e) == ("stefan tutea", "stefan-tutea", 1234.56, 0.75, None, dt.date(2024, 3, 5))


def test_amounts(spark):
    cases = {"60.294": 60294.0, "1,5": 1.5, "1,500": 1500.0, "2.5": 2.5, "1,234.5": 1234.5, "x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.v for r in rows.select("a", text.amount(F.col("a")).alias("v")).collect()} == cases


def test_cohort_and_ngrams(spark):
    out = spark.sql("SELECT DATE '1974-01-01' AS a, DATE '1979-12-31' AS b, array('x') AS w, array('x', 'y', 'z') AS v").select(text.age_cohort(F.col("a"), 2024).alias("a"), text.age_cohort(F.col("b"), 2024).alias("b"), text.ngrams(F.col("w"), 2).alias("w"), text.ngrams(F.col("v"), 2).alias("v")).first()
    assert (out.a, out.b, out.w, out.v) == ("50–54", "45–49", [], ["x y", "y z"])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert entry.entry(spark).count() == 5
