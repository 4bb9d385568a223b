"""Queries on small tables of odd values, compared with their SQL."""

import datetime as dt
import uuid

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tessera.plans import files
from tessera.plans.base import spread
from tessera.sources import documents, html, writers


def differing(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over tables (lists of dicts, with a schema) that only one of them has."""
    con, folder = duckdb.connect(), f"{tmp_path}/{uuid.uuid4().hex}"
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = entry_points.queries()[name](spark, f"file://{folder}")
    con.execute(f"CREATE TABLE expected AS SELECT {', '.join(found.columns)} FROM ({entry_points.oracle_sql()[name]})")
    expected = con.execute("SELECT * FROM expected").fetchall()
    return sorted(map(repr, {tuple(r) for r in found.collect()} ^ set(expected))), len(expected)


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def orders(*prices, first=4, step=5, customers=1):
    """Orders from a key on, dealt to customers."""
    return ORDERS, [(first + step * i, 100 + i % customers, "F", float(p), dt.datetime(1996, 5, 1 + i % 28), f"{i % 5 + 1}-X") for i, p in enumerate(prices)]


def test_contracts_of_nothing(spark, tmp_path):
    for name in ("contract_rows", "interest_records"):
        assert differing(spark, tmp_path, name, orders=orders(3000.4, 1200, 0, 77)) == ([], 1)


def test_cut_references_stay(spark, tmp_path):
    head = '<html><head><title>{}</title></head><body><ul><li><a href="/a?b=1&amp;c=2">x</a></li></ul></body></html>'
    titles = ["a &amp;&amp;&amp b", "A &lt;b&gt; &quot;c&quot; &am", "x&amp", "&amp;lt; &copy; &amp"]
    rows = [(i, "https://x.org", head.format(x)) for i, x in enumerate(titles)]
    assert differing(spark, tmp_path, "page_links", pages=("page_id long, url string, html string", rows)) == ([], 4)


def test_rows_are_dealt_to_all_cores(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i % 7}") for i in range(200)], "k long, name string").coalesce(1)
    assert spread(rows, "k").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_files_of_many_entities(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "s_suppkey long, s_name string").coalesce(1)
    writers.write_rows(rows.withColumn("entity", F.col("s_suppkey")), f"file://{tmp_path}/e", by="entity")
    names = spark.read.schema("s_suppkey long").json(f"file://{tmp_path}/e").select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("task")).distinct()
    assert names.count() > 1
    assert differing(spark, tmp_path, "files_of_entities", supplier=("s_suppkey long, s_name string, s_acctbal double", [(i, f"S{i}", float(i)) for i in range(30)])) == ([], 30)


def test_envelopes_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MOST", 7)
    read = []
    monkeypatch.setattr(files.records, "all_present", lambda s, paths, record, of=files.records.all_present: read.extend(paths) or of(s, paths, record))
    assert differing(spark, tmp_path, "present_envelopes", orders=orders(*range(20))) == ([], 1)
    assert spark.read.text(read[0], wholetext=True).count() == 3


def test_motion_summary_is_read_with_its_page(spark):
    page = '<meta name="a" content="z"><meta property="og:description" content=" x "><meta property="og:description" content="y"><body>t'
    assert html.motion_records(spark.createDataFrame([(1, page)], "k int, page string"), "k", "page", "b").collect()[0].summary == "x"


def test_sessions_are_those_of_orders(spark, tmp_path):
    lines = [(k, n, p, p % 3, "A") for k, n, p in [(1, 1, 5), (1, 1, 4), (1, 2, 3), (2, 1, 7), (2, 2, 7), (9, 1, 1), (None, 1, 1)]]
    twice = [(k, 1, "F", 1.0, dt.datetime(1996, 1, 1), "x") for k in (1, 2, 2, 3)]
    assert differing(spark, tmp_path, "split_and_merge", orders=(ORDERS, twice), lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string", lines)) == ([], 2)


def test_site_maps_sort_addresses_in_one_shuffle(spark, tmp_path, monkeypatch):
    sorted_rows = []
    monkeypatch.setattr(documents, "numbered", lambda rows, order, name, of=documents.numbered: sorted_rows.append(rows.orderBy(*order)) or of(rows, order, name))
    day = lambda k: dt.datetime(1996, 5, k)
    lines = [(k, 1 + k % 2, k % 9, 3, day(1 + k % 28)) for k in range(300)] + [(5, 2, 5, 3, day(28)), (6, 1, 6, 3, None), (7, 9, 7, -3, None)]
    assert differing(spark, tmp_path, "site_map_files", lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp", lines)) == ([], 2)
    assert sorted_rows[0].columns == ["loc", "lastmod", "priority"]
    plan = sorted_rows[0]._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("rangepartitioning")) == (1, 1)
