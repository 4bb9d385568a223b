"""Queries of tables that are written first: upserts by partition, streams of files, readers and writers over copies of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import expectations, joins
from tessera.plans.base import query, t
from tessera.sources import documents, partitions, writers
from tessera.sources.stores import scratch, set_order
from tessera.streaming import look_back, upserts

_ORDER = "o_orderkey long, o_totalprice double, year string"


@query(
    """
WITH old AS (SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, -o_totalprice AS o_totalprice, CASE WHEN o_orderkey % 40 = 4 THEN '1996' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders WHERE year(o_orderdate) IN (1995, 1997) AND o_orderkey % 4 = 0),
both AS (SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new)
SELECT o_orderkey, o_totalprice, year, year IN ('1995', '1996', '1997') AS rewritten FROM both
""".replace("both", "merged")
)
def yearly_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders by year before and after an upsert of two years, some of whose orders move to a third; whether a row's file is new."""
    path = scratch(spark, "orders")
    orders = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("string").alias("year"))
    partitions.upsert(spark, path, orders.where("o_orderkey % 3 <> 0"), ["o_orderkey"], "year")
    files = lambda: spark.read.schema(_ORDER).parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    before = scratch(spark, "files")
    files().select("file").distinct().write.parquet(before)
    new = orders.where("year IN ('1995', '1997') AND o_orderkey % 4 = 0").withColumns({"o_totalprice": -F.col("o_totalprice"), "year": F.when(F.col("o_orderkey") % 40 == 4, "1996").otherwise(F.col("year"))})
    partitions.upsert(spark, path, new, ["o_orderkey"], "year")
    known = spark.read.parquet(before).withColumn("known", F.lit(True))
    return files().join(known, "file", "left").select("o_orderkey", "o_totalprice", "year", F.col("known").isNull().alias("rewritten"))


def _shuffled(text: str) -> int:
    """A number that shuffles days alike in each run."""
    return int.from_bytes(text.encode(), "big") * 2654435761 % (1 << 32)


_EVENT = "event_id long, version int, ts timestamp, value double"


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END AS version, value + CASE WHEN event_id % 10 = 0 THEN 1000 ELSE 0 END AS value, strftime(ts, '%Y-%m-%d') AS day FROM events")
def look_back_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as files of a day, a tenth corrected up to five days later, in an order shuffled within weeks: the newest version of each."""
    events = t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    first = events.select("event_id", F.lit(1).alias("version"), "ts", "value", F.to_date("ts").alias("file"))
    again = events.where("event_id % 10 = 0").select("event_id", F.lit(2).alias("version"), "ts", (F.col("value") + 1000).alias("value"), F.date_add(F.to_date("ts"), (F.col("event_id") % 6).cast("int")).alias("file"))
    source, out, state = (scratch(spark, n) for n in ("days", "newest", "state"))
    both = first.unionByName(again)
    both.repartition("file").write.partitionBy("file").json(source)
    names = [r.name for r in spark.read.schema(_EVENT).json(source).select(F.col("_metadata.file_path").alias("name")).distinct().collect()]  # a file a day
    week = lambda name: int(name.split("file=")[1][8:10]) // 7
    set_order(spark, sorted(names, key=lambda n: (n.split("file=")[1][:7], week(n), _shuffled(n.split("file=")[1][:10]))))
    look_back.keep_latest(spark, f"{source}/*", _EVENT, "event_id", "ts", "version", 21, out, state, files=6)
    return partitions.read(spark, out, "event_id long, version int, ts timestamp, value double, day string").drop("ts")


@query("SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS day FROM events")
def appended_once(spark: SparkSession, d: str) -> DataFrame:
    """Events as files of a day, a seventh repeated with another value the day after: the first record of each stays."""
    events = t(spark, d, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    again = events.where("event_id % 7 = 0").select("event_id", (F.col("value") + 5).alias("value"), "day", F.date_add(F.to_date("day"), 1).cast("string").alias("file"))
    source, out, state = (scratch(spark, n) for n in ("days", "once", "state"))
    events.withColumn("file", F.col("day")).unionByName(again).repartition("file").write.partitionBy("file").json(source)
    schema = "event_id long, value double, day string"
    upserts.append_once(spark, f"{source}/*", schema, "event_id", "day", out, state)
    return partitions.read(spark, out, schema)


# --- maps by key, expectations --------------------------------------------------------

#: Bills with a first and a second number, and votes that name one. Of some bills the first number has no vote, but the second has.
_FIRST = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'fără număr' WHEN 2 THEN '' WHEN 3 THEN concat('PL-x ', 5000 + o_orderkey % 7, '/2019') ELSE concat('PL-x ', 100 + o_orderkey % 800, '/2024') END"
_SECOND = "concat('BP ', 10 + o_custkey % 80, '/2023 din ', o_orderpriority)"
_VOTE = "CASE WHEN l_linenumber % 3 = 0 THEN 'Vot de retragere' WHEN l_linenumber % 2 = 0 THEN concat('Vot final PL-x ', 100 + l_partkey % 700, '/2024') ELSE concat('BP nr. ', 10 + l_suppkey % 60, '/2023 respingere') END"


@query(
    f"""
WITH bills AS (SELECT o_orderkey, coalesce(nullif(regexp_extract({_FIRST}, '(\\d{{2,4}}/\\d{{4}})', 1), ''), nullif(regexp_extract({_SECOND}, '(\\d{{2,4}}/\\d{{4}})', 1), '')) AS key FROM orders),
votes AS (SELECT nullif(regexp_extract({_VOTE}, '(\\d{{2,4}}/\\d{{4}})', 1), '') AS key, l_orderkey AS vote, l_linenumber AS line, l_partkey, l_suppkey FROM lineitem),
firsts AS (SELECT DISTINCT ON (key) key, vote, line FROM votes WHERE key IS NOT NULL ORDER BY key, vote, line, l_partkey, l_suppkey)
SELECT o_orderkey, bills.key, vote, line FROM bills LEFT JOIN firsts USING (key)
""".replace("\\\\", "\\")
)
def bill_vote_map(spark: SparkSession, d: str) -> DataFrame:
    """The first vote on each bill, by its number in the first text that has one; hot numbers are split."""
    bills = t(spark, d, "orders").select("o_orderkey", F.expr(_FIRST).alias("a"), F.expr(_SECOND).alias("b"))
    votes = t(spark, d, "lineitem").select(F.expr(_VOTE).alias("title"), F.col("l_orderkey").alias("vote"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey")
    out = joins.map_by_key(bills, ["a", "b"], r"(\d{2,4}/\d{4})", ["o_orderkey"], votes, "title", ["vote", "line", "l_partkey", "l_suppkey"], hot=100)
    return out.select("o_orderkey", "key", "hit.vote", "hit.line")


@query(
    """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS p, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS person FROM orders)
SELECT 'filled:p' AS rule, 'error' AS severity, count(*) FILTER (p <> '') / count(*)::DOUBLE AS figure, count(*) FILTER (p <> '') / count(*)::DOUBLE >= 0.95 AS ok FROM o
UNION ALL SELECT 'filled:person', 'error', count(person) FILTER (person <> 0) / count(*)::DOUBLE, count(person) FILTER (person <> 0) / count(*)::DOUBLE >= 0.7 FROM o
UNION ALL SELECT 'known:p', 'warning', count(*) FILTER (p <> '' AND left(p, 2) NOT IN ('1-', '2-', '3-')), count(*) FILTER (p <> '' AND left(p, 2) NOT IN ('1-', '2-', '3-')) = 0 FROM o
UNION ALL SELECT 'between:o_totalprice', 'error', count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 1000000), count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 1000000) = 0 FROM o
UNION ALL SELECT 'between:rows', 'error', count(*), count(*) BETWEEN 300 AND 1e12 FROM o
UNION ALL SELECT 'stated:rows', 'error', count(*) - (SELECT count(*) FROM customer) * 10, count(*) = (SELECT count(*) FROM customer) * 10 FROM o
UNION ALL SELECT 'unique:o_orderkey', 'error', 0, true
UNION ALL SELECT 'unique:person+o_orderdate', 'warning', count(*), count(*) = 0 FROM (SELECT 1 FROM o WHERE person IS NOT NULL GROUP BY person, o_orderdate HAVING count(*) > 1)
"""
)
def expectations_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Eight rules of a table with their figures and verdicts; the stated count is another table's."""
    rows = t(spark, d, "orders").withColumns({"p": F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("o_orderpriority")), "person": F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey"))})
    x = expectations
    rules = [x.Filled("p", 0.95), x.Filled("person", 0.7), x.Known("p", ("1-", "2-", "3-")), x.Between("o_totalprice", 1000, 1_000_000), x.Between(None, 300, 1e12), x.Stated(t(spark, d, "customer").count() * 10), x.Unique(("o_orderkey",)), x.Unique(("person", "o_orderdate"), True, x.WARNING)]
    return x.check(rows, rules)


# --- documents ------------------------------------------------------------------------


@query(
    """
WITH urls AS (SELECT row_number() OVER (ORDER BY loc) - 1 AS k, * FROM (SELECT 'https://x.org/l/' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '/' || l_linenumber || '?a=1&b=' || l_partkey || '-' || l_suppkey AS loc, strftime(max(l_shipdate), '%Y-%m-%d') AS lastmod FROM lineitem GROUP BY 1))
SELECT 'sitemap-' || (k // 20000) || '.xml' AS file, count(*) AS n, min(loc) AS first, max(loc) AS last, min(lastmod) AS oldest FROM urls GROUP BY 1
UNION ALL SELECT 'sitemap.xml', (max(k) // 20000) + 1, 'https://x.org/sitemap-0.xml', NULL, NULL FROM urls
"""
)
def site_map_files(spark: SparkSession, d: str) -> DataFrame:
    """Site maps of an address for each line, cut after 20,000, and their index, read back as XML."""
    loc = F.concat(F.lit("https://x.org/l/"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("?a=1&b="), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    lines = t(spark, d, "lineitem").select(loc.alias("loc"), F.col("l_shipdate").cast("date").alias("day")).repartitionByRange(F.asc_nulls_last("loc"))  # these ranges serve the sort, too
    urls = lines.groupBy("loc").agg(F.date_format(F.max("day"), "yyyy-MM-dd").alias("lastmod")).withColumn("priority", F.lit("0.5"))
    path = scratch(spark, "site")
    documents.site_map(urls, path, "https://x.org", 20_000)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
    maps = documents.xml_rows(spark, f"{path}/sitemap-*.xml", "url", "loc string, lastmod string").select(file, "loc", "lastmod")
    out = maps.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("first"), F.max("loc").alias("last"), F.min("lastmod").alias("oldest"))
    index = documents.xml_rows(spark, f"{path}/sitemap.xml", "sitemap", "loc string").agg(F.lit("sitemap.xml").alias("file"), F.count(F.lit(1)).alias("n"), F.min("loc").alias("first"))
    return out.unionByName(index.withColumns({"last": F.lit(None).cast("string"), "oldest": F.lit(None).cast("string")}))


@query("SELECT 'https://x.org/feed#' || event_id AS id, event_type AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS updated, props AS summary FROM events")
def atom_feed_document(spark: SparkSession, d: str) -> DataFrame:
    """All events, newest first, as an Atom feed, read back as XML."""
    events = t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    entry = writers.atom_entry("https://x.org", F.col("event_id").cast("string"), F.col("event_type"), F.col("at"), F.lit("https://x.org/e"), F.lit("a & b"), F.col("props"))
    ordered = events.select(entry.alias("value"), (-F.unix_micros("at")).alias("o"), "event_id")
    path = scratch(spark, "feed")
    documents.atom_feed(ordered, [F.col("o"), F.col("event_id")], path, "https://x.org", "Events & more", "2024-01-31T00:00:00Z")
    return documents.xml_rows(spark, f"{path}/feed-*.atom", "entry", "id string, title string, updated string, summary string")


@query("SELECT 'https://x.org/feed#' || event_id AS id, event_type AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS date_published, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS BIGINT) AS place, 'https://jsonfeed.org/version/1.1' AS version FROM events")
def json_feed_document(spark: SparkSession, d: str) -> DataFrame:
    """All events, newest first, as a JSON feed, read back as JSON with the place of each item."""
    events = t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    item = writers.json_feed_item("https://x.org", F.col("event_id").cast("string"), F.col("event_type"), F.col("at"), F.lit("https://x.org/e"), F.lit("a"), F.col("props"))
    path = scratch(spark, "feed")
    documents.json_feed(events.select(item.alias("value"), (-F.unix_micros("at")).alias("o"), "event_id"), [F.col("o"), F.col("event_id")], path, "https://x.org", "Events")
    feeds = spark.read.schema("version string, items array<struct<id:string,title:string,date_published:string>>").option("multiLine", True).json(f"{path}/feed-*.json")
    part = F.regexp_extract(F.input_file_name(), r"feed-(\d+)\.json", 1).cast("long")
    items = feeds.select("version", part.alias("part"), F.posexplode("items").alias("at", "i"))
    return items.select("i.id", "i.title", "i.date_published", (F.col("part") * documents.MOST + F.col("at") + 1).alias("place"), "version")


@query("SELECT CAST(k // 4000 AS BIGINT) AS file, count(*) AS n, (SELECT count(*) FROM orders) AS stated, min(o_orderkey) AS first, max(o_orderkey) AS last, '2024-05-01T00:00:00Z' AS generated_at FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_orderkey FROM orders) GROUP BY 1")
def envelope_documents(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of 4,000 orders each, in order, read back: their counts, the stated count, and when they were made."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"))
    path = scratch(spark, "envelopes")
    documents.envelopes(rows, [F.col("o_orderkey")], path, {"generated_at": "2024-05-01T00:00:00Z", "source_url": "https://x.org", "scraper_version": "1"}, 4_000)
    read = spark.read.schema("meta struct<generated_at:string,count:long>, data array<struct<o_orderkey:long,price:double>>").option("multiLine", True).json(f"{path}/envelope-*.json")
    keys = F.transform("data", lambda x: x["o_orderkey"])
    file = F.regexp_extract(F.input_file_name(), r"envelope-(\d+)\.json", 1).cast("long")
    return read.select(file.alias("file"), F.size("data").cast("long").alias("n"), F.col("meta.count").alias("stated"), F.array_min(keys).alias("first"), F.array_max(keys).alias("last"), "meta.generated_at")
