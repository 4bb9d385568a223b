"""Queries of readers and writers, over copies of the tables that are written in their formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins, ranking
from tessera.plans.base import query, t
from tessera.plans.labels import D2, M2, O, Y, joined, pick, read_back
from tessera.sources import documents, records, writers
from tessera.sources.stores import exists, scratch, write_text

_RECORD = "struct<o_orderkey:long,o_orderpriority:string,price:double>"


def _envelopes(spark: SparkSession, d: str, most: int = 1_000) -> str:
    """Orders as envelopes of so many records each."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"))
    path = scratch(spark, "envelopes")
    documents.envelopes(rows, [F.col("o_orderkey")], path, {"generated_at": "2024-05-01T00:00:00Z", "source_url": "https://x.org", "scraper_version": "2"}, most)
    return path


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price FROM orders")
def envelope_rows_read(spark: SparkSession, d: str) -> DataFrame:
    """Records of all envelopes of a folder, one of which isn't JSON."""
    path = _envelopes(spark, d)
    write_text(spark, f"{path}/broken.json", '{"meta": {')
    return records.envelope_rows(spark, f"{path}/*.json", _RECORD)


@query("SELECT CAST(k // 1000 AS BIGINT) AS file, (SELECT count(*) FROM orders) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1 UNION ALL SELECT -1, 2")
def envelope_counts_read(spark: SparkSession, d: str) -> DataFrame:
    """What each envelope says its count is; without a count the number of its records."""
    path = _envelopes(spark, d)
    write_text(spark, f"{path}/plain.json", '{"data": [{"o_orderkey": 1}, {"o_orderkey": 2}]}')
    counts = records.envelope_counts(records.envelopes(spark, f"{path}/*.json", _RECORD))
    return counts.select(F.coalesce(F.regexp_extract("file", r"envelope-(\d+)\.json", 1).try_cast("long"), F.lit(-1)).alias("file"), "n")


@query("SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def present_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Records of a folder's envelopes and of one whose path is missing; an envelope is bounded, since one task reads it whole."""
    path = _envelopes(spark, d, documents.MOST)
    both = records.all_present(spark, [f"{path}/envelope-*.json", f"{path}/none/envelope-0.json"], _RECORD)
    return both.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT 'orders' AS grp, (count(*) - 1) // 1000 + 1 AS files, count(*) AS records, '2024-05-01T00:00:00Z' AS newest, '2' AS versions, true AS weighed FROM orders")
def file_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Files, records, the newest stamp and versions of a folder of envelopes; their bytes are those that the store tells."""
    path = _envelopes(spark, d)
    sizes = spark.read.format("binaryFile").load(f"{path}/envelope-*.json").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"))
    files = records.envelopes(spark, f"{path}/envelope-*.json", _RECORD).withColumn("name", F.regexp_extract("file", "[^/]+$", 0)).join(sizes, "name")
    out = writers.freshness(files, F.lit("orders"))
    return out.select("grp", "files", "records", "newest", F.array_join("versions", ",").alias("versions"), (F.col("bytes") > F.col("records") * 40).alias("weighed"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance FROM supplier")
def files_of_entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a file each, read back from their folder beside a file that isn't JSON."""
    rows = t(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance"))
    path = scratch(spark, "entities")
    writers.write_rows(rows.withColumn("entity", F.col("s_suppkey")), path, by="entity")
    write_text(spark, f"{path}/entity=x/broken.json", "{nonsense")
    found = records.documents(spark, f"{path}/*", "s_suppkey long, s_name string, balance double")
    return found.where("s_suppkey is not null")


@query("SELECT trim(c_name) AS key, max(c_mktsegment) AS value FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 GROUP BY 1")
def dimension_read(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of customers with blank keys and values, as a dimension."""
    rows = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("ID"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("Logo"))
    path = scratch(spark, "dimension")
    rows.write.option("header", True).csv(path)
    return records.dimension(spark, path, "ID", "Logo")


@query("SELECT s_suppkey || '_2024' AS key, s_nationkey AS n, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS name FROM supplier")
def keyed_map_read(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as JSON maps by key, a file for each nation, read back as rows."""
    value = F.struct(F.col("s_nationkey").alias("n"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"))
    maps = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("s_suppkey", F.lit("_2024")).alias("k"), value.alias("v")))).alias("m"))
    path = scratch(spark, "keyed")
    maps.select("s_nationkey", F.to_json("m").alias("value")).write.partitionBy("s_nationkey").text(path)
    return records.keyed_json(spark, f"{path}/*", "struct<n:int,name:string>").select("key", "value.n", "value.name")


@query("SELECT o_orderkey AS vote_id, strftime(o_orderdate, '%d.%m.%Y') AS voted_at, 'Şedinţă ' || o_orderpriority AS title, 2 AS chamber, o_custkey % 330 AS present, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey % 200 END AS yes FROM orders WHERE o_orderkey % 5 <> 0")
def daily_vote_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as votes in XML files; a missing number counts as 0, a row whose number isn't one is left out."""
    row = F.expr("concat('<ROW><VOTID>', o_orderkey, '</VOTID><TIME_VOT> ', date_format(o_orderdate, 'dd.MM.yyyy'), ' </TIME_VOT><DESCRIERE>&#350;edin&#355;&#259; ', o_orderpriority, '</DESCRIERE><CAMERA>2</CAMERA><PREZENTI>', CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE string(o_custkey % 330) END, '</PREZENTI>', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('<AU_VOTAT_DA>', o_custkey % 200, '</AU_VOTAT_DA>') END, '</ROW>')")
    path = scratch(spark, "votes")
    documents.write(t(spark, d, "orders").select(row.alias("value"), "o_orderkey"), [F.col("o_orderkey")], path, "votes-{}.xml", '<?xml version="1.0" encoding="ISO-8859-2"?>\n<ROWSET>', "</ROWSET>", most=4_000)
    return records.vote_rows(spark, path).select("vote_id", "voted_at", "title", "chamber", "present", "yes")


@query("SELECT CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS text, event_id % 4 <> 0 AS has_entities, count(*) AS n FROM events GROUP BY ALL")
def session_item_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the items of sessions, with whether they have entities, counted."""
    entity = F.when(F.col("event_id") % 4 != 0, F.struct(F.col("event_type").alias("kind")))
    item = F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("descriere"), entity.alias("entities"))
    sessions = t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(item).alias("items"))
    return records.item_texts(sessions, "items", "descriere", "entities").groupBy("text", "has_entities").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'necunoscut' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1")
def year_folders(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a folder for each year and one for those without a date, with the index that was returned."""
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("string")).alias("day"))
    path = scratch(spark, "years")
    index = writers.write_years(rows, F.col("day"), path)
    held = spark.read.schema("o_orderkey long, day string, year string").parquet(path).groupBy("year").agg(F.sum("o_orderkey").alias("keys"))
    return index.join(held, "year").select("year", "n", "keys")


@query("SELECT 'first' AS call, true AS written, count(*) AS n FROM customer UNION ALL SELECT 'same', false, count(*) FROM customer UNION ALL SELECT 'other', true, count(*) - 1 FROM customer UNION ALL SELECT 'equal', true, 0")
def written_if_changed(spark: SparkSession, d: str) -> DataFrame:
    """A table written three times, the second time in another order, the third time without a row; whether each call wrote."""
    rows = t(spark, d, "customer").select("c_custkey", "c_name")
    path, out = scratch(spark, "changed"), None
    for name, these in (("first", rows), ("same", rows.orderBy(F.desc("c_custkey"))), ("other", rows.where("c_custkey <> 1"))):
        wrote = writers.write_if_changed(these, path, spark)
        row = these.agg(F.lit(name).alias("call"), F.lit(wrote).alias("written"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    equal = joins.same_rows(rows, rows.repartition(3)) and not joins.same_rows(rows, rows.union(rows.limit(1)))
    return out.unionByName(rows.limit(0).agg(F.lit("equal").alias("call"), F.lit(equal).alias("written"), F.count(F.lit(1)).alias("n")))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, value DESC NULLS LAST, event_id")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event of the largest value."""
    return ranking.first_per_key(t(spark, d, "events"), ["user_id"], [F.desc_nulls_last("value"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT 'orders' AS stage, count(*) > 0 AS ok FROM orders UNION ALL SELECT 'none', false")
def run_marker(spark: SparkSession, d: str) -> DataFrame:
    """Which stages ended well, as the marker of a run says."""
    path = scratch(spark, "marker")
    writers.write_marker(spark, path, {"orders": not t(spark, d, "orders").isEmpty(), "none": exists(spark, f"{path}/none")})
    return spark.read.schema("stage string, ok boolean").json(path)


read_back(
    "item_documents", "orders", O,
    pick(O, f"concat('<table><tr><td>', {D2}, '.', {M2}, '.', {Y}, '</td><td>Raport <b>', o_orderkey, '</b></td></tr><tr><td colspan=2>antet</td></tr><tr><td>fără</td><td>', o_orderpriority, '</td></tr><tr><td>', {D2}, '-', {M2}, '-', {Y}, '</td><td>', o_custkey, '</td><td><a href=x>pdf</a></td></tr><tr><td>1.1.2000</td><td> </td></tr></table>')", "o_orderpriority"),
    lambda c: F.array_join(F.transform(records.item_documents(c, "caseta"), lambda x: joined(x["day"], x["title"], x["source"])), ","),
    pick(O, "strftime(o_orderdate, '%Y-%m-%d') || '|Raport ' || o_orderkey || '|caseta,-|' || o_orderpriority || '|caseta,' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_custkey || '|caseta'", "''"),
)
