"""Queries of the text functions over the tables' own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates, mappings, text
from tessera.plans.base import query, t


# --- normalisation --------------------------------------------------------------------


@query("SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-zăâîșț0-9]+(?:-[a-zăâîșț0-9]+)*'), lambda w: len(w) > 3 AND w NOT IN ('data', 'raport', 'partea', 'senat', 'precum')) AS w FROM documents".replace("SELECT doc_id, list_filter", "SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter").replace("FROM documents", "FROM documents)"))
def tokenise(spark: SparkSession, d: str) -> DataFrame:
    w = text.tokens(F.col("text"), ["data", "raport", "partea", "senat", "precum"])
    return t(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def escape_markup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", F.md5(text.escape_markup(F.col("html"))).alias("digest"))


@query("SELECT page_id, left(sha1(url), 12) AS key FROM pages")
def file_key(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.file_key(F.col("url")).alias("key"))


@query("SELECT s_suppkey, upper(left(split_part(s_name, ' ', 1), 1) || CASE WHEN split_part(s_name, ' ', 2) <> '' THEN left(split_part(s_name, ' ', 2), 1) ELSE '' END) AS initials FROM supplier")
def initials(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select("s_suppkey", text.initials(F.col("s_name")).alias("initials"))




# --- dates and numbers ----------------------------------------------------------------



@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 0 AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) < 730 THEN date_diff('day', o_orderdate::DATE, l_shipdate::DATE) END AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def answer_days(spark: SparkSession, d: str) -> DataFrame:
    both = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.answer_days(F.col("o_orderdate"), F.col("l_shipdate")).cast("long").alias("days"))




@query("SELECT o_orderkey, CASE WHEN o_totalprice::BIGINT % 100 >= 90 THEN 'high' WHEN o_totalprice::BIGINT % 100 >= 70 THEN 'middle' ELSE 'low' END AS bin, CASE WHEN o_orderstatus = 'F' THEN 'promulgat' WHEN o_orderpriority LIKE '%LOW%' THEN 'respins' WHEN o_custkey % 2 = 0 THEN 'adoptat' ELSE 'in_lucru' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'promulgat' WHEN o_orderpriority LIKE '%LOW%' THEN 'respins' ELSE 'în lucru' END AS facet FROM orders")
def status_and_bins(spark: SparkSession, d: str) -> DataFrame:
    law = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    stage = F.when(F.contains("o_orderpriority", F.lit("LOW")), "Respinsă: se respinge, respins").otherwise("la comisii")
    adopted = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate"))
    return t(spark, d, "orders").select("o_orderkey", mappings.threshold_bin(F.round("o_totalprice").cast("long") % 100, 90, 70).alias("bin"), mappings.bill_status(law, stage, adopted, F.lit(None)).alias("status"), mappings.bill_status_facet(law, stage).alias("facet"))


# --- pages and fields -----------------------------------------------------------------

@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS links, md5(array_to_string(list_transform(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: trim(x)), '|')) AS paragraphs FROM pages")
def page_lists(spark: SparkSession, d: str) -> DataFrame:
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.size(every('href="/([^"]*)"')).cast("long").alias("links"), F.md5(F.array_join(F.transform(every("<p>([^<]*)</p>"), lambda s: F.trim(s)), "|")).alias("paragraphs"))

