"""Writers of record collections: envelopes, partitioned years, normalised tables, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import escape_markup
from tessera.operators import lists
from tessera.operators.joins import same_rows

UNKNOWN_YEAR = "necunoscut"


def envelope(rows: DataFrame, version: str, source: str, generated_at: str) -> DataFrame:
    """One row ``value``: all records as one JSON envelope. Meant for small collections; ``documents.envelopes`` cuts others."""
    records = F.collect_list(F.struct(*rows.columns))
    meta = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(source).alias("source_url"), F.lit(version).alias("scraper_version"), F.count(F.lit(1)).alias("count"))
    return rows.agg(meta.alias("meta"), records.alias("data")).select(F.to_json(F.struct("meta", "data"), {"ignoreNullFields": "false"}).alias("value"))


def write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Compact JSON, one record a line; with ``by`` a folder for each of its values, such as an entity or a year.

    Values are dealt to all cores, a value's rows to at most eight tasks, and tasks put their files in place themselves.
    """
    if not by:
        rows.write.mode("overwrite").json(path)
        return
    dealt = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, by, F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
    dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).json(path)


def with_year(rows: DataFrame, day: Column) -> DataFrame:
    """Adds ``year``, the first four characters of a date; rows without one are in a bucket of their own."""
    return rows.withColumn("year", F.coalesce(F.nullif(F.substring(day.cast("string"), 1, 4), F.lit("")), F.lit(UNKNOWN_YEAR)))


def write_years(rows: DataFrame, day: Column, path: str) -> DataFrame:
    """Write a folder for each year and return the index ``year, n``, newest first."""
    dated = with_year(rows, day)
    dated.repartition("year", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").partitionBy("year").parquet(path)
    return dated.groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year"))


def split_sessions(sessions: DataFrame) -> dict[str, DataFrame]:
    """Sessions with nested items and documents as three flat tables and the items' entities.

    ``sessions`` has an id, ``items`` (array of structs with ``docs``, an array
    of structs, and ``entities``) and other plain columns. An item's id is its
    session's and its place, in three digits or more.
    """
    items = sessions.select(F.col("id").alias("session_id"), F.posexplode("items").alias("item_index", "item"))
    items = items.withColumn("item_id", F.concat_ws("_", F.col("session_id").cast("string"), F.lpad(F.col("item_index").cast("string"), F.greatest(F.lit(3), F.length(F.col("item_index").cast("string"))), F.lit("0"))))
    plain = [c for c in items.schema["item"].dataType.names if c not in ("docs", "entities")]
    docs = items.select("item_id", F.posexplode("item.docs").alias("doc_index", "doc")).select("item_id", "doc_index", "doc.*")
    return {
        "sessions": sessions.drop("items"),
        "items": items.select("session_id", "item_index", "item_id", *[F.col(f"item.{c}").alias(c) for c in plain], F.coalesce(F.size("item.docs"), F.lit(0)).alias("num_docs")),
        "docs": docs,
        "entities": items.select("item_id", F.col("item.entities").alias("entities")),
    }


def merge_sessions(tables: dict[str, DataFrame], size: int = lists.SIZE) -> DataFrame:
    """Sessions as they were before ``split_sessions``, with ``block``: a row for each block of a session's items.

    An item's documents are in its row, as they were. Items, documents and
    entities meet in one shuffle, dealt by what their item's id says of its
    session and block, so a large session lies in many tasks.
    """
    of = lambda name: F.struct(*[c for c in tables[name].columns if c != "item_id"]).alias(name)
    plain = [c for c in tables["items"].columns if c not in ("session_id", "item_index", "item_id", "num_docs")]
    fields = [c for c in tables["docs"].columns if c not in ("item_id", "doc_index")]
    rows = [tables[name].select("item_id", of(name)) for name in ("items", "docs", "entities")]
    every = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    stem, number = F.substring_index("item_id", "_", -1), F.lit(size)
    dealt = every.select(
        F.expr("left(item_id, length(item_id) - length(substring_index(item_id, '_', -1)))").alias("_stem"),
        stem.alias("_number"), F.floor(stem.try_cast("int") / number).alias("_part"), "items", "docs", "entities",
    ).repartition("_stem", "_part")
    whole = dealt.groupBy("_stem", "_part", "_number").agg(
        F.collect_list("items").alias("items"), F.transform(F.array_sort(F.collect_list("docs")), lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("docs"),
        F.first("entities.entities", True).alias("entities"),
    )
    items = whole.select("_stem", "_part", F.explode("items").alias("i"), "docs", "entities").withColumn("block", F.floor(F.col("i.item_index") / number).cast("long"))
    value = F.struct(F.col("i.item_index"), F.struct(*[F.col(f"i.{c}").alias(c) for c in plain], "docs", "entities").alias("v"))
    held = items.groupBy("_stem", "_part", F.col("i.session_id").alias("id"), "block").agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: x["v"]).alias("items"))
    return lists.joined_to(tables["sessions"], held.select("id", "block", "items"), "id", "items")


def write_if_changed(rows: DataFrame, path: str, spark: SparkSession) -> bool:
    """Write a table unless the one at the path holds the same rows; whether it was written."""
    from tessera.sources.records import exists

    if exists(spark, f"{path}/_SUCCESS") and same_rows(spark.read.schema(rows.schema).parquet(path), rows):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def atom_entry(site: str, id_: Column, title: Column, at: Column, url: Column, kind: Column, summary: Column) -> Column:
    """One entry of an Atom feed."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    e = escape_markup
    return F.concat(
        F.lit(f"<entry><id>{site}/feed#"), e(id_), F.lit("</id><title>"), e(title), F.lit("</title><updated>"), stamp, F.lit("</updated><published>"), stamp,
        F.lit('</published><link rel="alternate" href="'), e(url), F.lit('"/><category term="'), e(kind), F.lit('"/><summary>'), e(summary), F.lit("</summary></entry>"),
    )


def json_feed_item(site: str, id_: Column, title: Column, at: Column, url: Column, kind: Column, summary: Column) -> Column:
    """One item of a JSON feed."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.to_json(F.struct(F.concat(F.lit(f"{site}/feed#"), id_).alias("id"), url.alias("url"), title.alias("title"), summary.alias("summary"), stamp.alias("date_published"), F.array(kind).alias("tags")))


def site_map(urls: DataFrame) -> DataFrame:
    """``value``: an entry of a site map for each of ``loc, lastmod, priority``."""
    return urls.select(F.concat(F.lit("<url><loc>"), escape_markup(F.col("loc")), F.lit("</loc><lastmod>"), F.col("lastmod"), F.lit("</lastmod><priority>"), F.col("priority"), F.lit("</priority></url>")).alias("value"))


def search_page(title: Column, body: Column, facets: dict[str, Column]) -> Column:
    """A page for the search index: its text and its facets, those that aren't null."""
    marks = [F.when(v.isNotNull(), F.concat(F.lit(f'<span data-filter="{name}">'), escape_markup(v), F.lit("</span>"))) for name, v in facets.items()]
    return F.concat(F.lit("<html><body><h1>"), escape_markup(title), F.lit("</h1>"), F.concat_ws("", *marks), F.lit("<p>"), escape_markup(body), F.lit("</p></body></html>"))


def freshness(files: DataFrame, group: Column) -> DataFrame:
    """``grp, files, bytes, records, newest, versions`` of envelopes with their ``_metadata`` size as ``bytes``."""
    return files.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.size("data")).alias("records"), F.max("meta.generated_at").alias("newest"), F.array_sort(F.collect_set("meta.scraper_version")).alias("versions"))


def write_marker(spark: SparkSession, path: str, stages: dict[str, bool]) -> None:
    """Record which stages of a run ended well."""
    rows = spark.createDataFrame([(name, ok) for name, ok in stages.items()] or [], "stage string, ok boolean")
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)
