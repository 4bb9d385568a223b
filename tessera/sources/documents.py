"""Ordered documents from rows: files with a header, entries and a footer, cut after so many entries.

Entries are sorted by ranges and numbered without meeting in one task: the
sorted table is written, sums of its parts give each part's first number. A file
holds a bounded number of entries, so no task or row holds more than one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import escape_markup
from tessera.sources.stores import move_all, scratch

#: How many addresses a site map may hold, and the names of its schema.
MOST = 50_000
SITEMAP = "http://www.sitemaps.org/schemas/sitemap/0.9"
ATOM = "http://www.w3.org/2005/Atom"
JSON_FEED = "https://jsonfeed.org/version/1.1"
_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in an order, from 0; the order is by ranges, whose sums number them."""
    path = scratch(rows.sparkSession, "sorted")
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    sums = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()  # a row for each part
    first, starts = 0, []
    for part, n in sorted((r._part, r._n) for r in sums):
        starts.append((part, first))
        first += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    place = F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_id", "_part", "_first")


def write(entries: DataFrame, order: list[Column], path: str, name: str, header: str, footer: str, between: str = "", most: int = MOST, value: Column | None = None) -> list[str]:
    """Write ``value`` of rows in ascending order as files ``name-0``, ``name-1`` and so on; their paths.

    ``value`` is a column of the rows, or an expression over their columns that
    is put together where it is written: only the columns are sorted and dealt to
    files. ``name`` holds ``{}`` for the number. ``between`` ends each entry but a
    file's last. Without rows there is one file without entries. Files that a
    former call left beyond the last one stay.
    """
    spark = entries.sparkSession
    if value is None:
        keys = [f"_o{k}" for k in range(len(order))]
        entries, order, value = entries.select("value", *[c.alias(k) for c, k in zip(order, keys, strict=True)]), [F.col(k) for k in keys], F.col("value")
    placed = numbered(entries, [c.asc_nulls_last() for c in order], "_place")
    total = placed.count()
    files = max(1, -(-total // most))
    file = F.floor(F.col("_place") / most)
    columns = [c for c in placed.columns if c != "_place"]
    body = placed.select(file.cast("long").alias("_file"), F.col("_place").alias("_at"), F.lit(None).cast("string").alias("_end"), *columns)
    ends = spark.range(files).select(F.col("id").alias("_file"), F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("_at"), F.lit(header).alias("_end")), F.struct(F.lit((1 << 62)).cast("long").alias("_at"), F.lit(footer).alias("_end")))).alias("x")).select("_file", "x.*")
    made = scratch(spark, "documents")
    dealt = body.unionByName(ends, allowMissingColumns=True).repartition(min(files, 10_000), "_file").sortWithinPartitions("_file", "_at")
    last = (F.col("_at") % most == most - 1) | (F.col("_at") == total - 1)
    text = F.when(F.col("_at").between(0, total - 1), F.concat(value, F.when(last, "").otherwise(between))).otherwise(F.col("_end"))
    dealt.select(F.col("_file").alias("file"), text.alias("value")).write.partitionBy("file").text(made)
    out = [f"{path}/{name.format(k)}" for k in range(files)]
    move_all(spark, [(f"{made}/file={k}/part-*", to) for k, to in enumerate(out)])
    return out


def site_map(urls: DataFrame, path: str, site: str, most: int = MOST) -> list[str]:
    """Site map files of ``loc, lastmod, priority``, by address, and an index of them."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{SITEMAP}">'
    entry = _url(F.col("loc"), F.col("lastmod"), F.col("priority"))
    files = write(urls.select("loc", "lastmod", "priority"), [F.col("loc")], path, "sitemap-{}.xml", head, "</urlset>", most=most, value=entry)
    listed = urls.sparkSession.range(len(files)).select(F.col("id"), F.concat(F.lit(f"<sitemap><loc>{site}/sitemap-"), F.col("id").cast("string"), F.lit(".xml</loc></sitemap>")).alias("value"))
    index = write(listed, [F.col("id")], path, "sitemap.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{SITEMAP}">', "</sitemapindex>")
    return files + index


def _url(loc: Column, lastmod: Column, priority: Column) -> Column:
    mod = F.when(lastmod.isNotNull(), F.concat(F.lit("<lastmod>"), lastmod, F.lit("</lastmod>"))).otherwise("")
    return F.concat(F.lit("<url><loc>"), escape_markup(loc), F.lit("</loc>"), mod, F.lit("<priority>"), priority, F.lit("</priority></url>"))


def atom_feed(entries: DataFrame, order: list[Column], path: str, site: str, title: str, updated: str) -> list[str]:
    """An Atom feed of ``value`` entries in order."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="{ATOM}"><id>{site}/feed</id><title>{_escaped(title)}</title><updated>{updated}</updated><link rel="self" href="{site}/feed-0.atom"/>'
    return write(entries, order, path, "feed-{}.atom", head, "</feed>")


def json_feed(items: DataFrame, order: list[Column], path: str, site: str, title: str) -> list[str]:
    """A JSON feed of ``value`` items in order."""
    head = json.dumps({"version": JSON_FEED, "title": title, "home_page_url": site, "feed_url": f"{site}/feed-0.json"}, ensure_ascii=False)[:-1] + ', "items": ['
    return write(items, order, path, "feed-{}.json", head, "]}", ",")


def envelopes(rows: DataFrame, order: list[Column], path: str, meta: dict[str, object], most: int = MOST) -> list[str]:
    """Envelopes ``meta, data`` of at most so many records each, in order; ``meta`` says when they were made and how many all are."""
    count = rows.count()
    held = rows.select(*[c.alias(f"_k{i}") for i, c in enumerate(order)], F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    head = json.dumps({"meta": meta | {"count": count}}, ensure_ascii=False)[:-1] + ', "data": ['
    return write(held, [F.col(f"_k{i}") for i in range(len(order))], path, "envelope-{}.json", head, "]}", ",", most)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag in XML files, as rows."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
