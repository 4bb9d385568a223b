"""Readers of record collections: envelopes, folders, dimensions and keyed maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "meta struct<generated_at:string,source_url:string,scraper_version:string,count:long>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names something, in whatever store Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def envelopes(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Whole envelopes ``meta, data, file``; ``record`` is the type of one record.

    A file that isn't JSON, or none at all, gives no row. Files whose names
    start with an underscore are left out, as an index is.
    """
    schema = f"{META}, data array<{record}>, _corrupt_record string"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{META}, data array<{record}>, file string")
    read = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return read.select("meta", "data", "_corrupt_record", F.col("_metadata.file_path").alias("file")).where("_corrupt_record is null").drop("_corrupt_record")


def envelope_rows(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of all envelopes under a path, one row each."""
    return envelopes(spark, path, record).select(F.explode("data").alias("r")).select("r.*")


def envelope_counts(files: DataFrame) -> DataFrame:
    """``file, n``: the count that an envelope states, else the number of its records; null if it has neither."""
    return files.select("file", F.coalesce("meta.count", F.when(F.col("data").isNotNull(), F.size("data").cast("long"))).alias("n"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file from all JSON files of a folder; files that aren't such JSON are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def dimension(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """``key, value`` of a CSV with a header; rows in which either is blank are left out, of a repeated key the last in order of value stays."""
    rows = spark.read.option("header", True).csv(path).select(F.trim(key).alias("key"), F.trim(value).alias("value"))
    return rows.where("key <> '' and value <> ''").groupBy("key").agg(F.max("value").alias("value"))


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key, value`` of a JSON object that maps keys to values of a type."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def all_present(spark: SparkSession, paths: list[str], record: str) -> DataFrame:
    """Records of several envelopes as one table; a missing file is an empty one."""
    return reduce(DataFrame.unionByName, [envelope_rows(spark, p, record) for p in paths])


def item_texts(sessions: DataFrame, items: str, text: str, entities: str) -> DataFrame:
    """``text, has_entities`` of all items of all sessions."""
    return sessions.select(F.explode(items).alias("i")).select(F.coalesce(F.col(f"i.{text}"), F.lit("")).alias("text"), F.col(f"i.{entities}").isNotNull().alias("has_entities"))


def vote_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the daily vote files, in XML and Latin-2; a missing number counts as 0, a row whose number isn't one is left out."""
    names = {"VOTID": "vote_id", "TIME_VOT": "voted_at", "DESCRIERE": "title", "CAMERA": "chamber", "PREZENTI": "present", "AU_VOTAT_DA": "yes", "AU_VOTAT_NU": "no", "AU_VOTAT_AB": "abstain", "NU_AU_VOTAT": "not_voting"}
    texts = ("TIME_VOT", "DESCRIERE")
    rows = spark.read.format("xml").option("rowTag", "ROW").option("charset", "ISO-8859-2").schema(", ".join(f"{n} string" for n in names)).load(path)
    number = lambda c: F.coalesce(F.col(c), F.lit("0")).try_cast("long")
    out = rows.select([F.trim(F.coalesce(F.col(c), F.lit(""))).alias(n) if c in texts else number(c).alias(n) for c, n in names.items()])
    return out.dropna(subset=[n for c, n in names.items() if c not in texts])


def listed_ids(html: Column, pattern: str) -> Column:
    """Numbers that links of a page carry, each once, in order of the page; ``pattern`` holds one group."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("long")))


def session_days(text: Column, year: int, month: int) -> Column:
    """Days of one month among eight-digit dates in a text, each once, in order."""
    days = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{8})"), F.lit(1)), lambda x: F.try_to_date(x, "yyyyMMdd"))
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: (F.year(d) == year) & (F.month(d) == month))))


_CELL = r"<td\b[^>]*>(.*?)</td>\s*"


def cell_text(c: Column) -> Column:
    """What a reader sees of a table cell: no tags, single spaces."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), "&nbsp;|\u00a0", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(F.replace(plain, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def label_table(html: Column, colour: str = "fff0d8") -> Column:
    """Labels and values of a page's table rows whose first cell has the labels' colour; of a repeated label the last, empty ones left out."""
    row = rf"(?is)<tr\b[^>]*>\s*<td\b[^>]*bgcolor=[\"']?#?{colour}[\"']?[^>]*>(.*?)</td>\s*<td\b[^>]*>(.*?)</td>"
    part = lambda k: F.regexp_extract_all(html, F.lit(row), F.lit(k))
    tidy = lambda c: F.trim(F.rtrim(F.ltrim(cell_text(c), F.lit("- ")), F.lit(": .")))
    pairs = F.filter(F.zip_with(part(1), part(2), lambda a, b: F.struct(tidy(a).alias("k"), cell_text(b).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def table_rows(html: Column, cells: int) -> Column:
    """Texts of the cells of all table rows that have so many, in order."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>((?:(?!<tr\b).)*?)</tr>"), F.lit(1))
    split = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)" + _CELL), F.lit(1)), cell_text))
    return F.filter(split, lambda r: F.size(r) == cells)


def nominal_votes(html: Column) -> Column:
    """``name, party, symbol`` of the rows of a page that start with a number, hold four cells and name a member."""
    rows = F.filter(table_rows(html, 4), lambda r: r[0].rlike(r"^\d") & (r[1] != ""))
    return F.transform(rows, lambda r: F.struct(r[1].alias("name"), r[2].alias("party"), r[3].alias("symbol")))


def linked_files(html: Column, base: str) -> Column:
    """``url, day`` of the rows of a cell that link a PDF; each file once, with the first date that its row shows."""
    from tessera.functions.dates import day_first_date

    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>((?:(?!<tr\b).)*?)</tr>"), F.lit(1))

    def file(r: Column) -> Column:
        link = F.regexp_extract(r, "(?i)href=[\"']([^\"']+\\.pdf)[\"']", 1)
        day = F.regexp_extract(r, r"(?is)<a\b[^>]*>\s*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4})", 1)
        return F.struct(F.when(link.startswith("http"), link).when(link != "", F.concat(F.lit(base), link)).alias("url"), day_first_date(day).alias("day"))

    files = F.filter(F.transform(rows, file), lambda x: x["url"].isNotNull())
    return F.filter(files, lambda x, i: F.array_position(F.transform(files, lambda y: y["url"]), x["url"]) == i + 1)


def item_documents(html: Column, source: str) -> Column:
    """``day, title, source`` of the rows of a table of documents that have a title; rows of one cell are headings."""
    from tessera.functions.dates import day_first_date

    rows = F.filter(F.concat(table_rows(html, 2), table_rows(html, 3)), lambda r: r[1] != "")
    return F.transform(rows, lambda r: F.struct(day_first_date(r[0]).alias("day"), r[1].alias("title"), F.lit(source).alias("source")))
