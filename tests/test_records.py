"""Readers, writers and record functions on files and texts written here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import entities, mappings, text
from tessera.operators import facets, joins, lists, ranking
from tessera.sources import records, writers

RECORD = "struct<id:long,name:string>"


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_envelopes(spark, tmp_path):
    put(tmp_path / "in/a.json", {"meta": {"count": 7, "scraper_version": "1"}, "data": [{"id": 1, "name": "x"}, {"id": 2}]})
    put(tmp_path / "in/b.json", {"data": [{"id": 3, "name": None}]})
    put(tmp_path / "in/bad.json", "{nonsense")
    put(tmp_path / "in/_index.json", {"data": [{"id": 9}]})
    path = f"file://{tmp_path}/in"
    assert sorted(r.id for r in records.envelope_rows(spark, path, RECORD).collect()) == [1, 2, 3]
    counts = {r.file.rsplit("/", 1)[1]: r.n for r in records.envelope_counts(records.envelopes(spark, path, RECORD)).collect()}
    assert counts == {"a.json": 7, "b.json": 1}
    assert records.envelope_rows(spark, f"file://{tmp_path}/none", RECORD).count() == 0
    both = records.all_present(spark, [f"{path}/a.json", f"file://{tmp_path}/missing.json", f"{path}/b.json"], RECORD)
    assert both.count() == 3


def test_documents_dimension_and_keyed(spark, tmp_path):
    put(tmp_path / "d/1.json", {"id": 1, "name": "x"})
    put(tmp_path / "d/2.json", "{broken")
    rows = records.documents(spark, f"file://{tmp_path}/d", "id long, name string").where("id is not null")
    assert [tuple(r) for r in rows.collect()] == [(1, "x")]
    assert records.documents(spark, f"file://{tmp_path}/e", "id long").count() == 0
    put(tmp_path / "p.csv", "ID,Logo\nA, a.png\nB,\n,c.png\n")
    assert {r.key: r.value for r in records.dimension(spark, f"file://{tmp_path}/p.csv", "ID", "Logo").collect()} == {"A": "a.png"}
    put(tmp_path / "k.json", {"1_2024": {"n": 3}, "2_2024": {"n": None}})
    assert {r.key: r.value.n for r in records.keyed_json(spark, f"file://{tmp_path}/k.json", "struct<n:int>").collect()} == {"1_2024": 3, "2_2024": None}


def test_item_texts(spark):
    rows = spark.sql("SELECT array(named_struct('t', 'a', 'e', array('x')), named_struct('t', null, 'e', null)) AS items")
    assert sorted(tuple(r) for r in records.item_texts(rows, "items", "t", "e").collect()) == [("", False), ("a", True)]


def test_vote_rows(spark, tmp_path):
    xml = '<?xml version="1.0" encoding="ISO-8859-2"?><ROWSET><ROW><VOTID>5</VOTID><TIME_VOT>03.02.2025 10:00</TIME_VOT><DESCRIERE> Şedinţă </DESCRIERE><PREZENTI>7</PREZENTI><AU_VOTAT_DA>4</AU_VOTAT_DA></ROW><ROW><VOTID>bad</VOTID></ROW></ROWSET>'
    (tmp_path / "v.xml").write_bytes(xml.encode("iso-8859-2"))
    row = records.vote_rows(spark, f"file://{tmp_path}/v.xml").collect()
    assert [(r.vote_id, r.title, r.present, r.yes, r.no) for r in row] == [(5, "Şedinţă", 7, 4, 0)]


def test_pages(spark):
    page = """<table><tr><th>Nume</th></tr><tr><td>1.</td><td>Ion <b>Pop</b></td><td>PSD</td><td> DA </td></tr><tr><td>x</td><td>no</td><td>a</td><td>b</td></tr><tr><td>2.</td><td></td><td>USR</td><td>NU</td></tr></table>
    <tr><td bgcolor="#FFF0D8">- Nr. inregistrare:</td><td><a href="x">12 &amp; 3</a></td></tr><tr><td bgcolor=fff0d8>Stadiu</td><td> </td></tr>
    <tr><td><a href="/d/1.pdf">icon</a></td><td><a>05.03.2024</a></td></tr><tr><td><a href="/d/1.pdf">again</a></td></tr><a href="detalii?idm=31"></a><a href="detalii?idm=31"></a><a href="detalii?idm=4"></a> ,20260526,20260101,20260526,20260599,"""
    html = F.lit(page)
    r = spark.range(1).select(
        records.nominal_votes(html).alias("v"), records.label_table(html).alias("l"), records.linked_files(html, "https://x.org").alias("f"), records.listed_ids(html, r"idm=(\d+)").alias("i"), records.session_days(html, 2026, 5).alias("d"), records.item_documents(F.lit("<tr><td>05.03.2024</td><td>Raport</td></tr><tr><td colspan=2>x</td></tr>"), "caseta").alias("o")
    ).first()
    assert [tuple(v) for v in r.v] == [("Ion Pop", "PSD", "DA")]
    assert r.l == {"Nr. inregistrare": "12 & 3"}
    assert [tuple(f) for f in r.f] == [("https://x.org/d/1.pdf", dt.date(2024, 3, 5))]
    assert r.i == [31, 4] and r.d == [dt.date(2026, 5, 26)]
    assert [tuple(x) for x in r.o] == [(dt.date(2024, 3, 5), "Raport", "caseta")]


def test_split_and_merge(spark):
    kind = "id string, titlu string, items array<struct<descriere:string,docs:array<struct<titlu:string,url:string>>,entities:struct<kind:string>>>"
    rows = spark.createDataFrame([("s1", "t", [("a", [("d1", "u"), ("d2", None)], ("k",)), ("b", [], None)]), ("s2", None, [])], kind)
    tables = writers.split_sessions(rows)
    assert sorted((r.item_id, r.num_docs) for r in tables["items"].collect()) == [("s1_000", 2), ("s1_001", 0)]
    assert tables["docs"].count() == 2 and tables["entities"].count() == 2
    assert sorted(map(str, writers.merge_sessions(tables).select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_merge_of_long_sessions_shuffles_items_once(spark):
    kind = "id string, n int, items array<struct<descriere:string,docs:array<struct<titlu:string>>,entities:struct<kind:string>>>"
    many = [(f"i{k}", [(f"d{k}.{x}",) for x in range(k % 3)], (f"k{k}",) if k % 5 else None) for k in range(1_103)]
    rows = spark.createDataFrame([("s_1", 1, many), ("s", 2, many[:4]), ("s_1_000", 3, [])], kind)
    tables = writers.split_sessions(rows)
    assert tables["items"].select("item_id").distinct().count() == 1_107
    merged = writers.merge_sessions(tables, 100)
    assert merged.where("id = 's_1'").select(F.size("items").alias("n")).where("n <= 100").count() == 12
    whole = lists.whole(merged, ["id"], "items", "n").select(rows.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows.collect()))
    assert merged._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1


def test_write_years_and_unchanged(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-02"), (2, None), (3, "2023-05-01")], "id int, day string")
    index = writers.write_years(rows, F.col("day"), f"file://{tmp_path}/y")
    assert [tuple(r) for r in index.collect()] == [("necunoscut", 1), ("2024", 1), ("2023", 1)]
    assert spark.read.parquet(f"file://{tmp_path}/y").where("year = 'necunoscut'").count() == 1
    path = f"file://{tmp_path}/u"
    assert writers.write_if_changed(rows, path, spark) and not writers.write_if_changed(rows.orderBy("day"), path, spark)
    writers.write_rows(rows, f"file://{tmp_path}/j", by="id")
    assert (tmp_path / "j/id=1").is_dir()
    writers.write_marker(spark, f"file://{tmp_path}/m", {"a": True})
    assert spark.read.json(f"file://{tmp_path}/m").first().ok


def test_envelope_and_freshness(spark, tmp_path):
    value = writers.envelope(spark.createDataFrame([(1, None)], "id int, name string"), "2", "u", "2024-01-01").first().value
    assert json.loads(value) == {"meta": {"generated_at": "2024-01-01", "source_url": "u", "scraper_version": "2", "count": 1}, "data": [{"id": 1, "name": None}]}
    put(tmp_path / "in/a.json", value)
    files = records.envelopes(spark, f"file://{tmp_path}/in", RECORD).withColumn("bytes", F.lit(10))
    r = writers.freshness(files, F.lit("x")).first()
    assert (r.files, r.bytes, r.records, r.versions) == (1, 10, 1, ["2"])


def test_row_ids_keep_null_parts_apart(spark):
    r = spark.range(1).select(text.row_id(F.lit("a"), F.lit(None), F.lit("b")).alias("x"), text.row_id(F.lit("a"), F.lit("b")).alias("y")).first()
    assert r.x != r.y


@pytest.mark.parametrize("written,plain", [("Kovács Győző", "Kovacs Gyozo"), ("Černý", "Cerny"), ("Ștefan Ţ", "Stefan T")])
def test_fold(spark, written, plain):
    assert spark.range(1).select(text.fold(F.lit(written)).alias("x")).first().x == plain


def test_entities_of_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(entities.entities(F.col("t")).alias("e")).collect()
    assert all(r.e.item_type is None and not r.e.flags and r.e.subject is None for r in rows)


def test_facets_and_positions(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["a"], "y"), (3, None, "x")], "id int, tags array<string>, kind string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(facets.facet_filter(rows, all_of={"tags": ["a", "b"]})) == [1]
    assert ids(facets.facet_filter(rows, any_of={"tags": ["b", "z"], "kind": []})) == [1]
    assert ids(facets.facet_filter(rows, search=(["kind"], "X"))) == [1, 3]
    assert {(r.dim, r.value): r.n for r in facets.facet_counts(rows, ["tags", "kind"]).collect()} == {("tags", "a"): 2, ("tags", "b"): 1, ("kind", "x"): 2, ("kind", "y"): 1}
    values = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, None)], "v double")
    assert sorted((r.v, r.below, r.total) for r in ranking.below_all(values, "v", "below").where("v is not null").collect()) == [(1.0, 0, 4), (2.0, 1, 4), (3.0, 2, 4), (3.0, 2, 4)]


def test_either_key_takes_the_smallest_hit(spark):
    rows = spark.createDataFrame([(1, 5, 3), (2, 3, 3), (3, 9, 8)], "row int, a int, b int")
    side = spark.createDataFrame([(3, "x"), (5, "y")], "k int, v string")
    assert sorted(tuple(r) for r in joins.either_key(rows, ["a", "b"], side, "k", ["row", "a", "b"]).select("row", "k", "v").collect()) == [(1, 3, "x"), (2, 3, "x")]


def test_initiators(spark):
    r = spark.range(1).select(mappings.initiator_parties(F.lit("2 deputati - PSD: A; 1 senatori - PSD: B")).alias("p")).first()
    assert r.p == ["PSD"]


def test_streaming_upsert(spark, tmp_path):
    from tessera.sources import partitions
    from tessera.streaming.upserts import append_once

    schema = "vote_id long, title string, day string"

    def call(name, *rows):
        put(tmp_path / f"in/{name}.json", "\n".join(json.dumps({"vote_id": k, "title": v, "day": d}) for k, v, d in rows))
        append_once(spark, f"file://{tmp_path}/in", schema, "vote_id", "day", f"file://{tmp_path}/out", f"file://{tmp_path}/state")

    call(1, (1, "a", "d1"), (1, "b", "d1"), (3, None, None))
    call(2, (1, "again", "d1"), (2, "b", "d2"), (2, "c", "d2"), (3, "new", "d3"))
    call(3)
    assert sorted(tuple(r) for r in partitions.read(spark, f"file://{tmp_path}/out", schema).collect()) == [(1, "a", "d1"), (2, "b", "d2"), (3, None, "unknown")]
