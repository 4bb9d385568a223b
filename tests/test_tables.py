"""Selection, partition upserts, look-back streams, expectations, ordered documents, rules and marker indexes."""

import json
import os
import random
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import declarations, entities, fields, interests, markers, rules, text
from tessera.operators import aggregates, expectations, joins, ranking, selection
from tessera.sources import documents, partitions
from tessera.streaming import look_back

R = random.Random(3)


def groups():
    rows = [("hot", float(R.randint(-50, 2000))) for _ in range(3000)] + [(None, R.random()) for _ in range(40)] + [("few", 1.0), ("none", None), ("same", 5.0), ("same", 5.0)]
    R.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_quantiles_of_groups_and_of_all(spark, parts):
    rows = groups()
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = {"low": 0.0, "q": 0.25, "m": 0.5, "h": 0.9, "top": 1.0}
    out = {r.g: r for r in selection.quantiles(df, ["g"], "v", shares, parts).collect()}
    for g in ("hot", None, "few", "same"):
        values = [v for k, v in rows if k == g]
        assert out[g].n == len(values)
        assert [out[g][n] for n in shares] == pytest.approx([np.quantile(values, q) for q in shares.values()])
    assert "none" not in out
    every = [v for _, v in rows if v is not None]
    assert selection.quantiles(df, [], "v", {"m": 0.5}, parts).first().m == pytest.approx(np.quantile(every, 0.5))
    none = df.where("v > 1e9")
    assert tuple(selection.quantiles(none, [], "v", {"m": 0.5}, parts).first()) == (None, None)
    assert selection.quantiles(none, ["g"], "v", {"m": 0.5}, parts).collect() == []


def test_positions_in_groups(spark):
    rows = groups()
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for r in selection.with_positions(df, ["g"], "v", parts=7).collect():
        same = [v for k, v in rows if k == r.g and v is not None]
        want = (None, None, None) if r.v is None else (sum(v < r.v for v in same), sum(v > r.v for v in same), len(same))
        assert (r.below, r.above, r.n) == want
    few = spark.createDataFrame([("x", 50), ("x", 100), ("x", 300), (None, 5), ("y", None)], "g string, v int")
    out = {(r.g, r.v): (r.in_pct, r.in_rank, r.in_n) for r in ranking.context(few, "v", {"in": ["g"]}).collect()}
    assert out == {("x", 50): (0, 3, 3), ("x", 100): (33, 2, 3), ("x", 300): (67, 1, 3), (None, 5): (None, None, None), ("y", None): (None, None, None)}


def test_no_task_orders_a_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 20_000).cast("double").alias("v"))
    plan = selection.quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan.lower()
    stats = aggregates.group_stats(df, ["g"], "v", {"m": 0.5}, most=F.max("v")).first()
    assert (stats.n, stats.m, stats.most) == (20_000, 9_999.5, 19_999.0)


ROW = "k long, v string, year string"


def stored(spark, path):
    return sorted(tuple(r) for r in partitions.read(spark, path, ROW).collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-") and "_staged" not in d}


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, ROW)
    partitions.upsert(spark, path, make([(k, "a", str(2000 + k % 4)) for k in range(40)]), ["k"], "year")
    before = files_of(tmp_path / "t")
    partitions.upsert(spark, path, make([(1, "b", "2001"), (5, None, "2003"), (99, "new", "2009")]), ["k"], "year")
    after = files_of(tmp_path / "t")
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("year=")[1][:4] for f in kept} == {"2000", "2002"} and {f.split("year=")[1][:4] for f in after.keys() - kept} == {"2001", "2003", "2009"}
    want = {k: (k, "a", str(2000 + k % 4)) for k in range(40)} | {1: (1, "b", "2001"), 5: (5, None, "2003"), 99: (99, "new", "2009")}
    assert stored(spark, path) == sorted(want.values())
    partitions.upsert(spark, path, make([(1, "old wins", "2001"), (100, "c", "2000")]), ["k"], "year", keep_old=True)
    partitions.upsert(spark, path, make([]), ["k"], "year")
    partitions.upsert(spark, path, make([(99, "moved", "2001")]), ["k"], "year")
    assert stored(spark, path) == sorted((want | {100: (100, "c", "2000"), 99: (99, "moved", "2001")}).values())
    assert not os.path.exists(tmp_path / "t/year=2009") and not os.path.exists(tmp_path / "t/_pending")
    assert stored(spark, f"file://{tmp_path}/none") == []


def test_an_upsert_that_broke_off_is_carried_out(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    partitions.upsert(spark, path, spark.createDataFrame([(1, "a", "2001"), (2, "a", "2002")], ROW), ["k"], "year")
    replace = partitions._replace
    monkeypatch.setattr(partitions, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    new = spark.createDataFrame([(1, "b", "2003")], ROW)
    with pytest.raises(RuntimeError):
        partitions.upsert(spark, path, new, ["k"], "year")
    monkeypatch.setattr(partitions, "_replace", replace)
    assert stored(spark, path) == [(1, "b", "2003"), (2, "a", "2002")]
    assert not partitions.recover(spark, path)
    monkeypatch.setattr(partitions, "_noted", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        partitions.upsert(spark, path, spark.createDataFrame([(2, "c", "2001")], ROW), ["k"], "year")
    assert stored(spark, path) == [(1, "b", "2003"), (2, "a", "2002")]


def test_look_back_keeps_the_newest_version(spark, tmp_path):
    schema = "k long, version int, at timestamp, v string"
    (tmp_path / "in").mkdir()
    state, out, source = (f"file://{tmp_path}/{n}" for n in ("state", "out", "in"))

    def put(name, rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"k": k, "version": v, "at": f"2024-01-{d:02}T10:00:00Z", "v": x}) for k, v, d, x in rows))
        look_back.keep_latest(spark, source, schema, "k", "at", "version", 5, out, state)

    def held():
        return {r.k: (r.version, r.v, r.day) for r in partitions.read(spark, out, f"{schema}, day string").collect()}

    put("a", [(1, 1, 1, "x"), (2, 1, 1, "y"), (1, 1, 1, "x")])
    put("b", [(1, 2, 1, "x2"), (3, 1, 3, "z")])
    put("c", [(1, 1, 1, "older"), (4, 1, 4, "w")])
    assert held() == {1: (2, "x2", "2024-01-01"), 2: (1, "y", "2024-01-01"), 3: (1, "z", "2024-01-03"), 4: (1, "w", "2024-01-04")}
    put("d", [(5, 1, 20, "late")])
    put("e", [(2, 9, 1, "too old"), (5, 2, 20, "new")])
    assert held()[2] == (1, "y", "2024-01-01") and held()[5] == (2, "new", "2024-01-20")


def test_expectations(spark):
    df = spark.createDataFrame([(1, "PSD x", [1], 5.0, "a"), (2, "", [], 0.0, "a"), (2, None, None, None, ""), (4, "ZZ", [2], 900.0, "b")], "id int, party string, l array<int>, v double, name string")
    x = expectations
    rules_ = [x.Filled("party", 0.5), x.Filled("l", 0.6), x.Filled("v", 0.5), x.Known("party", ("PSD",)), x.Between("v", 0, 100), x.Between(None, 1, 3), x.Stated(4), x.Stated(None), x.Unique(("id",)), x.Unique(("name",), True, x.WARNING), x.Unique(("id", "name"))]
    out = [(r.rule, r.severity, r.figure, r.ok) for r in x.check(df, rules_).collect()]
    assert out == [
        ("filled:party", "error", 0.5, True), ("filled:l", "error", 0.5, False), ("filled:v", "error", 0.5, True), ("known:party", "warning", 1.0, False), ("between:v", "error", 1.0, False), ("between:rows", "error", 4.0, False),
        ("stated:rows", "error", 0.0, True), ("stated:rows", "error", None, False), ("unique:id", "error", 1.0, False), ("unique:name", "warning", 1.0, False), ("unique:id+name", "error", 0.0, True),
    ]
    empty = x.check(df.limit(0), rules_).collect()
    assert [r.ok for r in empty if r.rule.startswith(("filled", "unique"))] == [True] * 6


def test_documents_are_cut_and_parse(spark, tmp_path):
    path = f"file://{tmp_path}/site"
    urls = spark.range(120_000).select(F.concat(F.lit("https://x.org/?a&b="), F.lpad(F.col("id").cast("string"), 6, "0")).alias("loc"), F.when(F.col("id") % 2 == 0, "2024-01-01").alias("lastmod"), F.lit("0.5").alias("priority")).repartition(7)
    made = documents.site_map(urls, path, "https://x.org")
    assert [m.rsplit("/", 1)[1] for m in made] == ["sitemap-0.xml", "sitemap-1.xml", "sitemap-2.xml", "sitemap.xml"]
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    locs = [u.find(f"{space}loc").text for k in range(3) for u in ET.parse(tmp_path / f"site/sitemap-{k}.xml").getroot()]
    assert locs == [f"https://x.org/?a&b={k:06}" for k in range(120_000)]
    assert [u[0].text for u in ET.parse(tmp_path / "site/sitemap.xml").getroot()] == [f"https://x.org/sitemap-{k}.xml" for k in range(3)]
    rows = spark.range(11).select("id", F.when(F.col("id") > 3, F.lit('é "q"')).alias("t"))
    documents.envelopes(rows, [F.col("id")], path, {"generated_at": "2024-01-01"}, 4)
    read = [json.loads((tmp_path / f"site/envelope-{k}.json").read_text()) for k in range(3)]
    assert [x["id"] for e in read for x in e["data"]] == list(range(11)) and read[0]["meta"] == {"generated_at": "2024-01-01", "count": 11}
    documents.json_feed(rows.select(F.to_json(F.struct("id")).alias("value"), "id").limit(0), [F.col("id")], path, "https://x.org", "None & <none>")
    assert json.loads((tmp_path / "site/feed-0.json").read_text())["items"] == []
    documents.atom_feed(rows.select(F.lit("<entry><id>1</id></entry>").alias("value"), "id"), [F.col("id")], path, "https://x.org", "A & b", "2024-01-01T00:00:00Z")
    assert len(ET.parse(tmp_path / "site/feed-0.atom").getroot().findall("{http://www.w3.org/2005/Atom}entry")) == 11


def test_map_by_key_prefers_the_first_text(spark):
    bills = spark.createDataFrame([(1, "PL-x 12/2024", "x 34/2023"), (2, "PL-x 99/2024", "x 34/2023"), (3, None, "x 34/2023"), (4, "none", ""), (5, "", None)] + [(k, "PL-x 12/2024", None) for k in range(10, 40)], "id long, a string, b string")
    votes = spark.createDataFrame([(7, "on 12/2024"), (3, "on 12/2024 again"), (9, "34/2023"), (1, None), (2, "no number")], "vote long, title string")
    out = {r.id: (r.key, r.hit.vote if r.hit else None) for r in joins.map_by_key(bills, ["a", "b"], r"(\d{2,4}/\d{4})", ["id"], votes, "title", ["vote"], hot=4).collect()}
    assert out == {1: ("12/2024", 3), 2: ("99/2024", None), 3: ("34/2023", 9), 4: (None, None), 5: (None, None)} | {k: ("12/2024", 3) for k in range(10, 40)}


def test_rules_fit_where_a_search_would(spark):
    phrases = ["Procedură de urgență", "xANCOM", "ANCOM", "ANPCx", "BNR", "Consiliul Economic și Social European", "Consiliul Economic  și\nSocial", "Băncii Naționale a României", "Camera decizională", "condițiile articolului 115", "csm", "leg", "Legea nr.", "Comisia Comisia Europeană"]
    texts = [" ".join(R.choices(phrases, k=R.randint(0, 9))) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for table in (entities.FLAGS, entities.INSTITUTIONS, entities.ACTIONS):
        ci = [(rules.ANY_CASE + p, label) for p, label in table]
        both = lambda places: F.struct(rules.labels(places, table).alias("all"), rules.first_label(places, table).alias("first"))  # noqa: B023, E731
        for r in rows.select(text.bound(rules.candidates(F.col("t"), table), both).alias("x"), text.all_rules(F.coalesce("t", F.lit("")), ci).alias("y"), text.first_rule(F.coalesce("t", F.lit("")), ci).alias("z")).collect():
            assert r.x["all"] == r.y and r.x["first"] == r.z


def test_marker_index(spark):
    marks = markers.quoted("I. A", "II. A", "1. x")
    row = spark.createDataFrame([("0 II. A two 1. x in II. A again I. A one",), (None,), ("no heading",)], "t string")
    parts = lambda c: markers.marker_index(c, marks)
    out = row.select(
        markers.text_of(markers.part(parts(F.col("t")), "II. A", ["I. A", "II. A"])).alias("second"),
        markers.text_of(markers.part(parts(F.col("t")), "I. A", ["II. A"])).alias("inner"),
        markers.text_of(markers.part(markers.part(parts(F.col("t")), "II. A", ["II. A"]), "1. x", [])).alias("nested"),
        markers.text_of(markers.part(parts(F.col("t")), "1. x", ["none"], closed=True)).alias("closed"),
    ).collect()
    assert tuple(out[0]) == ("II. A two 1. x in ", "I. A two 1. x in ", "1. x in ", "")
    assert tuple(out[1]) == tuple(out[2]) == ("", "", "", "")


def test_records_of_odd_texts(spark):
    long = "VII. Venituri\n1.1. Titular\n" + "Firma 1.000 RON\n" * 3000
    df = spark.createDataFrame([(None,), ("",), ("x" * 99,), ("x" * 120,), (long,)], "t string")
    wealth = [r.w for r in df.select(declarations.wealth_record(F.col("t")).alias("w")).collect()]
    assert [w.readable for w in wealth] == [False, False, False, True, True] and all(w.net_worth == 0 for w in wealth[:4])
    assert wealth[4].income == wealth[4].own_income == 3_000_000.0
    held = [r.i for r in df.select(interests.interests(F.col("t")).alias("i")).collect()]
    assert [i.holds_any for i in held] == [False] * 5 and held[0].companies == []
    member = df.select(fields.member_record(F.col("t"), F.lit("Pop  Ana")).alias("m")).first().m
    assert (member.family_name, member.given_name, member.committees, member.party) == ("Pop", "Ana", [], None)


def test_first_per_key(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (1, 3, "a"), (2, None, "c")], "k int, o int, v string")
    out = ranking.first_per_key(rows, ["k"], [F.asc_nulls_last("o"), F.asc("v")]).collect()
    assert sorted((r.k, r.v) for r in out) == [(1, "a"), (2, "c")]
