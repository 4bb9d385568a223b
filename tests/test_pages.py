"""HTML elements, nested and broken pages, lists in blocks, and the queries' registry."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, joins, lists
from tessera.plans import base, registry
from tessera.sources import html

R = random.Random(8)


def flat(page, tags=None):
    return sorted((place, around, tag, path, text) for place, around, tag, path, _, text in html.read(page, tags))


def test_nested_tables_and_unclosed_cells():
    page = "<table><tr><td>a<td><table><tr><td>b<tr><th>c</table> d<tr><td>e</table>"
    cells = [(tag, around, text) for _, around, tag, _, text in flat(page, frozenset({"tr", "td", "th"}))]
    assert cells == [("tr", None, "a b c d"), ("td", 0, "a"), ("td", 0, "b c d"), ("tr", 2, "b"), ("td", 3, "b"), ("tr", 2, "c"), ("th", 5, "c"), ("tr", None, "e"), ("td", 7, "e")]


def test_broken_pages():
    assert flat("") == [] and flat("text only") == [] and flat("a < b > c &amp; d") == []
    assert flat("<p>one<p>two <b>bold<p>three") == [(0, None, "p", "p", "one"), (1, None, "p", "p", "two bold"), (2, 1, "b", "p/b", "bold"), (3, None, "p", "p", "three")]
    assert flat("<div></span><br><br/>x</p></div></div>")[0] == (0, None, "div", "div", "x")
    assert flat('<script>if (a < b) { "<p>" }</script><p>&lt;p&gt;')[1][-1] == "<p>"
    assert flat("<!-- <p> --><!DOCTYPE html><ul><li>1<li>2<ul><li>3</ul></ul>", frozenset({"li"})) == [(0, None, "li", "ul/li", "1"), (1, None, "li", "ul/li", "2 3"), (2, 1, "li", "ul/li/ul/li", "3")]
    assert flat("<style>p{}")[0][-1] == "" and flat("<!-- open") == []
    found = list(html.read("<a href='x?a=1&amp;b' Checked data-k=v href=second>t</a>"))
    assert found[0][4] == {"href": "x?a=1&b", "checked": "", "data-k": "v"}


def balanced(depth):
    """A random page without omitted ends, and its elements as a plain recursion lists them."""
    found = []

    def build(level, around, path):
        tag, place = R.choice(["div", "span", "b", "section"]), len(found)
        found.append(None)
        words, inner = [f"w{place}"], f"w{place}"
        for _ in range(R.randint(0, 3) if level < depth else 0):
            markup, text = build(level + 1, place, f"{path}{tag}/")
            inner += markup
            words += text
        found[place] = (place, around, tag, f"{path}{tag}", " ".join(words))
        return f"<{tag}>{inner}</{tag}>", words

    return build(0, None, "")[0], found


def test_balanced_pages_against_a_recursion():
    for _ in range(60):
        page, want = balanced(5)
        assert flat(page) == want


def test_elements_of_many_pages(spark, monkeypatch):
    pages = [(i, *balanced(4)) for i in range(40)]
    rows = [(i, p, "x") for i, p, _ in pages] + [(99, None, "x"), (98, "", "x"), (0, pages[0][1], "again")]
    monkeypatch.setattr(html, "_ROWS", 7)
    df = spark.createDataFrame(rows, "ord2 long, html string, text string").repartition(3)
    out = html.elements(df, "ord2", "html").collect()
    want = [(i, *x) for i, _, found in pages for x in found] + [(0, *x) for x in pages[0][2]]
    assert sorted((r.ord2, r.ord, -1 if r.parent is None else r.parent, r.tag, r.path, r.text) for r in out) == sorted((i, o, -1 if a is None else a, t, p, x) for i, o, a, t, p, x in want)
    assert html.elements(df.limit(0), "ord2", "html", ["b"]).count() == 0
    rec = html.motion_records(spark.createDataFrame([(1, "<body>nothing"), (2, None)], "k int, page string"), "k", "page", "b").collect()
    assert [(r.k, r.title, r.kind, r.signatories) for r in rec] == [(1, "(fără titlu)", "simpla", [])]


def test_lists_in_blocks(spark):
    rows = [("hot", R.randint(0, 50), i) for i in range(2500)] + [("few", 1, 1), ("few", 0, None), (None, 3, 9), (None, 2, 8)]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    blocked = lists.blocks(df, ["k"], ["o", "v"], F.col("v"), "vs", 100).cache()
    assert max(len(r.vs) for r in blocked.collect()) == 100 and blocked.where("k = 'hot'").count() >= 25
    out = {r.k: r.vs for r in lists.whole(blocked, ["k"], "vs").collect()}
    for k in ("hot", "few", None):
        assert out[k] == [v for _, v in sorted(((o, v) for g, o, v in rows if g == k), key=lambda x: (x[0], -1 if x[1] is None else x[1]))]
    parents = spark.createDataFrame([("hot",), ("none",)], "k string")
    joined = lists.joined_to(parents, blocked, "k", "vs").groupBy("k").agg(F.sum(F.size("vs")).alias("n"))
    assert {r.k: r.n for r in joined.collect()} == {"hot": 2500, "none": 0}
    merged = joins.merge_repeated(df.withColumn("c", F.array("v", "o")), "k", "o", ["o"], "c", 50)
    assert {r.k: (r.o, r.n) for r in merged.groupBy("k").agg(F.first("o").alias("o"), F.sum(F.size("c")).alias("n")).collect()}["hot"] == (0, 5000)
    team = spark.createDataFrame([("t", "a", "president", 1), ("t", "b", None, 2), ("t", "c", "x", 3), ("t", "b", "president", 9), ("u", "z", "president", 1)], "g string, name string, role string, at int")
    assert sorted((r.g, r.chair, r.members) for r in aggregates.roster(team, "g", "name", "role", "at", size=1).collect()) == [("t", "a", ["b"]), ("t", "a", ["c"]), ("u", "z", [])]


def test_two_queries_of_one_name_are_refused():
    with pytest.raises(ValueError):
        base.query()(registry.rate_by_group)


def test_pages_of_one_build_share_it(monkeypatch):
    page = lambda x: f"<ul><li>{x} &amp; 1<li><a href='{x}?a&amp;b'>{x}</a><script>'<li>'</script> end</ul><br/>"
    html._build.cache_clear()
    for x in ("one", "two  words", " ", "a&b"):
        shown = " ".join(x.split())
        assert [(tag, a, text) for _, _, tag, _, a, text in html.read(page(x), frozenset({"li", "a"}))] == [("li", {}, " ".join(f"{shown} & 1".split())), ("a", {"href": f"{x}?a&b"}, shown), ("li", {}, f"{shown} end".strip())]
    assert html._build.cache_info().misses == 1
    many = [tuple(x) for x in html.read("<p>x" * 30)]
    html._build.cache_clear()
    monkeypatch.setattr(html, "_BUILD_TAGS", 29)
    assert list(html.read("<p>x" * 30)) == many and html._build.cache_info().currsize == 0


def test_motions_are_read_without_a_shuffle(spark):
    page = lambda n: f'<head><meta property="og:description" content=" s{n} "></head><body><h1>A heading that is rather long, {n}</h1>Tip: simplă Voturi pentru: {n} Abțineri: x <a href=/{n}.pdf>f</a><a href="structura2015.mp?idm=1">Name {n}</a>'
    out = html.motion_records(spark.createDataFrame([(1, page(1)), (1, page(2)), (None, page(3)), (None, page(4))], "k int, page string"), "k", "page", "b")
    assert sorted((str(r.k), r.title[-1], r.kind, r.yes, r.abstentions, r.signatories, r.pdf, r.summary) for r in out.collect()) == [(k, str(n), "simpla", n, None, [f"Name {n}"], f"b/{n}.pdf", f"s{n}") for k, n in (("1", 1), ("1", 2), ("None", 3), ("None", 4))]
    assert "Exchange" not in out._jdf.queryExecution().toString()
