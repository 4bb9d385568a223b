"""Elements of HTML pages as rows: a stack of open elements, so nested tables and unclosed cells are read as browsers do.

Pages go through tasks in Arrow batches; a page's elements leave as rows, and
records are put together from them by joins and groupings.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fields, mappings
from tessera.functions.dates import day_first_date
from tessera.functions.text import strip

# --- Fixed values: elements without an end, and which open elements a new one ends. ---
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
TABLE = ("table", "tbody", "thead", "tfoot")
#: Open elements that the end of others doesn't go beyond, but for that of some.
CELLS, CELL_ENDS, TABLE_ENDS = ("td", "th", "table"), frozenset(("td", "th", "tr", "body", "html", *TABLE)), frozenset(("table", "body", "html"))
#: Of a new element: the open ones that it ends, and where the search for them stops.
ENDS = {tag: ({"p"}, {"td", "th", "table", "button", "html"}) for tag in BLOCKS} | {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, set(TABLE)),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}),
}
#: A comment, a declaration, or a tag: the slash of one that ends, its name, the name again if text follows that isn't markup (which is passed over), and what it says.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)((?<!/)((?i:script|style))(?![a-zA-Z0-9])|[a-zA-Z][a-zA-Z0-9]*)((?:[^>"']++|"[^"]{0,9999}"|'[^']{0,9999}')*+)>(?(3).*?(?=</(?i:\3)|\Z))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

SCHEMA = "ord int, parent int, tag string, path string, attributes map<string,string>, text string"
_ROWS = 20_000


def _resolver(references: Sequence[str] | None) -> Callable[[str], str]:
    """Resolves the named references that end in a semicolon; by default all, as browsers do."""
    if references is None:
        return entities.unescape
    named = re.compile("&(" + "|".join(map(re.escape, references)) + ");")
    return lambda text: named.sub(lambda m: entities.unescape(m[0]), text)


def read(page: str, tags: frozenset[str] | None = None, references: Sequence[str] | None = None) -> Iterator[tuple]:
    """Elements of the tags (all by default) as they end: place, place of the nearest such element around, tag, path, attributes, text.

    Text is that of the element and all within it, with single spaces between
    pieces, and without scripts and styles. What a page leaves open ends where the page does.
    With ``references`` only those names are resolved, and only with their semicolon.
    """
    unescape = _resolver(references)
    parts = TAG.split(page)
    texts, names, rests = parts[::5], tuple(parts[2::5]), parts[4::5]
    build = _build if len(names) <= _BUILD_TAGS else _build.__wrapped__
    for place, around, tag, path, start, end in build(tuple(parts[1::5]), names, tuple([bool(r) and r.endswith("/") for r in rests]), tags):
        attributes: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(rests[start]):
            attributes.setdefault(a[1].lower(), unescape(next((v for v in a.groups()[1:] if v is not None), "")))
        text = " ".join(texts[start + 1 : end + 1])
        yield place, around, tag, path, attributes, " ".join((unescape(text) if "&" in text else text).split())


#: Tags of a page whose build is kept, and how many builds: pages of one template share it.
_BUILD_TAGS, _BUILDS = 1000, 256


@lru_cache(_BUILDS)
def _build(closings: tuple, names: tuple, alone: tuple, tags: frozenset[str] | None) -> list[tuple]:
    """Elements of a page from its tags alone, as they end: place, place around, tag, path, and the numbers of the tags at which they start and end.

    Of each tag: its slash if it ends, its name (null for what isn't one), and whether a slash closes it.
    """
    out: list[tuple] = []
    open_: list[str] = []
    held: list[tuple[int, int] | None] = []  # place and tag of open elements that are wanted
    seen = 0

    def ended(down_to: int, at: int) -> None:
        while len(open_) > down_to:
            element = held.pop()
            if element is not None:
                around = next((x[0] for x in reversed(held) if x is not None), None)
                out.append((element[0], around, open_[-1], "/".join(open_), element[1], at))
            open_.pop()

    for at, (closing, name, closed) in enumerate(zip(closings, names, alone, strict=True)):
        if name is None:
            continue
        tag = name.lower()
        if closing:
            limit = -1
            for k in range(len(open_) - 1, -1, -1):
                around = open_[k]
                if around == tag:
                    limit = k
                    break
                if around in CELLS and tag not in CELL_ENDS or around == "table" and tag not in TABLE_ENDS:
                    break
            if limit >= 0:
                ended(limit, at)
            continue
        ending, stops = ENDS.get(tag, ((), ()))
        limit = len(open_)
        for k in range(len(open_) - 1, -1, -1):
            if open_[k] in ending:
                limit = k
            if open_[k] in stops:
                break
        ended(limit, at)
        wanted = tags is None or tag in tags
        open_.append(tag)
        held.append((seen, at) if wanted else None)
        seen += wanted
        if tag in VOID or closed:
            ended(len(open_) - 1, at)
    ended(0, len(names))
    return out


def _columns(found: list[tuple]) -> list[pa.Array]:
    """Elements as columns of Arrow, in the order of ``SCHEMA``."""
    place, around, tag, path, attributes, text = zip(*found, strict=True) if found else ((),) * 6
    ends = np.cumsum([0, *map(len, attributes)])
    held = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for a in attributes for k in a], pa.string()), pa.array([v for a in attributes for v in a.values()], pa.string()))
    return [pa.array(place, pa.int32()), pa.array(around, pa.int32()), pa.array(tag, pa.string()), pa.array(path, pa.string()), held, pa.array(text, pa.string())]


def elements(pages: DataFrame, key: str, html: str, tags: Sequence[str] | None = None, references: Sequence[str] | None = None) -> DataFrame:
    """``key`` and ``ord, parent, tag, path, attributes, text`` of the elements of each page.

    ``ord`` numbers a page's elements of the tags in the order in which they
    start, ``parent`` is that of the nearest one around. Null and empty pages have
    none; pages that repeat a key have theirs each. ``references`` as in ``read``.
    """
    wanted = frozenset(tags) if tags else None
    kind = pages.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "ord", "parent", "tag", "path", "attributes", "text"]
        for batch in batches:
            keys, found, held = batch.column(0), [], []
            out = lambda: pa.RecordBatch.from_arrays([keys.take(pa.array(held, pa.int32())), *_columns(found)], names)  # noqa: B023, E731
            for i, page in enumerate(batch.column(1).to_pylist()):
                for x in read(page or "", wanted, references):
                    found.append(x)
                    held.append(i)
                if len(found) > _ROWS:
                    yield out()
                    found, held = [], []
            yield out()

    return pages.select(F.col(key).alias(key), F.col(html).alias("_html")).mapInArrow(rows, f"`{key}` {kind}, {SCHEMA}")


def element_lists(pages: DataFrame, key: str, html: str, tags: Sequence[str] | None = None) -> DataFrame:
    """``key, found``: of each page with elements of the tags, all of them (``ord, parent, tag, path, attributes, text``) as they end, so nothing has to bring them together."""
    wanted = frozenset(tags) if tags else None
    kind = pages.schema[key].dataType.simpleString()
    names = ["ord", "parent", "tag", "path", "attributes", "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays(_columns(found), names))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held, pa.int32())), lists], [key, "found"])

        for batch in batches:
            found: list[tuple] = []
            held: list[int] = []
            sizes: list[int] = []
            for i, page in enumerate(batch.column(1).to_pylist()):
                before = len(found)
                found.extend(read(page or "", wanted))
                if len(found) > before:
                    held.append(i)
                    sizes.append(len(found) - before)
                if len(found) > _ROWS:
                    yield out()
                    found, held, sizes = [], [], []
            yield out()

    return pages.select(F.col(key).alias(key), F.col(html).alias("_html")).mapInArrow(rows, f"`{key}` {kind}, found array<struct<ord:int,parent:int,tag:string,path:string,attributes:map<string,string>,text:string>>")


def table_cells(found: DataFrame, key: str) -> DataFrame:
    """``key, row, cells``: each table row with its own cells in order, of nested tables as rows of their own.

    ``found`` holds elements of at least ``tr``, ``td`` and ``th``. A cell is
    ``text, tag, attributes``.
    """
    cells = found.where(F.col("tag").isin("td", "th")).select(key, F.col("parent").alias("row"), F.struct("ord", "text", "tag", "attributes").alias("c"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("c.ord"), F.col("c.text"), F.col("c.tag"), F.map_entries("c.attributes").alias("a"))))
    shown = F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["tag"].alias("tag"), F.map_from_entries(x["a"]).alias("attributes")))
    return cells.where("row is not null").groupBy(key, "row").agg(shown.alias("cells"))


#: Titles of motions are longer than this, and links that name members.
TITLE_OVER, NOT_TITLES, MEMBER_LINK, NO_TITLE = 30, ("camera deputatilor", "camera deputaților"), "structura2015.mp", "(fără titlu)"


#: Labels of a motion's fields, and within how many characters each ends.
MOTION_FIELDS = {
    "kind": (50, "Tip"),
    "initiators": (200, "Inițiatori", "Iniţiatori"),
    "registered": (100, "Nr./Data înregistrării", "Nr./Data inregistrarii"),
    "voted": (50, "Data votului", "Data vot"),
    "yes": (20, "Voturi pentru moțiunii", "Voturi pentru moţiunii", "Voturi pentru"),
    "no": (20, "Voturi împotriva moțiunii", "Voturi impotriva motiunii", "Voturi împotrivă"),
    "abstentions": (20, "Abțineri", "Abţineri"),
    "outcome": (60, "Rezultat"),
    "signatures": (30, "Semnături", "Semnatari"),
}


def motion_records(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """A motion's page as a record: ``title, kind, initiators, nr, registered, voted, yes, no, abstentions, outcome, signatures, signatories, pdf, summary``.

    The title is the longest heading or summary, of equally long ones the first.
    A page's own text gives the labelled fields. A page is read where its row
    is and its elements stay together; pages that repeat a key have a record
    each. Each label is looked for once: what follows it is a column of its own
    before anything is made of it.
    """
    found = element_lists(pages, key, html, ["body", "h1", "h2", "h3", "meta", "a"])
    of = lambda fits, shown: F.transform(F.filter("found", fits), shown)
    described = lambda x: (x["tag"] == "meta") & (x["attributes"]["property"] == "og:description")
    content = lambda x: F.trim(x["attributes"]["content"])
    headline = lambda x: F.when(x["tag"].isin("h1", "h2", "h3"), x["text"]).otherwise(content(x))
    is_title = lambda x: (x["tag"].isin("h1", "h2", "h3") | described(x)) & (F.length(headline(x)) > TITLE_OVER) & ~F.lower(headline(x)).isin(*NOT_TITLES)
    link = lambda x: x["attributes"]["href"]
    member = lambda x: (x["tag"] == "a") & F.contains(link(x), F.lit(MEMBER_LINK)) & F.contains(link(x), F.lit("idm=")) & (F.length(x["text"]) > 3)
    read_ = found.select(
        key,
        F.array_max(of(is_title, lambda x: F.struct(F.length(headline(x)), x["tag"] == "meta", -x["ord"], headline(x).alias("text"))))["text"].alias("title"),
        F.array_max(of(lambda x: x["tag"] == "body", lambda x: x["text"])).alias("body"),
        F.array_sort(of(member, lambda x: F.struct(x["ord"], x["text"].alias("text")))).alias("members"),
        F.array_min(of(lambda x: (x["tag"] == "a") & link(x).endswith(".pdf"), lambda x: F.struct(x["ord"], F.when(link(x).startswith("http"), link(x)).otherwise(F.concat(F.lit(base), link(x))).alias("pdf"))))["pdf"].alias("pdf"),
        F.array_min(of(described, lambda x: F.struct(x["ord"], content(x).alias("text"))))["text"].alias("summary"),
    )
    labels = [(f"_{name}_{k}", label, most) for name, (most, *of_name) in MOTION_FIELDS.items() for k, label in enumerate(of_name)]
    followed = read_.select(key, "title", "members", "pdf", "summary", *[fields.labelled_text(F.col("body"), label, fields.MOTION_LABELS, most).alias(name) for name, label, most in labels])
    field = {name: F.coalesce(*[strip(F.nullif(F.col(f"_{name}_{k}"), F.lit(""))) for k in range(len(of_name) - 1)]) for name, of_name in MOTION_FIELDS.items()}
    told = followed.select(key, "title", "members", "pdf", "summary", *[c.alias(f"_{name}") for name, c in field.items()])
    registered = fields.number_and_day(F.col("_registered"))
    return told.select(
        key,
        F.coalesce(F.substring("title", 1, 500), F.lit(NO_TITLE)).alias("title"),
        mappings.motion_type(F.coalesce("_kind", F.lit("simpla"))).alias("kind"),
        F.col("_initiators").alias("initiators"),
        registered["nr"].alias("nr"),
        registered["day"].alias("registered"),
        day_first_date(F.col("_voted")).alias("voted"),
        *[fields.leading_number(F.col(f"_{name}")).alias(name) for name in ("yes", "no", "abstentions")],
        mappings.motion_outcome(F.col("_outcome")).alias("outcome"),
        fields.leading_number(F.col("_signatures")).alias("signatures"),
        F.array_distinct(F.transform("members", lambda x: x["text"])).alias("signatories"),
        "pdf",
        "summary",
    )
