"""How far sources differ in their words: a split of terms that many groups have and terms that few have.

A group is a source of one language. Each kept term has a smoothed share in each
group, in parts of a thousand million; two groups differ by a sum over all
terms. Terms that many groups have ("heavy") fill dense tiles of groups by
terms. Of the others ("light") nearly all counts are zero: a sum over all light
terms as if each were in one of the two groups at most needs only how often each
share occurs in a group, and terms that both groups have are put right pair by
pair from the lists of their groups. All sums are of integers, so the parts add
up exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL, batched, discard, materialize, table, written_bytes

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: A term is heavy if more than one in so many groups of its language have it.
HEAVY = 4
#: Groups in a side of a tile, cells of a tile, rows of lists of groups in a block.
SIDE, CELLS, ROWS = 256, 1 << 16, 20_000
#: A tile has at least so many cells for each pair of its groups, so sums are far fewer than cells.
CELLS_A_PAIR = 8
#: A task's counts are sent on before they hold more bytes than this, an entry counted as so many, and texts above a length by it besides.
FLUSH_BYTES, ENTRY, LONG = 160 << 20, 200, 100_000
#: Occurrences and, in the lower bits, documents of a term in one number.
DOCS_BITS = 40
DOCS_MASK = (1 << DOCS_BITS) - 1
PAIRS = 1 << 20

#: Letters A-Z in lower case, other ASCII parts terms, bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``, and a row with an empty term for each group; counted by task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: defaultdict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            held = [len(c) for c in groups.values()]
            names = [pa.array(np.repeat(np.array([g[k] for g in groups], object), held), pa.string()) for k in (0, 1)]
            both = [x for c in groups.values() for x in c.values()]
            terms = pa.array([t for c in groups.values() for t in c], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*names, terms, pa.array([x >> DOCS_BITS for x in both], pa.int64()), pa.array([x & DOCS_MASK for x in both], pa.int64())], ["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = groups[a, b]
                group[b""] += 1
                before = len(group)
                for term, times in Counter(s.encode().translate(_TERMS).split()).items():
                    group[term] += (times << DOCS_BITS) + 1
                size += ENTRY * (len(group) - before) + (len(s) if len(s) > LONG else 0)
                if size > FLUSH_BYTES:
                    yield out()
                    groups.clear()
                    size = 0
        yield out()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "t"), (lang, "l"), (source, "s"))]
    parts = batched(docs).select(*plain).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), in decimals that don't overflow; 1 + SCALE if nothing is kept."""
    exact = [c.cast("decimal(24,0)") for c in (n, total, kept)]
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (exact[0] + 2), F.greatest(exact[1] + 2 * exact[2], F.lit(1)))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) in 64-bit integers: shares are at most SCALE + 1."""
    d = p - q
    return d * d // (p + q)


def _sided(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each tile that its group has part in: pairs of blocks of groups, the lower first."""
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    return df.select("*", other).withColumns({"low": F.least("side", "other").cast("int"), "high": F.greatest("side", "other").cast("int")}).select("lang", "low", "high", *keys)


_PAIR = "a long, b long, value long"


def _pairs(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


def _wanted(key: tuple, ids: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each pair of a tile once, smaller id first: within its block, or one from each of its two."""
    a, b = np.triu_indices(len(ids), 1)
    if key[1] != key[2]:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    return a, b


def _groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, side, floor = (t[c].to_numpy() for c in ("id", "side", "floor"))
    order = np.argsort(ids)
    return ids[order], side[order], floor[order]


def dense_tile(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of a tile's heavy terms, groups by terms in one array; terms a group hasn't have its floor."""
    ids, side, floor = _groups(groups)
    terms = rows["term"].combine_chunks().dictionary_encode()
    width = len(terms.dictionary)
    if not width:
        return _pairs(*np.zeros((3, 0), np.int64))
    shares = np.repeat(floor[:, None], width, axis=1)
    shares[np.searchsorted(ids, rows["id"].to_numpy()), terms.indices.to_numpy()] = rows["p"].to_numpy()
    first, second = _wanted(key, ids, side)
    value = np.zeros(len(first), np.int64)
    for k in np.unique(first):
        mine = first == k
        value[mine] = gap(shares[second[mine]], shares[k]).sum(axis=1)
    return _pairs(ids[first], ids[second], value)


def light_tile(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over all light terms of a pair as if no term were in both groups, from the shares that occur in each."""
    ids, side, floor = _groups(groups)
    light = int(groups["light"][0].as_py()) if len(groups) else 0
    both = gap(floor[:, None], floor[None, :])
    value = light * both
    at, p, n = np.searchsorted(ids, rows["id"].to_numpy()), rows["p"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(at, kind="stable")
    at, p, n = at[order], p[order], n[order]
    edges = np.searchsorted(at, np.arange(len(ids) + 1))
    for k in range(len(ids)):
        mine = slice(edges[k], edges[k + 1])
        more = (n[mine, None] * (gap(p[mine, None], floor[None, :]) - both[k])).sum(axis=0)
        value[k] += more
        value[:, k] += more
    first, second = _wanted(key, ids, side)
    return _pairs(ids[first], ids[second], value[first, second])


def corrections(rows: pa.Table) -> pa.Table:
    """What light terms that both groups of a pair have add to the sums of ``light_tile``."""
    term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    ids, p, floor = (rows[c].to_numpy() for c in ("id", "p", "floor"))
    order = np.lexsort((ids, term))
    term, ids, p, floor = term[order], ids[order], p[order], floor[order]
    total: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, value = (np.concatenate(c) for c in zip(*total, strict=True))
        by = np.lexsort((b, a))
        a, b, value = a[by], b[by], value[by]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return a[starts], b[starts], np.add.reduceat(value, starts)

    for step in range(1, len(term)):
        i = np.flatnonzero(term[step:] == term[:-step])
        if not len(i):
            break
        j = i + step
        value = gap(p[i], p[j]) - gap(p[i], floor[j]) - gap(floor[i], p[j]) + gap(floor[i], floor[j])
        total.append((ids[i], ids[j], value))
        waiting += len(i)
        if waiting > PAIRS:
            total[:] = [merged()]
            waiting = 0
    return _pairs(*(merged() if total else np.zeros((3, 0), np.int64)))


def _small(df: DataFrame) -> DataFrame:
    """A table of ``materialize``, broadcast if it is small as written."""
    return F.broadcast(df) if written_bytes(df) <= SMALL else df


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, heavy: int = HEAVY, side: int = SIDE, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each other source is, and which terms set a source apart.

    Part ``pair`` has each other source of the language with the sum over all
    terms that ``min_docs`` documents of the language have; part ``term`` the
    ``top`` terms that the source has more often than its language. Ties go by
    item in UTF-8 order. Null and empty values are the empty text: as a source or
    language of their own, as a text without terms. Rows that repeat an id are
    documents each; groups without terms and languages without kept terms have
    their pairs (at 0 where nothing is kept). Columns besides the three are not
    read, whatever their names. An empty table gives an empty result.

    No task holds a group or a language: terms are counted in tasks first, tiles
    are blocks of groups by blocks of terms whose number follows from their
    size, and the foremost terms are ranked in parts before they meet.
    """
    counted = materialize(term_counts(docs, text, lang, source), "counted")
    terms = counted.where("term <> ''")
    kept = materialize(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("spread")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    known = materialize(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "known")

    many = materialize(counted.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("groups")), "languages")
    is_heavy = F.col("spread") * heavy > F.col("groups")
    sizes = kept.join(_small(many), "lang").groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"), F.count_if(~is_heavy).alias("light"), F.count_if(is_heavy).alias("dense"), F.sum(F.when(~is_heavy, F.col("spread")).otherwise(0)).alias("listed")
    )
    langs = many.join(sizes, "lang", "left").na.fill(0, ["terms", "lang_total", "light", "dense", "listed"])
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    members = counted.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    blocks = {
        "floor": _share(F.lit(0), F.col("total"), F.col("terms")),
        "sides": F.greatest(F.ceil(F.col("groups") / side), F.lit(1)).cast("int"),
        "parts": F.greatest(F.ceil(F.col("dense") * F.col("groups") / F.greatest(F.lit(cells), CELLS_A_PAIR * F.pow(F.least("groups", F.lit(2 * side)), F.lit(2)))), F.lit(1)).cast("int"),
        "lists": F.greatest(F.ceil(F.col("listed") / rows), F.lit(1)).cast("int"),
    }
    groups = members.withColumns(blocks).withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int"))
    groups = materialize(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    discard(counted)

    joined = known.join(_small(groups), ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    shares = materialize(joined.select("lang", "source", "term", "id", "side", "sides", "parts", "lists", "floor", p.alias("p"), q.alias("q"), is_heavy.alias("heavy")), "shares")
    discard(known)

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    apart = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    tile = ("lang", "low", "high")
    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    dense = _sided(shares.where("heavy").withColumn("part", part), "part", "id", "term", "p")
    parted = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dense.groupBy(*tile, "part").cogroup(_sided(parted, "part", "id", "side", "floor").groupBy(*tile, "part")).applyInArrow(dense_tile, _PAIR)
    occurring = shares.where("NOT heavy").groupBy("lang", "id", "side", "sides", "p").agg(F.count(F.lit(1)).alias("n"))
    sums = _sided(occurring, "id", "p", "n").groupBy(*tile).cogroup(_sided(groups, "id", "side", "floor", "light").groupBy(*tile)).applyInArrow(light_tile, _PAIR)
    listed = shares.where("NOT heavy").select("lang", F.pmod(F.xxhash64("term"), F.col("lists")).cast("int").alias("block"), "term", "id", "p", "floor")
    put_right = listed.groupBy("lang", "block").applyInArrow(corrections, _PAIR)

    value = materialize(tiles.unionByName(sums).unionByName(put_right).groupBy("a", "b").agg(F.sum("value").alias("value")), "pairs")
    named = [groups.select(F.col("id").alias(c), "lang", F.col("source").alias(f"{c}_source")) for c in ("a", "b")]
    pairs = value.join(named[0], "a").join(named[1].drop("lang"), "b")
    both = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    far = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    return far.unionByName(apart)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), found AS (
  SELECT k, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT k) >= 10
), langs AS (
  SELECT lang, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) USING (lang)
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL
), members AS (
  SELECT lang, source, v, coalesce(t, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS t FROM counts GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT lang, m.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (m.total + 2 * m.v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 2)) // (l.total + 2 * l.v) AS q
  FROM members m JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM members a JOIN members b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS s1, y.source AS s2, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s1 = a.source AND s2 = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
