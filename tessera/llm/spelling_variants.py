"""Group spelling variants by wildcards, without a table of pairs.

Two words of one length that differ at position k share the group (k, what is
before, what is behind). A group keeps its size and its two foremost words, which
tell each member how many others it has and which of them is foremost. A word
without one of its letters meets the vocabulary's word of that spelling in the
same way. Sums by word over its groups are its near words; none is ever paired
with another.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, discard, materialize, table

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: One in so many (document, run) pairs, by checksum, loses a letter.
DROP = 97
#: Spellings up to this length are keys themselves, longer ones by a number of 127 bits.
WHOLE = 64
#: Words and letters counted in a task before they are sent on.
FLUSH_WORDS, FLUSH_CHARS = 200_000, 16 << 20
ROWS = 50_000

_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1B2C3A4F5E6D7C8B9A0917B
#: Latin-1 letters of a run stay, A-Z in lower case, all else parts runs.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` in Latin-1, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def misspelt(run: bytes, start: int, drop: int) -> bytes:
    """The run, or the run without one letter where the checksum says so; ``start`` is that of the id and the colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    return run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, drop: int | None = DROP) -> DataFrame:
    """``word, n``: how often each word of ``min_chars`` letters or more occurs; counted by task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        found: Counter[bytes] = Counter()
        chars = 0
        for batch in batches:
            for i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in Counter(runs(s or "")).items():
                    if len(run) < min_chars:
                        continue
                    word = misspelt(run, start, drop) if drop else run
                    if len(word) >= min_chars:
                        chars += len(word) * (word not in found)
                        found[word] += n
                if len(found) > FLUSH_WORDS or chars > FLUSH_CHARS:
                    yield out()
                    found.clear()
                    chars = 0
        yield out()

    parts = batched(docs).select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(word: str) -> tuple[list[int], list[int]]:
    """Of each beginning of a word its number, and powers of the base."""
    heads, powers = [0], [1]
    for c in word:
        heads.append((heads[-1] * _BASE + ord(c)) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return heads, powers


def keys(word: str) -> tuple[list[str], list[str]]:
    """Keys of a word's spellings: itself and then each without a letter; and with a wildcard at each place.

    A run of equal letters gives one deletion. A word of n letters takes about n
    steps whatever its length, as long spellings are put together from numbers.
    """
    n = len(word)
    first = [k for k in range(n) if k == 0 or word[k] != word[k - 1]]
    if n <= WHOLE:
        return [word, *(word[:k] + word[k + 1 :] for k in first)], [f"{word[:k]}*{word[k + 1 :]}" for k in range(n)]
    heads, powers = _numbers(word)

    def tail(k: int) -> int:
        return heads[n] - heads[k] * powers[n - k]

    def short(k: int) -> str:
        return word[:k] + word[k + 1 :] if n - 1 <= WHOLE else f"{n - 1}:{(heads[k] * powers[n - 1 - k] + tail(k + 1)) % _PRIME:x}"

    return [f"{n}:{heads[n]:x}", *(short(k) for k in first)], [f"{n}*{k}:{(heads[k] * powers[n - k] + tail(k + 1)) % _PRIME:x}" for k in range(n)]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, found = ("key", "kind", "rank"), ([], [], [])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int8(), pa.int64()), strict=True)], names)

    for batch in batches:
        for rank, word in zip(batch["rank"].to_pylist(), batch["word"].to_pylist(), strict=True):
            plain, wild = keys(word)
            found[0].extend(plain + wild)
            found[1].extend([0] + [1] * (len(plain) - 1) + [2] * len(wild))
            found[2].extend([rank] * (len(plain) + len(wild)))
            if len(found[0]) > ROWS:
                yield out()
                for c in found:
                    c.clear()
    yield out()


def near_words(ranked: DataFrame) -> DataFrame:
    """``rank, n_near, best``: of each word the number of near words and the foremost one's rank.

    A group has at most one word for each letter of the alphabet, and a word at
    most 90 longer neighbours a place: so a window holds a bounded group
    whatever the corpus.
    """
    rows = ranked.select("rank", "word").mapInArrow(_spread, "key string, kind byte, rank long")
    group = Window.partitionBy("key")
    order = group.orderBy("kind", "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = rows.select(
        "rank", "kind", F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(whole).alias("size"), F.first("kind").over(whole).alias("head"), F.first("rank").over(whole).alias("top"), F.nth_value("rank", 2).over(whole).alias("second")
    ).where("kind = 0 OR size > 1 AND head <> 1")
    others = F.when(F.col("kind") == 1, 1).otherwise(F.col("size") - 1)
    best = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top"))
    return kept.groupBy("rank").agg(F.sum(others).alias("n_near"), F.min(best).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``rank, root`` from ``rank, form``: each step doubles how far a row has followed its forms."""
    at = materialize(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("rank").alias("root"), F.col("root").alias("beyond"))
        step = materialize(at.join(ahead, "root", "left").select("rank", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        discard(at)
        at = step.drop("moved")
        if not moved:
            return at


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, drop: int | None = DROP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of a corpus.

    Words are runs of Latin-1 letters, those of ``min_chars`` letters and
    ``min_count`` occurrences. Near words differ by one inserted, deleted or
    replaced letter. A word's form is its near word of largest n, ties to the
    smallest in code point order, if that has ``ratio`` times its n; forms are
    followed to the root. ``drop`` deletes a letter from one in so many runs of a
    document; None deletes none. Null and empty texts have no words, rows that
    repeat an id count each, a null id is the empty text; columns besides these
    two are not read, whatever their names. An empty table gives an empty result.
    """
    counts = word_counts(docs, doc_id, text, min_chars, drop).where(F.col("n") >= min_count)
    ranked = materialize(counts.orderBy(F.col("n").desc(), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "vocabulary")
    near = materialize(near_words(ranked), "near")
    known = ranked.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    linked = ranked.select("rank", "n").join(near.where("best IS NOT NULL"), "rank").join(known, "best").where(F.col("best_n") >= ratio * F.col("n"))
    forms = materialize(linked.select("rank", F.col("best").alias("form")), "forms")
    roots = _roots(forms)
    names = [ranked.select(F.col("rank").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n")) for c in ("form", "root")]
    followed = forms.join(roots, "rank").join(names[0], "form").join(names[1].drop("root_n"), "root").select("rank", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    return ranked.join(near.drop("best"), "rank").join(followed, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Checksums byte by byte: a letter above 127 is two bytes of UTF-8, both below 256.
OP11_SQL = r"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), distinct_runs AS (
  SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY ALL
), sums AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS h FROM distinct_runs
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM sums
), vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), spots AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM vocabulary
), wild AS (
  SELECT word, n, left(word, k - 1) || '*' || substr(word, k + 1) AS key FROM spots
), shorter AS (
  SELECT DISTINCT word, n, left(word, k - 1) || substr(word, k + 1) AS key FROM spots
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON v.word = s.key
  UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON v.word = s.key
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), reach AS (
  SELECT word, word AS root, form AS ahead FROM forms UNION ALL SELECT r.word, f.word, f.form FROM reach r JOIN forms f ON f.word = r.ahead
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN reach r ON r.word = f.word AND r.ahead IS NULL
"""
