"""Substring dedup: paragraph MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, discard, materialize, power_of_two, shuffle_partitions, table, texts
from .components import connected_components, group_components, joined_edges, packed_signatures
from .shingles import WIDTH, mix, positions, words_of

PERCENT = 80
#: A passage goes if it has at least so many words, and so does a paragraph that is compared.
MIN_WORDS = 25
#: Of so many shingles in a row, the one with the smallest hash starts a piece.
#: A passage of 51 words has 47 shingles, so its first and last such start are at least 23 apart: what lies between has over MIN_WORDS words.
CUT = 12
RECALL = 0.99
BAND_ROWS = 3
#: Words of texts that a task gathers before it sends them.
FLUSH = 1 << 21
#: Copies of a piece in one row on their way to its keeper.
PLACES = 32


def tune_bands(similarity: float, recall: float = RECALL, rows: int = BAND_ROWS) -> tuple[int, int]:
    """Bands and rows with which two sets of this similarity collide with probability ``recall`` or more."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the words of a UTF-8 text, and whether a line ends after each."""
    codes = np.frombuffer(data, np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    line = np.zeros(len(starts), bool)
    if len(starts):
        line[np.searchsorted(starts, np.flatnonzero(codes == 10)) - 1] = True
        line[-1] = True
    return starts, ends, line


def pieces(hashes: np.ndarray) -> np.ndarray:
    """Where pieces of a text start: at the smallest shingle hash of each CUT in a row; the last one ends the last piece.

    That depends on nearby words only, so a passage is cut alike wherever it
    stands. Of equal shingles in a row only the first counts.
    """
    if len(hashes) < CUT:
        return np.zeros(0, np.int64)
    least, span = hashes, 1
    while span < CUT:
        step = min(span, CUT - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    most, span = np.concatenate((np.zeros(CUT - 1, np.uint64), least, np.zeros(CUT - 1, np.uint64))), 1
    while span < CUT:
        step = min(span, CUT - span)
        most, span = np.maximum(most[:-step], most[step:]), span + step
    start = hashes == most
    start[1:] &= hashes[1:] != hashes[:-1]
    return np.flatnonzero(start)


def paragraphs(line: np.ndarray) -> np.ndarray:
    """Word ranges (from, to), as rows, of the lines that have MIN_WORDS words or more."""
    ends = np.flatnonzero(line) + 1
    where = np.stack((np.concatenate(([0], ends[:-1])), ends), axis=1) if len(ends) else np.zeros((0, 2), np.int64)
    return where[where[:, 1] - where[:, 0] >= MIN_WORDS]


def _names(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ids of runs of shingles: a hash of the sum of their hashes."""
    return mix((sums[last] - sums[first]) ^ np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def band_signatures(values: np.ndarray, lengths: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash signatures, a row of bands for each set; the sets' values follow each other."""
    odd = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    spread, starts = mix(values), np.cumsum(lengths) - lengths
    out = np.empty((len(lengths), bands), np.uint64)
    for band in range(bands):
        code = np.full(len(lengths), band, np.uint64)
        for k in range(rows):
            code = mix(code * np.uint64(31) + np.minimum.reduceat(spread * odd[band * rows + k], starts))
        out[:, band] = code
    return out


#: Kinds of rows. The first three are places in texts, the others tell about ids.
PARAGRAPH, PIECE, COPY, KEEPER, EDGE, PACKED_PIECES, PACKED_BANDS = range(7)
_SENT = [("bucket", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("edges", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
SENT = "bucket long, kind int, id long, doc long, first long, last long, edges boolean, a binary, b binary, c binary"
_FOUND = [("kind", pa.int32()), ("id", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("keeper", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
FOUND = "kind int, id long, doc long, first long, last long, keeper long, a binary, b binary, c binary"


def _flat(schema: list, kind: int, columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({name: pa.array(columns[name], t) if name in columns else pa.array([kind] * n, t) if name == "kind" else pa.nulls(n, t) for name, t in schema})


class _Gathered:
    """Paragraphs and pieces of some texts of a task."""

    def __init__(self):
        self.pieces: list[np.ndarray] = []
        self.paragraphs: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.words = 0

    def add(self, doc: int, text: str) -> None:
        words = words_of(text)
        self.words += len(words) + 1
        if len(words) < MIN_WORDS:
            return
        hashes = positions(words)
        starts, ends, line = word_spans(text.encode("utf-8", "surrogatepass"))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes))))
        cuts = pieces(hashes)
        if len(cuts) > 1:
            a, b = cuts[:-1], cuts[1:]
            self.pieces.append(np.stack((_names(sums, a, b), np.full(len(a), doc), starts[a], ends[b + WIDTH - 2])))
        where = paragraphs(line)
        if len(where):
            a, b = where[:, 0], where[:, 1] - WIDTH + 1
            self.paragraphs.append(np.stack((_names(sums, a, b), np.full(len(a), doc), starts[a], ends[where[:, 1] - 1])))
            self.values += [hashes[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]

    def sent(self, seen: set[int], bands: int, rows: int, bits: int, spread: int) -> Iterator[pa.RecordBatch]:
        if self.pieces:
            id_, doc, first, last = np.concatenate(self.pieces, axis=1)
            order = np.lexsort((first, doc, id_))
            id_, doc, first, last = id_[order], doc[order], first[order], last[order]
            new = np.concatenate(([True], id_[1:] != id_[:-1]))
            where = np.flatnonzero(new)
            several = np.maximum.reduceat(doc, where) > doc[where]
            copies = ~new & several[np.cumsum(new) - 1]
            if copies.any():
                of = id_[copies]
                start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                inside = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
                at = np.flatnonzero(inside % PLACES == 0)
                packed = {c: [np.ascontiguousarray(x).tobytes() for x in np.split(v[copies], at[1:])] for c, v in (("a", doc), ("b", first), ("c", last))}
                yield from _flat(_SENT, COPY, {"bucket": (of[at] + spread) % (1 << bits), "id": of[at], **packed}).to_batches()
            bucket = id_[where] & ((1 << bits) - 1)
            order = np.argsort(bucket, kind="stable")
            chosen, bucket = where[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            packed = [(int(b[0]), id_[w].tobytes(), doc[w].tobytes(), np.stack((first[w], last[w] - first[w], s)).astype("<u4").tobytes()) for b, w, s in zip(np.split(bucket, cuts), np.split(chosen, cuts), np.split(several[order], cuts), strict=True)]
            yield from _flat(_SENT, PACKED_PIECES, dict(zip(("bucket", "a", "b", "c"), map(list, zip(*packed, strict=True)), strict=True))).to_batches()
        if self.paragraphs:
            id_, doc, first, last = np.concatenate(self.paragraphs, axis=1)
            yield from _flat(_SENT, PARAGRAPH, {"bucket": (doc + spread) % (1 << bits), "id": id_, "doc": doc, "first": first, "last": last}).to_batches()
            names, where = np.unique(id_, return_index=True)
            new = np.array([x not in seen for x in names.tolist()], bool)
            seen.update(names.tolist())
            names, values = names[new], [self.values[i] for i in where[new].tolist()]
            if len(names):
                sigs = band_signatures(np.concatenate(values), np.array([len(x) for x in values]), bands, rows)
                packed = packed_signatures(names, sigs.ravel(), np.repeat(np.arange(len(names)), bands), bits)
                yield from _flat(_SENT, PACKED_BANDS, dict(zip(("bucket", "edges", "a", "b"), map(list, zip(*packed, strict=True)), strict=True))).to_batches()


def _send_task(bands: int, rows: int, bits: int):
    """Paragraphs, their signatures, and pieces of a task's texts.

    Of a piece that several documents of a task hold, one occurrence goes to the
    bucket of its id; the others, some in a row, are spread and meet their
    keeper later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, spread = _Gathered(), TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held.add(doc, text)
                if held.words >= FLUSH:
                    yield from held.sent(seen, bands, rows, bits, spread)
                    held = _Gathered()
        yield from held.sent(seen, bands, rows, bits, spread)

    return run


def _meet_task(group: pa.Table) -> pa.Table:
    """Of a bucket: pieces that several documents hold, with the smallest of them, and edges of the signatures."""
    kind = group.column("kind").to_numpy()
    flat = group.filter(pa.array(kind < PACKED_PIECES))
    out = [_flat(_FOUND, 0, {c: flat.column(c).combine_chunks() for c in ("kind", "id", "doc", "first", "last", "a", "b", "c")})]
    packed = group.filter(pa.array(kind == PACKED_PIECES))
    if packed.num_rows:
        id_, doc = (np.concatenate([np.frombuffer(x, np.int64) for x in packed.column(c).to_pylist()]) for c in ("a", "b"))
        first, size, several = np.concatenate([np.frombuffer(x, "<u4").reshape(3, -1) for x in packed.column("c").to_pylist()], axis=1).astype(np.int64)
        order = np.lexsort((doc, id_))
        id_, doc, first, size, several = id_[order], doc[order], first[order], size[order], several[order]
        where = np.flatnonzero(np.concatenate(([True], id_[1:] != id_[:-1])))
        local = np.maximum.reduceat(several, where) > 0
        shared = local | (np.maximum.reduceat(doc, where) > doc[where])
        out.append(_flat(_FOUND, KEEPER, {"id": id_[where[local]], "keeper": doc[where[local]]}))
        counts = np.diff(np.append(where, len(id_)))
        some, keeper = np.repeat(shared, counts), np.repeat(doc[where], counts)
        out.append(_flat(_FOUND, PIECE, {"id": id_[some], "doc": doc[some], "first": first[some], "last": (first + size)[some], "keeper": keeper[some]}))
    bands = group.filter(pa.array(kind == PACKED_BANDS))
    if bands.num_rows:
        a, b = joined_edges(*(bands.column(c).to_pylist() for c in ("edges", "a", "b")))
        out.append(_flat(_FOUND, EDGE, {"id": a, "keeper": b}))
    return pa.concat_tables(out)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of copies, a row each, with their keeper."""
    for batch in batches:
        docs, firsts, lasts = ([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("a", "b", "c"))
        if docs:
            columns = [np.concatenate(x) for x in (docs, firsts, lasts)] + [np.repeat(batch.column("own").to_numpy(), [len(x) for x in docs])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc", "first", "last", "keeper"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the paragraphs that are asked for."""
    for batch in batches:
        rows: list[tuple[int, int, bytes]] = []
        for text, wanted in zip(texts(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for x in wanted or ():
                found = np.unique(positions(words_of(data[x["first"] : x["last"]].decode("utf-8", "surrogatepass"))))
                rows.append((x["id"], len(found), found.tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "n", "hashes"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def without(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged ranges, less what other merged ranges cover."""
    out = []
    for first, last in spans:
        for a, b in kept:
            if a < last and b > first:
                if a > first:
                    out.append((first, a))
                first = max(first, b)
        if first < last:
            out.append((first, last))
    return out


def cut(text: str, gone: list[tuple[int, int, int]], kept: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], list[int], int]:
    """The text without the byte ranges ``gone (first, last, keeper)``, save those to be kept and stretches of few words.

    Returns the text, what ranges went with the blanks before each, their
    keepers, and how many words went.
    """
    data, at, words, keep = text.encode("utf-8", "surrogatepass"), 0, 0, []
    spans = [s for s in merged([g[:2] for g in gone]) if len(data[s[0] : s[1]].split()) >= MIN_WORDS]
    keepers = sorted({k for first, last, k in gone if any(a <= first and last <= b for a, b in spans)})
    spans = [(a, b) for a, b in without(spans, merged(kept)) if data[a:b].strip()]
    for first, last in spans:
        keep.append(data[at:first].rstrip(b" \t"))
        words += len(data[first:last].split())
        at = last
    keep.append(data[at:])
    out = b"".join(keep)
    return (out.lstrip() if spans and spans[0][0] == 0 else out).decode("utf-8", "surrogatepass"), spans, keepers if spans else [], words


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is None or not spans:
                rows.append((text, 0, [], []))
                continue
            gone = [(x["first"], x["last"], x["kept_in"]) for x in spans if x["kept_in"] is not None]
            now, went, keepers, n = cut(text, gone, [(x["first"], x["last"]) for x in spans if x["kept_in"] is None])
            rows.append((now, n, [{"first": a, "last": b} for a, b in went], keepers))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), span, pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([columns[0], batch.column("others"), *columns[1:]], ["text", "others", "removed_words", "removed_spans", "kept_in"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc, spans``: byte ranges that another document keeps, and (``kept_in`` null) those that this one keeps for others.

    Of paragraphs and of pieces; a document with nothing to remove has no row.
    """
    spark = docs.sparkSession
    rows = batched(docs).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    bands, per = tune_bands(percent / 100)
    bits = power_of_two(max(64, 4 * shuffle_partitions(spark))).bit_length() - 1
    found = materialize(rows.mapInArrow(_send_task(bands, per, bits), SENT).groupBy("bucket").applyInArrow(_meet_task, FOUND), "found")

    # Paragraphs: components of what collides and is alike; all but the one in the smallest document go.
    places = found.where(F.col("kind") == PARAGRAPH).select("id", "doc", "first", "last")
    groups = connected_components(found.where(F.col("kind") == EDGE).select(F.col("id").alias("a"), F.col("keeper").alias("b")))
    shown = places.join(groups.select("id"), "id").groupBy("id").agg(F.min(F.struct("doc", "first", "last")).alias("at"))
    shown = materialize(shown.groupBy("at.doc").agg(F.collect_list(F.struct("id", "at.first", "at.last")).alias("wanted")), "shown")
    sets = rows.join(shown, "doc").select("text", "wanted").mapInArrow(_set_rows, "id long, n long, hashes binary")
    roots = group_components(groups, sets, percent)
    ends = places.groupBy("id").agg(F.min("doc").alias("d1"), F.max("doc").alias("d2")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    keepers = ends.groupBy("root").agg(F.min("d1").alias("kept_in"), F.max("d2").alias("d2")).where("kept_in < d2")
    named = ends.join(keepers.select("root", "kept_in"), "root").select("id", "kept_in")
    gone = places.join(named, "id").where("doc > kept_in").select("doc", "first", "last", "kept_in")

    # Pieces: all go but those in the smallest document that holds one.
    local = found.where(F.col("kind") == COPY).select("id", "a", "b", "c").join(found.where(F.col("kind") == KEEPER).select("id", F.col("keeper").alias("own")), "id")
    local = local.select("a", "b", "c", "own").repartition("a", "b").mapInArrow(_unpacked, "doc long, first long, last long, keeper long")
    held = found.where(F.col("kind") == PIECE).select("doc", "first", "last", "keeper").unionByName(local)
    held = held.select("doc", "first", "last", F.when(F.col("doc") > F.col("keeper"), F.col("keeper")).alias("kept_in"))
    out = gone.unionByName(held).groupBy("doc").agg(F.collect_list(F.struct("first", "last", "kept_in")).alias("spans")).where(F.exists("spans", lambda x: x["kept_in"].isNotNull()))
    out = materialize(out, "spans")
    for used in (found, groups, shown, roots):
        discard(used)
    return out


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Remove passages that an earlier document also has; one row per row of ``docs``.

    All columns stay, ``text`` without its repeated passages. New columns (an
    input column of such a name gives way): ``removed_words``; ``removed_spans``,
    byte ranges in the old text, merged; ``kept_in``, ids of the documents that
    keep what went.

    Two things are compared. Paragraphs are the lines of 25 words or more: MinHash
    bands bring them together, those that collide are compared by exact Jaccard
    similarity of five-word shingles, and of each component of links at
    ``percent`` / 100 or more the paragraphs of its smallest document stay.
    Pieces are what lies between content-defined cuts, wherever lines end; of
    equal ones the smallest document's stays, and a paragraph that goes leaves
    those pieces that other documents lost in its favour. Stretches of fewer
    than 25 words in a row stay. A passage of 51 words or more that two
    documents share has such a stretch, so it always loses its inner part; up to
    12 words may stay at either end of it.

    Repeats within a document, null and empty texts stay as they are, and so do
    rows with a null id. Rows that repeat an id are cut alike. Very long texts
    are cut whole. Ties go to the smaller id. An empty table gives an empty result.
    """
    docs = docs.select([c for c in docs.columns if c.lower() not in ("removed_words", "removed_spans", "kept_in")])
    spans = repeated_spans(docs, doc_id, text, percent)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.struct([F.col(c) for c in docs.columns if c != text]).alias("others"))
    rows = plain.join(spans, "doc", "left").select("text", "others", "spans")
    done = rows.mapInArrow(_cut_rows, "text string, others " + rows.schema["others"].dataType.simpleString() + ", removed_words long, removed_spans array<struct<first:bigint,last:bigint>>, kept_in array<bigint>")
    columns = [F.col("text").alias(c) if c == text else F.col(f"others.{c}").alias(c) for c in docs.columns]
    return done.select(*columns, "removed_words", "removed_spans", "kept_in")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its id, its text without repeated passages, and what went."""
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
