"""N-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marks, batched, discard, materialize, power_of_two, shuffle_partitions, table, texts
from .components import connected_components, group_components, joined_edges, packed_signatures
from .shingles import fingerprint, mix, shingle_set

PERCENT = 80
#: A class of tokens ends where this many sets hold one: in one set only, rare, less rare, frequent.
CLASS_ENDS = (2, 16, 512)
FREQUENT = len(CLASS_ENDS)
#: Tokens, and texts, of one pack.
PACK, PACK_TEXTS = 1 << 21, 1 << 16


def prefix_signatures(hashes: np.ndarray, kinds: np.ndarray, alone: int, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set, given its sorted hashes that other sets hold too, their classes, and how many it holds alone.

    Tokens are ordered by class, rare first, then by hash. A set of n tokens
    that overlaps another in ceil(percent * n / 100) of them misses at most the
    rest, so of its first p = n - ceil(..) + 1 tokens one is shared. Rare tokens
    each count as one towards p. Once tokens of the frequent class are needed,
    the prefix takes one more of them and indexes their pairs: with at most one
    of them shared, and no rare one, the set would miss p tokens. Tokens of this
    set alone fill the prefix but can't collide, so they get no row.
    """
    n = len(hashes) + alone
    need = n + (-percent * n // 100) + 1 - alone
    if need <= 0:
        return np.zeros(0, np.uint64)
    single = np.concatenate([hashes[kinds == k] for k in range(1, FREQUENT)])[:need]
    need -= len(single)
    frequent = hashes[kinds == FREQUENT][: need + 1] if need > 0 else single[:0]
    one, two = np.triu_indices(len(frequent), 1)
    return np.concatenate((single, mix(frequent[one] * np.uint64(31) + mix(frequent[two]))))


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, in as few bytes each as all need, one plane of bytes after the other."""
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.frombuffer(data, np.uint64, 1, 1)


#: Rows on their way: a pack's tokens of one bucket (``refs`` tells whose, ``kinds`` their classes once known), a pack's sets, or its texts.
ROW = "bucket int, pack long, keys binary, refs binary, kinds binary, ids binary, sizes binary, docs array<struct<doc:bigint,key:bigint,n:bigint,set_id:bigint>>"
_DOC = pa.list_(pa.struct([("doc", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64())]))
_COLUMNS = [("bucket", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary()), ("refs", pa.binary()), ("kinds", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("docs", _DOC)]


def _table(rows: list[dict]) -> pa.Table:
    return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in _COLUMNS})


def _pack_task(bits: int):
    """The sets of a task's texts in packs: their tokens by bucket, and rows that name sets and texts.

    A token that FREQUENT sets of one pack hold is frequent, whatever others
    hold: its class is known here, and its bucket only learns that. So no bucket
    gets more than a bound of entries of one token from a pack.
    """

    def flush(pack: int, sets: list[tuple[int, np.ndarray]], docs: list[dict]) -> pa.Table:
        rows = [{"bucket": pack % (1 << bits), "pack": pack, "ids": np.array([s for s, _ in sets], np.int64).tobytes(), "sizes": np.array([len(h) for _, h in sets], np.int64).tobytes(), "docs": docs}]
        if sets:
            keys, refs = np.concatenate([h for _, h in sets]), np.repeat(np.arange(len(sets), dtype=np.uint16), [len(h) for _, h in sets])
            order = np.argsort(keys)
            keys, refs = keys[order], refs[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(np.append(first, len(keys)))
            hot = np.repeat(counts >= CLASS_ENDS[-1], counts)
            if hot.any():
                rows.append({"bucket": pack % (1 << bits), "pack": pack, "keys": keys[hot].tobytes(), "refs": refs[hot].tobytes(), "kinds": np.full(int(hot.sum()), FREQUENT, np.uint8).tobytes()})
            for frequent, k, r in ((False, keys[~hot], refs[~hot]), (True, keys[first[counts >= CLASS_ENDS[-1]]], None)):
                cuts = np.flatnonzero(np.diff(k >> np.uint64(64 - bits))) + 1
                for part, own in zip(np.split(k, cuts), np.split(r, cuts) if r is not None else [None] * (len(cuts) + 1), strict=True):
                    if len(part):
                        rows.append({"bucket": int(part[0] >> np.uint64(64 - bits)), "pack": pack, "keys": _deltas(part), "refs": None if frequent else own.tobytes()})
        return _table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = TaskContext.get().partitionId() << 24, set()
        sets: list[tuple[int, np.ndarray]] = []
        docs: list[dict] = []
        total = 0
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                found = shingle_set(text)
                name = fingerprint(found) if len(found) else None
                docs.append({"doc": doc, "key": key, "n": len(found), "set_id": name})
                if name is not None and name not in seen:
                    seen.add(name)
                    sets.append((name, found))
                    total += len(found)
                if total >= PACK or len(docs) >= PACK_TEXTS:
                    yield from flush(pack, sets, docs).to_batches()
                    pack, sets, docs, total = pack + 1, [], [], 0
        if docs:
            yield from flush(pack, sets, docs).to_batches()

    return run


def _class_task(group: pa.Table) -> pa.Table:
    """Classes of the tokens of one bucket, for each pack; those that one set alone holds go no further."""
    rows, parts, hot = [], [], []
    for r in group.to_pylist():
        if r["keys"] is None or r["kinds"] is not None:
            rows.append(r)
        elif r["refs"] is None:
            hot.append(_keys(r["keys"]))
        else:
            parts.append((r["pack"], _keys(r["keys"]), np.frombuffer(r["refs"], np.uint16)))
    if parts:
        keys, where = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
        kind = np.searchsorted(CLASS_ENDS, np.bincount(where), side="right").astype(np.uint8)
        if hot:
            kind[np.isin(keys, np.concatenate(hot))] = FREQUENT
        kind, at = kind[where], 0
        for pack, own, refs in parts:
            mine, at = kind[at : at + len(own)], at + len(own)
            some = mine > 0
            if some.any():
                rows.append({"bucket": None, "pack": pack, "keys": own[some].tobytes(), "refs": refs[some].tobytes(), "kinds": mine[some].tobytes()})
    return _table(rows)


def _signature_task(bits: int, percent: int):
    """Of one pack: sets that can link, with the tokens they may share, and their signatures in packed rows."""
    names = [("id", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("bucket", pa.int32()), ("edges", pa.bool_()), ("keys", pa.binary()), ("ids", pa.binary()), ("docs", _DOC)]

    def run(group: pa.Table) -> pa.Table:
        rows, ids, sizes, parts = [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for r in group.to_pylist():
            if r["keys"] is not None:
                parts.append([np.frombuffer(r["refs"], np.uint16), np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["kinds"], np.uint8)])
            else:
                ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64)
                rows.append({"docs": r["docs"]})
        if parts:
            refs, keys, kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((keys, refs))
            refs, keys, kinds = refs[order], keys[order], kinds[order]
            bounds = np.searchsorted(refs, np.arange(len(ids) + 1))
            kept, sigs = [], []
            for k in np.flatnonzero(100 * (bounds[1:] - bounds[:-1]) >= percent * sizes).tolist():
                a, b = bounds[k], bounds[k + 1]
                found = prefix_signatures(keys[a:b], kinds[a:b], int(sizes[k] - (b - a)), percent)
                if len(found):
                    kept.append(k)
                    sigs.append(np.unique(found))
                    rows.append({"id": int(ids[k]), "n": int(sizes[k]), "hashes": keys[a:b].tobytes()})
            if kept:
                owners = np.repeat(np.arange(len(kept)), [len(x) for x in sigs])
                rows += [{"bucket": b, "edges": e, "keys": x, "ids": i} for b, e, x, i in packed_signatures(ids[kept], np.concatenate(sigs), owners, bits)]
        return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in names})

    return run


def _edge_task(group: pa.Table) -> pa.Table:
    a, b = joined_edges(*(group.column(c).to_pylist() for c in ("edges", "keys", "ids")))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def ngram_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc, key, n, component``: as ``ngram_jaccard_join``; key is xxhash64 of the text, which tells rows of one id apart."""
    spark = docs.sparkSession
    bits = power_of_two(max(64, 4 * shuffle_partitions(spark))).bit_length() - 1
    rows = batched(docs).select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    ids = materialize(rows.select("doc", "key"), "ids")
    firsts = materialize(ids.groupBy("key").agg(F.min("doc").alias("doc")), "firsts")
    marks = Marks(firsts, "doc", "key")
    classed = marks.maybe(rows, rows["doc"], rows["key"]).mapInArrow(_pack_task(bits), ROW).groupBy("bucket").applyInArrow(_class_task, ROW)
    found = classed.groupBy("pack").applyInArrow(_signature_task(bits, percent), "id long, n long, hashes binary, bucket int, edges boolean, keys binary, ids binary, docs array<struct<doc:bigint,key:bigint,n:bigint,set_id:bigint>>")
    found = materialize(found, "found")
    discard(firsts)
    marks.discard()
    edges = found.where("bucket is not null").groupBy("bucket").applyInArrow(_edge_task, "a long, b long")
    groups = connected_components(edges)
    roots = group_components(groups, found.where("id is not null").select("id", "n", "hashes"), percent)

    sets = found.where("docs is not null").select(F.inline("docs"))
    first = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc").alias("first"))
    rooted = first.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("set_id", "component")
    by_text = sets.groupBy("key").agg(F.first("n").alias("n"), F.first("set_id").alias("set_id")).join(named, "set_id", "left")
    out = materialize(ids.join(by_text, "key", "left").select("doc", "key", "n", F.coalesce("component", "doc").alias("component")), "links")
    for used in (ids, found, groups, roots):
        discard(used)
    return out


def ngram_jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Link texts whose sets of five-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``doc_id, n_shingles, component_id``: one row per row of ``docs``,
    the size of its set, and the smallest id that links lead to, itself included.

    Of equal texts (by a hash of 64 bits) the one of the smallest id is read on:
    a bit for each tells it from its copies, of which one of 16 may come along.
    So tokens travel once a text, however often it is repeated, and their
    classes count texts, not copies.

    Each text is hashed once. Its tokens go to buckets by hash, where
    they are counted over all sets, and come back to its pack with their class;
    only those that another set holds too. Sets then get prefix signatures, and
    sets that share one, also by way of others, are compared exactly; prefixes
    lose no link. Equal sets are one node, so copies are never paired with each
    other. But for the bits, 16 MB at most, nothing is broadcast or sent to the driver.

    Null and empty texts have an empty set and link with nothing. Rows that
    repeat an id keep a row each. Of a null id the component is the smallest id
    its text is linked with, or null. Other columns, also of these names, are
    not read. A very long text is one set like others. An empty table gives an
    empty result. ``docs`` should be a table as it is read, or a filter of one:
    a pack counts on its rows coming in the same order when a lost task runs
    again.
    """
    return ngram_links(docs, doc_id, text, percent).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
