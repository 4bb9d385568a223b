"""Embedding near-dedup: buckets of random signs, compared whole."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL, batched, discard, materialize, shuffle_partitions, table, written_bytes
from .components import connected_components

THRESHOLD = 0.9
#: A pair at the threshold shares a bucket in one pass or more with this probability, whatever the other vectors are.
RECALL = 0.9999
SEED = 11
#: Vectors of one block when a crowded bucket is compared.
BLOCK = 2048
#: To send a vector to a bucket costs about as much as so many comparisons.
SENT = 2000
MOST_BITS = 40
#: Links of a pair of blocks up to which they are joined one by one.
FEW_LINKS = 50_000
#: Members of one block when the links of a component are counted.
COUNT_BLOCK = 512


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket's key, and passes, that reach ``recall`` at the least cost; no bits: all pairs in one pass."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    best = (math.inf, 0, 1)
    for bits in range(MOST_BITS + 1):
        p, bucket = same**bits, rows / 2**bits
        if p < 1e-9:
            break
        passes = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        best = min(best, (passes * (SENT * max(1.0, bucket / BLOCK) + bucket), bits, passes))
    return best[1], best[2]


def usable(column: pa.ListArray, kind: str = "<f8") -> list[bytes | None]:
    """Vectors as bytes of numbers of numpy type ``kind``; null if null, zero, or with a null or non-finite component."""
    out: list[bytes | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(kind)
            if not np.isfinite(v).all() or not v.any():
                v = None
        out.append(None if v is None else v.tobytes())
    return out


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one size as rows of doubles of length 1."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projection_keys(vectors: np.ndarray, number: int, bits: int) -> np.ndarray:
    """The buckets of one pass: signs of random projections."""
    planes = np.random.default_rng([SEED, number, vectors.shape[1]]).standard_normal((vectors.shape[1], bits))
    return (vectors @ planes > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _key_rows(bits: int, passes: int, kind: str, whole: bool):
    """A row for each vector and pass; with ``whole``, id and vector too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                stacked = unit([vectors[i] for i in which], kind)
                part = batch.take(pa.array(which))
                for number in range(passes):
                    keys = projection_keys(stacked, number, bits)
                    columns = [pa.array([number] * len(which), pa.int32()), pa.array([int(size)] * len(which), pa.int32()), pa.array(keys, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + ([part.column(0), part.column(1)] if whole else []), ["pass", "size", "key", "id", "vector"][: 5 if whole else 3])

    return run


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all that a matrix of links between two lists of ids does."""
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    near, left, right = near[np.ix_(rows, cols)], left[rows], right[cols]
    if np.count_nonzero(near) > FEW_LINKS:
        ours, theirs = np.arange(len(left)), np.full(len(right), len(left))
        while True:
            theirs = np.where(near, ours[:, None], len(left)).min(axis=0)
            new = np.where(near, theirs[None, :], len(left)).min(axis=1)
            if np.array_equal(new, ours):
                break
            ours = new
        return [*zip(left.tolist(), left[ours].tolist(), strict=True), *zip(right.tolist(), left[theirs].tolist(), strict=True)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(*(x.tolist() for x in (left[np.nonzero(near)[0]], right[np.nonzero(near)[1]])), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent)]


def _bucket_links(threshold: float, kind: str):
    """Compare all vectors of a pair of blocks of a bucket; the rows of each are together."""

    def links(rows: list[tuple[int, int, bytes]], key: tuple) -> list[tuple[int, int]]:
        one, two = key[-2:]
        block = np.array([r[1] for r in rows])
        ids, x = np.array([r[0] for r in rows], np.int64), unit([r[2] for r in rows], kind)
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if one == two:
            return forest(np.triu(x @ x.T >= threshold, 1), ids, ids)
        return forest(x[a] @ x[b].T >= threshold, ids[a], ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for found in _by_key(batches, ("pass", "size", "key", "one", "two"), lambda rows, key: links(rows, key) if len(rows) > 1 else []):
            new = {(max(e), min(e)) for e in found if e[0] != e[1]} - known
            if len(known) < FEW_LINKS:
                known |= new
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in new], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], of: Callable) -> Iterator:
    """``of(rows, key)`` for the rows (id, block, vector) of each key, which are together."""
    now, rows = None, []
    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in names], strict=True)
        for key, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in ("id", "block", "vector")], strict=True), strict=True):
            if now != key:
                if rows:
                    yield of(rows, now)
                now, rows = key, []
            rows.append(row)
    if rows:
        yield of(rows, now)


def _count_links(threshold: float, kind: str):
    """Links of each member within a block, or between two blocks, of a component; the rows of a pair of blocks are together.

    A member stands for as many equal vectors as its weight says.
    """

    def count(rows: list[tuple[int, int, bytes, int]], one: int, two: int) -> tuple[list[int], list[int]]:
        ids = np.array([r[0] for r in rows], np.int64)
        block = np.array([r[1] for r in rows])
        size = np.array([len(r[2]) for r in rows])
        weight = np.array([r[3] for r in rows])
        links = np.zeros(len(rows), np.int64)
        for s in np.unique(size):
            a, b = np.flatnonzero((block == one) & (size == s)), np.flatnonzero((block == two) & (size == s))
            if not len(a) or not len(b):
                continue
            x, y = (unit([rows[i][2] for i in w], kind) for w in (a, b))
            near = ((x @ y.T) >= threshold) & (ids[a][:, None] != ids[b][None, :])
            links[a] += near @ weight[b]
            if one != two:
                links[b] += weight[a] @ near
        return ids.tolist(), links.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out: tuple[list[int], list[int]] = ([], [])
        for batch in batches:
            for root, one, two, block, name, vector, weight in zip(*[batch.column(c).to_pylist() for c in ("root", "one", "two", "block", "id", "vector", "weight")], strict=True):
                if now != (root, one, two):
                    if rows:
                        for x, y in zip(out, count(rows, now[1], now[2]), strict=True):
                            x.extend(y)
                    now, rows = (root, one, two), []
                rows.append((name, block, vector, weight))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "links"])
            out = ([], [])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in count(rows, now[1], now[2])], ["id", "links"])

    return run


def _in_pairs(rows: DataFrame, *group: str) -> DataFrame:
    """Send each row of a group of ``blocks`` blocks to each pair of blocks that its own is in."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*group, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "vector", "weight")
    return met.repartition(shuffle_partitions(rows.sparkSession), *group, "one", "two").sortWithinPartitions(*group, "one", "two")


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Group vectors with a cosine of ``threshold`` or more: ``vec_id, n_links, component_id, kept``, a row per row.

    In each pass, a vector's bucket is the signs of some random projections, and
    all vectors of a bucket are compared: a crowded one in pairs of blocks, so
    it is many tasks. Bits and passes follow from the number of rows and from
    ``recall``: up to some 10,000 vectors all pairs are compared, which is exact;
    above, a pair at the threshold shares a bucket at least once with that
    probability, and closer pairs with a higher one. That holds for each pair
    apart from how many or how crowded the others are; only the work grows with
    those. Equal vectors are linked first, and one of them is compared.

    Links of all passes make components. Within a component, all members are
    then compared in pairs of blocks, so the links of a large group are counted
    whole, and no task holds more than two blocks. A link is missed only if no
    pass brings its two sides' components together.

    Cosines are in double precision. Vectors that are null, empty or zero, or
    hold a null or non-finite component, link with nothing, nor do vectors of
    different lengths. Rows that repeat an id are one vector, the smallest by
    bytes. A null id links with nothing, has a null component and isn't kept.
    An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"))
    kind = "<f4" if rows.schema["vector"].dataType == T.ArrayType(T.FloatType(), rows.schema["vector"].dataType.containsNull) else "<f8"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(usable(batch.column(1), kind), pa.binary())], ["id", "vector"])

    good = batched(rows).where("id is not null").mapInArrow(clean, "id long, vector binary").where("vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    good = materialize(good, "vectors")
    first = materialize(good.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).select("id", "vector", "weight"), "distinct")
    alike = good.join(first.select("vector", F.col("id").alias("node"), "weight"), "vector").select("id", "node", "weight")

    bits, passes = plan(first.count(), threshold, recall)
    single = first.select("id", "vector")
    counts = single.mapInArrow(_key_rows(bits, passes, kind, False), "pass int, size int, key long").groupBy("pass", "size", "key").count()
    crowded = counts.where(F.col("count") > BLOCK).select("pass", "size", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    crowded = materialize(crowded, "crowded")
    keyed = single.mapInArrow(_key_rows(bits, passes, kind, True), "pass int, size int, key long, id long, vector binary")
    keyed = keyed.join(F.broadcast(crowded) if written_bytes(crowded) <= SMALL else crowded, ["pass", "size", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    edges = _in_pairs(keyed.withColumn("weight", F.lit(1).cast("long")), "pass", "size", "key").mapInArrow(_bucket_links(threshold, kind), "a long, b long")
    parts = connected_components(edges)

    members = parts.join(first, "id").select("root", "id", "vector", "weight")
    blocks = parts.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK).cast("int").alias("blocks"))
    met = _in_pairs(members.join(blocks, "root"), "root")
    counts = met.mapInArrow(_count_links(threshold, kind), "id long, links long").groupBy("id").agg(F.sum("links").alias("n_links"))

    nodes = parts.join(counts, "id", "left").select(F.col("id").alias("node"), "root", "n_links")
    found = alike.join(nodes, "node", "left").select("id", F.coalesce("root", "node").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    found = materialize(found, "links")
    for used in (good, first, crowded, parts):
        discard(used)
    found = rows.select("id").join(found, "id", "left")
    component = F.coalesce("root", "id")
    return found.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
