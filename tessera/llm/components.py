"""Connected components, signatures in packed rows, and links within groups, as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every node of ``edges (a, b)``; root is the smallest id reached.

    Alternates large-star and small-star steps: each node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows. All steps
    are joins and minima by node, so a node with very many links is pre-aggregated
    and its join can be split. The number of rounds grows with the logarithm of
    the longest chain. The result is a scratch table. Loops, repeated edges and an empty table are fine; rows
    with a null end are left out.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = _observed(now)
    seen = None
    while state != seen and state["n"]:
        seen = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before = now
        now, state = _observed(small.union(least.select("a", F.col("m"))).distinct())
        discard(before)
    out = materialize(now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct()), "components")
    discard(now)
    return out


def _observed(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Write edges; also their number and a sum of their hashes, which tell when they stay the same."""
    seen = Observation()
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("hashes"))
    return materialize(watched, "edges"), seen.get


# --- signatures -----------------------------------------------------------------------


def roots_by_signature(sigs: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets 0, 1, ... that signatures connect; ``owners``, ascending and without gaps, tells whose each is.

    Returns the smallest set that each set reaches, all signatures, and the root of each.
    """
    keys, where = np.unique(sigs, return_inverse=True)
    order = np.argsort(where, kind="stable")
    by_key = np.flatnonzero(np.diff(where[order], prepend=-1))
    by_owner = np.flatnonzero(np.diff(owners, prepend=-1))
    holders, root = owners[order], np.arange(len(by_owner))
    while len(root):
        least = np.minimum.reduceat(root[holders], by_key)
        now = np.minimum.reduceat(least[where], by_owner)
        now = now[now]
        if np.array_equal(now, root):
            return root, keys, least
        root = now
    return root, keys, root


def packed_signatures(ids: np.ndarray, sigs: np.ndarray, owners: np.ndarray, bits: int) -> list[tuple[int, bool, bytes, bytes]]:
    """Rows ``bucket, edges, keys, ids`` for the signatures of distinct sets of a task.

    Sets that meet here go as edges to one root, so of a signature that very
    many sets share, a task sends one at a time.
    """
    if not len(sigs):
        return []
    root, keys, least = roots_by_signature(sigs, owners)
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out = [(b, False, k.tobytes(), i.tobytes()) for b, k, i in zip(bucket[np.concatenate(([0], cuts))].tolist(), np.split(keys, cuts), np.split(ids[least], cuts), strict=True)]
    met = np.flatnonzero(root != np.arange(len(root)))
    if len(met):
        out.append((int(ids[0]) % (1 << bits), True, ids[met].tobytes(), ids[root[met]].tobytes()))
    return out


def joined_edges(edges: list[bool], keys: list[bytes], ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges among the sets of each signature of a bucket, all to one of them; edges found before pass through."""
    ends: list[tuple[np.ndarray, np.ndarray]] = [(np.frombuffer(k, np.int64), np.frombuffer(i, np.int64)) for e, k, i in zip(edges, keys, ids, strict=True) if e]
    parts = [(np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64)) for e, k, i in zip(edges, keys, ids, strict=True) if not e]
    if parts:
        sig, name = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        centre = np.repeat(name[starts], np.diff(np.concatenate((starts, [len(sig)]))))
        apart = name != centre
        pairs = np.unique(np.stack((name[apart], centre[apart])), axis=1)
        ends.append((pairs[0], pairs[1]))
    return tuple(map(np.concatenate, zip(*ends, strict=True))) if ends else (np.zeros(0, np.int64),) * 2


# --- links within groups --------------------------------------------------------------

#: Members, and values of all their sets, of one block of a group.
BLOCK, BLOCK_VALUES = 1024, 1 << 21
#: Columns of one product of incidence matrices.
COLUMNS = 4096
#: Up to so many pairs, sets are intersected one by one.
FEW = 64


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (sorted distinct values), as a matrix."""
    if len(left) * len(right) <= FEW:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    if len(left) == 1:
        values, owner = np.concatenate(right), np.repeat(np.arange(len(right)), [len(x) for x in right])
        at = np.minimum(np.searchsorted(left[0], values), len(left[0]) - 1)
        return np.bincount(owner[left[0][at] == values], minlength=len(right))[None, :]
    out = np.zeros((len(left), len(right)), np.float64)
    values = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for at in range(0, len(values), COLUMNS):
        some = values[at : at + COLUMNS]
        marked = []
        for sets in (left, right):
            held = np.zeros((len(sets), len(some)), np.float32)
            for i, x in enumerate(sets):
                x = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], side="right")]
                where = np.searchsorted(some, x)
                held[i, where[some[where] == x]] = 1
            marked.append(held)
        out += marked[0] @ marked[1].T
    return out.astype(np.int64)


class Members:
    """Sets of one block: ids, sizes (of whole sets), and the values that may be in other sets too."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.values = [np.frombuffer(r[2], np.uint64) for r in rows]

    def near(self, mine: np.ndarray, other: Members, theirs: np.ndarray, percent: int) -> np.ndarray:
        both = overlaps([self.values[i] for i in mine], [other.values[i] for i in theirs])
        return 100 * both >= percent * (self.sizes[mine][:, None] + other.sizes[theirs][None, :] - both)


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all that a matrix of links between two lists of ids does."""
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    near, left, right = near[np.ix_(rows, cols)], left[rows], right[cols]
    ours, theirs = np.arange(len(left)), np.full(len(right), len(left))
    while True:
        theirs = np.minimum(theirs, np.where(near, ours[:, None], len(left)).min(axis=0))
        new = np.where(near, theirs[None, :], len(left)).min(axis=1)
        if np.array_equal(new, ours):
            break
        ours = new
    return [*zip(left.tolist(), left[ours].tolist(), strict=True), *zip(right.tolist(), left[theirs].tolist(), strict=True)]


def block_links(left: Members, right: Members, percent: int) -> list[tuple[int, int]]:
    """Edges that connect all links of two blocks (or within one, if they are the same).

    All members meet the first one; those it links with are together already,
    and only pairs with one of the others are compared after that.
    """
    all_left, all_right = np.arange(len(left.ids)), np.arange(len(right.ids))
    if not len(all_left) or not len(all_right):
        return []
    first = np.zeros(1, np.int64)
    to_left, to_right = left.near(first, left, all_left, percent)[0], left.near(first, right, all_right, percent)[0]
    out = [(int(i), int(left.ids[0])) for i in (*left.ids[to_left], *right.ids[to_right])]
    rest = np.flatnonzero(~to_left)
    if len(rest):
        out += forest(left.near(rest, right, all_right, percent), left.ids[rest], right.ids)
    if left is not right:
        rest, linked = np.flatnonzero(~to_right), np.flatnonzero(to_left)
        if len(rest) and len(linked):
            out += forest(left.near(linked, right, rest, percent), left.ids[linked], right.ids[rest])
    return [e for e in out if e[0] != e[1]]


def _verify_blocks(percent: int):
    """Links among the members of each pair of blocks; the rows of a pair are together."""

    def links(rows: list[tuple[int, int, int, bytes]], one: int, two: int) -> list[tuple[int, int]]:
        left = Members([r[1:] for r in rows if r[0] == one])
        return block_links(left, left if one == two else Members([r[1:] for r in rows if r[0] == two]), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for group, one, two, *row in zip(*[batch.column(c).to_pylist() for c in ("group", "one", "two", "block", "id", "n", "hashes")], strict=True):
                if now != (group, one, two):
                    out.extend(links(rows, now[1], now[2]) if len(rows) > 1 else ())
                    now, rows = (group, one, two), []
                rows.append(tuple(row))
            yield edges_of(out)
        yield edges_of(links(rows, now[1], now[2]) if len(rows) > 1 else [])

    def edges_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def group_components(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of all links within the groups ``(id, root)`` of ``sets (id, n, hashes)``: ``(id, root)``.

    Two sets link when 100 * intersection >= percent * union; ``n`` is the size
    of a set, ``hashes`` its sorted distinct values that may occur in others.
    Rows of ``sets`` may repeat. No pairs are emitted. A group within one block
    is compared in one task; a larger one is dealt into blocks by a hash of the
    id, and each pair of blocks goes to a task that returns edges which connect
    all links. So no link is lost and no task holds more than two blocks. Sets
    without a link do not appear.
    """
    held = groups.join(sets, "id").groupBy("id").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    held = materialize(held, "members")
    blocks = held.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("hashes")) / 8 / BLOCK_VALUES), F.lit(1)).cast("int").alias("blocks"))
    placed = held.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select(F.col("root").alias("group"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "n", "hashes")
    met = met.repartition(shuffle_partitions(groups.sparkSession), "group", "one", "two").sortWithinPartitions("group", "one", "two")
    out = connected_components(met.mapInArrow(_verify_blocks(percent), "a long, b long"))
    discard(held)
    return out
