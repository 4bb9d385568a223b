"""BPE as a streaming transducer with bounded lookahead, and a streaming decoder."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table, texts

#: Fixed value: how the byte-level tokenizer splits text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, turned round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(raw[a], raw[b]) for a, b in pairs]
        self.rank = {(self.ids[a], self.ids[b]): (k, self.ids[a + b]) for k, (a, b) in enumerate(self.merges)}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(self.merges)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """How many bytes after a token's end decide that it is final.

    Compare the merging of a text with that of a prefix of it. Up to some
    boundary both agree; at first that is the prefix's end. A merge of (u, v)
    moves this frontier, by the length of u to the left, only if u ends there
    and v starts there in one of the two. Each rank can do so once, since equal
    pairs are merged from the left. After it the token at the frontier has u
    on its left edge, so the next merge (u', v') that moves the frontier has a
    later rank and a v' with u on its left edge. The lookahead is the longest
    such chain by the total length of its u, and a pass over the merges in
    order of rank finds it.
    """
    parts: dict[bytes, bytes] = {}
    best: dict[bytes, int] = {}
    longest = 0
    for u, v in merges:
        reach, edge = 0, v
        while edge:
            reach = max(reach, best.get(edge, 0))
            edge = parts.get(edge, b"")
        reach += len(u)
        best[u] = max(best.get(u, 0), reach)
        longest = max(longest, reach)
        parts.setdefault(u + v, u)
    return longest


def merge_bytes(data: bytes, m: Merges) -> list[int]:
    """Merge one stretch of bytes, lowest rank first and from the left."""
    n = len(data)
    ids = [m.single[b] for b in data]
    if n < 2:
        return ids
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(*r, i) for i in range(n - 1) if (r := m.rank.get((ids[i], ids[i + 1])))]
    heap = [(r, i, new, ids[i], ids[i + 1]) for r, new, i in heap]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else -1
            if y >= 0 and (r := m.rank.get((ids[x], ids[y]))):
                heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
    return [x for x in ids if x >= 0]


class Encoder:
    """The transducer: text goes in piece by piece, final tokens come out.

    It holds at most one stretch up to ``lookahead`` bytes beyond the last final
    token, however long a word is, and a memory of frequent words of bounded
    size.
    """

    LIMIT = 200_000
    WINDOW = 4096
    PIECE = 1 << 16

    def __init__(self, merges: Merges):
        self.m = merges
        self.split = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.known: dict[str, bytes] = {}

    def stretch(self, data: bytes) -> Iterator[int]:
        """Tokens of a word: windows are merged, and what ends before the lookahead is final."""
        window, at = self.WINDOW + self.m.lookahead, 0
        while len(data) - at > window:
            stop, done = at + window - self.m.lookahead, at
            for token in merge_bytes(data[at : at + window], self.m):
                if done + len(self.m.bytes[token]) > stop:
                    break
                done += len(self.m.bytes[token])
                yield token
            at = done
        yield from merge_bytes(data[at:], self.m)

    def word(self, word: str) -> bytes:
        out = np.array(list(self.stretch(word.encode())), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[word] = out
        return out

    def plain(self, text: str) -> Iterator[bytes]:
        """Text without special tokens, split into words a piece at a time.

        A piece is cut before its last blank that follows a character of
        another kind, where no word can span.
        """
        at, known, word = 0, self.known, self.word
        while at < len(text):
            stop = len(text)
            if stop - at > self.PIECE:
                stop = at + self.PIECE
                while stop < len(text) and not (text[stop] == " " and text[stop - 1] not in " \t\n\r" and not text[stop - 1].isspace()):
                    stop += 1
            words = self.split.findall(text[at:stop] if at or stop < len(text) else text)
            yield b"".join([known.get(w) or word(w) for w in words])
            at = stop

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        for k, piece in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                parts.append(np.array([self.m.special[piece]], "<u4").tobytes())
            elif piece:
                parts.extend(self.plain(piece))
        return np.frombuffer(b"".join(parts), "<u4")


class Decoder:
    """Bytes to text, a block of ids at a time: a UTF-8 state machine keeps an unfinished character."""

    BLOCK = 1 << 14

    def __init__(self, merges: Merges):
        self.table = [merges.bytes.get(i, b"") for i in range(max(merges.bytes) + 1)]

    def pieces(self, ids: Iterable[int] | np.ndarray) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.asarray(ids)
        for at in range(0, len(ids), self.BLOCK):
            yield machine.decode(b"".join(map(self.table.__getitem__, ids[at : at + self.BLOCK].tolist())))
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int] | np.ndarray) -> str:
        return "".join(self.pieces(ids))


_loaded: dict[str, tuple[Encoder, Decoder]] = {}


def _tools(path: str) -> tuple[Encoder, Decoder]:
    if path not in _loaded:
        merges = Merges(path)
        _loaded[path] = Encoder(merges), Decoder(merges)
    return _loaded[path]


SLICE = 128


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the tokens of each text as little-endian 32-bit integers in a binary column.

    A null text is empty; an input column of the name gives way. Rows are
    encoded each alone, without a shuffle, so an empty table, repeated rows and
    other columns need no care.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(tokenizer)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = pa.array([encoder.encode(x).tobytes() for x in texts(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), out], ["row", "text", "ids"])

    return _over(docs, text, ids, "binary", run)


def bpe_decode(docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` stand for; null ids are none, unknown ids no text, bad UTF-8 is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tools(tokenizer)[1]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [decoder.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(found, pa.string())], ["row", "text", "ids"])

    return _over(docs, ids, text, "string", run)


def _over(docs: DataFrame, read: str, made: str, kind: str, run) -> DataFrame:
    """Apply ``run`` to one column and keep the others."""
    kept = [c for c in docs.columns if c.lower() != made.lower() and c != read]
    rows = batched(docs).select((F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0))).alias("row"), F.col(read).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    done = rows.mapInArrow(run, f"row {types['row']}, text {types['text']}, ids {kind}")
    order = [c for c in docs.columns if c.lower() != made.lower()]
    return done.select(*[F.col("text").alias(c) if c == read else F.col(f"row.{c}").alias(c) for c in order], F.col("ids").alias(made))


def bpe_digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text and keep sizes and digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A row per row: a null or empty text has no tokens, rows that repeat an id or
    have none are judged alone, very long texts whole. Other columns are not
    read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(tokenizer)
        for batch in batches:
            counts, codes, decoded = [], [], []
            for x in texts(batch.column("text")):
                ids = encoder.encode(x)
                counts.append(len(ids))
                codes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                digest = hashlib.sha256()
                for piece in decoder.pieces(ids):
                    digest.update(piece.encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return batched(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
