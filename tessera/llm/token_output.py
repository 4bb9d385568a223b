"""Token ids on disk: fixed-width bit packing with block offsets."""

from __future__ import annotations

import json
import re
import string
import struct
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, scratch_path, shuffle_partitions, table

MAGIC = b"TSRP0001"
HEAD = struct.Struct("<8sBxxxIIIQQ")  # magic, bits, part, documents, blocks, ids, ids of the part before this chunk
BLOCK_IDS = 4096
CHUNK_IDS = 1 << 18
CHUNKS_PER_FILE = 16


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first, without gaps."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, count: int, start: int = 0) -> np.ndarray:
    """``count`` ids from the ``start``-th on."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count, start * 2).astype(np.uint32)
    first = start * bits
    part = np.frombuffer(data, np.uint8)[first // 8 : (first + count * bits + 7) // 8]
    spread = np.unpackbits(part, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack_chunk(part: int, before: int, docs: list, ids: list[np.ndarray], bits: int) -> bytes:
    """One self-contained chunk: header, document ids and ends, block offsets, packed blocks.

    A block holds BLOCK_IDS ids and starts on a byte, at the offset that the
    chunk lists, so any id is found without reading those before it.
    """
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack_ids(every[i : i + BLOCK_IDS], bits) for i in range(0, len(every), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = HEAD.pack(MAGIC, bits, part, len(docs), len(blocks), len(every), before)
    known = np.array([d is not None for d in docs], np.uint8)
    names, ends = np.array([d or 0 for d in docs], "<i8"), np.cumsum([len(x) for x in ids]).astype("<u8")
    return b"".join([head, known.tobytes(), names.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class Chunk:
    """Reads a chunk in place; ``end`` is where it ends in ``data``."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, self.bits, self.part, docs, blocks, self.ids, self.before = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a chunk of packed token ids")
        at += HEAD.size
        self.names = pa.array(np.frombuffer(data, "<i8", docs, at + docs).astype(np.int64), mask=np.frombuffer(data, np.uint8, docs, at) == 0)
        self.ends = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
        start = at + 17 * docs + 8 * (blocks + 1)
        self.end = start + int(self.offsets[-1])
        self.data = data[start : self.end]

    @property
    def docs(self) -> list[int | None]:
        return self.names.to_pylist()

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last``, from the blocks that hold them."""
        out, at = [], first
        while at < last:
            block = at // BLOCK_IDS
            stop = min(last, (block + 1) * BLOCK_IDS)
            out.append(unpack_ids(self.data[self.offsets[block] : self.offsets[block + 1]], self.bits, stop - at, at - block * BLOCK_IDS))
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def strings(column: pa.Array) -> list[str]:
    """Words without line ends as strings, made at once."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), "\n")[0].as_py().split("\n") if len(column) else []


def runs(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` by number, one after another, and where they end; run ``k`` is from ``ends[k]`` to ``ends[k + 1]``."""
    sizes = np.diff(ends)[which]
    found = np.concatenate(([0], np.cumsum(sizes)))
    places = np.repeat(ends[which] - found[:-1], sizes)
    places += np.arange(found[-1])
    return ids[places], found


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, word by word.

    Each distinct word of a batch is looked up once. Words between blanks and
    line ends that are new go to the library many at a time, as one text with a
    special token between them. Where the tokenizer splits as SPLITS says,
    words of Latin letters go in lower case, with blanks between, and past its
    normalizer and pattern, which leave them whole; one that marks follow is
    made of both. The first LIMIT words that a worker meets are remembered,
    frequent ones among them.
    """

    LIMIT = 300_000
    LONG = 64
    TOGETHER = 64
    #: Latin letters that stay letters in lower case.
    LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).lower().isalpha())
    #: A run of these is a piece of its own behind letters; an apostrophe may belong to letters, and special tokens begin with the other one.
    MARKS = "".join(c for c in string.punctuation if c not in "'<")
    OF_LETTERS = f"^[{LETTERS}]+$"
    MARKED = f"^[{LETTERS}]+[{re.escape(MARKS)}]*$"
    SPLITS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
    }

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = {t.content: i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.known: dict[str, int] = {"": 0}
        #: Ids of known words by number, and where those of each end.
        self.ids, self.bounds = np.zeros(0, "<u4"), np.zeros(2, np.int64)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        settings = json.loads(self.tokenizer.to_str())
        self.splits = bool(suffix) and all(settings[k] == v for k, v in self.SPLITS.items()) and all(t.content[:1] not in self.LETTERS + self.MARKS for t in added.values())

    def short(self, words: pa.Array, pattern: str) -> pa.Array:
        """Which words fit a pattern and are short."""
        return pc.and_(pc.match_substring_regex(words, pattern), pc.less_equal(pc.binary_length(words), self.LONG))

    def halves(self, words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """What is looked up for each word: letters in lower case and the marks behind, or the whole word and nothing."""
        if not self.splits:
            return words.dictionary_encode(), pc.binary_repeat(words, 0).dictionary_encode()
        marked = self.short(words, self.MARKED)
        stems = pc.if_else(marked, pc.utf8_lower(pc.utf8_rtrim(words, self.MARKS)), words)
        return stems.dictionary_encode(), pc.if_else(marked, pc.utf8_ltrim(words, self.LETTERS), "").dictionary_encode()

    def new_words(self, words: list[str], letters: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after another, and how many each has; the first ``letters`` words are of letters alone.

        These are told apart by ends of words, if their number is what it should be.
        """
        texts = [" ".join(words[at : min(at + self.TOGETHER, letters)]) for at in range(0, letters, self.TOGETHER)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.plain.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != letters:
            ids, ends, letters = ids[:0], ends[:0], 0
        found = self.other_words(words[letters:])
        parts = [found[w] for w in words[letters:]]
        others = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.concatenate((ids, np.frombuffer(b"".join(parts), "<u4"))), np.concatenate((np.diff(ends, prepend=0), others))

    def other_words(self, words: list[str]) -> dict[str, bytes]:
        mark = next(iter(self.marks), None)
        alone = [w for w in words if len(w) > self.LONG or mark is None or any(m in w for m in self.marks)]
        out = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True)}
        rest = [w for w in words if w not in out] if alone else words
        texts = [mark.join(rest[at : at + self.TOGETHER]) for at in range(0, len(rest), self.TOGETHER)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.marks[mark]), len(ids)).tolist()
            data, first = ids.tobytes(), 0
            for word, end in zip(rest[k * self.TOGETHER : (k + 1) * self.TOGETHER], ends, strict=True):
                out[word] = data[4 * first : 4 * end]
                first = end + 1
        return out

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each word, and ids and their bounds by number; new words are encoded and, up to LIMIT, remembered."""
        ids, bounds = self.ids, self.bounds
        number = np.fromiter(map(self.known.get, strings(words), repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number, ids, bounds
        new = words.take(pa.array(missing))
        letters = self.short(new, self.OF_LETTERS).to_numpy(zero_copy_only=False) if self.splits else np.zeros(len(new), bool)
        long = pc.greater(pc.utf8_length(new), self.LONG).to_numpy(zero_copy_only=False)
        order = np.argsort(np.where(letters, 0, np.where(long, 2, 1)), kind="stable")
        each, first = strings(new.take(pa.array(order))), len(bounds) - 1
        more, sizes = self.new_words(each, int(letters.sum()))
        number[missing[order]] = np.arange(first, first + len(each))
        ids, bounds = np.concatenate((ids, more)), np.concatenate((bounds, bounds[-1] + np.cumsum(sizes)))
        if len(self.known) < self.LIMIT:
            kept = len(each) - int((long & ~letters).sum())
            self.known.update(zip(each[:kept], range(first, first + kept), strict=True))
            self.bounds = bounds[: first + kept + 1].copy()
            self.ids = ids[: self.bounds[-1]].copy()
        return number, ids, bounds

    def encode(self, batch: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text; Arrow splits the texts and numbers their distinct words, so only those are looked up."""
        column = pc.fill_null(batch if isinstance(batch, pa.Array) else pa.array(batch, pa.string()), "")
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        stems, tails = self.halves(words.dictionary)
        number, ids, bounds = self.numbers(pa.concat_arrays([stems.dictionary, tails.dictionary]))
        both = np.column_stack((number[stems.indices.to_numpy()], number[tails.indices.to_numpy() + len(stems.dictionary)])).ravel()
        ids, bounds = runs(ids, bounds, both)
        ids, bounds = runs(ids, bounds[::2], words.indices.to_numpy())
        return np.split(ids, bounds[split.offsets.to_numpy() - split.offsets[0].as_py()][1:-1]) if len(column) else []


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode texts and write their ids to files under ``path``, in ascending order of ``doc_id``.

    Ranges of ids go to parts, each sorted; a part writes chunks of about
    CHUNK_IDS ids, a few to a file, through Spark's own writer, so a task that
    runs again leaves no partial file. File names sort as their parts do. Each
    text is followed by ``end_id``; a null text is empty. Null ids come first;
    rows that repeat an id stay in the order of their texts.
    """
    spark, bits = docs.sparkSession, id_bits(vocabulary)
    ranged = batched(docs).select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = ranged.repartitionByRange(shuffle_partitions(spark), "doc").sortWithinPartitions("doc", F.crc32(F.col("text").cast("binary")), F.length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        total = 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_chunk(part, before, names, held, bits)], pa.binary())], ["chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                for name, ids in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1)), strict=True):
                    names.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    total += len(ids) + 1
                    if total >= CHUNK_IDS:
                        yield chunk()
                        before, names, held, total = before + total, [], [], 0
        if names:
            yield chunk()

    packed = ranged.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from files of packed ids; start counts the ids of all documents before."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    chunk = Chunk(data, at)
                    at = chunk.end + 1  # the writer ends each chunk with a line feed
                    bounds = np.concatenate(([0], chunk.ends))
                    for k in range(0, len(chunk.names), 256):
                        some = bounds[k : k + 257]
                        ids = np.ascontiguousarray(chunk.read(int(some[0]), int(some[-1])), "<u4")
                        places, n = pa.array(4 * (some - some[0]), pa.int32()), len(some) - 1
                        packed = pa.Array.from_buffers(pa.binary(), n, [None, places.buffers()[1], pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays([pa.array([chunk.part] * n, pa.int32()), chunk.names.slice(k, n), pa.array(chunk.before + some[:-1]), pa.array(np.diff(some)), packed], ["part", "doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, base``: ids in all parts before, from the chunks' headers alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int]] = []
            for content in batch.column(0):
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    chunk = Chunk(data, at)
                    rows.append((chunk.part, chunk.ids))
                    at = chunk.end + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["part", "ids"])

    sums = {r.part: r.ids for r in files.mapInArrow(run, "part int, ids long").groupBy("part").agg(F.sum("ids").alias("ids")).collect()}
    base, rows = 0, []
    for part in sorted(sums):
        rows.append((part, base))
        base += sums[part]
    return spark.createDataFrame(rows, "part int, base long")


def op2_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as packed ids, read the files back and digest what they hold."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    found = read_token_files(spark, path).select("part", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(F.broadcast(part_starts(spark, path)), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
