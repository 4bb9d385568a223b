"""Quality rules: how well a text compresses, as a whole and chunk by chunk, against limits by length.

Repetitive text compresses too well, encoded or random text too badly. Short
texts compress worse than long ones of the same kind, so each length has its
own band of the ratio of compressed to raw bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table, texts

#: From so many bytes on: lowest and highest ratio of prose. Below the first, and below its
#: low limit's length, overhead of the format hides what the text is like.
BANDS = ((64, 0.50, 1.30), (128, 0.40, 1.05), (256, 0.32, 0.90), (512, 0.28, 0.80), (1024, 0.25, 0.72), (2048, 0.23, 0.66), (4096, 0.20, 0.62), (16384, 0.18, 0.60), (131072, 0.14, 0.58), (1048576, 0.10, 0.58))
CHUNK = 4096
#: A text fails if chunks outside their bands hold more than this share of its bytes.
BAD_SHARE = 0.25
LEVEL = 3

WINDOW = 5
MIN_WORDS = 10
#: Percent of words in windows that occur again.
MAX_REPEAT = 20
_BLANKS, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"

_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_share double, kept boolean"


def _renumber(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each distinct pair."""
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1]


def repeated_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that occur twice or more, by exact comparison.

    Windows are numbered by doubling: numbers of pairs, of pairs of pairs, and
    so on, so neither hashes nor copies of the words are needed.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    one = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    number, covered, span = one, 1, one
    while covered * 2 <= width:
        number = _renumber(number[:-covered], number[covered:])
        covered *= 2
    if covered < width:
        span = number[width - covered :]
        number = _renumber(number[: len(span)], span)
    again = np.bincount(number)[number] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(again), 1)
    np.add.at(marks, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def outside(size: int, packed: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> bool:
    """Whether ``size`` bytes that compress to ``packed`` lie outside the band of their length."""
    fitting = [b for b in bands if b[0] <= size]
    return bool(fitting) and not fitting[-1][1] <= packed / size <= fitting[-1][2]


def judge(text: str, packer: zstandard.ZstdCompressor, bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> tuple:
    """The columns of ``_FIELDS`` for one text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _BLANKS)))
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(words)
    packed = len(packer.compress(raw)) if raw else 0
    view, bad = memoryview(raw), 0
    for at in range(0, len(raw), chunk):
        part = view[at : at + chunk]
        bad += len(part) * outside(len(part), packed if len(part) == len(raw) else len(packer.compress(part)), bands)
    kept = not failed and not outside(len(raw), packed, bands) and bad <= bad_share * len(raw)
    return len(words), word_chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, packed / max(1, len(raw)), bad / max(1, len(raw)), kept


def compression_quality(docs: DataFrame, text: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> DataFrame:
    """Adds base counts, ``base_failed``, ``ratio``, ``bad_share`` and ``kept`` to each row.

    A text is kept if it passes the base rules (words, repeated windows), its
    zstandard ratio lies in the band of its length, and chunks outside the band
    of theirs hold at most ``bad_share`` of its bytes. A last, shorter chunk is
    judged by its own length. Null and empty texts have no words and are not
    kept; equal texts, rows that repeat an id and ties are judged alike, row by
    row; an empty table gives an empty result. Texts of any length are read
    whole, in memory that a text's own size bounds. Input columns of the new
    names give way. Nothing is shuffled.
    """
    new = [f.split()[0] for f in _FIELDS.split(", ")]
    schema = pa.struct([(f.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]]) for f in _FIELDS.split(", ")])

    @F.arrow_udf(_FIELDS)
    def judged(column: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        rows = [judge(x, packer, bands, chunk, bad_share) for x in texts(column)]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], fields=list(schema))

    stay = [c for c in docs.columns if c.lower() not in new]
    return batched(docs).select(*[F.col(f"`{c}`") for c in stay], judged(F.col(text)).alias("judged")).select(*[F.col(f"`{c}`") for c in stay], "judged.*")


def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
