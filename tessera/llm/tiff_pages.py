"""TIFF images in a binary column: one row per page, and a writer for grey pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table

# Fixed values of the format: tags, field types and their sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Samples that a byte of a file can stand for at most, by compression; a header that asks for more is an error, not an allocation.
MOST = {PLAIN: 8, PACKBITS: 64 * 8, LZW: 4096 * 8, DEFLATE: 1100 * 8, OLD_DEFLATE: 1100 * 8}


def unpack_bits(data: bytes, size: int) -> bytes:
    """Decode PackBits."""
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        have += len(part)
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Encode PackBits: runs of three or more as runs, the rest as literals."""
    codes = np.frombuffer(data, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)])) if len(codes) else np.zeros(1, int)
    out, plain = [], 0

    def literal(first: int, last: int) -> None:
        for i in range(first, last, 128):
            out.append(bytes([min(128, last - i) - 1]) + data[i : min(i + 128, last)])

    lengths = np.diff(edges)
    for k in np.flatnonzero(lengths >= 3):
        first, last = int(edges[k]), int(edges[k + 1])
        literal(plain, first)
        while last - first >= 2:
            n = min(128, last - first)
            out.append(bytes([257 - n, data[first]]))
            first += n
        plain = first
    literal(plain, len(data))
    return b"".join(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Decode LZW: codes of 9 to 12 bits, highest bit first, with the early change of width."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    words, width, held, bits, last, out, have = list(first), 9, 0, 0, b"", [], 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            words, width, last = list(first), 9, b""
            continue
        if code == 257 or have >= size:
            break
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(word)
        have += len(word)
        if last:
            words.append(last + word[:1])
            if len(words) + 1 >= 1 << width and width < 12:
                width += 1
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Encode LZW as ``lzw_decode`` reads it."""
    out, held, bits, width = bytearray(), 0, 0, 9
    words: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal words, width
        put(256)
        words, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    word, count = b"", 258
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer] = count
        count += 1
        if count >= 4094:
            clear()
            count = 258
        elif count >= 1 << width:
            width += 1
        word = data[k : k + 1]
    if word:
        put(words[word])
        count += 1
        if count >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == PLAIN:
        return data
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {how} is not supported")


def _unpredict(block: np.ndarray, kind: int, order: str) -> np.ndarray:
    """Undo a predictor on rows x columns x samples."""
    if kind == 1:
        return block
    if kind == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if kind == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        planes = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, columns * samples * size // samples, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples).astype(f"{order}f{size}")
    raise ValueError(f"predictor {kind} is not supported")


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Tags and values of one directory, and where the next one is."""
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    entry, inline = (20, 8) if big else (12, 4)
    out: dict[int, tuple] = {}
    for k in range(count):
        here = at + k * entry
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, here)
        if kind not in FIELD:
            continue
        form = f"{order}{n}{FIELD[kind]}"
        where = here + entry - inline
        if struct.calcsize(form) > inline:
            where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
        out[tag] = struct.unpack_from(form, data, where)
    return out, struct.unpack_from(order + ("Q" if big else "I"), data, at + count * entry)[0]


def decode_page(data: bytes, tags: dict[int, tuple], order: str) -> tuple[int, int, int, int, bytes]:
    """Width, height, samples, bits and the samples of one page, row by row, in the file's byte order."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits, how = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1)
    if how not in MOST:
        raise ValueError(f"compression {how} is not supported")
    if not all(isinstance(x, int) and 0 < x < 1 << 31 for x in (width, height, samples)):
        raise ValueError(f"a page of {width} x {height} x {samples} samples")
    planes = samples if one(PLANAR, 1) == 2 and samples > 1 else 1
    deep = samples // planes
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"{tags.get(BITS)} bits a sample are not supported")
    kind = np.dtype(np.uint8) if bits < 8 else np.dtype(f"{order}{'f' if one(SAMPLE_FORMAT, 1) == 3 and bits > 16 else 'u'}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    wide, tall = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if not all(isinstance(x, int) and 0 < x < 1 << 31 for x in (wide, tall)):
        raise ValueError(f"blocks of {wide} x {tall}")
    if max(width * height * samples, wide * tall * deep) * max(bits, 8) // 8 > MOST[how] * len(data):
        raise ValueError(f"a page of {width} x {height} needs more than the file can hold")
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags.get(STRIP_BYTES) or (len(data),))
    across, down = -(-width // wide), -(-height // tall)
    image = np.zeros((planes, height, width, deep), kind)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(k, across * down)
        if plane >= planes:
            break
        y, x = place // across * tall, place % across * wide
        rows = tall if tiled else min(tall, height - y)
        line = (wide * deep * bits + 7) // 8
        raw = _expand(data[offset : offset + size], how, rows * line)
        raw = raw[: rows * line].ljust(rows * line, b"\0")
        if bits < 8:
            units = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : wide * deep * bits].reshape(rows, wide, deep, bits)
            block = (units << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, wide, deep)
            if one(PREDICTOR, 1) == 2 and kind.kind == "f":
                block = _unpredict(block.view(f"{order}u{bits // 8}"), 2, order).view(kind)
            else:
                block = _unpredict(block, one(PREDICTOR, 1), order)
        image[plane, y : y + rows, x : x + wide] = block[: height - y, : width - x]
    return width, height, samples, bits, np.ascontiguousarray(image.transpose(1, 2, 0, 3)).tobytes()


#: What decoding bytes of any kind may raise.
BAD = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)


def pages_of(data: bytes) -> Iterator[tuple]:
    """(page, width, height, samples, bits, sample bytes, error) for each directory, in order.

    A page that can't be decoded has an error and no samples, and the walk goes
    on; a file whose directories can't be walked gives one row with an error.
    """
    page = 0
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        version = struct.unpack_from(order + "H", data, 2)[0]
        if version not in (42, 43):
            raise ValueError(f"version {version}")
        big = version == 43
        at, seen = struct.unpack_from(order + "Q", data, 8)[0] if big else struct.unpack_from(order + "I", data, 4)[0], set()
        while at:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            tags, at = _fields(data, at, order, big)
            try:
                yield page, *decode_page(data, tags, order), None
            except BAD as e:
                yield page, None, None, None, None, None, str(e) or type(e).__name__
            page += 1
        if not page:
            raise ValueError("no directory")
    except BAD as e:
        yield page, None, None, None, None, None, f"not a readable TIFF file: {e}"


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 0, order: str = "<") -> bytes:
    """A TIFF file of grey pages (rows x columns, unsigned); tiles of that size, else strips."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    pack = {PLAIN: bytes, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    for image in pages:
        image = image.astype(image.dtype.newbyteorder(order))
        height, width = image.shape
        tall, wide = (tile, tile) if tile else (rows_per_strip or height, width)
        offsets, sizes = [], []
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                block = image[y : y + tall, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), block.dtype)).astype(image.dtype)
                packed = pack(block.tobytes())
                offsets.append(len(out)), sizes.append(len(packed))
                out += packed
        bits = image.dtype.itemsize * 8
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [bits], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [tall], STRIP_BYTES: sizes}
        away = {}
        for tag, values in sorted(tags.items()):
            if len(values) > 1:
                away[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, values in sorted(tags.items()):
            out += struct.pack(order + "HHII", tag, 4, len(values), away.get(tag, values[0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(images: DataFrame, image: str = "image") -> DataFrame:
    """One row per page of each TIFF file in a binary column, with all other columns.

    Adds ``page, width, height, samples, bits, pixels, error`` (input columns of
    such names give way); ``pixels`` holds the decoded samples row by row. Reads
    classic and 64-bit files of either byte order; strips and tiles; plain,
    PackBits, LZW and deflate; predictors 1 to 3; 1 to 64 bits. What can't be
    read is a row with ``error``, whatever the bytes; a null file gives no row.
    Repeated rows are read each on their own, an empty table gives an empty
    result. Files are decoded each alone, a page at a time, without a shuffle.
    """
    made = "page int, width int, height int, samples int, bits int, pixels binary, error string"
    names = [x.split()[0] for x in made.split(", ")]
    kept = [c for c in images.columns if c.lower() not in names]
    rows = batched(images).select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(image).alias("image"))
    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            index: list[int] = []
            size = 0
            for i, data in enumerate(batch.column("image")):
                for found in pages_of(data.as_buffer().to_pybytes()) if data.is_valid else ():
                    index.append(i), held.append(found)
                    size += len(found[5] or b"")
                    if size > 1 << 24:
                        yield emit(batch, index, held)
                        index, held, size = [], [], 0
            yield emit(batch, index, held)

    def emit(batch: pa.RecordBatch, index: list[int], held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(index, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["row", *names])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {made}").select("row.*", *names)


COLUMNS = 64
STRIP_ROWS = 256


def text_images(docs: DataFrame, text: str = "text", image: str = "image") -> DataFrame:
    """Each text's UTF-8 bytes, zeros appended to a positive multiple of 64, as a grey page 64 samples wide.

    A checksum of the bytes chooses PackBits, LZW, or deflate with the
    horizontal predictor, in strips, so equal texts give equal files.
    """
    kept = [c for c in docs.columns if c not in (text, image)]
    rows = batched(docs).select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, sizes = [], []
            for x in batch.column("text").to_pylist():
                data = x.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                padded = np.frombuffer(data.ljust(max(1, -(-len(data) // COLUMNS)) * COLUMNS, b"\0"), np.uint8).reshape(-1, COLUMNS)
                how = (PACKBITS, LZW, DEFLATE)[zlib.crc32(data) % 3]
                files.append(write_tiff([padded], how, 2 if how == DEFLATE else 1, rows_per_strip=STRIP_ROWS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["row", "n_bytes", "image"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, image binary").select("row.*", "n_bytes", F.col("image").alias(image))


def page_feature(pixels: bytes | None) -> str | None:
    """Sixteen 4-bit levels of a grey page, its mean and spread: a short name for how it looks."""
    if not pixels:
        return None
    codes = np.frombuffer(pixels, np.uint8)
    share = np.bincount(codes >> 4, minlength=16) * 15 // len(codes)
    return "".join(f"{x:x}" for x in share) + f"-{codes.mean():.3f}-{codes.std():.3f}"


def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a TIFF page, read the pages back, and digest both."""
    made = text_images(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sized = made.select("doc_id", "n_bytes", F.length("image").cast("long").alias("media_bytes"), F.sha2("image", 256).alias("media_sha256"), "image")
    pages = tiff_pages(sized)
    kinds = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, pixels binary, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("feature", pa.array([page_feature(x) for x in batch.column("pixels").to_pylist()], pa.string()))

    named = pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "pixels").mapInArrow(run, kinds)
    payload = F.col("pixels")
    return named.select("doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")
