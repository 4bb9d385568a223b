"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, shuffle_partitions, table

#: The template.
START, END = b"<|im_start|>", b"<|im_end|>\n"
TRAINED = "assistant"
#: Bytes of a segment from which it is copied on its own.
LONG = 4096

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Put a backslash into each ``<|``, and one more where there are some; no ``<|`` is left."""
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """A role must also stay on its line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: list[str], contents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one buffer: the bytes, the turns' offsets, and where each text begins and ends.

    Lengths of the four segments of a turn (mark and role, line end, text, end
    mark) give cumulative offsets. Each segment's bytes are spread to their
    places by scatter indices; marks come from one small buffer over and over.
    Long segments are copied one by one, so indices stay few whatever the texts.
    """
    n = len(roles)
    sides = [pa.array(x, pa.large_string()) for x in (roles, contents)]
    data = [np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8) for x in sides]
    starts = [np.frombuffer(x.buffers()[1], np.int64)[: n + 1] for x in sides]
    marks = np.frombuffer(START + b"\n" + END, np.uint8)
    at = np.array([0, len(START), len(START) + 1])
    lengths = np.stack((np.full(n, len(START)), np.diff(starts[0]), np.ones(n, int), np.diff(starts[1]), np.full(n, len(END))), axis=1).astype(np.int64)
    ends = np.cumsum(lengths.ravel())
    places = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, (source, first) in enumerate(((marks, np.full(n, at[0])), (data[0], starts[0][:-1]), (marks, np.full(n, at[1])), (data[1], starts[1][:-1]), (marks, np.full(n, at[2])))):
        for i in np.flatnonzero(lengths[:, k] > LONG).tolist():
            out[places[i, k] : places[i, k] + lengths[i, k]] = source[first[i] : first[i] + lengths[i, k]]
        size = np.where(lengths[:, k] > LONG, 0, lengths[:, k])
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(places[:, k], size) + inner] = source[np.repeat(first, size) + inner]
    turns = np.concatenate((places[:, 0], ends[-1:])) if n else np.zeros(1, np.int64)
    return out, turns, places[:, 3], places[:, 3] + lengths[:, 3]


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format each turn: ``conv_id, turn, formatted, loss_from, loss_to``.

    The rows of a conversation follow each other in one partition, by turn, and
    their ``formatted`` bytes put together are the conversation. ``loss_from``
    and ``loss_to`` bound, within a row, the bytes that are trained on: the text
    of an assistant's turn, null for others. Marks inside texts and roles are
    escaped reversibly. Null texts and roles are empty. Null ids are one
    conversation, null turns come first, and rows that repeat a turn follow by
    role and text. A long conversation streams through its task, a batch at a
    time. An empty table gives an empty result; other columns are not read.
    """
    rows = batched(turns).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            data, offsets, first, last = assemble([escape_role(x) for x in roles], [escape(x) for x in batch.column("text").to_pylist()])
            formatted = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
            own = [x == TRAINED for x in roles]
            spans = [pa.array(np.where(own, x - offsets[:-1], 0), pa.int64(), mask=~np.array(own, bool)) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), formatted.cast(pa.binary()), *spans], ["conv_id", "turn", "formatted", "loss_from", "loss_to"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted binary, loss_from long, loss_to long")


_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def parse_chat(data: bytes) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; anything else among them is an error."""
    out, at = [], 0
    for m in _TURN.finditer(data):
        if m.start() != at:
            break
        at = m.end()
        out.append((unescape_role(m[1].decode()), unescape(m[2].decode())))
    if at != len(data):
        raise ValueError(f"no turn at byte {at}")
    return out


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back, in the order that ``format_chat`` left them, and digest each conversation.

    One row a conversation, null ids as one; an empty table gives an empty result. Only a batch of turns is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")]
            for conv, data, first, last in zip(*columns, strict=True):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_chat(data):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(data.decode())
                if first is not None:
                    masked = unescape(data[first:last].decode())
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            yield batch_of(rows)
            rows = []
        close()
        yield batch_of(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat_digests(format_chat(turns.unionByName(extra)))
