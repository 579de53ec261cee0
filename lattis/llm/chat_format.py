"""Chat formatting by columnar byte assembly.

A turn becomes ``### <Role>: <text></turn>\\n``. Inside texts the escape
character and the two control strings are written in two characters each, so
that the formatted bytes can be read back exactly:

    \\\\ for a backslash, \\\\h for ``###``, \\\\e for ``</turn>``
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
#: A role outside LABELS is written after this sign, escaped, its colons too.
OTHER = "="

FORMATTED = "conv_id long, fragment long, text string, n_turns long, loss array<struct<start:int,stop:int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    for plain, coded in ESCAPES:
        texts = pc.replace_substring(texts, pattern=plain, replacement=coded)
    return texts


_plain = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _plain[m[1]], text) if "\\" in text else text


def role_label(role: str) -> str:
    if role in LABELS:
        return LABELS[role]
    coded = role
    for plain, code in (*ESCAPES, (":", "\\c")):
        coded = coded.replace(plain, code)
    return OTHER + coded


def role_of(label: str) -> str:
    return unescape(label[1:]) if label.startswith(OTHER) else next(r for r, x in LABELS.items() if x == label)


#: Bytes from which a text is copied whole.
LONG = 1 << 16


def assemble(heads: pa.Array, contents: pa.Array, tail: bytes) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer of head, content, tail for each row; row offsets; content offsets.

    Segment lengths give cumulative offsets; each source buffer, which is
    contiguous, is scattered to its places in the preallocated output. A row
    of over ``LONG`` bytes is copied as a slice: indices take many times the
    bytes they place.
    """
    n = len(contents)
    parts = [_bytes_of(heads), _bytes_of(contents), (np.tile(np.frombuffer(tail, np.uint8), n), np.full(n, len(tail), np.int64))]
    lengths = np.column_stack([x[1] for x in parts])
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(n, 3)
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    for k, (source, length) in enumerate(parts):
        own = np.cumsum(length) - length
        long = np.flatnonzero(length > LONG)
        for i in long:
            out[begins[i, k] : begins[i, k] + length[i]] = source[own[i] : own[i] + length[i]]
        for a, b in zip(np.r_[0, long + 1], np.r_[long, n]):  # the rows between long ones
            if a < b:
                some = np.arange(own[a], own[b - 1] + length[b - 1])
                out[np.repeat(begins[a:b, k] - own[a:b], length[a:b]) + some] = source[some[0] : some[-1] + 1] if len(some) else source[:0]
    rows = np.r_[begins[:, 0], total]
    return buffer, rows, begins[:, 1:]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The contiguous bytes of a string array without nulls, and each row's length."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return data, np.diff(offsets)


def format_conversations(turns: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Formatted conversations in fragments of consecutive turns; columns ``FORMATTED``.

    Rows of a conversation are taken by ``turn`` (null first), equal turns by
    role and text; repeated rows all count. A null role or text counts as
    empty. ``fragment`` numbers a conversation's fragments from 0; its text
    is their concatenation. ``loss`` spans the escaped assistant texts, in
    characters of the fragment. A conversation of any length is formatted a
    batch at a time, never held whole.
    """
    ordered = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fragment = object(), 0
        for whole in batches:
            lengths = pc.binary_length(whole.column(2)).to_numpy()
            cuts = np.searchsorted(np.cumsum(lengths), np.arange(batch_bytes, lengths.sum() + 1, batch_bytes)) + 1
            bounds = sorted({0, len(whole), *(int(c) for c in cuts if c < len(whole))})
            for a, b in zip(bounds, bounds[1:]):
                batch = whole.slice(a, b - a)
                roles = batch.column(1).dictionary_encode()
                labels = pa.array([OPEN + role_label(r) + COLON for r in roles.dictionary.to_pylist()], type=pa.string())
                content = escape(batch.column(2))
                buffer, rows, inner = assemble(labels.take(roles.indices), content, CLOSE.encode())
                keys = batch.column(0).to_pylist()
                starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                stops = [*starts[1:], len(keys)]
                chars = pc.utf8_length(content).to_numpy().astype(np.int64)
                heads = pc.utf8_length(labels).to_numpy().astype(np.int64)[roles.indices.to_numpy()]
                trained = pc.equal(batch.column(1), "assistant").to_numpy(zero_copy_only=False)
                spans = []
                for i, j in zip(starts, stops):
                    ends = np.cumsum(heads[i:j] + chars[i:j] + len(CLOSE))
                    stop = ends - len(CLOSE)
                    at = np.flatnonzero(trained[i:j])
                    spans.append([{"start": int(stop[x] - chars[i + x]), "stop": int(stop[x])} for x in at])
                numbers = []
                for i in starts:
                    fragment = fragment + 1 if keys[i] == last else 0
                    last = keys[i]
                    numbers.append(fragment)
                offsets = pa.py_buffer(np.r_[rows[starts], rows[-1]].astype(np.int32))
                text = pa.StringArray.from_buffers(len(starts), offsets, buffer)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in starts], pa.int64()), pa.array(numbers, pa.int64()), text, pa.array(np.subtract(stops, starts), pa.int64()), pa.array(spans, kind)],
                    names=["conv_id", "fragment", "text", "n_turns", "loss"],
                )

    return ordered.mapInArrow(run, FORMATTED)


def read_turns(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn in formatted text."""
    found, at = [], 0
    while at < len(text):
        colon = text.index(COLON, at)
        stop = text.index(CLOSE, colon)
        found.append((role_of(text[at + len(OPEN) : colon]), unescape(text[colon + len(COLON) : stop])))
        at = stop + len(CLOSE)
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation says when its formatted text is read back; columns ``DIGEST``.

    ``formatted`` holds a conversation's fragments in one partition, in
    order, as :func:`format_conversations` leaves them. SHA-256 takes bytes
    in order, so one task reads a conversation's fragments, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        turns = loss = None
        n = trained = chars = 0
        out: list[tuple] = []

        def close() -> None:
            if key is not run:
                out.append((key, n, turns.hexdigest(), trained, loss.hexdigest(), chars))

        for batch in batches:
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                if key is run or conv != key:
                    close()
                    key, turns, loss, n, trained, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                chars += len(text)
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["stop"]])
                    trained += len(said)
                    loss.update(said.encode())
            if len(out) >= 1024:
                yield flush(out)
                out = []
        close()
        if out:
            yield flush(out)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return formatted.mapInArrow(run, DIGEST)


def check_row(spark: SparkSession) -> DataFrame:
    """Conversation -7: control strings inside a user's and an assistant's text."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
