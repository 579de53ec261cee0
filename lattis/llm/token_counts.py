"""Token counts by a separator scan of flat, unindexed token files.

A flat file is identifiers of one width, every document ended by the
end-of-document identifier, and nothing else. Blocks of a file are searched
for the identifier independently; a prefix scan over the blocks' summaries
numbers the documents and tells where a document that began in an earlier
block started.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattis.llm import files
from lattis.llm.memory import trimmed
from lattis.llm.tokens import byte_bpe
from lattis.session import deal, materialize, new_shared_path


def write_token_files(docs: DataFrame, folder: str, ranks: str, pattern: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each task's texts as one flat file; ``(doc_id, file, ordinal)`` of every row.

    Texts are encoded whole, strings that look like special tokens as
    ordinary text, so ``end_id`` occurs at ends only; a null text counts as
    empty.
    """
    if end_id > np.iinfo(dtype).max:
        raise ValueError(f"{end_id} doesn't fit {dtype}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(ranks, pattern)
        end = np.array([end_id], dtype=dtype)
        name, out, n = "", None, 0
        for batch in trimmed(batches):
            if out is None and len(batch):
                name = f"{folder}/{files.attempt_name('tokens', '.bin')}"
                out = files.create(name)
            first = n
            for text in batch.column(1):
                out.write(encoding.encode_to_numpy(text.as_py() or "").astype(dtype).tobytes())
                out.write(end.tobytes())
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * (n - first), pa.string()), pa.array(np.arange(first, n))], names=["doc_id", "file", "ordinal"])
        if out is not None:
            out.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, file string, ordinal long")


def count_tokens(token_files: DataFrame, end_id: int, dtype: str = "<u2", block_bytes: int = 4 << 20) -> DataFrame:
    """``(file, ordinal, start, n_tokens, ended)`` of every document in the files of ``(file)``.

    ``start`` is the identifier's place in the file; ``n_tokens`` leaves out
    the end identifier. Identifiers after the last end are a last document
    that isn't ``ended``. Neighbouring ends enclose a document of no tokens;
    an empty file holds none; a file that is listed twice counts once, a null
    file not at all. A file whose size isn't a multiple of the width is an
    error. The prefix scan of a file takes one row of five numbers a block.
    """
    width = np.dtype(dtype).itemsize
    block = block_bytes // width * width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                size = files.size(file)
                if size % width:
                    raise ValueError(f"{file} holds part of an identifier")
                n = -(-size // block)
                for k in range(0, n, 65_536):
                    at = np.arange(k, min(n, k + 65_536)) * block
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(at), pa.array(np.minimum(block, size - at))], names=["file", "offset", "bytes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(files.read_range(file, offset, size), dtype=dtype)
                ends = np.flatnonzero(ids == end_id) + offset // width
                last = int(ends[-1]) if len(ends) else None
                stop = (offset + size) // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.string()), pa.array([offset], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([stop], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "offset", "n", "last", "stop", "ends"],
                )

    blocks = token_files.select("file").where("file is not null").distinct().mapInArrow(cut, "file string, offset long, bytes long")
    # written, as the windows run over a few numbers a block and the ends of a block stay where they are
    found = materialize(deal(blocks, "file", "offset").mapInArrow(scan, "file string, offset long, n long, last long, stop long, ends array<long>"), "ends")
    in_file = Window.partitionBy("file").orderBy("offset")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file",
        "offset",
        F.lead("offset").over(in_file).isNull().alias("final"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
    )
    stitched = found.select("file", "offset", "stop", "ends").join(carried, ["file", "offset"])
    tail = F.when(F.col("final") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("carry")) < F.col("stop") - 1), F.array(F.col("stop"))).otherwise(F.array().cast("array<long>"))
    documents = stitched.select("file", "base", "carry", "ends", F.size("ends").alias("n"), F.posexplode(F.concat("ends", tail)).alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("carry")).otherwise(F.get("ends", F.col("at") - 1)) + 1
    return documents.select("file", (F.col("base") + F.col("at")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("at") < F.col("n")).alias("ended"))


def count_document_tokens(spark: SparkSession, docs: DataFrame, ranks: str, pattern: str, end_id: int = 50_256, dtype: str = "<u2", block_bytes: int = 4 << 20, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, file, start)`` for every row of ``docs``, counted from flat files of them."""
    folder = folder or new_shared_path(spark, "tokens")
    written = materialize(write_token_files(docs, folder, ranks, pattern, end_id, dtype, id_col, text_col), "manifest")
    counted = count_tokens(written, end_id, dtype, block_bytes)
    # both sides have a row a document, though the blocks they come from look small: never broadcast
    return written.hint("merge").join(counted.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "start")
