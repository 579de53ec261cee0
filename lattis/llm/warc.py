"""WARC archives: written as one gzip stream a file, then normalised.

A whole-file stream has no entry points. The normaliser inflates each such
file once, rewrites every record as a gzip member of its own, and writes a
sidecar index of offsets beside it, so that any record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattis.llm import files
from lattis.session import deal, materialize, new_shared_path

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, row long, offset long, length long, record_id string, record_type string"


# -------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without it."""
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class RecordReader:
    """Cuts a stream of inflated bytes into records, holding one at a time."""

    def __init__(self) -> None:
        self.buffer = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """The header fields and the whole bytes of each record that ``data`` completes."""
        self.buffer += data
        at = 0
        while len(self.buffer) - at >= self.need:
            end = self.buffer.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head = headers_of(bytes(self.buffer[at:end]))
            total = end + 4 - at + int(head["content-length"]) + 4
            if len(self.buffer) - at < total:
                self.need = total
                break
            yield head, bytes(self.buffer[at : at + total])
            at += total
            self.need = 0
        del self.buffer[:at]

    def close(self) -> None:
        if self.buffer.strip():
            raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and block."""
    end = raw.index(b"\r\n\r\n")
    head = headers_of(raw[:end])
    return head, raw[end + 4 : end + 4 + int(head["content-length"])]


def page_number(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


# ----------------------------------------------------- write and normalise


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` as ``(page_id, url, payload, digest, size, refers_to)``.

    Equal payloads of ``least_bytes`` or more are stored once, by the page
    with the largest id (every row that repeats that id stays a response, as
    does a null id's, which no record could name). Only ids and digests are
    shuffled to decide that; payloads move at most once, by their unique id.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    slim = materialize(base.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    holder = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    revisits = slim.join(holder, "digest").where("page_id <> refers_to").select("page_id", F.col("digest").alias("of"), "refers_to").distinct()
    joined = base.join(revisits, (base.page_id == revisits.page_id) & (base.digest == revisits.of), "left")
    return joined.select(base.page_id, "url", "payload", "digest", "size", "refers_to")


def write_monoliths(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Each task's records as one gzip stream in one file of ``folder``; ``(file, n)`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, out = "", 0, None
        gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(batch.column(i) for i in range(6))):
                if out is None:
                    name = f"{folder}/{files.attempt_name('crawl', '.warc.gz')}"
                    out = files.create(name)
                out.write(gzip.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), size.as_py(), refers_to.as_py())))
                n += 1
        if out is not None:
            out.write(gzip.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    return records.mapInArrow(run, "file string, n long")


def normalise(monoliths: DataFrame, folder: str, level: int = 1, chunk: int = 1 << 20, flush_rows: int = 4_096) -> DataFrame:
    """Rewrite each file of ``(file)`` with one gzip member a record; the rows of ``INDEX``.

    Beside every rewritten file lies ``<file>.idx``, a line
    ``offset length record-id type`` for each record. Streams of one or of
    many members are read alike, a megabyte at a time; one record and
    ``flush_rows`` index rows are held at a time. An archive that ends within a
    record is an error.
    """

    def inflated(uri: str) -> Iterator[bytes]:
        system, path = files.open_fs(uri)
        with system.open_input_stream(path, compression=None) as f:
            stream = zlib.decompressobj(31)
            while data := f.read(chunk):
                while data:
                    if stream.eof:
                        stream = zlib.decompressobj(31)
                    out = stream.decompress(data, chunk)
                    data = stream.unused_data if stream.eof else stream.unconsumed_tail
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, source in enumerate(batch.column(0).to_pylist()):
                name = f"{folder}/{files.attempt_name(f'{source.rpartition('/')[2].split('.')[0]}-{k}', '.warc.gz')}"
                names = [x.split()[0] for x in INDEX.split(", ")]
                rows: dict[str, list] = {x: [] for x in names}
                reader, at, n = RecordReader(), 0, 0
                with files.create(name) as out, files.create(f"{name}.idx") as sidecar:
                    for data in inflated(source):
                        for head, raw in reader.feed(data):
                            gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = gzip.compress(raw) + gzip.flush()
                            out.write(member)
                            sidecar.write(f"{at} {len(member)} {head['warc-record-id']} {head['warc-type']}\n".encode())
                            for key, value in zip(rows, (name, n, at, len(member), head["warc-record-id"], head["warc-type"])):
                                rows[key].append(value)
                            at += len(member)
                            n += 1
                            if n % flush_rows == 0:
                                yield pa.RecordBatch.from_pydict(rows)
                                rows = {x: [] for x in names}
                    reader.close()
                if rows["file"]:
                    yield pa.RecordBatch.from_pydict(rows)

    return monoliths.select("file").mapInArrow(run, INDEX)


def read_records(index: DataFrame, run_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_digest, payload_bytes, stored_digest)``.

    Records are read by their offsets; neighbours in a file are fetched
    together, ``run_bytes`` at a time, and dealt out so that a task reads
    about ``task_bytes`` (the offsets are small, whatever they stand for). A
    response's digest and size are those of the payload that was read; a
    revisit's are its headers'. ``index`` is read twice.
    """
    names = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, stored_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = sorted((s["offset"], s["length"]) for s in spans)
                first = spans[0][0]
                data = memoryview(files.read_range(file, first, spans[-1][0] + spans[-1][1] - first))
                for offset, length in spans:
                    head, block = parse(zlib.decompress(data[offset - first : offset - first + length], 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stored = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = head["warc-type"]
                    if kind == "revisit":
                        digest, size = stored, int(headers_of(http)["content-length"])
                    else:
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    out.append((page_number(head["warc-record-id"]), head.get("warc-target-uri"), kind, page_number(head.get("warc-refers-to")), digest, size, stored))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in names.split(", ")])

    runs = index.groupBy("file", F.floor(F.col("offset") / run_bytes).alias("run")).agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    stored = index.agg(F.sum("length")).first()[0] or 0
    # by a hash of its own: the aggregate is partitioned by file and run already, and would be left as it is
    dealt = deal(runs.withColumn("to", F.xxhash64("file", "run")), "to", least=-(-stored // task_bytes))
    return dealt.select("file", "spans").mapInArrow(run, names)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC, normalise the archives, and return their ``INDEX``.

    A null html is an empty payload. The whole-file streams are removed once
    the index of their normalised forms is committed. No pages, no files.
    """
    folder = folder or new_shared_path(spark, "warc")
    monoliths = materialize(write_monoliths(with_revisits(pages), f"{folder}/whole"), "whole")
    index = materialize(normalise(deal(monoliths, "file", least=2 * monoliths.count()), f"{folder}/records"), "index")
    system, path = files.open_fs(f"{folder}/whole")
    if system.get_file_info(path).is_file is False and not monoliths.isEmpty():
        system.delete_dir(path)
    return index
