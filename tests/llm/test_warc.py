import hashlib
import zlib

from pyspark.sql import functions as F

from lattis.llm import files, warc
from lattis.session import new_shared_path

BIG = "é" * 700  # 1400 bytes
PAGES = "page_id long, url string, html string, digest string, size long"
ROWS = [
    (1, "http://a/1", BIG, "x", 1),
    (2, None, BIG, None, None),
    (3, "http://a/\n3", BIG, "x", 1),
    (3, "http://a/3", BIG, "x", 1),
    (4, "http://a/4", "small", "x", 1),
    (5, "http://a/5", "small", "x", 1),
    (6, "http://a/6", None, "x", 1),
    (7, "http://a/7", "", "x", 1),
    (8, "http://a/8", "one\r\n\r\nWARC/1.1\r\n" * 9000, "x", 1),
    (None, "http://a/9", BIG, "x", 1),
]


def test_round_trip(spark):
    index = warc.archive(spark, spark.createDataFrame(ROWS, PAGES))
    found = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect())
    expected = []
    for page, _, html, *_ in ROWS:
        data = (html or "").encode()
        revisit = page in (1, 2)
        expected.append((page or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert found == sorted(expected)


def test_each_record_is_a_member_and_the_sidecar_tells_where(spark):
    index = warc.archive(spark, spark.createDataFrame(ROWS, PAGES)).collect()
    assert len(index) == len(ROWS)
    for file in {r["file"] for r in index}:
        lines = bytes(files.read_range(f"{file}.idx", 0, files.size(f"{file}.idx"))).decode().splitlines()
        assert len(lines) == sum(r["file"] == file for r in index)
        data = bytes(files.read_range(file, 0, files.size(file)))
        at = 0
        for offset, length, name, kind in (x.split() for x in lines):
            assert int(offset) == at
            member = zlib.decompressobj(31)
            raw = member.decompress(data[at : at + int(length)])
            assert member.eof and not member.unused_data
            head, _ = warc.parse(raw)
            assert (head["warc-record-id"], head["warc-type"]) == (name, kind)
            at += int(length)
        assert at == len(data)


def test_streams_of_one_or_many_members_are_read_alike(spark):
    raws = [warc.record(k, "u", b"x" * k * 5000, hashlib.sha1(b"x" * k * 5000).hexdigest(), k * 5000, None) for k in range(1, 6)]
    folder = new_shared_path(spark, "test")
    one, many = zlib.compressobj(6, 8, 31), b""
    for raw in raws:
        gzip = zlib.compressobj(6, 8, 31)
        many += gzip.compress(raw) + gzip.flush()
    for name, data in (("one", one.compress(b"".join(raws)) + one.flush()), ("many", many)):
        with files.create(f"{folder}/{name}.warc.gz") as f:
            f.write(data)
        source = spark.createDataFrame([(f"{folder}/{name}.warc.gz",)], "file string")
        found = warc.read_records(warc.normalise(source, f"{folder}/out", chunk=100).cache()).collect()
        assert sorted((r["page_id"], r["payload_bytes"]) for r in found) == [(k, k * 5000) for k in range(1, 6)]


def test_no_pages(spark):
    assert warc.read_records(warc.archive(spark, spark.createDataFrame([], PAGES))).collect() == []


def test_the_read_back_takes_many_tasks(spark):
    pages = spark.range(400).selectExpr("id as page_id", "'u' as url", "repeat(cast(id * 7919 as string), 300) as html")
    index = warc.archive(spark, pages)
    tasks = warc.read_records(index, run_bytes=2_000).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 400
    many = warc.read_records(index, run_bytes=2_000, task_bytes=3_000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert many > len(tasks)


def test_index_rows_are_flushed(spark):
    raws = [warc.record(k, "u", b"x", hashlib.sha1(b"x").hexdigest(), 1, None) for k in range(25)]
    folder = new_shared_path(spark, "test")
    stream = zlib.compressobj(6, 8, 31)
    with files.create(f"{folder}/a.warc.gz") as f:
        f.write(stream.compress(b"".join(raws)) + stream.flush())
    for batch in (1, 10, 25):
        index = warc.normalise(spark.createDataFrame([(f"{folder}/a.warc.gz",)], "file string"), f"{folder}/out", flush_rows=batch).collect()
        assert [r["row"] for r in index] == list(range(25))
