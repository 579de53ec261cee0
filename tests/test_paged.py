"""A listing read a page a task, narrowed by the server, and asked again where it fails."""

import os

import pytest
from pyspark.sql import functions as F

from lattis.sources import paged as P

SWITCH = "spark.sql.python.filterPushdown.enabled"


class Flaky:
    """250 entities of two types; every page fails once, and one that is ``broken`` always."""

    def __init__(self, options):
        self.folder, self.broken = options["client.marks"], options.get("client.broken")

    def _rows(self, where):
        rows = [(f"e{i:03}", f"name {i}", "odd" if i % 2 else "even") for i in range(250)]
        return [r for r in rows if all(r[2] == v for v in where.values())]

    def count(self, kind, where):
        self._mark(f"count-{len(where)}")
        return len(self._rows(where))

    def page(self, kind, offset, limit, where):
        self._mark(f"{offset}-{len(where)}")
        assert limit <= 100
        return self._rows(where)[offset : offset + limit]

    def _mark(self, name):
        path = os.path.join(self.folder, name)
        if self.broken == name:
            raise TimeoutError("down")
        if not os.path.exists(path):
            open(path, "w").close()
            raise ConnectionError("once")


@pytest.fixture
def pushed(spark):
    before = spark.conf.get(SWITCH, None)
    spark.conf.set(SWITCH, "true")
    yield spark
    spark.conf.set(SWITCH, before) if before is not None else spark.conf.unset(SWITCH)


def flaky(spark, marks, **options):
    return P.read_pages(spark, "entities", "tests.test_paged:Flaky", **{"client.marks": str(marks), **options})


def test_pages_are_read_by_tasks_of_their_own_and_again_if_they_fail(spark, tmp_path):
    df = flaky(spark, tmp_path, page_size=40)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["id"] for r in rows) == [f"e{i:03}" for i in range(250)]
    assert len({r["task"] for r in rows}) == 7
    assert {f"{k}-0" for k in range(0, 250, 40)} <= set(os.listdir(tmp_path))


def test_the_server_narrows_by_type(pushed, tmp_path):
    df = flaky(pushed, tmp_path).where("entity_type = 'odd' and name <> 'name 3'")
    assert df.count() == 124
    assert set(os.listdir(tmp_path)) == {"count-1", "0-1", "100-1"}  # two pages of one type, never the other's


def test_a_page_that_never_comes_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="down"):
        flaky(spark, tmp_path, retries=1, **{"client.broken": "100-0"}).collect()
    with pytest.raises(Exception, match="kind is one of"):
        P.read_pages(spark, "things", "tests.test_paged:Flaky")
    with pytest.raises(Exception, match="unknown options"):
        flaky(spark, tmp_path, pages=3).collect()


def test_a_listing_in_a_folder(pushed):
    rows = pushed.createDataFrame([(f"n{i}", None if i % 7 == 0 else f"name{i}", ("a", "b", None)[i % 3]) for i in range(500)], "id string, name string, entity_type string")
    df = P.folder_pages(rows, "entities", 30)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(df) == key(rows) and key(df.where("entity_type = 'b'")) == key(rows.where("entity_type = 'b'")) and key(df.where("entity_type is null")) == key(rows.where("entity_type is null"))
    assert df.where("entity_type = 'none such'").count() == 0
    empty = P.folder_pages(rows.where("id = 'x'"), "entities")
    assert empty.collect() == []


def test_a_long_listing_is_read_in_runs_of_pages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "MOST_TASKS", 4)
    monkeypatch.setattr(P.FolderClient, "ahead", 50)
    scans = []
    look = P.FolderClient._table
    monkeypatch.setattr(P.FolderClient, "_table", lambda self, *a: scans.append(a) or look(self, *a))
    P.write_listing(spark.range(250).selectExpr("concat('e', lpad(id, 3, '0')) as id", "'n' as name", "'t' as entity_type"), "entities", f"file://{tmp_path}/listing")
    reader = P.PagedReader({"kind": "entities", "client": "lattis.sources.paged:FolderClient", "folder": f"file://{tmp_path}/listing", "page_size": "10"})
    runs = reader.partitions()
    assert [(r.offset, r.limit) for r in runs] == [(0, 70), (70, 70), (140, 70), (210, 40)]
    scans.clear()
    assert [x[0] for r in runs for x in reader.read(r)] == [f"e{i:03}" for i in range(250)]
    assert len(scans) == 4 + 7  # each task's spans, and 50 rows at a time
