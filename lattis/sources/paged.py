"""A server's listing of entities and relations, a page a task, or a run of pages if there are over ``MOST_TASKS`` (SRC6, SRC12).

``spark.read.format("paged")`` with the options ``client`` (the import path
``module:name`` of a class, made with the options), ``kind`` (``entities`` or
``relations``), ``page_size`` and ``retries``. A client has ``count(kind,
where)`` and ``page(kind, offset, limit, where)``; ``where`` maps columns to
the value they must have, and a page's rows come in one and the same order
whenever they are asked for.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from lattis.operators.ordering import global_index
from lattis.session import new_shared_path

#: What a listing of each kind gives, and the column by which it can be narrowed.
KINDS = {"entities": ("id string, name string, entity_type string", "entity_type"), "relations": ("source_id string, target_id string, edge_type string", "edge_type")}
#: The most rows that a page may have.
LARGEST_PAGE = 100
#: The most tasks that a listing is read by; each asks for a run of pages, one after the other.
MOST_TASKS = 100


@dataclass
class Pages(InputPartition):
    offset: int
    limit: int


class PagedSource(DataSource):
    """Registered by :func:`read_pages`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        if self.options.get("kind") not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return KINDS[self.options["kind"]][0]

    def reader(self, schema) -> DataSourceReader:
        return (NarrowingReader if self.options.get("narrow") == "true" else PagedReader)(dict(self.options))


class PagedReader(DataSourceReader):
    """Plans a partition a page, or a run of pages; a task asks for its pages alone, and for one again if the server fails."""

    def __init__(self, options: Mapping[str, str]):
        self.options, self.kind = options, options["kind"]
        self.size = min(int(options.get("page_size", LARGEST_PAGE)), LARGEST_PAGE)
        self.retries = int(options.get("retries", 3))
        self.where: dict[str, str] = {}
        unknown = set(options) - {"kind", "client", "page_size", "retries", "folder", "path", "narrow"} - {k for k in options if k.startswith("client.")}
        if unknown or self.size < 1:
            raise ValueError(f"unknown options {sorted(unknown)}" if unknown else "page_size is 1 or more")

    def client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self) -> list[Pages]:
        n = self._again(lambda: self.client().count(self.kind, self.where))
        run = self.size * max(1, -(-n // (self.size * MOST_TASKS)))
        return [Pages(at, min(run, n - at)) for at in range(0, n, run)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        end, client = partition.offset + partition.limit, None

        def ask(at: int) -> list[tuple]:
            nonlocal client
            client = client or self.client()
            return list(client.page(self.kind, at, min(self.size, end - at), self.where))

        for at in range(partition.offset, end, self.size):
            yield from self._again(lambda at=at: ask(at))

    def _again(self, ask):
        for attempt in range(self.retries + 1):
            try:
                return ask()
            except OSError:  # connections that fail and time out are such
                if attempt == self.retries:
                    raise
                time.sleep(min(0.1 * 2**attempt, 5))


class NarrowingReader(PagedReader):
    """A reader whose server narrows by type; all other filters are left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == (KINDS[self.kind][1],) and one.attribute[0] not in self.where:
                self.where[one.attribute[0]] = one.value
            else:
                yield one


class FolderClient:
    """Pages of a listing that :func:`write_listing` wrote, wherever the shared folder is.

    Rows of the pages after the one asked for, ``ahead`` in all, are read
    with it, so that a run of pages doesn't look through the listing each time.
    """

    ahead = 6_400

    def __init__(self, options: Mapping[str, str]):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(options["folder"])
        self.opened: dict = {}
        self.spans: dict[str, list[dict]] = {}
        self.held: tuple[str, int, list[tuple]] = "", 0, []

    def _table(self, kind: str, columns: list[str] | None, rows) -> list[dict]:
        import pyarrow.dataset as ds

        if kind not in self.opened:
            self.opened[kind] = ds.dataset(f"{self.folder}/{kind}", filesystem=self.fs, format="parquet")
        return self.opened[kind].to_table(columns=columns, filter=rows).to_pylist()

    def _span(self, kind: str, where: Mapping[str, str]) -> tuple[int, int]:
        if kind not in self.spans:
            self.spans[kind] = self._table(f"{kind}-spans", None, None)
        kept = [s for s in self.spans[kind] if all(s["by"] == v for v in where.values())]
        return min((s["first"] for s in kept), default=1), sum(s["n"] for s in kept)

    def count(self, kind: str, where: Mapping[str, str]) -> int:
        return self._span(kind, where)[1]

    def page(self, kind: str, offset: int, limit: int, where: Mapping[str, str]) -> list[tuple]:
        import pyarrow.compute as pc

        names = [c.split()[0] for c in KINDS[kind][0].split(", ")]
        first, total = self._span(kind, where)
        first, limit = first + offset, max(0, min(limit, total - offset))
        held_kind, start, rows = self.held
        if held_kind != kind or first < start or first + limit > start + len(rows):
            found = self._table(kind, [*names, "_i"], (pc.field("_i") >= first) & (pc.field("_i") < first + max(limit, self.ahead)))
            start, rows = first, [tuple(r[c] for c in names) for r in sorted(found, key=lambda r: r["_i"])]
            self.held = kind, start, rows
        return rows[first - start : first - start + limit]


def write_listing(rows: DataFrame, kind: str, folder: str) -> None:
    """``rows`` of a kind as a listing in ``folder``, in the order of type and the other columns."""
    schema, by = KINDS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    order = [by, *(c for c in names if c != by)]
    indexed = global_index(rows.select(*names), order, "_i")
    indexed.write.option("parquet.block.size", str(1 << 20)).parquet(f"{folder}/{kind}")  # a page is looked for by the row groups' ends
    spans = rows.sparkSession.read.parquet(f"{folder}/{kind}").groupBy(F.col(by).alias("by")).agg(F.min("_i").alias("first"), F.count("*").alias("n"))
    spans.coalesce(1).write.parquet(f"{folder}/{kind}-spans")


def read_pages(spark: SparkSession, kind: str, client: str, **options: str | int) -> DataFrame:
    """The listing of ``kind`` by the client at the import path ``client``; options of the client itself begin with ``client.``, but for ``folder``.

    Filters go to the server if ``spark.sql.python.filterPushdown.enabled`` is
    set in the session; else Spark applies them to all pages.
    """
    spark.dataSource.register(PagedSource)
    narrow = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    reader = spark.read.format("paged").option("kind", kind).option("client", client).option("narrow", narrow)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def folder_pages(rows: DataFrame, kind: str, page_size: int = LARGEST_PAGE) -> DataFrame:
    """``rows`` as a listing in the shared folder, read back in pages."""
    folder = new_shared_path(rows.sparkSession, "listing")
    write_listing(rows, kind, folder)
    return read_pages(rows.sparkSession, kind, "lattis.sources.paged:FolderClient", folder=folder, page_size=page_size)
