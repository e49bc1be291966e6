"""A paged remote table as a Python data source, with equality filters sent to the server.

``fetch(filters, offset, length)`` returns a page of rows as dictionaries; partitions are ranges of
pages. It is injected, so nothing here opens a connection by itself."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from plumbline.sources.tables import Refusal

PAGE, TRIES = 100, 4


class TooMany(OSError):
    """The server asks to slow down (HTTP status 429); ``after`` is how long, if it says so."""

    def __init__(self, message: str = "too many requests", after: float | None = None):
        super().__init__(message)
        self.after = after


def retrying(call: Callable, tries: int = TRIES, wait: float = 1.0, sleep: Callable = time.sleep):
    """``call()`` again after a failure, waiting a little longer each time: as long as the server asks
    for, or twice as long, where it refuses for too many requests."""
    for k in range(1, tries + 1):
        try:
            return call()
        except OSError as error:
            if k == tries:
                raise Refusal(f"gave up after {tries} tries: {error}") from error
            longer = isinstance(error, TooMany)
            sleep(error.after if longer and error.after is not None else wait * k * (2 if longer else 1))


def revision(describe: Callable[[], dict]) -> str:
    """The revision that a remote data set is at, from its description; "unknown" if it doesn't say."""
    return str(retrying(describe).get("sha") or "unknown")


def cached(path: str, fetch: Callable[[], Iterable[bytes]]) -> str:
    """``path``, which is fetched if it isn't there: chunk by chunk into a neighbour ending in .part, which is
    renamed when it is whole, so that an interrupted download is never taken for the file."""
    if not os.path.exists(path):
        def whole():
            with open(f"{path}.part", "wb") as out:
                for chunk in fetch():
                    out.write(chunk)

        retrying(whole)
        os.replace(f"{path}.part", path)
    return path


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, schema, fetch, count, page: int = PAGE):
        self.fields, self.fetch, self.count, self.page, self.filters = [f.name for f in schema], fetch, count, page, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo):
                self.filters[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        n = retrying(lambda: self.count(self.filters))
        pages = -(-n // self.page)
        step = max(1, -(-pages // 64))
        return [Pages(k, min(k + step, pages)) for k in range(0, pages, step)] or [Pages(0, 0)]

    def read(self, partition):
        for k in range(partition.first, partition.last):
            for row in retrying(lambda k=k: self.fetch(self.filters, k * self.page, self.page)):
                yield tuple(row.get(f) for f in self.fields)


def paged_source(name: str, schema: str, fetch: Callable, count: Callable, page: int = PAGE) -> type[DataSource]:
    """A data source class to register with ``spark.dataSource.register``."""
    called, ddl = name, schema

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return called

        def schema(self):
            return ddl

        def reader(self, schema):
            return PagedReader(schema, fetch, count, page)

    return Paged
