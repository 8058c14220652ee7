"""Paged remote searches as a data source: a partition for each query, a token from page to page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Pages of a query that are asked for at most.
PAGES = 3
Fetch = Callable[[str, str | None], tuple[list[dict], str | None]]


class _Query(InputPartition):
    def __init__(self, seq: int, query: str):
        self.seq, self.query = seq, query


class _Pages(DataSourceReader):
    """Rows seq, query, page, rank and the fields of the results. Filters on the query are taken over: others are not asked for."""

    def __init__(self, queries: list[str], fields: list[str], fetch: Fetch, pages: int, key: str):
        self.queries, self.fields, self.fetch, self.pages, self.key = list(enumerate(queries)), fields, fetch, pages, key

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("query",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = [q for q in self.queries if q[1] in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Query(*q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "query"):
            return
        token = None
        for page in range(self.pages):
            rows, token = self.fetch(partition.query, token)
            for rank, row in enumerate(rows):
                if row.get(self.key):
                    yield (partition.seq, partition.query, page + 1, rank, *(row.get(f) for f in self.fields))
            if not token:
                break


def register(spark: SparkSession, name: str, queries: list[str], fields: dict[str, str], fetch: Fetch, pages: int = PAGES, key: str = "place_id") -> None:
    """Make ``spark.read.format(name).load()`` known: results of a paged search for each of ``queries``, by a task of its own.

    ``fetch(query, token)`` gives a page's results and the token of the next page, or None; it is sent to the tasks, and is asked for at most
    ``pages`` pages a query, one after another. ``fields`` are the results' names and types. Results without ``key`` are left out; a
    failed call fails the task, which Spark tries again.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    types = ", ".join(["seq int", "query string", "page int", "rank int", *(f"{n} {t}" for n, t in fields.items())])

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return types

        def reader(self, schema) -> DataSourceReader:
            return _Pages(queries, list(fields), fetch, pages, key)

    spark.dataSource.register(Search)
