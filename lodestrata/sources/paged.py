"""A Spark data source of paged HTML: one partition per catalog entry, pages read until the source ends.

The fetcher is a parameter (a function of a URL), so that pages can come from a store or from the network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Entry(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


def first_url(url: str) -> str:
    return url if "page=" in url else url + ("&" if "?" in url else "?") + "page=1&next_page=true"


class PagedReader(DataSourceReader):
    def __init__(self, catalog: dict[str, str], fetch: Callable[[str], str | None], most: int):
        self.catalog, self.fetch, self.most = catalog, fetch, most

    def partitions(self) -> list[Entry]:
        return [Entry(name, first_url(url)) for name, url in self.catalog.items()]

    def read(self, partition: Entry) -> Iterator[tuple[str, int, str, str]]:
        before = None
        for page in range(1, self.most + 1):
            url = partition.url.replace("page=1", f"page={page}")
            html = self.fetch(url)
            if not html or html == before:
                return
            yield partition.name, page, url, html
            before = html


def paged_source(name: str, catalog: dict[str, str], fetch: Callable[[str], str | None], most: int = 10_000) -> type[DataSource]:
    """A data source class of that name: register it and load it to get name, page, url, html."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "name string, page int, url string, html string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(catalog, fetch, most)

    return Paged
