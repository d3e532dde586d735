"""A Python data source for crawlers: pages of a remote catalogue as rows, throttled in each task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Catalogues by name: a function from page number to rows (id, url, body). Register before use; none is built in,
#: as crawling needs a network.
CATALOGUES: dict[str, Callable[[int], list[tuple[str, str, str]]]] = {}


class CataloguePart(InputPartition):
    def __init__(self, first: int, past: int) -> None:
        self.first, self.past = first, past


class CatalogueReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], list[tuple[str, str, str]]], pages: int, parts: int, delay: float, retries: int, wait: float) -> None:
        self.fetch, self.pages, self.parts, self.delay, self.retries, self.wait = fetch, pages, parts, delay, retries, wait

    def partitions(self) -> Sequence[InputPartition]:
        step = -(-self.pages // max(1, self.parts))
        return [CataloguePart(i, min(i + step, self.pages)) for i in range(0, self.pages, max(1, step))]

    def read(self, partition: CataloguePart) -> Iterator[tuple[str, str, str, str | None]]:
        for page in range(partition.first, partition.past):
            for attempt in range(self.retries):
                try:
                    rows = self.fetch(page)
                except OSError as failure:
                    if attempt + 1 == self.retries:
                        yield (f"page-{page}", None, None, str(failure))
                        break
                    time.sleep(self.wait * 2**attempt)
                else:
                    yield from ((*row, None) for row in rows)
                    break
            time.sleep(self.delay)


class CatalogueSource(DataSource):
    """spark.read.format("catalogue").option("name", ...).load(): id, url, body, error. A page that fails is one row.

    Options: name, pages, parts, delay (seconds between pages), retries, wait (seconds, doubled each time).
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "id string, url string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return CatalogueReader(
            CATALOGUES[o["name"]], int(o.get("pages", 1)), int(o.get("parts", 1)), float(o.get("delay", 1.0)), int(o.get("retries", 5)), float(o.get("wait", 2.0))
        )
