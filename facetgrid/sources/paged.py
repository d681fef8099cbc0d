"""A data source over a folder of numbered pages: in one batch, or as a stream of pages.

Page 1 tells how many pages there are; each page is a partition.  The pages'
own numbers, their stated count and full size are checked before rows go out.
In a batch any fault is an error of the whole read.  As a stream the offset is
the number of pages read, so a stop between pages loses and repeats nothing; a
page that is not there yet is waited for, one that contradicts the first is an
error and its offset is not taken.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class PagePartition(InputPartition):
    def __init__(self, page: int) -> None:
        super().__init__(page)
        self.page = page


class Pages:
    """The folder's pages, and what they must agree on."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.stem = options.get("stem", "page")
        self.least = int(options.get("min_total", "0"))

    def name(self, page: int) -> str:
        return os.path.join(self.folder, f"{self.stem}.json" if page == 1 else f"{self.stem}-{page:02d}.json")

    def read_page(self, page: int) -> dict:
        with open(self.name(page), encoding="utf-8") as f:
            return json.load(f)

    def first(self) -> dict:
        first = self.read_page(1)
        if first["maxPageNo"] < 1 or first["total"] < self.least:
            raise ValueError(f"{first['total']} rows on {first['maxPageNo']} pages")
        return first

    def checked(self, number: int) -> list:
        """The rows of a page that agrees with the first."""
        first, page = self.first(), self.read_page(number)
        if page["pageNo"] != number or page["maxPageNo"] != first["maxPageNo"]:
            raise ValueError(f"page {number} contradicts the first")
        if number < first["maxPageNo"] and len(page["rows"]) != len(first["rows"]):
            raise ValueError(f"page {number} is not full")
        return page["rows"]

    def rows(self, number: int) -> Iterator[tuple]:
        for item, row in enumerate(self.checked(number)):
            yield number, item, json.dumps(row, ensure_ascii=False)


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pages = Pages(options)

    def partitions(self) -> list[InputPartition]:
        return [PagePartition(p) for p in range(1, self.pages.first()["maxPageNo"] + 1)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        return self.pages.rows(partition.page)


class PageStream(DataSourceStreamReader):
    """Offsets ``{"page": n}``: pages 1 to n were read.

    ``pages_each``: at most so many in a batch (1 if not given), but for the
    first batch after a start, which takes all that is there, as the reader is
    not told where the stream stands.
    """

    def __init__(self, options: dict) -> None:
        self.pages = Pages(options)
        self.each = int(options.get("pages_each", "1"))
        self.taken: int | None = None

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        """The last page that is there, with all before it, each of them checked."""
        at = self.taken or 0
        if os.path.exists(self.pages.name(1)):
            most = self.pages.first()["maxPageNo"]
            if self.taken is not None:
                most = min(most, at + self.each)
            while at < most and os.path.exists(self.pages.name(at + 1)):
                at += 1
                self.pages.checked(at)
        if self.taken is not None:
            self.taken = at
        return {"page": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.taken = end["page"]
        return [PagePartition(p) for p in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        return self.pages.rows(partition.page)

    def commit(self, end: dict) -> None:
        self.taken = end["page"]


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``; then ``spark.read.format("pages").load(folder)``, or ``readStream``.

    The folder must be one that all executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, item int, record string"

    def reader(self, schema) -> PageReader:  # noqa: ANN001
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:  # noqa: ANN001
        return PageStream(self.options)
