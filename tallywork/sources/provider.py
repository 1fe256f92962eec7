"""A paged provider as a streaming source: a run of pages becomes a batch once it has been walked to its end.

A provider hands out pages by cursor; the next cursor is known from the page before it. If its data change during a run,
the pages so far don't fit together: the run starts over from its first cursor, a few times at most. If a cursor is
of no use any more, the run starts once from none, which reads everything anew. Walking keeps cursors, not rows. Only the
cursors of the attempt that reached its end become an offset, with the number of that attempt, so pages of an abandoned one
never reach a batch; executors then fetch the pages, one partition each.

Offsets are kept by the query's checkpoint, and with `state` also in a file of the shared folder, which tells a restarted
reader where to walk on. It may lag behind the checkpoint; pages that a batch has had are then left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.files import read_text, write_text
from ..streaming.changefeed import FEED


class MutationDuringPaging(Exception):
    """The provider's data changed between two pages of a run."""


class BadCursor(Exception):
    """The provider doesn't know the cursor any more."""


class Provider:
    """What a connector offers. fetch(cursor) gives (rows, next cursor, whether more follows); rows are in FEED's order without page. None is the cursor of the very beginning."""

    def fetch(self, cursor: str | None) -> tuple[list[tuple], str | None, bool]:
        raise NotImplementedError


@dataclass
class Page(InputPartition):
    number: int
    cursor: str | None
    following: str | None


class Reader(DataSourceStreamReader):
    """An offset: cursors (of the pages of one run, and the one behind them), page (number of the first), attempt, reset."""

    def __init__(self, provider: Provider, cursor: str | None = None, state: str | None = None, attempts: int = 3, most_pages: int = 10_000):
        self.provider, self.cursor, self.state, self.attempts, self.most_pages = provider, cursor, state, attempts, most_pages
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"cursors": [self.cursor], "page": 0, "attempt": 0, "reset": False}

    def position(self) -> dict:
        if self.at is None:
            kept = read_text(self.state) if self.state else None
            self.at = json.loads(kept) if kept else self.initialOffset()
        return self.at

    def latestOffset(self) -> dict:
        at = self.position()
        first, attempt, reset = at["cursors"][-1], 0, False
        while True:
            try:
                cursors, some = self.walk(first)
                break
            except MutationDuringPaging:
                attempt += 1
                if attempt >= self.attempts:
                    raise
            except BadCursor:
                if reset:
                    raise
                first, reset = None, True
        if not some and not reset:
            return at
        return {"cursors": cursors, "page": at["page"] + len(at["cursors"]) - 1, "attempt": attempt, "reset": reset}

    def walk(self, cursor: str | None) -> tuple[list, bool]:
        """The cursors from cursor on to the end, or most_pages of them, and whether a page has rows."""
        cursors, more, some = [cursor], True, False
        while more and len(cursors) <= self.most_pages:
            rows, following, more = self.provider.fetch(cursors[-1])
            some |= bool(rows)
            cursors.append(following)
        return cursors, some

    def partitions(self, start: dict, end: dict) -> list[Page]:
        cursors, done = end["cursors"], start["cursors"][-1]
        had = 0 if end["reset"] or done not in cursors else cursors.index(done)
        self.at = end
        return [Page(end["page"] + i, cursors[i], cursors[i + 1]) for i in range(had, len(cursors) - 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows, following, _ = self.provider.fetch(partition.cursor)
        if following != partition.following:
            raise MutationDuringPaging(f"page {partition.number} has changed since its run was walked")
        return ((partition.number, *row) for row in rows)

    def commit(self, end: dict) -> None:
        if self.state:
            write_text(self.state, json.dumps(end))


def source(provider: type[Provider], short_name: str = "changefeed") -> type[DataSource]:
    """A data source class over provider, for spark.dataSource.register. Options: cursor, state (a file in the shared folder), attempts, pages."""

    class ChangeFeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return FEED

        def streamReader(self, schema) -> Reader:
            o = self.options
            return Reader(provider(), o.get("cursor"), o.get("state"), int(o.get("attempts", 3)), int(o.get("pages", 10_000)))

    return ChangeFeedSource
