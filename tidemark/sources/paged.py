"""A paged service as a batch and a streaming source: filters and retries reach the requests, offsets are update times.

The service is a function fetch(page, query) -> (items as JSON texts, next page or None), named by the option `fetch` as
module:function, which workers can import. query holds the source's options and what is pushed down: `updatedAfter`,
`updatedUntil` and `type`. Errors with a `status` among TRANSIENT, and lost connections, are tried again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, InputPartition, LessThanOrEqual

#: Statuses that say nothing about the request itself.
TRANSIENT = frozenset({408, 425, 429, 500, 502, 503, 504})
#: Places in an item of the columns that filters are pushed on.
UPDATED, TYPE = "updatedAt", "type"


def named(path: str) -> Callable:
    module, _, function = path.partition(":")
    return getattr(import_module(module), function)


def retrying(call: Callable[[], tuple], retries: int, base_s: float, cap_s: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """What call returns, after up to `retries` more tries; waits double from base_s to cap_s unless the error has retry_after (seconds).

    Other errors, and the last one, are raised as they are.
    """
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            transient = getattr(e, "status", None) in TRANSIENT or isinstance(e, (ConnectionError, TimeoutError))
            if not transient or attempt == retries:
                raise
            hint = getattr(e, "retry_after", None)
            sleep(min(cap_s, hint if hint is not None and hint >= 0 else base_s * 2**attempt))
    raise ValueError("retries must be 0 or more")


def rows_of(page: int, options: dict, query: dict) -> tuple[list[tuple], int | None]:
    """The rows (page, updated_at, type, body) of a page that the query asks for, and the next page."""
    fetch = named(options["fetch"])
    items, following = retrying(lambda: fetch(page, options | query), int(options.get("retries", 4)), float(options.get("retrybase", 1.0)))
    out = []
    for body in items:
        item = json.loads(body)
        updated, kind = item.get(UPDATED), item.get(TYPE)
        after, until = query.get("updatedAfter"), query.get("updatedUntil")
        asked = (after is None or updated is not None and updated > after) and (until is None or updated is not None and updated <= until) and ("type" not in query or kind == query["type"])
        if asked:  # a service may give more than it was asked for
            out.append((page, updated, kind, body))
    return out, following


class PagedSource(DataSource):
    """spark.read or readStream.format("tidemark_paged"): page, updated_at, type and body of each item.

    Options: fetch; pages (read so many as partitions; 0, the default, follows next pages one by one); retries; retryBase (seconds);
    for streams head (module:function that gives (newest update time or None, number of pages) for a query), since and margin.
    Batch filters updated_at > x, updated_at <= x and type = x become part of the requests where
    spark.sql.python.filterPushdown.enabled is true; with a pushed filter the pages are followed, as their number is another one.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_paged"

    def schema(self) -> str:
        return "page int, updated_at string, type string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PagedStream(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.query = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case GreaterThan(("updated_at",), value) if value is not None:
                    self.query["updatedAfter"] = max(value, self.query.get("updatedAfter", value))
                case LessThanOrEqual(("updated_at",), value) if value is not None:
                    self.query["updatedUntil"] = min(value, self.query.get("updatedUntil", value))
                case EqualTo(("type",), value) if value is not None and self.query.get("type", value) == value:
                    self.query["type"] = value
                case _:
                    yield f

    def partitions(self) -> list[InputPartition]:
        pages = 0 if self.query else int(self.options.get("pages", 0))
        return [InputPartition(p) for p in range(1, pages + 1)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value or 1
        while page is not None:
            rows, following = rows_of(page, self.options, self.query)
            yield from rows
            page = None if partition.value else following


class _PagedStream(DataSourceStreamReader):
    """Offsets are the newest update times taken. A batch is the window of items updated after its start and up to its end,
    its pages are partitions, and Spark logs its end only when the batch is done, so a failed one is read again.

    With `margin` (seconds) a window begins that much before its start, so that items that came late at its edge are read again: put
    them by key. Times are ISO texts in UTC.
    """

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"updated_at": self.options.get("since", "")}

    def latestOffset(self) -> dict:
        newest, _ = self._head({})
        return {"updated_at": newest or self.options.get("since", "")}

    def _head(self, query: dict) -> tuple:
        head = named(self.options["head"])
        return retrying(lambda: head(self.options | query), int(self.options.get("retries", 4)), float(self.options.get("retrybase", 1.0)))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        query = {"updatedAfter": earlier(start["updated_at"], float(self.options.get("margin", 0))), "updatedUntil": end["updated_at"]}
        _, pages = self._head(query)
        return [InputPartition((p, query)) for p in range(1, pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, query = partition.value
        yield from rows_of(page, self.options, query)[0]


def earlier(at: str, seconds: float) -> str:
    """An ISO time in UTC so many seconds earlier, in milliseconds; an empty one stays."""
    from datetime import datetime, timedelta

    if not at or not seconds:
        return at
    moved = datetime.fromisoformat(at.replace("Z", "+00:00")) - timedelta(seconds=seconds)
    return moved.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moved.microsecond // 1000:03d}Z"
