"""Paged HTTP endpoints as a Spark data source: tasks fetch the pages, the driver learns no more than how many rows there are.

A page is named by its number or by the place of its first row. Where the endpoint tells the number of rows, each page is a
partition. Where it doesn't, some workers stride over the pages until one comes empty. Where a page only names the next
(cursor), pages follow one another in one task. A stream reads on from the number of rows it has seen.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = T.StructType([T.StructField("value", T.StringType())])


def get_json(config: dict, more: dict | None = None) -> object:
    """The response of the configured request with further parameters; failures of the network are tried again."""
    query = urllib.parse.urlencode((config.get("params") or {}) | (more or {}))
    url = config["url"] + (("&" if "?" in config["url"] else "?") + query if query else "")
    tries = int(config.get("max_retries", 2)) + 1
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=config.get("headers") or {}), timeout=config.get("timeout", 30)) as response:
                return json.load(response)
        except urllib.error.HTTPError as e:
            if e.code < 500 or not left:  # asking again doesn't help
                raise
        except OSError:
            if not left:
                raise
        time.sleep(float(config.get("retry_wait", 0.2)))
    raise AssertionError


def at_path(data: object, path: str) -> object:
    """The value at a dotted path, or None."""
    for key in path.split("."):
        if not isinstance(data, dict) or key not in data:
            return None
        data = data[key]
    return data


def rows_of(data: object, config: dict) -> list:
    """The list at `data_path` (`data` unless given); a response that is a list is the rows itself."""
    found = data if isinstance(data, list) else at_path(data, config.get("data_path") or "data")
    if not isinstance(found, list):
        raise ValueError(f"the response has no list at {config.get('data_path') or 'data'!r}")
    return found


@dataclass
class Rows(InputPartition):
    """Rows [start, stop) of the endpoint."""

    start: int
    stop: int


@dataclass
class Stride(InputPartition):
    """Pages first, first + step, ... until one is empty."""

    first: int
    step: int


@dataclass
class Chain(InputPartition):
    """Pages that name the next."""


class Pages:
    """One endpoint and how it is paged: `paging` has mode (page, offset or cursor), size, and the names of parameters."""

    def __init__(self, config: dict) -> None:
        self.config, p = config, config.get("paging") or {}
        self.mode, self.size = p.get("mode", "page"), int(p.get("size", 100))
        if self.mode not in ("page", "offset", "cursor") or self.size < 1:
            raise ValueError(f"pages go by page, offset or cursor, at least one row each: {p!r}")
        self.param, self.size_param = p.get("param", self.mode), p.get("size_param", "limit")
        self.first, self.total_path, self.next_path = int(p.get("first", 1 if self.mode == "page" else 0)), p.get("total_path"), p.get("next_path", "next")
        self.workers, self.per_task = int(p.get("workers", 8)), int(p.get("pages_per_task", 1))

    def total(self) -> int | None:
        """How many rows the endpoint says it has."""
        if not self.total_path:
            return None
        said = at_path(get_json(self.config, self._at(0) | {self.size_param: 1}), self.total_path)
        if said is None:
            raise ValueError(f"the response has no {self.total_path!r}")
        return int(said)

    def _at(self, page: int) -> dict:
        return {self.param: self.first + (page if self.mode == "page" else page * self.size), self.size_param: self.size}

    def page(self, number: int) -> list:
        return rows_of(get_json(self.config, self._at(number)), self.config)

    def read(self, part: InputPartition) -> Iterator[tuple[str]]:
        text = lambda rows: ((json.dumps(r),) for r in rows)
        if isinstance(part, Rows):  # whole pages, cut to the rows asked for
            for number in range(part.start // self.size, -(-part.stop // self.size)):
                lo = number * self.size
                yield from text(self.page(number)[max(0, part.start - lo) : part.stop - lo])
        elif isinstance(part, Stride):
            number = part.first
            while rows := self.page(number):
                yield from text(rows)
                number += part.step
        else:
            more, seen = {self.size_param: self.size}, set()
            while True:
                data = get_json(self.config, more)
                yield from text(rows_of(data, self.config))
                after = at_path(data, self.next_path)
                if not after or after in seen:
                    return
                seen.add(after)
                more[self.param] = after

    def parts(self, start: int = 0, stop: int | None = None) -> list[InputPartition]:
        if self.mode == "cursor":
            return [Chain()]
        stop = self.total() if stop is None else stop
        if stop is None:
            return [Stride(k, self.workers) for k in range(self.workers)]
        step = self.size * self.per_task
        edges = [start, *range((start // step + 1) * step, stop, step), stop]
        return [Rows(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


class HttpReader(DataSourceReader):
    def __init__(self, pages: Pages) -> None:
        self.pages = pages

    def partitions(self) -> Sequence[InputPartition]:
        return self.pages.parts()

    def read(self, partition: InputPartition | None) -> Iterator[tuple[str]]:
        return self.pages.read(partition) if partition is not None else iter(())


class HttpStreamReader(DataSourceStreamReader):
    """Rows by their number; the endpoint has to keep their order and to append."""

    def __init__(self, pages: Pages) -> None:
        if not pages.total_path or pages.mode == "cursor":
            raise ValueError("a stream needs pages by number or offset and a total_path")
        self.pages = pages

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rows": self.pages.total()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.pages.parts(start["rows"], end["rows"])

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        return self.pages.read(partition)


class HttpSource(DataSource):
    """option `config`: the source's configuration as JSON. Rows are JSON texts in `value`."""

    @classmethod
    def name(cls) -> str:
        return "loomspark_http"

    def schema(self) -> T.StructType:
        return SCHEMA

    def _pages(self) -> Pages:
        return Pages(json.loads(self.options["config"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HttpReader(self._pages())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return HttpStreamReader(self._pages())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
