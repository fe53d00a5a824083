"""Where pages come from: a protocol, HTTP with spacing and retries, pages in memory, and a Spark data source.

Fetching runs on the executors inside one Arrow function. All addresses of a host go to one task, where two requests
to it keep their spacing: that is the rate of the whole fleet for this host, while hosts are fetched side by side.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loamdex.functions.urls import part, resolve
from loamdex.operators.python_columns import with_python_columns

_PASSING = ("timeout", "timed out", "connection", "network", "http error 5", "http error 429")


def may_pass(error: str) -> bool:
    """Whether a fetch that failed so is worth another attempt."""
    return any(x in error.lower() for x in _PASSING)


class PageSource(Protocol):
    """HTML of an address; raises OSError or ValueError. Must be picklable."""

    def get(self, url: str) -> str: ...


class MemoryPages:
    """Pages of a mapping, for tests and prepared collections."""

    def __init__(self, pages: Mapping[str, str]):
        self.pages = dict(pages)

    def get(self, url: str) -> str:
        if url not in self.pages:
            raise ValueError("HTTP error 404")
        return self.pages[url]


class HttpPages:
    """At least ``spacing`` seconds between two requests to one host, up to ``retries`` more attempts after errors that may pass."""

    def __init__(self, spacing: float = 0.25, timeout: float = 30, retries: int = 3, wait: float = 30, agent: str = "loamdex", opener: Callable[[str], str] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.spacing, self.timeout, self.retries, self.wait, self.agent, self.opener, self.sleep = spacing, timeout, retries, wait, agent, opener, sleep
        self.last: dict[str, float] = {}

    def _open(self, url: str) -> str:
        if self.opener:
            return self.opener(url)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise ValueError(f"HTTP error {e.code}") from None

    def get(self, url: str) -> str:
        host = urlsplit(url).netloc.lower()
        for k in range(self.retries + 1):
            rest = self.last.get(host, float("-inf")) + self.spacing - time.monotonic()
            if rest > 0:
                self.sleep(rest)
            self.last[host] = time.monotonic()
            try:
                return self._open(url)
            except (OSError, ValueError) as e:
                if k == self.retries or not may_pass(str(e)):
                    raise
                self.sleep(self.wait)
        raise AssertionError("no attempt")


@dataclass(frozen=True)
class RenderSettings:
    """How pages are rendered: seconds to wait for a page and to let it settle, renderers of a worker, size of the window, seconds after which an unused renderer is closed."""

    wait: int = 30
    settle: float = 2.0
    renderers: int = 2
    width: int = 1280
    height: int = 720
    idle: float = 300.0

    def problems(self) -> Iterator[str]:
        for name, least, most in (("wait", 1, 300), ("renderers", 1, 10), ("width", 100, 4000), ("height", 100, 4000)):
            if not least <= getattr(self, name) <= most:
                yield f"{name} must be {least} to {most}, not {getattr(self, name)}"


class Renderer(Protocol):
    """A running renderer: HTML of a page after its scripts, until it is closed."""

    def get(self, url: str) -> str: ...

    def close(self) -> None: ...


class RenderedPages:
    """Pages after their scripts have run. ``start`` gives a renderer; renderers are started as they are needed, used in turn, closed when idle, and replaced after a failure.

    Put before plain HTTP by ``FirstOf``; ``start`` must be picklable, what it started stays in its worker."""

    def __init__(self, start: Callable[[RenderSettings], Renderer], settings: RenderSettings | None = None, clock: Callable[[], float] = time.monotonic):
        self.start, self.settings, self.clock = start, settings or RenderSettings(), clock
        for p in self.settings.problems():
            raise ValueError(p)
        self.open: list[tuple[float, Renderer]] = []  # used longest ago first

    def __getstate__(self) -> dict:
        return {**self.__dict__, "open": []}

    def get(self, url: str) -> str:
        self.close_idle()
        renderer = self.start(self.settings) if len(self.open) < self.settings.renderers else self.open.pop(0)[1]
        try:
            html = renderer.get(url)
        except (OSError, ValueError):
            renderer.close()
            raise
        self.open.append((self.clock(), renderer))
        return html

    def close_idle(self) -> int:
        """Closes renderers that gave no page for ``idle`` seconds; how many."""
        old = [r for used, r in self.open if self.clock() - used > self.settings.idle]
        self.open = [x for x in self.open if x[1] not in old]
        for r in old:
            r.close()
        return len(old)


class FirstOf:
    """The first source that gives a page, such as a renderer with plain HTTP behind it."""

    def __init__(self, *sources: PageSource):
        self.sources = sources

    def get(self, url: str) -> str:
        for k, s in enumerate(self.sources):
            try:
                return s.get(url)
            except (OSError, ValueError):
                if k + 1 == len(self.sources):
                    raise
        raise ValueError("no source")


def robots_text(source: PageSource, url: str) -> str | None:
    """robots.txt of the address's host; empty where there is none, null where it can't be read (then all is open)."""
    where = resolve(url, "/robots.txt")
    try:
        return source.get(where) if where else None
    except ValueError as e:
        return "" if "404" in str(e) or "not found" in str(e).lower() else None
    except OSError:
        return None


def fetch_pages(frontier: DataFrame, source: PageSource) -> DataFrame:
    """``frontier`` (url) with html, or the error that kept it away; a host's addresses are fetched by one task, one after another."""

    def compute(urls):
        for url in urls:
            try:
                yield source.get(url), None
            except (OSError, ValueError) as e:
                yield None, str(e)

    by_host = frontier.repartition(F.lower(part(F.col("url"), "HOST")))
    return with_python_columns(by_host, ["url"], [("html", T.StringType()), ("error", T.StringType())], compute)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], parts: int):
        self.urls, self.parts = urls, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source = HttpPages()
        for url in partition.value:
            try:
                yield url, source.get(url), None
            except (OSError, ValueError) as e:
                yield url, None, str(e)


class PagesDataSource(DataSource):
    """``spark.read.format("pages").option("urls", "...").option("parts", 2)``: url, html, error of addresses, one a line."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("urls", "").split(), int(self.options.get("parts", 1)))
