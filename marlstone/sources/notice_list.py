"""Remote notice lists as a Python data source: `spark.read.format("notice_list")` and `spark.readStream.format("notice_list")`.

A list is paged by menu. Two protocols are read: JSON answers of an interface and HTML list pages. Pages are saved ones, as
`<path>/menu=<menu>/page=<number>/<file>.json` (a line an answer) or `.html` and `.txt` (markup); a crawler that fetches would only put another `_fetch` here.

A page is a partition. As a stream the cursor is the offset: the last page of each menu that was read, so that a run that is
started again goes on behind it. Filters on menu and page are taken over by the reader and leave pages unread.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import ready
from . import stores

SCHEMA = "menu string, page int, position int, notice_id string, title string, url string, published timestamp_ntz"
PLACE = re.compile(r"/menu=([^/]+)/page=(\d+)/[^/]+\.(json|html?|txt)$")
ITEM = re.compile(r"(?is)<li\b[^>]*>(.*?)</li>")
LINK = re.compile(r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["'][^>]*>(.*?)</a>""")
DAY = re.compile(r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?")
TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Page(InputPartition):
    """One page of a menu: all files that hold it."""

    menu: str
    number: int
    files: tuple[str, ...]


def _time(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def json_items(text: str) -> Iterator[tuple]:
    """(id, title, url, published) of the items of a JSON answer: {"items": [...]} or one item a line."""
    for line in text.splitlines():
        if not line.strip():
            continue
        answer = json.loads(line)
        for i in answer["items"] if "items" in answer else [answer]:
            yield i.get("id"), i.get("title"), i.get("url"), _time(i.get("published"))


def html_items(text: str) -> Iterator[tuple]:
    """(address, title, address, published) of an HTML list page: the address stands for the id."""
    for item in ITEM.findall(text):
        if link := LINK.search(item):
            day = DAY.search(re.sub(r"<[^>]+>", " ", item[link.end() :]))
            href = unescape(link[1])
            yield href, unescape(re.sub(r"<[^>]+>", "", link[2])).strip(), href, _time(day[0] if day else None)


def _pages(path: str, menus: list[str]) -> list[Page]:
    """Saved pages by menu and number."""
    found: dict[tuple[str, int], list[str]] = {}
    for file in stores.files_under(path):
        if (m := PLACE.search(file)) and (not menus or m[1] in menus):
            found.setdefault((m[1], int(m[2])), []).append(file)
    return [Page(menu, number, tuple(files)) for (menu, number), files in sorted(found.items())]


class _Reading:
    """What both readers share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.menus = [m.strip() for m in options.get("menus", "").split(",") if m.strip()]
        self.search = options.get("search", "").upper()  # only items whose title holds this, ignoring case

    def _fetch(self, file: str) -> str:
        store, _ = stores.opened(self.path)
        return b"".join(stores.pieces(store, file)).decode("utf-8", "replace")

    def read(self, page: Page) -> Iterator[tuple]:
        position = 0
        for file in page.files:
            for item in (json_items if file.endswith(".json") else html_items)(self._fetch(file)):
                position += 1
                if self.search in (item[1] or "").upper():
                    yield (page.menu, page.number, position, *item)


class NoticeReader(_Reading, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("menu",), ("page",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        pages = _pages(self.path, self.menus)
        for name, kind, value in self.tests:
            pages = [p for p in pages if TESTS[kind](p.menu if name == "menu" else p.number, value)]
        return pages or [Page("", 0, ())]


class NoticeStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are {menu: last page read}."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for p in _pages(self.path, self.menus):
            last[p.menu] = max(p.number, last.get(p.menu, 0))
        return last

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [p for p in _pages(self.path, self.menus) if start.get(p.menu, 0) < p.number <= end.get(p.menu, 0)]

    def commit(self, end: dict) -> None:
        """Saved pages stay."""


class NoticeList(DataSource):
    """Options: path; menus (commas between; all by default); search (a part of the title)."""

    @classmethod
    def name(cls) -> str:
        return "notice_list"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NoticeReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return NoticeStreamReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session; its readers take filters over."""
    ready(spark).dataSource.register(NoticeList)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
