"""Searches: optional filters, keywords, named sorts, pages."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE, PAGE_MOST = 20, 200


@dataclass
class Page:
    """One page of a search and the number of all rows."""

    total: int
    rows: DataFrame
    index: int
    size: int


@dataclass
class SearchSpec:
    """What a search may ask: keyword columns, sorts by name, the default sort and the unique key that ends it.

    A sort is a list of column names, each with " desc" after it where it descends.
    """

    keyword_columns: list[str] = field(default_factory=list)
    sorts: dict[str, list[str]] = field(default_factory=dict)
    default_sort: str = ""
    key: str = "id"
    number_key: str | None = None


def keyword_filter(columns: Iterable[str], keyword: str | None) -> Column:
    """Any of the columns holds the keyword, ignoring case; a blank keyword filters nothing."""
    if not keyword or not keyword.strip():
        return F.lit(True)
    word = F.lit(keyword.strip().lower())
    return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(c)), word), F.lit(False)) for c in columns])


def range_filter(column: str, low=None, high=None) -> Column:
    """low <= column <= high, each end optional; a low end above the high one is an error."""
    if low is not None and high is not None and low > high:
        raise ValueError(f"{column}: the low end is above the high end")
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    return out & (F.col(column) <= high) if high is not None else out


def choice_filter(column: str, value: str | None, choices: Iterable[str]) -> Column:
    """Equality with a known choice, ignoring case; unknown values filter nothing."""
    known = {c.lower(): c for c in choices}
    return F.col(column) == known[value.strip().lower()] if value and value.strip().lower() in known else F.lit(True)


def presence_filter(column: str, present: bool | None) -> Column:
    """True: there; False: absent; None: all."""
    return F.lit(True) if present is None else F.col(column).isNotNull() if present else F.col(column).isNull()


def json_value_filter(column: str, path: str, value) -> Column:
    """The JSON value at a path, as text, equals value exactly."""
    return F.get_json_object(column, path) == str(value)


def search(rows: DataFrame, spec: SearchSpec, keyword: str | None = None, filters: Iterable[Column] = (), sort: str | None = None) -> DataFrame:
    """Filtered rows in a total order."""
    for f in filters:
        rows = rows.filter(f)
    if spec.number_key and keyword and keyword.strip().isdigit():
        rows = rows.filter(F.col(spec.number_key) == int(keyword))
    elif spec.keyword_columns:
        rows = rows.filter(keyword_filter(spec.keyword_columns, keyword))
    order = spec.sorts.get((sort or "").strip(), spec.sorts.get(spec.default_sort, []))
    columns = [F.col(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c).asc() for c in order]
    return rows.orderBy(*columns, F.col(spec.key).asc())


def clamp(index: int, size: int) -> tuple[int, int]:
    """Page index from 1, page size 20 unless given, 200 at most."""
    return max(1, index), PAGE_SIZE if size < 1 else min(size, PAGE_MOST)


def page_rows(ordered: DataFrame, index: int, size: int) -> DataFrame:
    index, size = clamp(index, size)
    return ordered.offset((index - 1) * size).limit(size)


def page(ordered: DataFrame, index: int = 1, size: int = PAGE_SIZE) -> Page:
    """A page with the count of all rows; the count drops the order."""
    index, size = clamp(index, size)
    return Page(ordered.count(), page_rows(ordered, index, size), index, size)


def cell_text(row: Column, names: list[str], wanted: str) -> Column:
    """The text of a row's cell by its name: the exact name, else one that ignores case, else empty. row: a struct with those fields."""
    exact = [n for n in names if n == wanted] or [n for n in names if n.lower() == wanted.strip().lower()]
    return F.coalesce(row[exact[0]].cast("string"), F.lit("")) if exact else F.lit("")


def pick_columns(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested columns in the requested order; names ignore case; blank, repeated and unknown ones are errors."""
    known = {c.lower(): c for c in rows.columns}
    names = [w.strip().lower() for w in wanted]
    if any(not n for n in names) or len(set(names)) != len(names) or any(n not in known for n in names):
        raise ValueError("columns must be known, not blank and not repeated")
    return rows.select(*[known[n] for n in names])
