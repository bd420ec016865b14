"""Python stages over Arrow batches: key columns stay Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


PIECE = 1_000  # rows of a batch that are worked on at a time: what they become in Python is many times as large


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """values as Arrow; nested ones that many rows share are turned over once and taken by place."""
    if not pa.types.is_nested(kind):
        return pa.array(values, kind)
    known: dict[int, int] = {}
    places = [known.setdefault(id(v), len(known)) for v in values]
    if len(known) == len(values):
        return pa.array(values, kind)
    first = dict(zip(reversed(places), reversed(values)))
    return pa.array([first[k] for k in range(len(known))], kind).take(pa.array(places, pa.int64()))


def added(rows: DataFrame, keep: list[str], work: Callable[[pa.RecordBatch], tuple[list[int] | None, list]], columns: str) -> DataFrame:
    """rows' `keep` columns and those that `work` makes of each batch, described by the DDL text `columns`.

    work returns the row of the batch that each of its rows belongs to (None: one for each, in order) and its columns. Kept columns are taken by place, so
    that 64-bit ids beside nulls stay what they are; pandas would turn them into floating-point numbers.
    """
    new = T._parse_datatype_string(columns)
    schema = T.StructType([*rows.select(*keep).schema, *new])
    kinds = list(to_arrow_schema(new).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            places, made = work(batch)
            kept = [batch[c] if places is None else batch[c].take(pa.array(places, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(c if isinstance(c, pa.Array) else _array(c, k) for c, k in zip(made, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def from_texts(rows: DataFrame, key: str, text: str, read: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """key and the rows that `read` finds in each text; a null text has none."""
    width = len(T._parse_datatype_string(columns))

    def work(batch: pa.RecordBatch) -> tuple[list[int], list]:
        found = [(at, r) for at, t in enumerate(batch[text].to_pylist()) if t is not None for r in read(t)]
        return [at for at, _ in found], [list(c) for c in zip(*(r for _, r in found), strict=True)] or [[] for _ in range(width)]

    return added(rows.select(key, text), [key], work, columns)
