"""Gapless numbers over all rows of a frame, without a window over all of them, and what follows from them for inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

IN_PARTITION = (1 << 33) - 1  # the bits of a monotonically increasing id that count within a partition


def numbered(rows: DataFrame, name: str, start: int = 0, order: list[Column] | None = None) -> DataFrame:
    """rows with gapless numbers from `start` on, in the order given or, without one, in that of the partitions.

    Rows are written once with their place within their partition; the counts of partitions, one row each, are summed up
    by the driver, and every row adds what stands before its partition. An order is a range partitioning and a sort within ranges.
    """
    if order:
        rows = rows.orderBy(*order)
    placed = settled(rows.withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))}), "numbered")
    at, ahead = start, []
    for part, n in sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        ahead.append((part, at))
        at += n
    parts = rows.sparkSession.createDataFrame(ahead, "__part int, __ahead long")
    return placed.join(F.broadcast(parts), "__part").withColumn(name, F.col("__ahead") + F.col("__n")).select(*rows.columns, name)


def for_insert(rows: DataFrame, key: str, last: int, defaults: dict[str, Column], nulls: str = "insert", order: list[Column] | None = None) -> DataFrame:
    """Rows ready to append: those without an id get the next ones behind `last`, gapless and in order, those with one keep it.

    nulls: `insert` writes null columns as they are, `ignore` leaves them to the defaults of the target.
    """
    if nulls not in ("insert", "ignore"):
        raise ValueError(nulls)
    if nulls == "ignore":
        rows = rows.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in rows.columns})
    new = numbered(rows.filter(F.col(key).isNull()).drop(key), key, last + 1, order)
    return rows.filter(F.col(key).isNotNull()).unionByName(new.select(*rows.columns))


def back_filled(children: DataFrame, parents: DataFrame, reference: str, parent_key: str, foreign_key: str) -> DataFrame:
    """children whose foreign key is the id that their parent got, found by the reference that both carry; without a parent it stays as it is."""
    ids = parents.select(reference, F.col(parent_key).alias("__new"))
    return children.join(ids, reference, "left").withColumn(foreign_key, F.coalesce("__new", F.col(foreign_key))).select(*children.columns)
