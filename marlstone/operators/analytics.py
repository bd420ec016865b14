"""Aggregates and windows that analytics share; every limit follows a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def ranked(rows: DataFrame, keys: list[str], order: list[Column], rank: str = "rn") -> DataFrame:
    """rows numbered 1, 2, ... within keys; ties are what the order leaves."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: latest, earliest or best, as the order says."""
    return ranked(rows, keys, order, "__rn").filter("__rn = 1").drop("__rn")


def latest_by(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the row with the greatest order values of each key: one partial aggregate, no sort of the groups."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("__m"))
    return best.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in columns])


def unique_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key, only where no other ties with it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = rows.withColumn("__r", F.rank().over(w)).filter("__r = 1")
    return top.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n = 1").drop("__r", "__n")


def fill_down(rows: DataFrame, keys: list[str], order: list[Column], column: str, out: str) -> DataFrame:
    """The last non-null value so far, within keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(w))


def bucket_top(rows: DataFrame, label: Column, n: int, default: str = "Unknown") -> DataFrame:
    """label, count of the n largest groups: labels compare without case, blank ones get the default, the least spelling is shown."""
    shown = F.when(F.trim(F.coalesce(label, F.lit(""))) == "", F.lit(default)).otherwise(F.trim(label))
    return (
        rows.select(shown.alias("label")).groupBy(F.lower("label").alias("k")).agg(F.min("label").alias("label"), F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(n).select("label", "n")
    )


def tagged_buckets(rows: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """tag, label, n for several bucketings of the same rows in one pass; null labels don't count."""
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), c.cast("string").alias("label")) for t, c in labels.items()])
    return rows.select(F.inline(tags)).filter("label is not null").groupBy("tag", "label").agg(F.count("*").alias("n"))


def zero_filled(rows: DataFrame, column: Column, fixed: list[str], extra: bool = False) -> DataFrame:
    """position, label, n: the fixed labels in their order, absent ones at 0; then the others by count, if wanted."""
    spark = rows.sparkSession
    counts = rows.groupBy(column.alias("label")).agg(F.count("*").alias("n"))
    dim = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(fixed)], "position int, label string"))
    out = dim.join(counts, "label", "left").select("position", "label", F.coalesce("n", F.lit(0)).alias("n"))
    if not extra:
        return out
    others = counts.filter(~F.col("label").isin(fixed) | F.col("label").isNull())
    placed = numbered(others, "position", len(fixed), [F.desc("n"), F.col("label").asc_nulls_last()])
    return out.union(placed.select(F.col("position").cast("int"), "label", "n"))


def ratio_percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, half to even; 0 where the whole is 0 or null."""
    return F.coalesce(F.bround(F.try_divide(part.cast("decimal(18,4)") * 100, whole.cast("decimal(18,4)")), digits), F.lit(0))


def unique_value(column: Column) -> Column:
    """As an aggregate: the one distinct value of a group, null if there are none or several."""
    return F.when(F.min(column) == F.max(column), F.min(column))


def joined_distinct(rows: DataFrame, keys: list[str], column: Column, most: int, name: str, separator: str = ",") -> DataFrame:
    """keys, name: the first `most` distinct values of each key in ascending order, joined; no more than those are ever gathered."""
    each = rows.select(*keys, column.alias("__v")).filter("__v is not null").distinct()
    few = ranked(each, keys, [F.col("__v")], "__p").filter(F.col("__p") <= most)
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__v")), separator).alias(name))


def rollup_status(confirmed: Column, rejected: Column) -> Column:
    """As an aggregate: AllConfirmed, SomeConfirmed, AllRejected, Pending or None for a group."""
    n, c, r = F.count("*"), F.count_if(confirmed), F.count_if(rejected)
    return F.when(n == 0, "None").when(c == n, "AllConfirmed").when(c > 0, "SomeConfirmed").when(r == n, "AllRejected").otherwise("Pending")


def limited_by_type(rows: DataFrame, kind: str, order: list[Column], per_type: int, slots: int) -> DataFrame:
    """The first `slots` rows in order, no more than per_type of a kind: what a greedy walk takes, for a refused row uses no slot.

    A kind needs no more than min(per_type, slots) rows, so the final sort sees a bounded number a kind.
    """
    few = ranked(rows, [kind], order, "__k").filter(F.col("__k") <= min(per_type, slots))
    return few.orderBy(*order).limit(slots).drop("__k")
