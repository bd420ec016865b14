"""Joins with a meaning of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.alike import best_of_kinds, name_pairs
from ..session import TASK_SIZE, settled, shared_folder, spread
from .analytics import first_per_key

SMALL_SIDE = 64 * 1024 * 1024
ROW_SIZE = 128  # bytes that a row of a few columns takes where it is sorted
ARROW_ROWS = 10_000  # rows of a batch that a task gives back


def checked_broadcast(rows: DataFrame, most: int = SMALL_SIDE) -> DataFrame:
    """rows with a broadcast hint only where the optimizer's size estimate is proven below `most`; else left to the planner."""
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(rows) if int(str(size)) <= most else rows


def shuffled(rows: DataFrame) -> DataFrame:
    """rows that a join is not to broadcast: the optimizer takes rows that were exploded, or unpacked from a file, for as few bytes as what they come from."""
    return rows.hint("merge")


def lookup(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join to a table with one row per key."""
    return left.join(checked_broadcast(right), on, "left")


def in_any(rows: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Rows whose key is in any of several one-column sources."""
    ids = sources[0].toDF(key)
    for s in sources[1:]:
        ids = ids.union(s.toDF(key))
    return rows.join(ids.distinct(), key, "left_semi")


def not_in(rows: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """Rows whose key the source lacks."""
    return rows.join(source.toDF(key), key, "left_anti")


def cascade(left: DataFrame, right: DataFrame, key: str, right_key: str, rules: list[Column], block: Column | None = None) -> DataFrame:
    """For each left key the right rows by the first rule that any pair fulfils: rule is 1-based.

    Rules are conditions over the columns of both. Each rule joins for itself, so that equalities in it stay hash
    joins; `block`, where given, is a condition common to all. A left row gets only its lowest rule.
    """
    hits = None
    for i, rule in enumerate(rules, 1):
        on = rule if block is None else block & rule
        part = left.join(right, on).select(left[key], right[right_key], F.lit(i).alias("rule"))
        hits = part if hits is None else hits.union(part)
    best = hits.groupBy(key).agg(F.min("rule").alias("__r"))
    return hits.join(best, key).filter("rule = __r").drop("__r").distinct()


def asof_within(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, key: list[str], days: int, most: int, tie: list[Column]) -> DataFrame:
    """For each left row the newest right rows not later than left_time plus `days`, rows without a time last, at most `most`; `place` from 1.

    `key` names the left rows: one each. Right rows stand in buckets of a day; how many stand in buckets before gives each its position within its key,
    and a left row learns in its own bucket how many are not too late: the newest of these have the positions just below. So a left row
    meets only the rows that it keeps, at most `most`, however many its key has, and a hot key is sorted a day at a time. Rows are dealt by key
    and day to tasks whose number grows with the tables.
    """
    bound = F.col(left_time).cast("timestamp_ntz") + F.expr(f"INTERVAL {days} DAYS")
    day = lambda x: F.unix_date(F.to_date(x))
    start = -(2**31)  # the bucket of rows without a time: before all
    r = right.withColumns({"__t": F.col(right_time).cast("timestamp_ntz"), "__b": F.coalesce(day(F.col(right_time)), F.lit(start))})
    bucket = Window.partitionBy(*on, "__b")
    n = right.count()
    r = spread(r, [*on, "__b"], n * ROW_SIZE)
    r = r.withColumn("__turn", F.row_number().over(bucket.orderBy(F.col("__t").desc_nulls_last(), *tie)))
    asks = left.withColumns({"__t": bound, "__b": F.coalesce(day(bound), F.lit(start))})
    # What stands in each bucket, and before it.
    sizes = r.groupBy(*on, "__b").agg(F.count("*").alias("__n")).unionByName(asks.select(*on, "__b", F.lit(0).cast("long").alias("__n")).distinct()).groupBy(*on, "__b").agg(F.sum("__n").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*on).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = sizes.withColumn("__upto", before)
    placed = r.join(sizes, [*on, "__b"]).withColumn("__pos", F.col("__upto") - F.col("__turn") + 1).drop("__t", "__b", "__turn", "__n", "__upto")
    # In its own bucket a left row counts those not later than its bound.
    both = asks.select(*on, "__b", "__t", F.struct(*left.columns).alias("__left")).unionByName(r.select(*on, "__b", "__t", F.lit(None).cast(asks.select(F.struct(*left.columns)).schema[0].dataType).alias("__left")))
    upto = F.sum(F.when(F.col("__left").isNull(), 1).otherwise(0)).over(bucket.orderBy(F.col("__t").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = spread(both, [*on, "__b"], (n + left.count()) * ROW_SIZE).withColumn("__own", upto).filter("__left is not null").join(sizes, [*on, "__b"])
    last = F.col("__upto") - F.col("__n") + F.col("__own")
    wanted = counted.select("__left.*", last.alias("__last")).filter("__last > 0")
    wanted = wanted.select("*", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("__last") - most + 1), F.col("__last"))).alias("__pos"))
    return wanted.join(placed, [*on, "__pos"]).withColumn("place", (F.col("__last") - F.col("__pos") + 1).cast("int")).drop("__pos", "__last")


def best_match(left: DataFrame, right: DataFrame, condition: Column, left_key: str, order: list[Column]) -> DataFrame:
    """The best right row of each left row under a condition; left rows without one stay out."""
    return first_per_key(left.join(right, condition), [left_key], order)


def contained_either_way(a: Column, b: Column) -> Column:
    """One text holds the other, ignoring case; blank texts never."""
    p, q = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (p != "") & (q != "") & (F.contains(p, q) | F.contains(q, p))


def _runs(low: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of some lengths in a text."""
    some = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[some(n) for n in sizes]))


def _together(left: DataFrame, right: DataFrame, on: list[str], also: Column | None = None) -> DataFrame:
    """left and right joined where all of `on` are equal, nulls as values; right's come out as __of_<name>."""
    right = right.withColumnsRenamed({c: f"__of_{c}" for c in on})
    condition = also if also is not None else F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return left.join(right, condition).drop(*[f"__of_{c}" for c in on])


def contained_pairs(inner: DataFrame, outer: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """on, a, b: distinct texts a of `inner` that lie within a text b of `outer` of the same `on`, both as they are.

    The join has a key: of a the run of three characters that the fewest texts b of its group hold (all of a, where it is
    shorter), of b every run of one to three. No pair is made that shares no such run, and common runs are keys only of texts that have no rarer one.
    """
    inner = inner.select(*on, a).filter(F.col(a) != "").distinct()
    held = outer.select(*on, b).filter(F.col(b) != "").distinct().select(*on, b, F.explode(_runs(F.col(b), (1, 2, 3))).alias("__run"))
    counts = held.groupBy(*on, "__run").agg(F.count("*").alias("__n"))
    own = inner.select(*on, a, F.explode(F.when(F.length(a) < 3, F.array(a)).otherwise(_runs(F.col(a), (3,)))).alias("__run"))
    keyed = _together(own, counts.withColumnRenamed("__run", "__of_run"), on, F.col("__run") == F.col("__of_run"))
    keyed = keyed.groupBy(*on, a).agg(F.min(F.struct("__n", "__run"))["__run"].alias("__key"))
    return _together(keyed, held, on, F.col("__key") == F.col("__run")).filter(F.contains(b, F.col(a))).select(*on, a, b)


def containing_pairs(names: DataFrame, group: list[str], name: str) -> DataFrame:
    """group, inner, outer: distinct names of a group of which one lies in another, different one, ignoring case."""
    low = names.select(*group, F.col(name).alias("n"), F.lower(name).alias("low")).filter("low <> ''").distinct()
    pairs = contained_pairs(low.withColumnRenamed("low", "i"), low.withColumnRenamed("low", "o"), group, "i", "o")
    inner = _together(pairs, low.select(*group, F.col("n").alias("inner"), "low"), group, F.col("i") == F.col("low")).drop("low")
    both = _together(inner, low.select(*group, F.col("n").alias("outer"), "low"), group, F.col("o") == F.col("low"))
    return both.filter(F.col("inner") != F.col("outer")).select(*group, "inner", "outer")


CELL = 8192  # names of either side that are compared at a time
CELLS_IN_TASK = 4


def in_cells(left: DataFrame, right: DataFrame | None, on: list[str], least: float, inside: bool, key: str | None = None) -> DataFrame:
    """on, a, b, score of the like names __t of `left` and `right`, rows on, __t (of right also __kind and `key`, see similar_pairs); without `right` pairs a < b of `left`.

    Names of a group are dealt by their hash to parts of CELL names, and each pair of parts is a cell: however large a group is, a
    cell holds two parts and is a group of its own, and cells go to tasks by the number of their pairs. Nothing is broadcast but the numbers of parts of
    groups with more names than a part has, which are fewer than names by that factor.
    """
    spark = left.sparkSession
    keep = [key, "__kind"] if key else []
    shaped = lambda rows, there: rows.select(*on, "__t", F.lower("__t").alias("__low"), *[F.col(c) if there else F.lit(None).cast(right.schema[c].dataType).alias(c) for c in keep])
    sides = [settled(shaped(left, False), "names")] + ([settled(shaped(right, True), "names")] if right is not None else [])
    counted = [side.select(*on, *[F.lit(int(k == n)).cast("long").alias(f"__n{n}") for n in range(2)]) for k, side in enumerate(sides)]
    counts = counted[0] if right is None else counted[0].unionByName(counted[1])
    counts = settled(counts.groupBy(*on).agg(F.sum("__n0").alias("__n0"), F.sum("__n1" if right is not None else "__n0").alias("__n1")), "sizes")
    pairs, copies = counts.agg(F.sum(F.col("__n0").cast("double") * F.col("__n1")), F.sum(F.ceil(F.col("__n1") / CELL) * F.col("__n0") + F.ceil(F.col("__n0") / CELL) * F.col("__n1"))).first()
    many = F.broadcast(counts.filter((F.col("__n0") > CELL) | (F.col("__n1") > CELL)).select(*[F.col(c).alias(f"__of_{c}") for c in on], *[F.ceil(F.col(f"__n{k}") / CELL).cast("int").alias(f"__parts{k}") for k in range(2)]))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))

    def dealt(side: DataFrame, k: int) -> DataFrame:
        parts = [F.coalesce(f"__parts{n}", F.lit(1)) for n in range(2)]
        own = side.join(many, same, "left").withColumn("__own", F.pmod(F.xxhash64("__t"), parts[k]).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), parts[1 - k] - 1)))
        if right is None:
            cell = [F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"), (F.col("__own") > F.col("__other")).alias("__second")]
        else:
            cell = [F.col("__other" if k else "__own").alias("__i"), F.col("__own" if k else "__other").alias("__j"), F.lit(bool(k)).alias("__second")]
        return own.select(*on, "__t", "__low", *keep, *cell)

    cells = dealt(sides[0], 0) if right is None else dealt(sides[0], 0).unionByName(dealt(sides[1], 1))
    tasks = max(spark.sparkContext.defaultParallelism, -int(-(pairs or 0) // (CELLS_IN_TASK * CELL * CELL)), -int(-(copies or 0) * ROW_SIZE // TASK_SIZE))
    alone = right is None
    schema = T.StructType([*left.select(*on).schema, T.StructField("a", T.StringType()), T.StructField("b", right.schema[key].dataType if key else T.StringType()), T.StructField("score", T.DoubleType())])
    types = to_arrow_schema(schema)

    def compared(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        upper = alone and of[-1].as_py() == of[-2].as_py()
        second = rows["__second"]
        one = rows.filter(pc.invert(second))
        two = one if upper else rows.filter(second)
        if key:
            two = two.sort_by([("__kind", "ascending"), (key, "ascending")])
        names = [x[c].to_pylist() for c in ("__t", "__low") for x in (one, two)]
        met = name_pairs(*names, least, inside, upper)
        if key and two.num_rows:
            met = best_of_kinds(met, np.array(two["__kind"].combine_chunks().dictionary_encode().indices))
        a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (one["__t"], two[key or "__t"]))
        for i, j, score in met:
            for at in range(0, len(i), ARROW_ROWS):
                x, y = a.take(pa.array(i[at : at + ARROW_ROWS])), b.take(pa.array(j[at : at + ARROW_ROWS]))
                if alone:
                    less = pc.less(x, y)
                    x, y = pc.if_else(less, x, y), pc.if_else(less, y, x)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(v, len(x)) for v in of[:-2]], x, y, pa.array(score[at : at + ARROW_ROWS])], schema=types)

    return cells.repartition(tasks, *on, "__i", "__j").groupBy(*on, "__i", "__j").applyInArrow(compared, schema)


def alike_pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, least: float) -> DataFrame:
    """on, a, b, score: pairs of distinct texts whose shared distinct characters are at least `least` of the longer length, each pair once."""
    own = lambda df, x: df.select(*on, F.col(x).alias("__t")).filter(F.col(x) != "").distinct()
    return in_cells(own(left, a), own(right, b), on, least, False).withColumnsRenamed({"a": a, "b": b})


def prefix_candidates(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, least: float) -> DataFrame:
    """on, a, b: pairs of distinct texts that share distinct characters in number of at least `least` times the longer length."""
    return alike_pairs(left, right, on, a, b, least).select(*on, a, b)


def similar_pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, least: float, key: str | None = None, kind: list[str] | None = None) -> DataFrame:
    """on, a, b, score: all pairs of distinct name cores of the same `on` whose similarity is at least `least` (0.88 at most).

    With `key` and `kind` on, a, key, score: of right rows, and of each kind of them, only the likest to a name, of these the one of the least key. All are
    compared either way, but what is only compared stays in its cell. Of small alphabets names are compared by bits, of large ones by an index on
    their rarest characters; equal and containing names meet by a rare run.
    """
    own = lambda df, x: df.select(*on, F.col(x).alias("__t")).filter(F.col(x) != "").distinct()
    if key is None:
        return in_cells(own(left, a), own(right, b), on, least, True).withColumnsRenamed({"a": a, "b": b})
    others = right.filter(F.col(b) != "").select(*on, F.col(b).alias("__t"), key, F.to_json(F.struct(*kind), {"ignoreNullFields": "false"}).alias("__kind"))
    return in_cells(own(left, a), others, on, least, True, key).withColumnsRenamed({"a": a, "b": key})


def similar_within(names: DataFrame, on: list[str], name: str, least: float) -> DataFrame:
    """on, a, b, score: similar_pairs of the names of one table, each pair once with a < b."""
    return in_cells(names.select(*on, F.col(name).alias("__t")).filter(F.col(name) != "").distinct(), None, on, least, True)


def without_fragments(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """Rows whose name is not a proper part of another name of the same group; blank names stay."""
    parts = containing_pairs(rows, group, name).filter(F.length("outer") > F.length("inner")).select(*[F.col(g).alias(f"__of_{g}") for g in group], F.col("inner").alias("__inner")).distinct()
    on = F.col(name) == F.col("__inner")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return rows.join(parts, on, "left_anti")


def pairs_in_block(rows: DataFrame, block: list[str], key: str, columns: list[str]) -> DataFrame:
    """Pairs of rows of a block with key a < key b, their columns suffixed _a and _b."""
    a = rows.select(*block, *[F.col(c).alias(f"{c}_a") for c in [key, *columns]])
    b = rows.select(*block, *[F.col(c).alias(f"{c}_b") for c in [key, *columns]])
    return a.join(b, block).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))


def components(spark_edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label: label is the least node of a connected component; rounds are cut by checkpoint()."""
    shared_folder(spark_edges.sparkSession)
    both = spark_edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(spark_edges.select(F.col(b), F.col(a))).distinct().checkpoint()
    labels = both.select(F.col("x").alias("node")).distinct().select("node", F.col("node").alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = new.join(far, "label").select("node", "was", F.least("label", "far").alias("label")).checkpoint()
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels


def _least_labels(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges x-y and the least node that each is connected with: roots hook onto lesser ones, paths are halved."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            return nodes, nodes[label]
        low = np.minimum(p, q)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while (label[label] != label).any():
            label = label[label]


def block_components(edges: DataFrame, block: list[str], a: str, b: str, size: int) -> DataFrame:
    """node, label as `components` gives them, of `size` edges none of which leaves its block: one shuffle instead of rounds.

    Blocks stand one behind another in their task. Of a block that goes on in the next batch only the labels so far are kept, so that memory follows the
    nodes of the largest block. Blocks whose hashes collide are taken together, which joins nothing.
    """
    kind = edges.schema[a].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("label", kind)])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(_least_labels(x, y), types.types, strict=True)], schema=types)

        open_, x, y = None, None, None  # the last block and its edges
        for batch in batches:
            if not batch.num_rows:
                continue
            h, p, q = (batch[i].to_numpy(zero_copy_only=False) for i in range(3))
            if open_ is not None:
                h, p, q = np.concatenate([np.full(len(x), open_), h]), np.concatenate([x, p]), np.concatenate([y, q])
            last = h == h[-1]
            if not last.all():
                yield made(p[~last], q[~last])
            open_, (x, y) = h[-1], _least_labels(p[last], q[last])
        if open_ is not None:
            yield made(x, y)

    keyed = spread(edges.select(F.xxhash64(*block).alias("__h"), a, b), ["__h"], size * ROW_SIZE)
    return keyed.sortWithinPartitions("__h").mapInArrow(run, schema)
