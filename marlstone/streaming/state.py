"""Keyed state in streams: newest content by key, an inbox, deliveries with back-off.

Newest content and inbox are stateful processors: their state lies by key in the state store of the stream's checkpoint, so that a record and what
it gives out are one commit. Deliveries are steps in built-in functions over a table by key, one table a batch. A batch that is run again after
a crash finds the state of before; batches may come late, twice or out of order.
Rows travel as rows, not as pandas, so that 64-bit keys beside nulls stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.analytics import first_per_key
from ..session import dropped, ready

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = ("Created", "Changed", "IdentityUpdated", "Refreshed", "Late")


def _ready(rows: DataFrame) -> SparkSession:
    spark = ready(rows.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Newest(StatefulProcessor):
    """Keeps the newest row of a key and tells what a batch did to it."""

    def __init__(self, columns: list[str], schema: str, order: list[str], content: str, identity: list[str]):
        self.columns, self.schema, self.order, self.content, self.identity = columns, schema, order, content, identity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", self.schema)

    def _age(self, row: dict) -> tuple:
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in self.order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = dict(zip(self.columns, self.state.get(), strict=True)) if self.state.exists() else None
        new = max((r.asDict() for r in rows), key=self._age)
        if old is not None and self._age(new) < self._age(old):
            yield Row(**{c: old[c] for c in self.columns}, outcome="Late")
            return
        if old is None:
            outcome = "Created"
        elif new[self.content] != old[self.content]:
            outcome = "Changed"
        elif any(new[c] != old[c] for c in self.identity):
            outcome = "IdentityUpdated"
        else:
            outcome = "Refreshed"
        self.state.update(tuple(new[c] for c in self.columns))
        yield Row(**{c: new[c] for c in self.columns}, outcome=outcome)

    def close(self) -> None:
        """Nothing is held outside the state."""


def newest_by_key(stream: DataFrame, key: list[str], order: list[str], content: str, identity: list[str] = ()) -> DataFrame:
    """For each micro-batch one row a key that occurs in it: the newest row of the key so far, and `outcome`.

    Newest is by `order` (nulls first), over all batches: a late batch neither changes a row nor hides that it came (Late).
    Of rows of one age the last batch counts. Null keys are a key like others.
    """
    _ready(stream)
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("outcome", T.StringType())])
    processor = Newest(columns, stream.schema, order, content, list(identity))
    return stream.groupBy(*key).transformWithState(processor, schema, "Update", "None")


class Inbox(StatefulProcessor):
    """Lets the first message of a key through."""

    def __init__(self, columns: list[str], keep_ms: int | None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            first = min((r.asDict() for r in rows), key=lambda r: repr(tuple(r.values())))
            yield Row(**first)

    def close(self) -> None:
        """Nothing is held outside the state."""


def inbox(messages: DataFrame, key: list[str], keep_ms: int | None = None) -> DataFrame:
    """One row of each key, in the first batch that holds it; with keep_ms a key is forgotten so long after (by the clock).

    The record and the row are one commit: written by a sink that takes a batch once (files, a table), a message has its effect
    exactly once, whatever batch is repeated. Messages that are nothing but their key pass through Spark's own dropping of duplicates; of
    others the least of a batch is taken, a key at a time in Python, so that a repeated batch takes the same.
    """
    _ready(messages)
    if keep_ms is None and set(key) == set(messages.columns):
        return messages.dropDuplicates(key)
    mode = "None" if keep_ms is None else "ProcessingTime"
    return messages.groupBy(*key).transformWithState(Inbox(messages.columns, keep_ms), messages.schema, "Append", mode)


@dataclass(frozen=True)
class Stepped:
    """A stream and the step that takes each of its batches on from the table of before: run_to_log runs it.

    step(batch, before, clock) gives a table by key whose array `out` holds what the batch gives out for that key; the other columns are the
    table of after. clock is the watermark in milliseconds that the batch comes upon; null at first.
    """

    stream: DataFrame
    step: Callable[[DataFrame, DataFrame | None, int | None], tuple[DataFrame, int | None]]
    key: list[str]


def _delivered(most: int, initial: float, longest: float) -> Callable[[Column, Column], Column]:
    """One event of a message upon its state, for F.aggregate: attempts, done, timers, out."""

    def step(t: Column, e: Column) -> Column:
        live, attempts = ~t["done"], t["attempts"]
        is_ = lambda name: live & (e["event"] == name)
        dispatch, dead = is_("Enqueued") & (attempts == 0), is_("Failed") & (attempts >= most)
        wait = (F.least(F.lit(float(longest)), F.lit(float(initial)) * F.pow(F.lit(2.0), attempts - 1)) * 1000).cast("long")
        row = lambda n, action: F.array(F.struct(n.alias("attempt"), e["at_ms"].alias("at_ms"), F.lit(action).alias("action")))
        return F.struct(
            F.when(dispatch, F.lit(1)).otherwise(attempts).alias("attempts"),
            (t["done"] | is_("Succeeded") | dead).alias("done"),
            F.when(is_("Failed") & ~dead & (attempts > 0), F.array_union(t["timers"], F.array(e["at_ms"] + wait))).otherwise(t["timers"]).alias("timers"),
            F.when(dispatch, F.concat(t["out"], row(F.lit(1), "Dispatch"))).when(dead, F.concat(t["out"], row(attempts, "DeadLetter"))).otherwise(t["out"]).alias("out"),
        )

    return step


def deliveries(events: DataFrame, key: list[str], at: str, event: str, delay: str = "0 seconds", most: int = 5, initial: float = 30, longest: float = 3600) -> Stepped:
    """key, attempt, due, action (Dispatch or DeadLetter) from events Enqueued, Succeeded and Failed at event times: to be run by run_to_log.

    The first attempt is made at once, further ones a back-off behind each failure, then comes a dead letter. A failure starts a timer of
    min(longest, initial * 2^(attempts - 1)) seconds; the watermark (`delay` behind the newest event) lets it fire behind the events of its batch.
    Events not later than the watermark that a batch comes upon are late and have no effect. Messages stand in a table by key, which a batch
    meets in one shuffle: no message costs a call of its own.
    """
    ready(events.sparkSession)
    late = round(events.sparkSession.sql(f"SELECT (timestamp '1970-01-01' + interval {delay}) - timestamp '1970-01-01' AS d").first()["d"].total_seconds() * 1000)
    start = "array<struct<attempt:int,at_ms:bigint,action:string>>"

    def step(batch: DataFrame, before: DataFrame | None, clock: int | None) -> tuple[DataFrame, int | None]:
        rows = batch.select(*key, F.unix_millis(at).alias("at_ms"), F.col(event).alias("event"))
        newest = rows.agg(F.max("at_ms")).first()[0]
        after = clock if newest is None else max(newest - late, newest - late if clock is None else clock)
        if clock is not None:
            rows = rows.filter(F.col("at_ms") > clock)
        told = rows.filter(F.col("event").isin("Enqueued", "Succeeded", "Failed")).select(*key, F.struct("at_ms", "event").alias("e"), F.lit(None).cast("int").alias("attempts"), F.lit(None).cast("boolean").alias("done"), F.lit(None).cast("array<bigint>").alias("timers"))
        if before is not None:
            told = told.unionByName(before.select(*key, F.lit(None).cast("struct<at_ms:bigint,event:string>").alias("e"), "attempts", "done", "timers"))
        met = told.groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("e"), F.max("attempts").alias("attempts"), F.max("done").alias("done"), F.max("timers").alias("timers"))
        state = F.struct(F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("timers", F.array().cast("array<bigint>")).alias("timers"), F.array().cast(start).alias("out"))
        t = F.col("t")
        one = met.select(*key, F.when(F.size("e") > 0, F.aggregate("e", state, _delivered(most, initial, longest))).otherwise(state).alias("t"))
        due = F.array_sort(F.filter(t["timers"], lambda x: x <= F.lit(after).cast("long")))
        fired = F.when(t["done"], F.array().cast(start)).otherwise(F.transform(due, lambda x, i: F.struct((t["attempts"] + i + 1).alias("attempt"), x.alias("at_ms"), F.lit("Dispatch").alias("action"))))
        left = F.when(t["done"], F.array().cast("array<bigint>")).otherwise(F.filter(t["timers"], lambda x: ~F.coalesce(x <= F.lit(after).cast("long"), F.lit(False))))
        one = one.select(*key, "t", fired.alias("fired"), left.alias("timers"))
        out = F.transform(F.concat(t["out"], F.col("fired")), lambda o: F.struct(o["attempt"].alias("attempt"), F.timestamp_millis(o["at_ms"]).alias("due"), o["action"].alias("action")))
        return one.select(*key, (t["attempts"] + F.size("fired")).cast("int").alias("attempts"), t["done"].alias("done"), "timers", out.alias("out")), after

    return Stepped(events, step, key)


def _run_steps(rows: Stepped, path: str, keep: Callable[[DataFrame], DataFrame] | None) -> StreamingQuery:
    """Batch n reads the table of batch n - 1 and writes its own and its log; each is replaced when the batch is repeated."""
    table = lambda n: f"{path}/table/turn={n}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, clock = batch.sparkSession, None
        before = None
        if batch_id:
            before = spark.read.parquet(table(batch_id - 1)).drop("out")
            clock = spark.read.parquet(f"{path}/clock/turn={batch_id - 1}").first()["ms"]
        after, clock = rows.step(batch, before, clock)
        after.write.mode("overwrite").parquet(table(batch_id))
        spark.createDataFrame([(clock,)], "ms long").coalesce(1).write.mode("overwrite").parquet(f"{path}/clock/turn={batch_id}")
        out = spark.read.schema(after.schema).parquet(table(batch_id)).filter(F.size("out") > 0).select(*rows.key, F.inline("out"))
        (keep(out) if keep else out).write.mode("overwrite").parquet(f"{path}/log/turn={batch_id}")
        if batch_id > 1:  # a batch that is repeated reads the table of the one before it, none older
            dropped(spark, table(batch_id - 2))

    return rows.stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def run_to_log(rows: DataFrame | Stepped, path: str, mode: str = "update", keep: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start a run that adds each micro-batch to a log: a folder a batch under path/log, replaced when the batch is repeated.

    The checkpoint lies beside it, and for steps their table; a later run with the same path goes on where this one ends.
    """
    if isinstance(rows, Stepped):
        return _run_steps(rows, path, keep)

    def write(batch: DataFrame, batch_id: int) -> None:
        (keep(batch) if keep else batch).write.mode("overwrite").parquet(f"{path}/log/turn={batch_id}")

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log with their `turn`."""
    return spark.read.parquet(f"{path}/log")


def current(rows: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """The table that a log of newest_by_key describes: the row of each key's last turn."""
    return first_per_key(rows, key, order or [F.desc("turn")]).drop("turn", "outcome")
