"""Lists, exports and streams over the business tables: what comes in by pages and goes out as files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder, table
from ..sources import csv_export, notice_list, sinks, snapshots
from ..streaming import state
from .registry import query

PAGE_KEYS = 20_000  # order keys of a page


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of orders by menu (their priority) and page; every third one stands in the menu `all` as well, a day later."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("menu"), (key / PAGE_KEYS + 1).cast("int").alias("page"), F.concat(F.lit("n/"), key).alias("id"), F.concat(F.lit("T & "), key, F.lit(" "), "o_orderpriority").alias("title"), key, F.to_date("o_orderdate").alias("day"))
    again = rows.filter(key % 3 == 0).withColumns({"menu": F.lit("all"), "day": F.date_add("day", 1)})
    return rows.unionByName(again).withColumn("url", F.concat(F.lit("https://example.org/"), "id"))


def _save_pages(rows: DataFrame, path: str) -> None:
    """Pages as they would be saved: `all` as HTML list pages, other menus as JSON answers."""
    rows.filter("menu <> 'all'").select("menu", "page", "id", "title", "url", F.date_format("day", "yyyy-MM-dd").alias("published")).repartition("menu", "page").write.mode("append").partitionBy("menu", "page").json(path)
    item = F.format_string("<li class='x'><a href='%s'><b>%s</b></a> <span>%s</span></li>", F.col("id"), F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.date_format("day", "yyyy-MM-dd"))
    rows.filter("menu = 'all'").select("menu", "page", item.alias("value")).repartition("menu", "page").write.mode("append").partitionBy("menu", "page").text(path)


@query("""with n as (select o_orderkey as k, left(o_orderpriority, 1) as menu, o_orderkey // 20000 + 1 as page, 'T & ' || o_orderkey || ' ' || o_orderpriority as title, cast(o_orderdate as date) as day from orders where o_orderpriority ilike '%high%')
select 'n/' || k as notice_id, case when k % 3 = 0 then 'all' else menu end as menu, cast(page as int) as page, title, cast(case when k % 3 = 0 then day + 1 else day end as timestamp) as published from n""")
def notice_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18, SRC19: a search over the saved lists of all menus, in two protocols; one row a notice, the newest wins."""
    path = fresh_folder(spark, "menus")
    _save_pages(_notices(spark, sf_dir), path)
    lists = notice_list.register(spark).read.format("notice_list").option("path", path).option("search", "high").load()
    return snapshots.search_fan_out([lists.filter("menu = 'all'"), lists.filter("menu <> 'all'")]).select("notice_id", "menu", "page", "title", "published")


@query("""with n as (select o_orderkey as k, left(o_orderpriority, 1) as menu, o_orderkey // 20000 + 1 as page from orders)
select 'n/' || k as notice_id, menu, cast(page as int) as page, cast(case when page > (select max(page) // 2 from n) then 1 else 0 end as bigint) as batch from n where menu <= '3'""")
def notice_list_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18, SG1: lists as a stream whose cursor is the offset: a run that starts again reads the pages behind it, and no other."""
    rows, path = _notices(spark, sf_dir), fresh_folder(spark, "menus")
    half = rows.agg((F.max("page") / 2).cast("int")).first()[0]

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}-rows/turn={batch_id}")

    for part in (rows.filter(F.col("page") <= half), rows.filter(F.col("page") > half)):
        _save_pages(part, path)
        source = notice_list.register(spark).readStream.format("notice_list").option("path", path).option("menus", "1,2,3").load()
        source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-cursor").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}-rows").select("notice_id", "menu", "page", "batch")


EXPORTED = [sinks.ExportColumn("o_orderkey", "序号"), sinks.ExportColumn("price", "Price, total", "number", "0.0", 1), sinks.ExportColumn("note", "Note", order=2), sinks.ExportColumn("day", "Day", "datetime", None, 3)]


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.concat("o_orderpriority", F.lit(', "é"')).alias("note"), F.col("o_orderdate").cast("timestamp_ntz").alias("day"))


@query("""with r as (select o_orderkey, o_orderkey || ',' || cast(cast(cast(o_totalprice as decimal(18,2)) as decimal(38,1)) as varchar) || ',"' || o_orderpriority || ', ' || repeat(chr(34), 2) || 'é' || repeat(chr(34), 3) || ',' || strftime(cast(o_orderdate as timestamp), '%Y-%m-%d %H:%M:%S') as line from orders),
t as (select chr(65279) || '序号,"Price, total",Note,Day' || chr(10) || string_agg(line || chr(10), '' order by o_orderkey) as t, count(*) as n from r)
select strlen(t) as bytes, n as rows, sha256(t) as sha256 from t""")
def export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SNK8: an export as one file: its size, rows and digest as the commit took them."""
    path = f"{fresh_folder(spark, 'exports')}/orders.csv"
    return csv_export.write_file(_exported(spark, sf_dir), EXPORTED, [F.col("o_orderkey")], path).select("bytes", "rows", "sha256")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def _arrivals(batches: list[DataFrame], path: str) -> Iterator[DataFrame]:
    """A stream over files that arrive batch by batch."""
    for batch in batches:
        batch.write.mode("append").parquet(f"{path}/in")
        yield batch.sparkSession.readStream.schema(batch.schema).parquet(f"{path}/in")


@query("""select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type, cast(max(ts) as timestamp) as ts from events group by user_id""")
def newest_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG5, SG3: the newest content by key over batches that come out of order, and one of them twice, with a restart before each."""
    rows, path = _events(spark, sf_dir).withColumn("order", F.unix_micros("ts")), fresh_folder(spark, "newest")
    batches = [rows.filter("event_id % 3 = 2"), rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 = 1")]
    for source in _arrivals(batches, path):
        state.run_to_log(state.newest_by_key(source, ["user_id"], ["order", "event_id"], "event_type"), path).awaitTermination()
    kept = state.current(state.log(spark, path), ["user_id"])
    return kept.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""select user_id, event_type, cast(min(event_id % 2) as bigint) as turn from events group by 1, 2""")
def inbox_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG10: an inbox: every message by (user, type) passes once, in the first batch that brings it, though the next brings all again."""
    rows, path = _events(spark, sf_dir).select("user_id", "event_type"), fresh_folder(spark, "inbox")
    for source in _arrivals([rows.filter(F.col("event_id") % 2 == 0), rows], path):
        state.run_to_log(state.inbox(source, ["user_id", "event_type"]), path, "append").awaitTermination()
    return state.log(spark, path).select("user_id", "event_type", F.col("turn").cast("long").alias("turn"))


@query("""with m as (select o_orderkey as id, o_orderkey % 4 as failures from orders),
d as (select id, failures, unnest(range(0, least(failures, 2) + 1)) as k from m)
select id, cast(k + 1 as int) as attempt, case when k = 0 then 0 when k = 1 then 1030 else 2060 end::bigint as due, 'Dispatch' as action from d
union all select id, 3, 3000, 'DeadLetter' from m where failures = 3""")
def outbox_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG9: an outbox: the first attempt at once, a back-off of 30 and 60 seconds by timers behind a failure, a dead letter after three."""
    orders, path = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), fresh_folder(spark, "outbox")
    at = lambda s: F.timestamp_seconds(F.lit(1_000_000 + s)).alias("at")
    tick = lambda s: spark.range(-1, 0).select("id", at(s), F.lit("Tick").alias("event"))
    failed = lambda n: orders.filter(F.col("id") % 4 >= n).select("id", at(1000 * n), F.lit("Failed").alias("event"))
    first = orders.select("id", at(0), F.lit("Enqueued").alias("event"))
    batches = [first.unionByName(failed(1)), tick(1500), failed(2), tick(2500), failed(3)]
    for source in _arrivals(batches, path):
        state.run_to_log(state.deliveries(source, ["id"], "at", "event", most=3), path, "append").awaitTermination()
    return state.log(spark, path).select("id", "attempt", (F.unix_seconds("due") - 1_000_000).alias("due"), "action")
