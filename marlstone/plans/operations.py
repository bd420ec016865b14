"""Ingestion, queues, commands, writes and evidence over the business tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import AccessContext
from ..functions import classify, codes, text
from ..operators import analytics as A
from ..operators import linkage, merging, numbering, scoring
from ..session import table
from ..sources import sinks
from ..sources.catalog import Catalog, TableScope
from ..streaming import commands, ingest
from .registry import query

CTX = AccessContext(datetime(2026, 1, 2), tenant_id=7, user_id=3)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("day"), "o_orderpriority")


def _status(*names: str) -> Column:
    """The status that an order's letter stands for: F, O, P."""
    return classify.ladder([(F.col("o_orderstatus") == k, v) for k, v in zip("FO", names, strict=False)], names[2])


@query("""select o_orderkey as id, cast(7 as bigint) as tenant_id, timestamp '2026-01-02' as created_at, cast(3 as bigint) as created_by, o_orderkey % 2 = 1 as touched, case when o_orderkey % 2 = 1 then 2 else 1 end as version,
case when o_orderkey % 2 = 1 then timestamp '2026-01-02' end as updated_at from orders""")
def audited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK3: inserts stamped with tenant and audit columns, updates with theirs and the next version."""
    new = sinks.stamped(_orders(spark, sf_dir).select("id"), CTX)
    changed = sinks.stamped(new.filter("id % 2 = 1"), CTX, new=False)
    rows = new.filter("id % 2 = 0").withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).unionByName(changed.drop("updated_by"))
    return rows.select("id", "tenant_id", "created_at", "created_by", (F.col("id") % 2 == 1).alias("touched"), "version", "updated_at")


@query("""select o_orderkey as id, o_orderkey % 5 = 0 as gone from orders where o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0""")
def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, FIL6: rows marked deleted are not scanned, hard deleted ones are gone."""
    none = lambda t: F.lit(None).cast(t)
    rows = sinks.stamped(_orders(spark, sf_dir).select("id"), CTX).withColumns({"deleted_at": none("timestamp_ntz"), "deleted_by": none("long")})
    left = sinks.soft_deleted(sinks.hard_deleted(rows, rows.filter("id % 7 = 0"), "id"), rows.filter("id % 5 = 0"), "id", CTX)
    seen = Catalog(spark, frames={"t": left}, scopes={"t": TableScope(kind="tenant", key="id", deleted="is_deleted")}).scan("t", CTX)
    return seen.select("id", F.col("deleted_at").isNotNull().alias("gone"))


@query("""with r as (select o_orderkey, cast(o_orderkey as varchar) || ',' || cast(cast(cast(o_totalprice as decimal(18,2)) as decimal(38,1)) as varchar) || ',' || case when o_orderstatus = 'O' then 'true' else 'false' end || ',"' || o_orderpriority || ', ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) || ',' || strftime(cast(o_orderdate as timestamp) + interval 8 hour, '%Y-%m-%d %H:%M:%S') || ',' as value from orders)
select '序号,"Price, total",Open,Priority,Day,Empty' as value union all select value from r""")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, SNK7, PRJ3: the lines of a CSV export: ordered, shown columns, values by kind, quotes only where needed, times in a zone."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), (F.col("o_orderstatus") == "O").alias("open"), F.concat("o_orderpriority", F.lit(', "x"')).alias("p"), F.col("o_orderdate").cast("timestamp_ntz").alias("day"), F.lit(None).cast("string").alias("empty")
    )
    c = sinks.ExportColumn
    columns = [c("empty", "Empty", order=9), c("price", "Price, total", "number", "0.0", 1), c("o_orderkey", "序号"), c("open", "Open", order=2), c("p", "Priority", order=3), c("day", "Day", "datetime", None, 4), c("o_custkey", "Hidden", hidden=True), c("x", " ")]
    head, lines = sinks.export_lines(rows, columns, [F.col("o_orderkey")], "Asia/Shanghai")
    return spark.createDataFrame([(head,)], "value string").unionByName(lines)


@query("select o_orderkey as id from orders where o_orderstatus = 'F' and o_orderdate + interval 30 day < timestamp '1996-01-01' order by o_orderdate, o_orderkey limit 500")
def expired_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: a sweep's batch of ready artifacts past their time, oldest first."""
    rows = _orders(spark, sf_dir).select("id", _status("Ready", "Running", "Failed").alias("status"), (F.col("day") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return sinks.expired(rows, F.lit("1996-01-01").cast("timestamp_ntz"), 500).select("id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.get(F.array(*[F.lit(x) for x in ("Created", "Changed", "Refreshed", "Failed", "Refreshed")]), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), outcome.alias("outcome"))


@query("""with a as (select event_type, max(ts) as h, min(ts) as l, count(*) as s, count(*) filter (event_id % 5 = 0) as c, count(*) filter (event_id % 5 = 1) as g, count(*) filter (event_id % 5 = 3) as f from events group by 1)
select event_type, cast(h as timestamp) as high_watermark, cast(l as timestamp) as low_watermark, s as scanned, c as created, g as changed, f as failed, cast(3 as bigint) as next_cursor from a""")
def crawl_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG1, AG19: a checkpoint after two pages of a backfill: watermarks widen, counters add up, the cursor goes on."""
    empty = "event_type string, high_watermark timestamp_ntz, low_watermark timestamp_ntz, scanned long, created long, changed long, failed long, next_cursor long"
    rows = _events(spark, sf_dir)
    state = spark.createDataFrame([("click", None, None, 0, 0, 0, 0, 1)], empty)
    start = rows.select("event_type").distinct().filter("event_type <> 'click'")
    state = state.unionByName(start.select("event_type", *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("high_watermark", "low_watermark")], *[F.lit(0).cast("long").alias(c) for c in ("scanned", "created", "changed", "failed")], F.lit(1).cast("long").alias("next_cursor")))
    for half in (0, 1):
        state = ingest.advance_cursor(state, rows.filter(F.col("event_id") % 2 == half), ["event_type"], "ts", incremental=False)
    return state


@query("select event_id % 10 as channel from events group by 1 having count(*) filter (event_id % 5 in (0, 1, 3)) = 0")
def quiet_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG2: channels whose page brought nothing new: their run ends."""
    return ingest.quiet_channels(_events(spark, sf_dir).withColumn("channel", F.col("event_id") % 10), ["channel"])


@query("""select c_custkey as id, case when c_custkey % 4 > 0 then 'k' || c_custkey % 97 end as deduplication_key from customer where c_custkey % 4 = 0
union all select min(c_custkey), 'k' || c_custkey % 97 from customer where c_custkey % 4 > 0 and 'k' || c_custkey % 97 not in (select 'k' || o_custkey % 997 from orders where o_orderstatus <> 'F') group by c_custkey % 97""")
def enqueued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG6: jobs to append: one a key, none whose key waits or runs; those without a key all."""
    queue = _orders(spark, sf_dir).select(_status("Succeeded", "Pending", "Running").alias("status"), F.concat(F.lit("k"), F.col("o_custkey") % 997).alias("deduplication_key"))
    k = F.col("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 > 0, F.concat(F.lit("k"), k % 97)).alias("deduplication_key"))
    return ingest.enqueue(queue, jobs)


@query("""with r as (select o_orderkey as id, o_orderstatus as s, o_orderkey % 3 as out, o_orderkey % 6 as tries, o_orderkey % 5 = 0 as cancel, o_orderkey % 4 = 0 as lost from orders),
t as (select *, s = 'O' and (out = 1 or (out = 2 and lost)) as failed from r)
select id, case when s = 'F' then 'Succeeded' when cancel and (s = 'P' or failed) then 'Cancelled' when s = 'O' and out = 0 then 'Succeeded' when failed and tries >= 4 then 'DeadLetter' when failed then 'Pending' when s = 'P' then 'Pending' else 'Running' end as status,
cast(case when failed and tries < 4 and not cancel then least(100, 30 * power(2, tries - 1)) end as bigint) as wait from t""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG8, SC41: the next state of queue rows: success, retry with back-off, dead letter, lost lease, cancellation."""
    n = F.col("id")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    rows = _orders(spark, sf_dir).select(
        "id", _status("Succeeded", "Running", "Pending").alias("status"), F.get(F.array(F.lit("Succeeded"), F.lit("Failed"), F.lit(None)), (n % 3).cast("int")).alias("outcome"), (n % 6).alias("attempt_count"), F.lit(4).alias("max_attempts"),
        F.when(n % 4 == 0, F.lit("2025-12-31").cast("timestamp_ntz")).otherwise(F.lit("2026-01-02").cast("timestamp_ntz")).alias("lease_until"), (n % 5 == 0).alias("cancel_requested"),
    )
    out = rows.select("id", ingest.next_job_state(now, 30, 100).alias("s"))
    return out.select("id", F.col("s.status").alias("status"), (F.unix_seconds("s.next_attempt_at") - F.unix_seconds(now.cast("timestamp"))).alias("wait"))


@query("select user_id, count(*) as n from (select distinct user_id, event_type from events where event_id % 2 = 0 and (user_id, event_type) not in (select user_id, event_type from events where event_id % 7 = 0)) group by 1")
def unseen_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG9, SG10: messages of a batch that the inbox lacks, one per key."""
    rows = _events(spark, sf_dir)
    keys = ["user_id", "event_type"]
    return ingest.unseen(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 7 = 0").select(*keys).distinct(), keys).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""select c_custkey as id, cast(row_number() over (order by t nulls first, c_custkey) as int) as place from (select c_custkey, case when c_custkey % 5 > 0 then timestamp '2026-01-01' - c_custkey * interval 1 minute end as t from customer where c_custkey % 3 > 0)
where t is null or t + interval 2 hour <= timestamp '2026-01-01' order by t nulls first, c_custkey limit 40""")
def scan_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG13, SRC8, WN2: due channels, never scanned ones first, then the longest waiting: a run's batch."""
    k, now = F.col("c_custkey"), F.lit("2026-01-01").cast("timestamp_ntz")
    last = F.when(k % 5 > 0, now - F.make_dt_interval(mins=k.cast("int")))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 3 > 0).alias("enabled"), F.lit(120).alias("scan_interval_minutes"), last.alias("last_scan_time"))
    due = ingest.due_channels(rows, now, 40)
    return A.ranked(due.withColumn("all", F.lit(1)), ["all"], [F.col("last_scan_time").asc_nulls_first(), F.col("id")], "place").select("id", "place")


@query("""with e as (select o_orderkey as id, o_orderstatus as s, case when o_orderkey % 3 = 0 then o_orderkey * 2 end as job, 'k' || o_orderkey as k from orders),
j as (select o_orderkey * 2 as id, case o_orderkey % 5 when 0 then 'DeadLetter' when 1 then 'Cancelled' else 'Running' end as st, 'k' || o_orderkey as k from orders where o_orderkey % 4 > 0)
select e.id, case when e.s = 'F' then 'Unchanged' when j.st in ('DeadLetter', 'Cancelled') then 'Fail' when j.id is null then 'Requeue' when e.job is null then 'Link' else 'Unchanged' end as action, j.id as job_id from e left join j using (k)""")
def reconciled_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG15: exports against their jobs, found by id or by key: link, fail, queue again, leave."""
    n = F.col("id")
    exports = _orders(spark, sf_dir).select("id", _status("Ready", "Queued", "Running").alias("status"), F.when(n % 3 == 0, n * 2).alias("background_job_id"), F.concat(F.lit("k"), n).alias("deduplication_key"))
    state = classify.ladder([(n % 5 == 0, "DeadLetter"), (n % 5 == 1, "Cancelled")], "Running")
    jobs = _orders(spark, sf_dir).filter("id % 4 > 0").select((n * 2).alias("id"), state.alias("status"), F.concat(F.lit("k"), n).alias("deduplication_key"))
    return ingest.reconciled(exports, jobs).select("id", "action", "job_id")


@query("""with o as (select user_id, max(event_id) as e from events where event_id % 2 = 0 group by 1), n as (select user_id, max(event_id) as e from events where event_id % 2 = 1 and event_id % 3 > 0 group by 1)
select coalesce(n.user_id, o.user_id) as user_id, coalesce(n.e, o.e) as event_id, case when n.e is null then 'Kept' when o.e is null then 'Created' when n.e % 10 <> o.e % 10 then 'Changed' else 'Refreshed' end as outcome from n full join o on n.user_id = o.user_id""")
def merged_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG4, SG5, SNK5, SRC2: the newest row of each key in a load, classified against the target by its content's hash, and merged."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.sha2((F.col("event_id") % 10).cast("string"), 256).alias("hash"))
    old = ingest.newest(rows.filter("event_id % 2 = 0"), ["user_id"], [F.desc("event_id")])
    new = ingest.newest(rows.filter("event_id % 2 = 1 and event_id % 3 > 0"), ["user_id"], [F.desc("event_id")])
    told = ingest.classify_upsert(new, old, "user_id", "hash", [])
    after = ingest.merged(old, told.drop("outcome"), ["user_id"])
    return after.join(told.select("user_id", "outcome"), "user_id", "left").select("user_id", "event_id", F.coalesce("outcome", F.lit("Kept")).alias("outcome"))


@query("select o_orderkey as id, o_orderstatus as status from orders where o_orderkey % 3 = 0 and o_orderkey % 6 > 0")
def promoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM1: staged rows that the formal table lacks."""
    rows = _orders(spark, sf_dir).select("id", F.col("o_orderstatus").alias("status"))
    return commands.promoted(rows.filter("id % 3 = 0"), rows.filter("id % 6 = 0"), "id")


@query("""select o_orderkey as id, cast(-o_orderkey as bigint) as ordinal from orders where o_orderkey % 3 > 0 and o_orderstatus = 'O' and o_orderkey % 4 <= 1 and o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')""")
def eligible_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM2: tasks that a bulk approval may take: asked for, pending, of low risk, with few grave issues."""
    rows = _orders(spark, sf_dir).select("id", _status("Done", "Pending", "Failed").alias("status"), F.col("o_orderpriority").alias("risk"), (F.col("id") % 4).alias("high_count"))
    ids = rows.filter("id % 3 > 0").select("id", (-F.col("id")).alias("ordinal"))
    return commands.eligible(rows, ids.union(ids.select("id", F.lit(10).cast("long"))), "id", 1, ["4-NOT SPECIFIED", "5-LOW"]).select("id", "ordinal")


@query("""select i.id, case when o.o_orderkey is null then 'Missing' when o.o_orderstatus = 'O' then 'Done' else 'Skipped' end as outcome, case when o.o_orderstatus = 'O' then 'Reserved' when o.o_orderstatus = 'F' then 'Done' when o.o_orderstatus = 'P' then 'Failed' end as status
from (select c_custkey * 3 as id from customer) i left join orders o on o.o_orderkey = i.id""")
def reserved_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM3, CM7, CM10: a conditional change of status with the outcome of every id asked for."""
    rows = _orders(spark, sf_dir).select("id", _status("Done", "Pending", "Failed").alias("status"))
    return commands.moved(rows, table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("id")), "id", ["Pending"], "Reserved")


@query("""select o_orderkey as id, '{"a":' || o_custkey || ',"s":"' || o_orderstatus || '"}' as before_json, '{"a":' || (o_custkey + 1) || ',"s":"' || o_orderstatus || '"}' as after_json from orders where o_orderkey % 10 = 0""")
def correction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM4: rows that a reviewer changed, before and after as JSON."""
    before = _orders(spark, sf_dir).select("id", F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("s"))
    return commands.corrections(before, before.withColumn("a", F.when(F.col("id") % 10 == 0, F.col("a") + 1).otherwise(F.col("a"))), "id")


@query("""with old as (select o_custkey, cast(count(*) as int) as n from orders where o_orderkey % 2 = 0 group by 1), new as (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as k from orders where o_orderkey % 2 = 1)
select o_orderkey as id, o_custkey, coalesce(n, 0) + k as number from new left join old using (o_custkey)""")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM5: rows added by hand, numbered on from the last of their group."""
    rows = _orders(spark, sf_dir).select("id", "o_custkey")
    old = A.ranked(rows.filter("id % 2 = 0"), ["o_custkey"], [F.col("id")], "number")
    return commands.appended(old, rows.filter("id % 2 = 1"), ["o_custkey"], "number", [F.col("id")])


@query("""select o_orderkey as id, case when o_orderkey % 3 = 1 and o_orderkey % 2 = 0 then 'new' else o_orderpriority end as name from orders where o_orderkey % 5 > 0""")
def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM5: manual updates and deletes; a change without a name, or of a deleted row, has no effect."""
    rows = _orders(spark, sf_dir).select("id", F.col("o_orderpriority").alias("name"))
    changes = rows.filter("id % 3 = 1").select("id", F.when(F.col("id") % 2 == 0, "new").otherwise(" ").alias("name"))
    return commands.renumbered(rows, changes, rows.filter("id % 5 = 0"), "id", "name")[0]


@query("""select o_orderkey as id, case when o_orderkey = m then 'Selected' when o_orderkey % 4 = 0 then 'Recommended' else 'Rejected' end as status, case when o_orderkey = m then cast(o_totalprice as decimal(18,2)) end::double as final_amount
from orders join (select o_custkey, max(o_orderkey) as m from orders group by 1) using (o_custkey)""")
def selected_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM6: one amount selected per link, the one before demoted."""
    n = F.col("id")
    rows = _orders(spark, sf_dir).select("id", F.col("o_custkey").alias("link_id"), F.when(n % 8 == 0, "Selected").when(n % 4 == 0, "Recommended").otherwise("Rejected").alias("status"), F.col("o_totalprice").cast("decimal(18,4)").alias("amount_value"), F.lit("manual").alias("source"))
    changed, links = commands.selected_amount(rows, rows.groupBy("link_id").agg(F.max("id").alias("id")))
    final = links.select("link_id", F.col("final_amount").cast("double").alias("final_amount"))
    return changed.join(final, "link_id").select("id", "status", F.when(F.col("status") == "Selected", F.col("final_amount")).alias("final_amount"))


@query("select o_orderkey as id from orders where o_orderkey % 4 = 0 or o_custkey % 10 in (select c_custkey % 10 from customer where c_custkey % 10 < 6)")
def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM9: candidates whose source record is still there, and those without one."""
    rows = _orders(spark, sf_dir).select("id", F.when(F.col("id") % 4 > 0, F.col("o_custkey") % 10).alias("record"))
    records = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("record")).filter("record < 6")
    return commands.orphans_removed(rows, records, "record").select("id")


@query("""with s as (select o_custkey, min(o_orderpriority) as lo, max(o_orderpriority) as hi from orders where o_orderkey % 6 = 0 group by 1)
select o_orderkey as id, case when o_orderkey % 2 = 1 then 'own' else case when lo = hi then lo else ' ' end end as code from orders left join s using (o_custkey)""")
def propagated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM11: links without a code get the one that their group's sources agree on."""
    rows = _orders(spark, sf_dir)
    links = rows.select("id", "o_custkey", F.when(F.col("id") % 2 == 1, "own").otherwise(" ").alias("code"))
    return commands.propagated(links, rows.filter("id % 6 = 0").select("o_custkey", F.col("o_orderpriority").alias("code")), ["o_custkey"], "code").select("id", "code")


@query("""select min(o_orderkey) as id, o_custkey as package_id, 'opened' as what from orders where o_orderkey % 2 = 1 and o_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0 and o_orderstatus = 'O') group by o_custkey
union all select o_orderkey, o_custkey, 'F>O' from orders where o_orderstatus = 'F' and o_orderkey % 3 = 0 union all select o_orderkey, o_custkey, 'P>O' from orders where o_orderstatus = 'P' and o_orderkey % 3 = 0""")
def opened_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM12: new opportunities of packages without an active one, and the history of real stage changes."""
    rows = _orders(spark, sf_dir).select("id", F.col("o_custkey").alias("package_id"), _status("Lost", "Active", "Lost").alias("status"), F.col("o_orderstatus").alias("stage"))
    new = commands.opened(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")).select("id", "package_id", F.lit("opened").alias("what"))
    moves = commands.stage_changes(rows, rows.filter("id % 3 = 0").select("id", F.lit("O").alias("stage")))
    return new.unionByName(moves.join(rows.select("id", "package_id"), "id").select("id", "package_id", F.concat("from_stage", F.lit(">"), "to_stage").alias("what")))


@query("""select coalesce(a.k, b.k) as id, coalesce(t, w) as stage, case when coalesce(t, w) = 'Closed' then 'Closed' else 'Active' end as status, case coalesce(t, w) when 'Preparing' then 25 when 'Submitted' then 90 when 'Closed' then 100 else 0 end as progress,
case when w is null then 'Created' when t is not null and t <> w then 'Updated' else 'Unchanged' end as outcome from (select o_orderkey as k, case o_orderstatus when 'F' then 'Closed' when 'O' then 'Preparing' else 'New' end as w from orders where o_orderkey % 3 > 0) a
full join (select o_orderkey as k, case when o_orderkey % 4 = 0 then 'Closed' else 'Submitted' end as t from orders where o_orderkey % 2 = 0) b on a.k = b.k""")
def pursuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM13: pursuits created and moved, status and progress by stage."""
    rows = _orders(spark, sf_dir).select("id", _status("Closed", "Preparing", "New").alias("stage"))
    wanted = rows.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "Closed").otherwise("Submitted").alias("stage"))
    return commands.pursued(rows.filter("id % 3 > 0"), wanted, {"New": 0, "Preparing": 25, "Review": 60, "Submitted": 90, "Awarded": 100, "Closed": 100})


@query("""with i as (select c_custkey * 3 as id from customer) select i.id, case when o_orderkey is null then 'Missing' when o_orderstatus = 'P' then 'Retried' else 'Refused' end as retry, case when o_orderkey is null then 'Missing' when o_orderstatus = 'O' then 'CancelRequested' else 'Refused' end as cancel,
case when o_orderkey is null then 'Missing' when o_orderstatus = 'O' then 'Cancelled' else 'Refused' end as forced from i left join orders on o_orderkey = i.id""")
def job_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM14: retries, cancellations and forced ones, with the outcome of every job asked for."""
    jobs = _orders(spark, sf_dir).select("id", _status("Succeeded", "Running", "DeadLetter").alias("status"))
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("id"))
    act = lambda name, *args: commands.job_actions(jobs, ids, *args).withColumnRenamed("outcome", name)
    return act("retry", True).join(act("cancel", False), "id").join(act("forced", False, True), "id")


@query("""select o_orderkey as id, case when o_orderkey % 4 = 0 then 'Own' when o_orderkey % 4 = 1 then 'Notice' when o_orderkey % 4 = 2 then 'Channel' end as business_type, case when o_orderkey % 4 = 0 then 1 when o_orderkey % 4 in (1, 2) then o_custkey end as business_id from orders""")
def business_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM15: a job's business object from its payload, by the first path with a value, where it lacks one."""
    n, c = F.col("id"), F.col("o_custkey")
    payload = F.when(n % 4 == 1, F.concat(F.lit('{"noticeId":"'), c, F.lit('","channelId":5}'))).when(n % 4 == 2, F.concat(F.lit('{"in":{"channelId":'), c, F.lit("}}"))).otherwise(F.lit('{"x":1}'))
    jobs = _orders(spark, sf_dir).select("id", F.when(n % 4 == 0, "Own").alias("business_type"), F.when(n % 4 == 0, 1).cast("long").alias("business_id"), payload.alias("payload"))
    return commands.business_links(jobs, {"Notice": "$.noticeId", "Channel": "$.in.channelId"}).select("id", "business_type", "business_id")


@query("""with r as (select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'A') as awarded, cast(sum(case when l_returnflag <> 'N' then cast(l_extendedprice as decimal(18,2)) end) as double) as total, max((l_shipdate, l_orderkey, l_linenumber, l_partkey)) as m from lineitem where l_quantity > 1 group by 1)
select l_suppkey, n, awarded, total, cast(m[1] as timestamp) as last_time, m[4] as last_part from r order by coalesce(total, 0) > 0 desc, coalesce(total, 0) desc, awarded desc, n desc, l_suppkey limit 50""".replace("max((l_shipdate, l_orderkey, l_linenumber, l_partkey))", "max(row(l_shipdate, l_orderkey, l_linenumber, l_partkey))").replace("m[1]", "struct_extract(m, 1)").replace("m[4]", "struct_extract(m, 4)"))
def latest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10: per supplier counts, sum and the latest row itself, from one partial aggregation; the top 50."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 1")
    latest = A.latest_by(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], ["l_shipdate", "l_partkey"]).select("l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("last_time"), F.col("l_partkey").alias("last_part"))
    sums = rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("awarded"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice").cast("decimal(18,2)"))).cast("double").alias("total"))
    total = F.coalesce("total", F.lit(0.0))
    return sums.join(latest, "l_suppkey").select("l_suppkey", "n", "awarded", "total", "last_time", "last_part").orderBy((total > 0).desc(), total.desc(), F.desc("awarded"), F.desc("n"), "l_suppkey").limit(50)


EVIDENCE = """with q as (select p_partkey, p_partkey % 10 as s, 'T' || p_partkey % 7 as need from part), d as (select o_orderkey as id, o_custkey % 10 as s, 'Type T' || o_orderkey % 9 as name, case o_orderstatus when 'F' then 'Expired' when 'O' then 'Valid' else 'ExpiringSoon' end as st, o_orderdate as t from orders),
m as (select p_partkey, st, t, id, row_number() over (partition by p_partkey order by st = 'Valid' desc, t desc, id) as n from q join d on q.s = d.s and contains(lower(d.name), lower(q.need)))
select q.p_partkey, m.id as document_id, case when m.id is null then 'Missing' when st = 'Expired' or t < timestamp '1998-07-01' then 'Expired' when st = 'ExpiringSoon' or t <= timestamp '1998-07-31' then 'ExpiringSoon' else 'Valid' end as state from q left join m on m.p_partkey = q.p_partkey and n = 1"""


@query(EVIDENCE)
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, DA2: the best document of each requirement, and whether it is missing, expired or about to expire."""
    k = F.col("p_partkey")
    needs = table(spark, sf_dir, "part").select(k, (k % 10).alias("s"), F.concat(F.lit("T"), k % 7).alias("required_type"))
    docs = _orders(spark, sf_dir).select((F.col("o_custkey") % 10).alias("s"), F.col("id").alias("document_id"), F.lit("").alias("document_type"), F.concat(F.lit("Type T"), F.col("id") % 9).alias("document_name"), _status("Expired", "Valid", "ExpiringSoon").alias("status"), F.col("day").alias("valid_to"))
    out = scoring.evidence_checks(needs, docs, ["s"], F.lit("1998-07-01").cast("timestamp_ntz"))
    return out.select("p_partkey", "document_id", "state")


@query("""with a as (select l_orderkey, min(case when l_linenumber > 2 and l_tax > 0 then round(l_tax, 2) end) as lo1, max(case when l_linenumber > 2 and l_tax > 0 then round(l_tax, 2) end) as hi1, min(case when l_discount > 0 then round(l_discount, 2) end) as lo2, max(case when l_discount > 0 then round(l_discount, 2) end) as hi2, min(l_quantity) as lo3, max(l_quantity) as hi3 from lineitem group by 1)
select l_orderkey, case when lo1 = hi1 then lo1 when lo2 = hi2 then lo2 when lo3 = hi3 then lo3 end::double as amount, case when lo1 = hi1 then 'a' when lo2 = hi2 then 'l_discount' when lo3 = hi3 then 'l_quantity' end as source from a""")
def resolved_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: of several columns in order, the first with one distinct positive amount in the group."""
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.when(F.col("l_linenumber") > 2, F.col("l_tax")))
    return scoring.resolved_amounts(rows, "l_orderkey", ["a", "l_discount", "l_quantity"]).withColumn("amount", F.col("amount").cast("double"))


@query("""select cast(row_number() over (order by lower(trim(o_orderpriority)) desc, o_orderdate desc, o_totalprice, o_orderkey) as int) as place, o_orderkey from orders order by place limit 200""")
def text_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7: by cleaned text without case, then three tie-breakers and the key: the first 200."""
    shown = text.clean_value(F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit("　")))
    order = [F.lower(shown).desc(), F.desc("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey")]
    top = table(spark, sf_dir, "orders").orderBy(*order).limit(200).withColumn("all", F.lit(1))
    return A.ranked(top, ["all"], order, "place").select("place", "o_orderkey")


@query("""select o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ';' order by o_orderkey) as own from orders group by 1""")
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: the rows of each key as an ordered list."""
    own = F.array_sort(F.collect_list(F.struct("id", "o_orderstatus")))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(F.transform(own, lambda r: F.concat_ws(":", r["id"], r["o_orderstatus"])), ";").alias("own"))


@query("""with r as (select o_orderkey as id, o_orderkey % 6 as m, cast(o_totalprice as decimal(18,2)) as p from orders)
select id, case m when 1 then 'AmbiguousAmountUnit' when 2 then 'RateOrDiscountInAmountColumn' when 4 then 'AmbiguousAmountUnit' end as issue_type, case m when 1 then 'budget' when 2 then 'ceiling' when 4 then 'budget' end as field, case m when 1 then '预算金额（万元）' when 2 then '折扣率' when 4 then '预算' end as header from r where m in (1, 2, 4)""")
def unit_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA10: cells of original rows that show an amount left in ten thousands or a rate in an amount field."""
    n = F.col("id")
    p = F.col("o_totalprice").cast("decimal(18,2)")
    cell = lambda h, t: F.to_json(F.create_map(F.lit(h), t, F.lit("备注"), F.lit("无")))
    shown = F.get(F.array(cell("预算金额（元）", p.cast("string")), cell("预算金额（万元）", F.format_number(p, 2)), cell("折扣率", F.lit("97.5%")), cell("预算金额（万元）", (p / 10000).cast("decimal(18,6)").cast("string")), cell("预算", F.concat(p.cast("string"), F.lit("万元"))), F.lit("no json")), (n % 6).cast("int"))
    rows = _orders(spark, sf_dir).select("id", shown.alias("cells"), p.alias("budget"), F.lit(97.5).alias("ceiling"))
    return scoring.unit_suspects(rows, "id", "cells", ["budget", "ceiling"])


@query("""with r as (select o_orderkey as id, o_orderkey % 2 = 0 as pk, o_orderkey % 3 = 0 as lot, o_orderkey % 5 > 0 as ev, o_orderstatus as s from orders),
p as (select id, 35 + case when pk then 15 else 0 end + case when lot then 30 else 0 end + case when ev then 10 else 0 end + 10 as c,
case when not ev then 20 else least(100, 15 + 5 + 5 + 30 + case when pk then 20 else 12 end + case when lot then 35 else 0 end) end as e, case s when 'F' then 100 when 'O' then 60 else 20 end as t from r)
select id, c as completeness, e as evidence, cast(least(10000, c * 45 + e * 30 + t * 25) // 100 as int) as strength from p""")
def extract_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA12: completeness, evidence and trust of extracted rows, and their strength in whole numbers."""
    n = F.col("id")
    pk, lot = F.when(n % 2 == 0, F.lit("5")), F.when(n % 3 == 0, F.lit("L-77"))
    name = F.concat(F.lit("S"), F.col("o_custkey"), F.lit("电力有限公司"))
    full = F.concat(F.lit("包"), F.coalesce(pk, F.lit("一")), F.lit(" 中标人 "), name, F.lit(" 分标 "), F.coalesce(lot, F.lit("")), F.lit(" 变电设备" ), F.lit("。"))
    ev = F.when(n % 5 > 0, full)
    lot_name = F.when(n % 3 == 0, F.lit("变电设备"))
    c = scoring.completeness(name, F.lit("Awarded"), pk, F.lit(None).cast("string"), lot, lot_name, ev, F.lit(True), F.lit(True))
    e = scoring.evidence_points(ev, F.when(n % 5 > 0, F.lit("row")), F.lit(True), name, pk, lot, lot_name, F.lit(True))
    rows = _orders(spark, sf_dir).select("id", c.alias("completeness"), e.alias("evidence"), _status("100", "60", "20").cast("int").alias("trust"))
    return rows.select("id", "completeness", "evidence", scoring.strength(F.col("completeness"), F.col("evidence"), F.col("trust")).alias("strength"))


@query("""select o_orderkey as id, case when o_orderkey % 7 = 0 then 'NotPending' when o_orderkey % 5 = 0 then 'SupplierMissing' when o_orderkey % 3 = 0 then 'ProjectCodeMissing' when o_orderkey % 11 = 0 then 'PackageNoMissing' when o_totalprice < 50000 then 'AmountMissing' when o_orderkey % 2 = 0 then 'ScoreTooLow' end as refusal from orders""")
def confirm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA8: why links can't be confirmed by themselves, the first reason that holds."""
    n = F.col("id")
    blank = lambda m: F.when(n % m == 0, F.lit(" ")).otherwise(F.lit("x"))
    amount = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice").cast("decimal(18,2)"))
    why = linkage.confirm_refusal(F.when(n % 2 == 1, 0.85).otherwise(0.8499), F.when(n % 7 == 0, "Confirmed").otherwise("Pending"), blank(5), blank(3), blank(11), amount)
    return _orders(spark, sf_dir).select("id", why.alias("refusal"))


@query("""with n as (select c_custkey as k, c_name as name, 'new' || c_custkey as contact from customer where c_custkey % 3 > 0), o as (select c_custkey as k, case when c_custkey % 4 > 0 then 'old' end as name, case when c_custkey % 5 > 0 then 'was' end as contact from customer where c_custkey % 2 = 0)
select coalesce(o.k, n.k) as k, coalesce(o.name, n.name) as name, coalesce(n.contact, o.contact) as contact from o full join n on o.k = n.k""")
def master_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA14: master data after a load: names are filled in, contacts follow the load."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    old = rows.filter("c_custkey % 2 = 0").select(k.alias("k"), F.when(k % 4 > 0, F.lit("old")).alias("name"), F.when(k % 5 > 0, F.lit("was")).alias("contact"))
    new = rows.filter("c_custkey % 3 > 0").select(k.alias("k"), F.col("c_name").alias("name"), F.concat(F.lit("new"), k).alias("contact"))
    return merging.fill_or_update(old, new, "k", ["name"], ["contact"])


@query("""select count(*) as opportunities, count(*) filter (o_orderdate <= timestamp '1998-01-08') as risks, count(*) filter (o_orderdate < timestamp '1998-01-01') as overdue, count(*) filter (o_orderdate >= timestamp '1998-01-01' and o_orderdate <= timestamp '1998-01-04') as urgent,
count(*) filter (o_orderkey % 3 = 0 and (o_orderkey % 5 = 0 or o_orderdate <= timestamp '1998-01-08')) as watched, count(*) filter (o_orderdate < timestamp '1997-12-18') as stale from orders where o_orderstatus = 'O'""")
def maintenance_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA4: deadline, watch and stale scans of active opportunities, in one pass."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    rows = _orders(spark, sf_dir).filter("o_orderstatus = 'O'")
    return scoring.maintenance(rows, "day", "day", (F.col("id") % 3 == 0), (F.col("id") % 5 == 0), now, 7, 14)


CLOSURES = """with k as (select o_orderkey as id, cast(o_custkey % 20 + 1 as varchar) as package_no, 'L' || o_orderkey % 2 as lot_no, case when o_orderkey % 5 > 0 then 'PC' || o_custkey end as code, 'S' || o_orderkey % 3 || '电力有限公司' as supplier, o_orderkey % 3 as sup, o_orderkey, o_orderstatus as s, cast(o_totalprice as decimal(18,2)) as p, 'project number ' || o_custkey as name, o_orderkey % 4 as m from orders),
a as (select * from k where s = 'F'), c as (select * from k where s = 'O' and o_orderkey % 2 = 0), t as (select * from k where s = 'O' and o_orderkey % 2 = 1),
mc as (select a.id, c.id as cid, c.p as quote, c.m as rank, row_number() over (partition by a.id order by c.id) as n from a join c on a.package_no = c.package_no and a.code = c.code and a.lot_no = c.lot_no and a.sup = c.sup),
mt as (select a.id, t.id as tid, t.p as ceiling, row_number() over (partition by a.id order by t.id) as n from a join t on a.package_no = t.package_no and a.code = t.code where a.m <> 9),
j as (select a.id, cid, tid, quote, rank, ceiling, case when a.m = 0 then a.p end as award from a left join mc on mc.id = a.id and mc.n = 1 left join mt on mt.id = a.id and mt.n = 1)
select id as award_id, cid as candidate_id, tid as tender_id, (case when award is not null then award when cid is not null then quote when tid is not null then ceiling end)::double as amount,
case when award is not null then 'DirectAwardAmount' when cid is not null then 'CandidateFinalQuote' when tid is not null then 'DefaultedFromProcurementPackageAmount' else 'Unknown' end as kind,
concat_ws(',', case when cid is null then 'Candidate' end, case when tid is null then 'Tender' end, case when award is null and cid is null and tid is null then 'Amount' end) as missing,
round((case when cid is null then 0 else 1 end + case when tid is null then 0 else 1 end + case when award is not null then 0.98 when cid is not null then case when rank = 1 then 0.95 else 0.88 end when tid is not null then 0.72 else 0 end) / 3, 4)::double as confidence,
case when award is not null then false when cid is not null then rank <> 1 else true end or cid is null or tid is null as needs_review from j"""


@query(CLOSURES)
def package_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12, DA7: awards with their candidate (lot, supplier and project) and tender, the price that follows, what is missing, and whether to review."""
    n, c = F.col("id"), F.col("o_custkey")
    rows = _orders(spark, sf_dir).select(
        "id", (c % 20 + 1).cast("string").alias("package_no"), F.concat(F.lit("L"), n % 2).alias("lot_no"), F.lit("").alias("lot_name"), F.when(n % 5 > 0, F.concat(F.lit("pc "), c)).alias("project_code"), F.lit("").alias("project_name"),
        F.concat(F.lit("S"), n % 3, F.lit("电力有限公司")).alias("supplier"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"), "o_orderstatus",
    )
    keys = ["package_no", "lot_no", "lot_name", "project_code", "project_name", "supplier"]
    none = F.lit(None)
    awards = rows.filter("o_orderstatus = 'F'").select(n.alias("award_id"), *keys, F.when(n % 4 == 0, F.col("p")).alias("amount"), none.cast("string").alias("rate_type"), none.cast("decimal(18,6)").alias("rate_value"))
    candidates = rows.filter("o_orderstatus = 'O' and id % 2 = 0").select(n.alias("candidate_id"), *keys, (n % 4).cast("int").alias("rank"), F.col("p").alias("quote"))
    tenders = rows.filter("o_orderstatus = 'O' and id % 2 = 1").withColumn("lot_no", F.lit("")).select(n.alias("tender_id"), *keys, none.cast("decimal(18,2)").alias("guide"), F.col("p").alias("ceiling"), none.cast("decimal(18,2)").alias("budget"))
    out = linkage.closures(awards, candidates, tenders)
    return out.select("award_id", "candidate_id", "tender_id", F.col("decision.amount").cast("double").alias("amount"), F.col("decision.kind").alias("kind"), F.array_join("missing", ",").alias("missing"), "confidence", "needs_review")


@query("""with k as (select o_orderkey as id, o_orderkey % 4 as m, o_orderkey % 3 as n, o_orderkey % 5 as g, o_orderstatus as s from orders),
t as (select id, case when m < 2 then 45 else 0 end as c, case when n < 2 then 25 else 0 end as a, case when g < 3 then 15 else 0 end as p, case s when 'F' then 15 when 'O' then 12 else 0 end as e from k)
select id, (least(100, c + a + p + e) / 100.0)::double as confidence, (c > 0)::int + (a > 0)::int + (p > 0)::int + (e > 0)::int as n_reasons, c + a + p + e = 0 as missing from t""")
def notice_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA6, SC18, SC21: the second notice score, from the text: code, like name, package number and kind, with reasons."""
    n, c = F.col("id"), F.col("o_custkey")
    digits = F.lpad((n % 10000).cast("string"), 4, "0")
    code, name = F.concat(F.lit("PC"), digits), F.concat(F.lit("变电站改造工程"), digits)
    t = F.concat(
        F.when(n % 4 == 0, F.concat(F.lit("项目编号：pc"), digits, F.lit("-7\n"))).when(n % 4 == 1, F.concat(F.lit("招标编号: PC"), digits, F.lit("\n"))).otherwise(F.lit("项目编号：无\n")),
        F.lit("项目名称："), F.when(n % 3 == 0, name).when(n % 3 == 1, F.concat(name, F.lit("（二）"))).otherwise(F.lit("道路养护")), F.lit("\n"), F.when(n % 5 < 3, F.concat(F.lit("包"), c)).otherwise(F.lit("无")),
    )
    rows = _orders(spark, sf_dir).select("id", t.alias("t"), code.alias("code"), name.alias("name"), F.concat(F.lit("包"), c).alias("package"), "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "F", "Candidate").when(F.col("o_orderstatus") == "O", "Tender")
    m = scoring.notice_text_match(codes.extract_project_code(F.col("t")) == F.col("code"), text.similarity(codes.extract_project_name(F.col("t")), F.col("name")), F.contains("t", "package"), kind)
    return rows.select("id", m.alias("m")).select("id", F.col("m.confidence").cast("double").alias("confidence"), F.size("m.reasons").alias("n_reasons"), F.col("m.missing").isNotNull().alias("missing"))


@query("""with r as (select l_orderkey as g, l_returnflag as o, 'Sup' || l_suppkey % 12 as s, case when l_partkey % 3 = 0 then 'L' || l_partkey end as lot, case when l_orderkey % 5 > 0 then 'P' end as pk, l_linenumber * 1000000 + l_partkey as id, l_extendedprice as x from lineitem),
one as (select * from (select *, row_number() over (partition by g, o, s order by lot is not null desc, x, id) as n from r) where n = 1)
select g, o, s, lot from one a where pk is null or lot is not null or not exists (select 1 from one b where b.g = a.g and b.o = a.o and b.lot is not null)""")
def specific_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA13: one row a supplier of a package and outcome, without those that a row with a lot makes idle."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("g"), c("l_returnflag").alias("o"), F.concat(F.lit("Sup"), c("l_suppkey") % 12).alias("s"), F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("L"), c("l_partkey"))).alias("lot"), F.lit(None).cast("string").alias("lot_name"),
        F.when(c("l_orderkey") % 5 > 0, "P").alias("pk"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("id"), c("l_extendedprice").alias("x"),
    )
    return merging.less_specific_pruned(rows, ["g", "o"], "pk", "s", "lot", "lot_name", [c("x"), c("id")]).select("g", "o", "s", "lot")


@query("""select 'jobs' as metric, count(*) as n from orders union all select 'running', count(*) from orders where o_orderstatus = 'O' union all select 'dead', count(*) from orders where o_orderstatus = 'P' union all select 'created_today', count(*) from orders where o_orderdate >= timestamp '1998-01-01'
union all select 'fetched_today', count(*) from events where ts >= timestamp '2024-01-15' union all select 'failed_notices', count(*) from events where event_type = 'error' union all select 'pending_files', count(*) from lineitem where l_linestatus = 'O' or l_returnflag = 'N' union all select 'failed_files', count(*) from lineitem where l_returnflag = 'R'
union all select 'recent_failed_' || row_number() over (order by o_orderdate desc, o_orderkey), o_orderkey from (select * from orders where o_orderstatus = 'P' order by o_orderdate desc, o_orderkey limit 8)""")
def operations_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA17: the operations half: one multi-aggregate a table, and the eight last failed jobs."""
    jobs, events, files = _orders(spark, sf_dir), _events(spark, sf_dir), table(spark, sf_dir, "lineitem")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    frames = [
        jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("running"), F.count_if(F.col("o_orderstatus") == "P").alias("dead"), F.count_if(F.col("day") >= at("1998-01-01")).alias("created_today")),
        events.agg(F.count_if(F.col("ts") >= at("2024-01-15")).alias("fetched_today"), F.count_if(F.col("event_type") == "error").alias("failed_notices")),
        files.agg(F.count_if((F.col("l_linestatus") == "O") | (F.col("l_returnflag") == "N")).alias("pending_files"), F.count_if(F.col("l_returnflag") == "R").alias("failed_files")),
    ]
    last = jobs.filter("o_orderstatus = 'P'").orderBy(F.desc("day"), "id").limit(8).withColumn("all", F.lit(1))
    out = A.ranked(last, ["all"], [F.desc("day"), F.col("id")], "place").select(F.concat(F.lit("recent_failed_"), "place").alias("metric"), F.col("id").alias("n"))
    for df in frames:
        out = out.unionByName(df.unpivot([], df.columns, "metric", "n"))
    return out


@query("""with recursive l as (select l_orderkey as g, l_linenumber as line, l_quantity as q, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem),
r as (select g, n, [line] as kept, [n] as places from l where n = 1
union all select l.g, l.n, case when list_any_value(list_filter(r.kept, lambda k: abs(k - l.line) <= 1)) is null then list_append(r.kept, l.line) else r.kept end,
  case when list_any_value(list_filter(r.kept, lambda k: abs(k - l.line) <= 1)) is null then list_append(r.places, l.n) else r.places end from r join l on l.g = r.g and l.n = r.n + 1),
w as (select g, max_by(places, n) as places from r group by g)
select g, unnest(places) as place from w""")
def uncovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA13: the sequential pass: in order of quantity, lines that no line kept before them stands next to; in rounds over all orders."""
    order = [F.desc("l_quantity"), *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]]
    rows = A.ranked(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "place").select(F.col("l_orderkey").alias("g"), "place", F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "place").alias("key"))
    next_to = F.abs(F.col("line_a") - F.col("line_b")) <= 1
    return merging.greedy_uncovered(rows, ["g"], "key", [F.col("place")], next_to).select("g", "place")


@query("""with p as (select o_orderkey, case when o_orderstatus = 'F' then (select max(o_orderkey) from orders) + row_number() over (partition by o_orderstatus = 'F' order by o_orderdate, o_orderkey) else o_orderkey end as id, coalesce(case when o_orderpriority <> '5-LOW' then o_orderpriority end, 'none') as note from orders)
select p.id, note, count(l_orderkey) as n, sum(case when l_orderkey is not null then l_linenumber else 0 end)::bigint as lines from p left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def numbered_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: a batch to insert: gapless ids for the rows without one, defaults for nulls, ids filled into the children."""
    c = F.col
    orders = table(spark, sf_dir, "orders")
    batch = orders.select(F.when(c("o_orderstatus") != "F", c("o_orderkey")).alias("id"), c("o_orderkey").alias("ref"), "o_orderdate", F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).alias("note"))
    last = orders.agg(F.max("o_orderkey")).first()[0] or 0
    rows = numbering.for_insert(batch, "id", last, {"note": F.lit("none")}, "ignore", [c("o_orderdate"), c("ref")])
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("ref"), F.lit(None).cast("long").alias("order_id"), "l_linenumber")
    each = numbering.back_filled(lines, rows, "ref", "id", "order_id").groupBy(c("order_id").alias("id")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
    return rows.join(each, "id", "left").select("id", "note", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lines", F.lit(0)).alias("lines"))
