"""Dashboards, pipeline states, linkage and text functions over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, codes, text
from ..operators import analytics as A
from ..operators import linkage
from ..session import table
from ..streaming import commands, ingest
from .registry import query


@query("""select o.o_orderkey, 'Received' as s1, case when l.n is not null then 'Done' else 'Pending' end as s2, case when l.n is null then 'Waiting' when l.open > 0 then 'Pending' else 'Done' end as s3,
case when o.o_orderstatus = 'F' then 'Done' when o.o_orderstatus = 'P' then 'Failed' else 'Pending' end as s4,
case when l.n is null then 2 when l.open > 0 then 3 when o.o_orderstatus <> 'F' then 4 else 5 end as step
from orders o left join (select l_orderkey, count(*) as n, count(*) filter (l_linestatus = 'O') as open from lineitem group by 1) l on l.l_orderkey = o.o_orderkey""")
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA16: where each order stands, step by step."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    none, open_, done = F.col("n").isNull(), F.col("open") > 0, F.col("o_orderstatus") == "F"
    return rows.select(
        "o_orderkey",
        F.lit("Received").alias("s1"),
        F.when(none, "Pending").otherwise("Done").alias("s2"),
        classify.ladder([(none, "Waiting"), (open_, "Pending")], "Done").alias("s3"),
        classify.ladder([(done, "Done"), (F.col("o_orderstatus") == "P", "Failed")], "Pending").alias("s4"),
        classify.ladder([(none, 2), (open_, 3), (~done, 4)], 5).alias("step"),
    )


@query("""select 'orders' as metric, count(*) as n from orders union all select 'open_orders', count(*) from orders where o_orderstatus = 'O' union all select 'high_value', count(*) from orders where o_totalprice >= 250000
union all select 'customers', count(*) from customer union all select 'active_customers', count(distinct o_custkey) from orders union all select 'errors', count(*) from events where event_type = 'error'
union all select 'error_users', count(distinct user_id) from events where event_type = 'error'""")
def business_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA17: one multi-aggregate a table, unpivoted."""
    orders = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_totalprice") >= 250000).alias("high_value"), F.countDistinct("o_custkey").alias("active_customers")
    )
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))
    error = F.col("event_type") == "error"
    events = table(spark, sf_dir, "events").agg(F.count_if(error).alias("errors"), F.countDistinct(F.when(error, F.col("user_id"))).alias("error_users"))
    out = None
    for df in (orders, customers, events):
        part = df.unpivot([], df.columns, "metric", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""select e.user_id, count(*) as n, cast(max(date_diff('millisecond', e.ts, p.ts)) as bigint) as longest_ms from events e join (select user_id, max(ts) as ts from events group by 1) p using (user_id)
where e.event_type = 'click' group by 1""")
def wait_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC35: milliseconds from clicks to the user's last event."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("end"))
    waits = events.filter("event_type = 'click'").join(last, "user_id").withColumn("ms", classify.millis_between(F.col("ts"), F.col("end")))
    return waits.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ms").alias("longest_ms"))


@query("""select p_partkey, upper(replace(p_name, ' ', '')) as comparable, case when p_brand like '%1' then 'Brand ends in 1' else coalesce(nullif(trim(p_type), ''), 'Other') end as shown, left(p_name, 6) as short from part""")
def cleaned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC2, SC23, PRJ5: cleaned, shortened, comparable and derived columns."""
    shown = F.when(F.col("p_brand").endswith("1"), "Brand ends in 1").when(~text.is_blank(F.col("p_type")), text.clean_value(F.col("p_type"))).otherwise("Other")
    return table(spark, sf_dir, "part").select("p_partkey", text.comparable(F.col("p_name")).alias("comparable"), shown.alias("shown"), text.clean_and_truncate(F.col("p_name"), 6).alias("short"))


@query("select c_custkey, ltrim(regexp_extract(c_name, '(\\d+)', 1), '0') as number, upper(regexp_replace(c_name, '[\\s#\\-]', '', 'g')) as key from customer where ltrim(regexp_extract(c_name, '(\\d+)', 1), '0') <> ''")
def normalized_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6, SC17: numbers without leading zeros, names as match keys."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", codes.normalize_package_no(F.col("c_name")).alias("number"), F.regexp_replace(codes.org_match_key(F.col("c_name")), "#", "").alias("key"))
    return rows.filter("number rlike '^[1-9]'")


@query("""select p_partkey, word from (select p_partkey, unnest(list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 2))) as word from part)""")
def name_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24: keywords of names (they have fewer than eight)."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.keywords(F.col("p_name"))).alias("word"))


@query("""select event_type, least(3600.0, 30.0 * power(2.0, (event_id % 9))) as seconds, count(*) as n from events where event_type = 'error' group by 1, 2""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC41, SG8: waiting time by attempt."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    seconds = classify.backoff_seconds(F.col("event_id") % 9 + 1, 30, 3600)
    return rows.groupBy("event_type", seconds.alias("seconds")).agg(F.count("*").alias("n"))


@query("""with a as (select o_orderkey as award_id, o_custkey as package_no, o_orderpriority as project from orders where o_orderstatus = 'F'),
t as (select o_orderkey as tender_id, o_custkey as package_no, o_orderpriority as project from orders where o_orderstatus = 'O'),
r as (select award_id, tender_id, row_number() over (partition by award_id order by tender_id) as n from a join t using (package_no, project)) select award_id, tender_id from r where n = 1""")
def award_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12, JN13, DA7: the tender of each award, by package, lot and project."""
    orders = table(spark, sf_dir, "orders")
    blank = F.lit("")
    keys = [F.col("o_custkey").cast("string").alias("package_no"), blank.alias("lot_no"), blank.alias("lot_name"), F.col("o_orderpriority").alias("project_code"), blank.alias("project_name")]
    awards = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("award_id"), *keys)
    tenders = orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("tender_id"), *keys)
    return linkage.link(awards, tenders, "award_id", "tender_id", False).select("award_id", F.col("o_tender_id").alias("tender_id"))


@query("""with p as (select floor(p_retailprice) as price, count(*) as n from part group by 1)
select event_id, case when n = 1 then 'ok' when n > 1 then 'conflict' else 'missing' end as package from events left join p on price = 900 + user_id""")
def package_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19: one match is fine, several conflict, none is missing."""
    part = table(spark, sf_dir, "part").groupBy((F.floor("p_retailprice") - 900).alias("user_id")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id").join(part, "user_id", "left")
    return rows.select("event_id", classify.ladder([(F.col("n") == 1, "ok"), (F.col("n") > 1, "conflict")], "missing").alias("package"))


@query("""with u as (select c_custkey as user_id, c_nationkey % 5 as tenant_id, c_custkey % 97 = 0 as is_admin from customer), r as (select c_custkey as user_id, c_custkey % 3 as role_id from customer),
g as (select n_nationkey % 3 as role_id, n_name as permission from nation), e as (select n_regionkey as tenant_id, n_name as permission from nation)
select u.user_id, e.permission from u join r using (user_id) join g using (role_id) join e on e.tenant_id = u.tenant_id and e.permission = g.permission union select u.user_id, e.permission from u join e using (tenant_id) where is_admin union select user_id, 'self' from u""")
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM16: role grants within entitlements, administrators and self."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    users = customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 5).alias("tenant_id"), (F.col("c_custkey") % 97 == 0).alias("is_admin"))
    roles = customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).alias("role_id"))
    grants = nation.select((F.col("n_nationkey") % 3).alias("role_id"), F.col("n_name").alias("permission"))
    return commands.effective_permissions(users, roles, grants, nation.select(F.col("n_regionkey").alias("tenant_id"), F.col("n_name").alias("permission")))


@query("""select c_custkey, case when o_custkey is null then 'Missing' when b > 0 then 'Done' else 'Skipped' end as outcome from (select c_custkey, o.o_custkey, o.b from customer left join
(select o_custkey, count(*) filter (o_orderstatus = 'P') as b from orders group by 1) o on o.o_custkey = c_custkey)""")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM8, CM10: the outcome of a batch command for each id."""
    has = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, "Pending").otherwise("Closed").alias("status"))
    return commands.moved(has, table(spark, sf_dir, "customer"), "c_custkey", ["Pending"], "Confirmed").select("c_custkey", "outcome")


@query("select distinct on (user_id) user_id, event_id, event_type from events order by user_id, event_id desc")
def last_command_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM17: the last of each key."""
    return commands.last_wins(table(spark, sf_dir, "events").withColumn("ordinal", F.col("event_id")), "user_id").select("user_id", "event_id", "event_type")


@query("select event_id, event_type from events where ts >= timestamp '2024-01-30' - interval 7 days")
def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG11: what a retention of a week leaves."""
    return ingest.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 7).select("event_id", "event_type")


@query("""with d as (select o_orderkey as id, o_totalprice as v from orders where o_orderpriority <> '5-LOW'), o as (select o_orderkey as id, o_totalprice - 1 as v, o_orderstatus = 'F' as confirmed from orders)
select id, v from o where confirmed union all select id, v from d where id not in (select id from o where confirmed)""")
def refreshed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG14: confirmed rows stay, the others give way to the drafts."""
    orders = table(spark, sf_dir, "orders")
    old = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") - 1).alias("v"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    drafts = orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(False).alias("confirmed"))
    return ingest.refreshed_links(old, drafts, "id", "confirmed").select("id", "v")


@query("select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2")
def histogram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: histograms as rows."""
    return A.tagged_buckets(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), {"x": F.concat_ws(":", "l_suppkey", "l_returnflag")}).select(
        F.split_part("label", F.lit(":"), F.lit(1)).cast("long").alias("l_suppkey"), F.split_part("label", F.lit(":"), F.lit(2)).alias("l_returnflag"), "n"
    )
