"""Aggregates, windows, sorts, joins and set operations over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import due_state, ladder
from ..operators import analytics as A
from ..operators import joins as J
from ..session import table
from .registry import query

MONEY = "decimal(18,4)"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("""with o as (select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as returned, count(*) filter (l_linestatus = 'O') as open,
  count(distinct l_partkey) as parts, cast(coalesce(sum(cast(l_extendedprice as decimal(18,4))), 0) as double) as total,
  cast(max(cast(l_extendedprice as decimal(18,4))) as double) as largest, max(l_shipdate) as last_ship from lineitem where l_quantity > 0 group by l_suppkey)
select s_suppkey, s_name, n, returned, open, parts, total, largest, last_ship from o join supplier on s_suppkey = l_suppkey order by n desc, s_suppkey limit 50""")
def supplier_outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, AG11, ST1: one pass over the lines, then the names."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    money = F.col("l_extendedprice").cast(MONEY)
    out = lines.groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("open"),
        F.countDistinct("l_partkey").alias("parts"),
        F.coalesce(F.sum(money), F.lit(0)).cast("double").alias("total"),
        F.max(money).cast("double").alias("largest"),
        F.max("l_shipdate").alias("last_ship"),
    )
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = out.join(names, out.l_suppkey == names.s_suppkey).orderBy(F.desc("n"), "s_suppkey").limit(50)
    return joined.select("s_suppkey", "s_name", "n", "returned", "open", "parts", "total", "largest", "last_ship")


@query("select event_type, count(*) as n from events group by event_type")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG2: counts by key."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n from events where event_type = 'error' group by user_id order by n desc, user_id limit 20")
def queue_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2: the 20 largest groups."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("""select count(*) as n, count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'O' and starts_with(o_orderpriority, '1')) as urgent_open,
count(*) filter (o_totalprice >= 200000) as large, count(*) filter (o_orderdate >= timestamp '1999-12-31' and o_orderdate < timestamp '2000-01-01') as last_day from orders""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3: many conditions, one scan."""
    day = F.lit("1999-12-31").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.count_if((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")).alias("urgent_open"),
        F.count_if(F.col("o_totalprice") >= 200000).alias("large"),
        F.count_if((F.col("o_orderdate") >= day) & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))).alias("last_day"),
    )


@query("""select min(label) as label, count(*) as n from (select case when trim(coalesce(p_brand, '')) = '' then 'Unknown' else trim(p_brand) end as label from part)
group by lower(label) order by n desc, lower(min(label)) limit 10""")
def bucket_topn_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4: top buckets, labels without case."""
    return A.bucket_top(table(spark, sf_dir, "part"), F.col("p_brand"), 10)


@query("""select 'status' as tag, o_orderstatus as label, count(*) as n from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2
union all select 'year', cast(year(o_orderdate) as varchar), count(*) from orders group by 2
union all select 'band', case when o_totalprice >= 250000 then 'high' when o_totalprice >= 100000 then 'middle' end as b, count(*) from orders where o_totalprice >= 100000 group by 2""")
def tagged_bucketings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: four bucketings of the same rows in one aggregate."""
    return A.tagged_buckets(
        table(spark, sf_dir, "orders"),
        {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "band": F.when(F.col("o_totalprice") >= 250000, "high").when(F.col("o_totalprice") >= 100000, "middle")},
    )


@query("""with c as (select o_orderstatus as label, count(*) as n from orders group by 1), d as (select * from (values (0, 'O'), (1, 'F'), (2, 'X')) as v(position, label))
select position, d.label, coalesce(n, 0) as n from d left join c using (label)
union all select 2 + row_number() over (order by n desc, label), label, n from c where label not in ('O', 'F', 'X')""")
def stage_funnel_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: fixed stages with zeros, others after them."""
    return A.zero_filled(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), ["O", "F", "X"], extra=True)


@query("""with c as (select case when o_totalprice is null then 'Unknown' when o_totalprice >= 250000 then 'High' when o_totalprice >= 100000 then 'Medium' else 'Low' end as label, count(*) as n from orders group by 1)
select position, d.label, coalesce(n, 0) as n from (values (0, 'High'), (1, 'Medium'), (2, 'Low'), (3, 'Unknown')) as d(position, label) left join c using (label)""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: a distribution over a fixed list."""
    p = F.col("o_totalprice")
    level = ladder([(p.isNull(), "Unknown"), (p >= 250000, "High"), (p >= 100000, "Medium")], "Low")
    return A.zero_filled(table(spark, sf_dir, "orders"), level, ["High", "Medium", "Low", "Unknown"])


@query("""select o_orderpriority, cast(round_even(coalesce(count(*) filter (o_orderstatus = 'F') * cast(100 as decimal(18,4)) / nullif(count(*), 0), 0), 2) as double) as done_percent,
round(coalesce(avg(greatest(0, o_totalprice - 100000)), 0), 2) as mean_above from orders group by 1""")
def ratio_and_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, AG9, DA19: guarded ratio and clamped mean."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        A.ratio_percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).cast("double").alias("done_percent"),
        F.round(F.coalesce(F.avg(F.greatest(F.lit(0.0), F.col("o_totalprice") - 100000)), F.lit(0.0)), 2).alias("mean_above"),
    )


@query("select p_brand, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem join part on p_partkey = l_partkey group by p_brand")
def distinct_suppliers_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11, AG12: pairs first, so that each supplier of a part counts once before the join."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("k"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return pairs.join(part, pairs.l_partkey == part.p_partkey).groupBy("p_brand").agg(F.sum("k").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""select l_orderkey, case when count(*) filter (l_returnflag = 'R') = count(*) then 'AllConfirmed' when count(*) filter (l_returnflag = 'R') > 0 then 'SomeConfirmed'
when count(*) filter (l_returnflag = 'A') = count(*) then 'AllRejected' else 'Pending' end as state from lineitem group by l_orderkey""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13: one state per group."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(A.rollup_status(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("state"))


@query("""select o_custkey, count(*) as orders, coalesce(sum(r.n), 0) as returned from orders left join
(select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) r on l_orderkey = o_orderkey group by o_custkey""")
def child_counts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, AG23: children are counted before they are joined; none is 0."""
    risks = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(risks, orders.o_orderkey == risks.l_orderkey, "left").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("k"), F.lit(0)).alias("returned"))


@query("select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from events group by user_id")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15: first and last times."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""select l_orderkey, case when count(distinct round_even(cast(l_tax as decimal(9,4)), 2)) = 1 then cast(min(round_even(cast(l_tax as decimal(9,4)), 2)) as double) end as tax
from lineitem where l_tax > 0 group by l_orderkey""")
def unique_value_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: the value, if there is just one."""
    tax = F.bround(F.col("l_tax").cast("decimal(9,4)"), 2)
    return table(spark, sf_dir, "lineitem").filter("l_tax > 0").groupBy("l_orderkey").agg(A.unique_value(tax).cast("double").alias("tax"))


@query("select p_name, p_brand, count(*) as n, min(p_partkey) as first_key from part group by 1, 2 having count(*) > 1")
def duplicate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: identities that repeat."""
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).filter("n > 1")


@query("""select l_suppkey, array_to_string(list_sort(list(distinct l_returnflag || l_linestatus))[1:5], ',') as flags from lineitem group by 1""")
def joined_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18, AG20: distinct flags joined, five at most."""
    flag = F.concat("l_returnflag", "l_linestatus")
    return A.joined_distinct(table(spark, sf_dir, "lineitem"), ["l_suppkey"], flag, 5, "flags")


@query("""with l as (select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as returned, count(distinct l_partkey) as parts from lineitem group by 1),
e as (select user_id as k, count(*) as events from events group by 1), c as (select c_nationkey, count(*) as customers from customer group by 1)
select s_suppkey, coalesce(n, 0) as n, coalesce(returned, 0) as returned, coalesce(parts, 0) as parts, coalesce(events, 0) as events, coalesce(customers, 0) as customers
from supplier left join l on l_suppkey = s_suppkey left join e on k = s_suppkey left join c on c_nationkey = s_nationkey
order by n desc, returned desc, parts desc, events desc, customers desc, s_suppkey limit 100""")
def supplier_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22: counters of several tables, each aggregated before its join; top 100."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.countDistinct("l_partkey").alias("parts"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("s_suppkey")).agg(F.count("*").alias("events"))
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("customers"))
    out = supplier.join(lines, "s_suppkey", "left").join(events, "s_suppkey", "left").join(customers, "s_nationkey", "left")
    counters = ["n", "returned", "parts", "events", "customers"]
    return out.select("s_suppkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters]).orderBy(*[F.desc(c) for c in counters], "s_suppkey").limit(100)


@query("select * exclude (r) from (select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, WN13: the latest row by a partial maximum, no sort."""
    return A.latest_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type"])


@query("select * exclude (r) from (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1")
def earliest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2: the earliest row of each (user, type)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return A.first_per_key(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate desc, o_orderkey) as r from orders)
where r = 1 order by o_totalprice desc, o_orderkey limit 50""")
def best_per_key_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3, WN4, WN6, WN7: the best row per key, then the best of these."""
    order = [F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")]
    best = A.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], order)
    return best.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select s_suppkey, s_nationkey, cast(row_number() over (partition by s_nationkey order by s_acctbal desc, s_name, s_suppkey) as int) as place from supplier")
def dense_rank_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5, WN12: places 1..n without gaps or ties."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", "s_name")
    return A.ranked(rows, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_name"), F.col("s_suppkey")], "place").select("s_suppkey", "s_nationkey", "place")


@query("""select event_id, last_value(case when event_type <> 'error' then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events""")
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN8: the last type that was no error."""
    rows = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return A.fill_down(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "kind", "carried").select("event_id", "carried")


@query("""with o as (select *, rank() over (partition by o_custkey order by o_orderpriority) as r from orders), b as (select *, count(*) over (partition by o_custkey) as n from o where r = 1)
select o_custkey, o_orderkey, o_orderpriority from b where n = 1""")
def unique_best_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN10: the best, unless it ties."""
    return A.unique_best(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderpriority")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""select event_id, event_type from (select *, row_number() over (partition by event_type order by value desc, event_id) as r from events) where r <= 30 order by value desc, event_id limit 100""")
def type_limited_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11: a cap per type, then one for all."""
    return A.limited_by_type(table(spark, sf_dir, "events"), "event_type", [F.desc("value"), F.col("event_id")], 30, 100).select("event_id", "event_type")


@query("""select key, source from (select *, row_number() over (partition by key order by source, v desc, key) as r from (select 1 as source, c_custkey as key, c_acctbal as v from customer where c_acctbal > 5000
union all select 2, s_suppkey, s_acctbal from supplier union all select 3, p_partkey, p_retailprice from part where p_size < 10)) where r = 1""")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN9, SE1: several lists, the first that has a key gives it: a minimum over the union."""
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.lit(1).alias("source"), F.col("c_custkey").alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.lit(2).alias("source"), F.col("s_suppkey").alias("key"))
    c = table(spark, sf_dir, "part").filter("p_size < 10").select(F.lit(3).alias("source"), F.col("p_partkey").alias("key"))
    return a.unionByName(b).unionByName(c).groupBy("key").agg(F.min("source").alias("source"))


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on c_custkey = o_custkey where o_orderdate >= timestamp '2001-01-01'")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1-JN3: a lookup; the small side is broadcast only below a checked size."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.lookup(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5: rows whose id is among others."""
    ids = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return J.in_any(table(spark, sf_dir, "customer"), "c_custkey", ids).select("c_custkey", "c_name")


@query("select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_not_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7, SE3, SE7: rows without a counterpart."""
    return J.not_in(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem").select("l_orderkey")).select("o_orderkey", "o_totalprice")


@query("""select c_custkey, coalesce(orders, 0) as orders, coalesce(lines, 0) as lines from customer left join (select o_custkey, count(*) as orders, sum(coalesce(n, 0)) as lines
from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey group by 1) on o_custkey = c_custkey""")
def child_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, AG23: children and their children, each aggregated before its join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left")
    each = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "customer").select("c_custkey").join(each, "c_custkey", "left").select("c_custkey", none("orders"), none("lines"))


@query("""select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 50 union select o_orderkey from orders where o_totalprice > 350000
union select l_orderkey from lineitem where l_returnflag = 'R' and l_discount >= 0.1)""")
def union_sources_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6, JN8, SE2: ids of three sources."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a, b = lines.filter("l_quantity >= 50").select("l_orderkey"), orders.filter("o_totalprice > 350000").select("o_orderkey")
    c = lines.filter("l_returnflag = 'R' and l_discount >= 0.1").select("l_orderkey")
    return J.in_any(orders, "o_orderkey", a, b, c).select("o_orderkey")


@query("""select n_nationkey, m.mode, coalesce(n, 0) as n from nation cross join (values ('Incremental'), ('Backfill')) as m(mode)
left join (select c_nationkey, case when c_acctbal >= 0 then 'Incremental' else 'Backfill' end as mode, count(*) as n from customer group by 1, 2) c on c.c_nationkey = n_nationkey and c.mode = m.mode""")
def cross_mode_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, DA18: every nation in two modes, by exploding two literals."""
    modes = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit("Incremental"), F.lit("Backfill"))).alias("mode"))
    seen = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_acctbal") >= 0, "Incremental").otherwise("Backfill").alias("mode")).agg(F.count("*").alias("n"))
    return modes.join(seen, ["n_nationkey", "mode"], "left").select("n_nationkey", "mode", F.coalesce("n", F.lit(0)).alias("n"))


@query("""with n as (select distinct p_name from part) select a.p_name as a, b.p_name as b from n a join n b on a.p_name <> b.p_name
and (contains(lower(a.p_name), lower(b.p_name)) or contains(lower(b.p_name), lower(a.p_name)))""")
def bidirectional_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: distinct names, one inside the other, wherever words end; both ways."""
    pairs = J.containing_pairs(table(spark, sf_dir, "part"), [], "p_name")
    return pairs.select(F.col("inner").alias("a"), F.col("outer").alias("b")).union(pairs.select("outer", "inner")).distinct()


@query("""select o_orderkey, l_linenumber, l_partkey, place from (select *, row_number() over (partition by o_orderkey order by l_shipdate desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place
from orders join lineitem on l_orderkey = o_orderkey where l_shipdate <= o_orderdate + interval 7 days) where place <= 3""")
def asof_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: shipments up to a week after the order, newest first, three at most."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *LINE_KEY[1:])
    tie = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return J.asof_within(orders, lines, ["o_orderkey"], "o_orderdate", "l_shipdate", ["o_orderkey"], 7, 3, tie).select("o_orderkey", "l_linenumber", "l_partkey", "place")


@query("""with q as (select * from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as r from part) where r = 1)
select p.p_partkey as a, q.p_partkey as b, case when p.p_name = q.p_name then 1 when p.p_type = q.p_type then 2 when p.p_size = q.p_size then 3 else 4 end as rule from part p join q using (p_brand)""")
def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: every part and the cheapest one of its brand, by the first rule that holds; every rule is a hash join."""
    part = table(spark, sf_dir, "part")
    cheapest = A.first_per_key(part, ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")])
    fields = ("brand", "name", "type", "size")
    p = part.select(F.col("p_partkey").alias("a"), *[F.col(f"p_{c}").alias(f"{c}_a") for c in fields])
    q = cheapest.select(F.col("p_partkey").alias("b"), *[F.col(f"p_{c}").alias(f"{c}_b") for c in fields])
    same = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    return J.cascade(p, q, "a", "b", [same("name"), same("type"), same("size"), F.lit(True)], same("brand"))


@query("with n as (select distinct p_name from part) select p_name from n where not exists (select 1 from n m where length(m.p_name) > length(n.p_name) and contains(lower(m.p_name), lower(n.p_name)))")
def subsumed_rows_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16: names that are no part of a longer name."""
    return J.without_fragments(table(spark, sf_dir, "part").select("p_name").distinct(), [], "p_name")


@query("""select o_orderkey, kind, moment, detail from (select o_orderkey, 'Ordered' as kind, o_orderdate as moment, o_orderpriority as detail from orders
union all select l_orderkey, 'Shipped', l_shipdate, l_returnflag || l_linestatus from lineitem
union all select l_orderkey, 'Returned', max(l_shipdate), cast(count(*) as varchar) from lineitem where l_returnflag = 'R' group by 1)""")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE6: events of three sources in one shape."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.select("o_orderkey", F.lit("Ordered").alias("kind"), F.col("o_orderdate").alias("moment"), F.col("o_orderpriority").alias("detail"))
    b = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.lit("Shipped").alias("kind"), F.col("l_shipdate").alias("moment"), F.concat("l_returnflag", "l_linestatus").alias("detail"))
    c = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit("Returned").alias("kind"), F.max("l_shipdate").alias("moment"), F.count("*").cast("string").alias("detail"))
    return a.unionByName(b).unionByName(c)


@query("""select o_orderkey, cast(score as double) as score from (select o_orderkey, (case o_orderstatus when 'P' then 3 when 'O' then 2 else 1 end) * 10000 + (case when starts_with(o_orderpriority, '1') then 1 else 0 end) * 100
+ (100 - least(100, cast(floor(o_totalprice / 10000) as int))) as score from orders) order by score desc, o_orderkey limit 100""")
def composite_risk_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST6, ST8: a sort key made of three."""
    status = ladder([(F.col("o_orderstatus") == "P", 3), (F.col("o_orderstatus") == "O", 2)], 1)
    urgent = F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0)
    score = status * 10000 + urgent * 100 + (100 - F.least(F.lit(100), F.floor(F.col("o_totalprice") / 10000)))
    return table(spark, sf_dir, "orders").select("o_orderkey", score.cast("double").alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(100)


@query("""select o_orderkey, days, case when days < 0 then 'Overdue' when days <= 3 then 'Urgent' else 'DueSoon' end as state from
(select o_orderkey, date_diff('day', date '2000-01-01', cast(o_orderdate as date)) as days from orders where o_orderstatus = 'O')""")
def deadline_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC34, DA4: days left at a stated time."""
    state = due_state(F.col("o_orderdate"), F.lit("2000-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", state.alias("s"))
    return rows.select("o_orderkey", "s.days", "s.state")


@query("""select source, id, due from (select 1 as source, o_orderkey as id, case when o_orderkey % 7 = 0 then null else o_orderdate end as due from orders where o_orderstatus = 'P'
union all select 2, event_id, ts from events where event_type = 'error') order by due nulls last, source, id limit 10""")
def merged_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9, ST10: two lists, no date last, top ten."""
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit(1).alias("source"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("due"))
    b = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit(2).alias("source"), F.col("event_id").alias("id"), F.col("ts").alias("due"))
    return a.unionByName(b).orderBy(F.col("due").asc_nulls_last(), "source", "id").limit(10)


@query("select min(c_mktsegment) as segment from customer group by lower(c_mktsegment)")
def distinct_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE5: distinct spellings that differ in more than case."""
    return table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment")).agg(F.min("c_mktsegment").alias("segment")).select("segment")
