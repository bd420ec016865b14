"""Reviews of notices and results, and the commands that follow from them, over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import merging, quality, scoring, search
from ..operators.joins import ROW_SIZE
from ..session import spread, table
from ..streaming import commands
from .registry import query

c = F.col

# Children of an order: packages are its first lines, requirements the later ones, details some of either.
CHILDREN = """l as (select *, l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, cast(l_extendedprice as decimal(18,2)) as price from lineitem),
k as (select l_orderkey as n, id, case when l_partkey % 5 = 0 then null else l_linenumber end as no, l_suppkey % 4 > 0 as named, case when l_partkey % 3 = 0 then 'L' || l_linenumber % 2 end as lot, case when l_suppkey % 2 = 1 then 'LOT' end as lot_name from l where l_linenumber <= 3 and l_orderkey % 7 > 0),
q as (select l_orderkey as n, bool_or(l_partkey % 4 = 0 or l_suppkey % 3 = 2) as q, bool_or(l_partkey % 4 = 2) as p, bool_or(l_suppkey % 3 = 0) as s from l where l_linenumber >= 4 group by 1),
d as (select l_orderkey as n, id, l_partkey % 4 as m from l where l_linenumber in (2, 5))"""

NOTICE_ISSUES = f"""with {CHILDREN},
o as (select o_orderkey as n, o_orderkey % 3 = 0 as bare, (select count(*) from k where k.n = o_orderkey) as np, (select count(*) from d where d.n = o_orderkey) as nd, (select count(*) from d where d.n = o_orderkey and m = 0) as nb, coalesce(q, false) as q, coalesce(p, false) as p, coalesce(s, false) as s from orders left join q on q.n = o_orderkey),
a as (select * from o where np > 0 or nd > 0 or n % 2 = 0)
select n as notice_id, null::bigint as item_id, 'MissingProjectCode' as issue_type, 'Medium' as severity, 'project_code' as field from a where bare
union all select n, null, 'MissingLotOrPackage', 'High', 'packages' from a where np = 0
union all select n, null, 'MissingQualificationRequirement', 'Medium', 'requirements' from a where not q and not p and not s
union all select n, null, 'MissingQualificationRequirement', 'Low', 'requirements' from a where not q and (p or s)
union all select n, null, 'MissingPerformanceRequirement', 'Low', 'requirements' from a where not p and (q or s)
union all select n, null, 'MissingPersonnelRequirement', 'Low', 'requirements' from a where not s and (q or p)
union all select n, null, 'OriginalEvidenceMissing', 'Medium', 'original_row' from a where nb > 0
union all select n, id, 'MissingLotOrPackage', 'Medium', 'package_no' from k where no is null
union all select n, id, 'MissingLotOrPackage', 'Medium', 'package_name' from k where not named
union all select n, id, 'MissingLotOrPackage', 'Medium', 'lot_no' from k where lot is null and lot_name is null
union all select n, null, 'DuplicatePackageIdentity', 'High', 'package_no' from k where no is not null group by n, no, coalesce(lot, '?'), coalesce(lot_name, '?') having count(*) > 1
union all select n, id, case m when 1 then 'AmbiguousAmountUnit' else 'RateOrDiscountInAmountColumn' end, 'High', 'budget' from d where m in (1, 2)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem")
    rows = spread(rows, ["l_orderkey"], rows.count() * ROW_SIZE)  # numbered within orders: what a task sorts does not grow with the table
    return rows.withColumns({"id": c("l_orderkey") * 100 + place, "price": c("l_extendedprice").cast("decimal(18,2)")}).withColumn("notice_id", c("l_orderkey"))


def _packages(lines: DataFrame) -> DataFrame:
    text = lambda ok, x, other=None: F.when(ok, x.cast("string")).otherwise(F.lit(other))
    nothing = F.lit(None).cast("decimal(18,2)")
    return lines.filter("l_linenumber <= 3 and l_orderkey % 7 > 0").select(
        "notice_id", c("id").alias("package_id"), text(c("l_partkey") % 3 == 0, F.concat(F.lit("l "), c("l_linenumber") % 2), "未识别").alias("lot_no"), text(c("l_suppkey") % 2 == 1, F.lit("Lot")).alias("lot_name"),
        text(c("l_partkey") % 5 > 0, c("l_linenumber"), " n/a").alias("package_no"), text(c("l_suppkey") % 4 > 0, F.concat(F.lit("P"), c("l_partkey")), " ").alias("package_name"), nothing.alias("budget"), nothing.alias("max_price"),
    )


def _notice_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, pick = _lines(spark, sf_dir), lambda n, *v: F.get(F.array(*[F.lit(x) if not hasattr(x, "alias") else x for x in v]), n.cast("int"))
    notices = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("notice_id"), F.when(c("o_orderkey") % 2 == 0, "招标 公告").otherwise("other").alias("notice_type"), F.when(c("o_orderkey") % 3 == 0, " 无").otherwise("PC-1").alias("project_code"))
    asked = lines.filter("l_linenumber >= 4").select("notice_id", pick(c("l_partkey") % 4, "qualification", "其他", "PERFORMANCE", None).alias("requirement_type"), pick(c("l_suppkey") % 3, "项目经理一名", "无要求", "营业执照、许可证").alias("original_text"))
    cell = lambda h, x: F.to_json(F.create_map(F.lit(h), x.cast("string"), F.lit("备注"), F.lit("3")))
    shown = pick(c("l_partkey") % 4, None, cell("预算金额（万元）", F.format_number("price", 2)), cell("折扣率", F.concat("price", F.lit(" %"))), cell("预算金额（万元）", c("price") / 10000))
    details = lines.filter("l_linenumber in (2, 5)").select("notice_id", c("id").alias("detail_id"), F.lit(None).cast("long").alias("package_id"), shown.alias("original_row"), c("price").alias("budget"), F.lit(0).alias("max_price"))
    return quality.notice_issues(notices, _packages(lines), asked, details, ["budget", "max_price"])


@query(NOTICE_ISSUES)
def notice_review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA9, DA10: the evaluator's rules over notices, packages, requirements and details: what is missing, twice there, uncovered or in the wrong unit."""
    return _notice_issues(spark, sf_dir)


OUTCOME_ISSUES = f"""with {CHILDREN},
r as (select l_orderkey as n, id, l_partkey % 7 = 0 as unnamed, l_suppkey % 5 as m, case when l_suppkey % 5 in (1, 2) then null else l_linenumber end as no, case when l_suppkey % 5 = 3 then 'L' || l_linenumber % 2 end as lot, l_partkey % 6 as e, l_quantity > 25 as ranked, l_tax > 0.04 as linked from l where l_linenumber between 3 and 6 and l_orderkey % 4 > 0),
m as (select r.n, r.id, count(k.id) as hits from r left join k on k.n = r.n and r.no is not null and k.no = r.no and (r.lot is null or (k.lot is not null and k.lot = r.lot)) where not linked and exists (select 1 from k where k.n = r.n) group by 1, 2)
select o_orderkey as notice_id, null::bigint as item_id, 'OriginalEvidenceMissing' as issue_type, 'High' as severity, 'outcome_suppliers' as field from orders where o_orderkey % 3 < 2 and not exists (select 1 from r where r.n = o_orderkey)
union all select n, id, 'MissingSupplierName', 'High', 'supplier' from r where unnamed
union all select n, id, 'MissingLotOrPackage', 'High', 'package_no' from r where no is null and lot is null
union all select n, id, 'MissingCandidateRank', 'Medium', 'rank' from r where n % 3 = 1 and not ranked
union all select n, id, 'LifecycleMatchConflict', 'High', 'package_no' from m where hits > 1
union all select n, id, 'LifecycleMatchMissing', 'Medium', 'package_no' from m where hits = 0
union all select n, id, case when e = 1 then 'AmbiguousAmountUnit' else 'RateOrDiscountInAmountColumn' end, 'High', 'award_amount' from r where e in (1, 2, 3)"""


def _outcome_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    n = c("o_orderkey") % 3
    # Candidates' notices tell of it in the title, results in the type; others in neither.
    notices = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("notice_id"), F.when(n == 0, "award").otherwise("notice").alias("notice_type"), F.when(n == 1, "第一包候选人公示").otherwise("公告").alias("title"))
    m, e, price = c("l_suppkey") % 5, c("l_partkey") % 6, c("price").cast("string")
    evidence = F.when(e == 1, F.concat(F.lit("中标金额 "), price, F.lit(" 万元"))).when(e == 2, F.concat(F.lit("下浮 "), price, F.lit("%"))).when(e == 3, F.concat(F.lit("折扣 "), price)).when(e == 4, F.concat(F.lit("中标 "), price, F.lit("元")))
    records = lines.filter("l_linenumber between 3 and 6 and l_orderkey % 4 > 0").select(
        "notice_id", c("id").alias("record_id"), F.when(c("l_partkey") % 7 == 0, "-").otherwise("S").alias("supplier"), F.lit("Candidate").alias("outcome_type"), F.when(c("l_quantity") > 25, 1).alias("rank"),
        F.when(m == 3, F.concat(F.lit("l"), c("l_linenumber") % 2)).alias("lot_no"), F.lit("").alias("lot_name"), F.when(~m.isin(1, 2), c("l_linenumber").cast("string")).alias("package_no"), F.lit(None).cast("string").alias("package_name"),
        c("price").alias("award_amount"), evidence.alias("evidence"), F.when(c("l_tax") > 0.04, c("id")).alias("tender_package_id"),
    )
    return quality.outcome_issues(notices, records, _packages(lines))


@query(OUTCOME_ISSUES)
def outcome_review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA9: the evaluator's rules over result notices: suppliers, lots, ranks, amounts against their evidence, packages that match none or several."""
    return _outcome_issues(spark, sf_dir)


@query(f"""with i as (select 'notice' as part, notice_id, issue_type, severity from ({NOTICE_ISSUES}) union all select 'outcome', notice_id, issue_type, severity from ({OUTCOME_ISSUES})),
a as (select notice_id, sum(case severity when 'High' then 30 when 'Medium' then 15 else 5 end) as lost, count(*) as n, count(*) filter (severity = 'High') as high, count(*) filter (severity = 'Medium') as medium,
count(*) filter (issue_type in ('MissingLotOrPackage', 'AmbiguousAmountUnit', 'RateOrDiscountInAmountColumn', 'OriginalEvidenceMissing', 'DuplicatePackageIdentity')) as again from i group by 1),
s as (select o_orderkey as notice_id, greatest(0, 100 - coalesce(lost, 0)) as score, coalesce(n, 0) as n, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(again, 0) as again from orders left join a on a.notice_id = o_orderkey),
r as (select *, case when score < 60 or high > 0 then 'High' when score < 85 or medium > 0 then 'Medium' else 'Low' end as risk from s)
select notice_id, score::int as score, risk, n as issue_count, case when risk = 'Low' then 'BatchConfirmCandidate' when risk = 'High' and again > 0 then 'NeedsReparse' else 'NeedsReview' end as recommendation from r""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA9, DA19: score, risk and advice of each notice by the rules that it and its results break."""
    issues = _notice_issues(spark, sf_dir).unionByName(_outcome_issues(spark, sf_dir))
    keys = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("notice_id"))
    out = scoring.quality_score(keys, issues, "notice_id", quality.REPARSE)
    return out.select("notice_id", c("score").cast("int").alias("score"), "risk", "issue_count", "recommendation")


@query("""with n as (select o_orderkey as s, o_custkey as raw, row_number() over (partition by o_custkey order by o_orderkey) as r from orders where o_orderstatus <> 'P' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')),
a as (select s, raw, 100 + row_number() over (order by s) as id from n where r = 1),
l as (select l_orderkey, l_linenumber, l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as s from lineitem),
p as (select l.s, a.id as up, 1000 + row_number() over (order by l.s) as id from l join a on a.s = l.l_orderkey where l_linenumber <= 2),
q as (select l.s * 10 + k as s, p.id as up, row_number() over (order by l.s * 10 + k) as id from l join p on p.s = l.s, (values (1), (2)) as v(k))
select 'notice' as part, s as staging_id, raw::bigint as parent_id, id::bigint as id from a union all select 'package', s, up, id from p union all select 'requirement', s, up, id from q""")
def approved_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM1: a staged notice with its packages and requirements becomes formal as a whole, once for each raw notice."""
    orders, lines = table(spark, sf_dir, "orders"), _lines(spark, sf_dir)
    notices = orders.filter("o_orderstatus <> 'P'").select(c("o_orderkey").alias("staging_id"), c("o_custkey").alias("parent_id"))
    formal = orders.filter("o_orderstatus = 'P'").select(c("o_custkey").alias("raw_id")).distinct()
    packages = lines.filter("l_linenumber <= 2").select(c("id").alias("staging_id"), c("l_orderkey").alias("parent_id"))
    asked = lines.select(F.explode(F.array(c("id") * 10 + 1, c("id") * 10 + 2)).alias("staging_id"), c("id").alias("parent_id"))
    made = commands.promoted_tree(notices, packages, asked, formal, {"notices": 100, "packages": 1000, "requirements": 0})
    parts = [f.select(F.lit(name).alias("part"), "staging_id", c("formal_parent_id").cast("long").alias("parent_id"), "id") for name, f in zip(("notice", "package", "requirement"), made, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""with k as (select o_orderkey as id, o_custkey as link, o_totalprice as v, o_orderkey % 6 as m, case when o_orderkey % 4 = 0 then 'Selected' when o_orderkey % 4 = 1 then 'Rejected' else 'Recommended' end as st from orders),
d as (select *, case when m = 1 then 'Deposit' else 'DealAmount' end as ty from k),
r as (select id, link, v, ty, case when m = 2 then 'Rejected' when m = 3 or (m = 1 and st <> 'Selected') then case ty when 'Deposit' then 'Rejected' else 'Recommended' end else st end as status, m = 2 and st = 'Selected' as lost from d),
g as (select link, list(v) as gone from r where lost group by 1)
select r.id, ty as amount_type, status, case when g.link is null then 'Manual' when list_contains(gone, f.v) then 'Missing' else 'Manual' end as final_source, case when list_contains(coalesce(gone, []), f.v) then null else f.v end as final_amount
from r join (select o_custkey as link, max(case when o_orderkey % 4 = 0 then o_totalprice else 0 end) as v from orders group by 1) f using (link) left join g using (link)""")
def amount_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM7: types marked, candidates rejected and restored; a rejected selection clears the link's final amount."""
    n = c("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(n.alias("id"), c("o_custkey").alias("link_id"), F.lit("DealAmount").alias("amount_type"), c("o_totalprice").alias("amount_value"), F.when(n % 4 == 0, "Selected").when(n % 4 == 1, "Rejected").otherwise("Recommended").alias("status"), F.lit(None).cast("string").alias("reject_reason"), F.lit(0.5).cast("decimal(5,4)").alias("confidence"))
    links = rows.groupBy("link_id").agg(F.max(F.when(c("status") == "Selected", c("amount_value")).otherwise(0)).alias("final_amount"), F.lit("Manual").alias("final_source"))
    m = c("id") % 6
    # The first action is overruled by the last; a rejection without a reason has no effect.
    acts = rows.select("id", F.lit(2).alias("ordinal"), F.when(m == 1, "MarkType").when(m.isin(2, 4), "Reject").when(m == 3, "Restore").alias("action"), F.lit("Deposit").alias("amount_type"), F.when(m == 2, "wrong").otherwise(" ").alias("reason")).filter("action is not null")
    acts = acts.unionByName(acts.select("id", F.lit(1).alias("ordinal"), F.lit("Reject").alias("action"), "amount_type", F.lit("first").alias("reason")))
    out, after = commands.amount_actions(rows, acts, links)
    return out.join(after, "link_id").select("id", "amount_type", "status", "final_source", "final_amount")


@query("""with j as (select o_orderkey as o, row_number() over (order by o_orderkey) as n from orders where o_orderstatus <> 'O' and o_orderkey % 3 = 0 and o_orderstatus = 'F')
select (select max(o_orderkey) from orders) + n as id, o as original_id, case when o % 2 = 0 then 'job' || o || ' (manual retry)' else 'kind' end as job_name, case when o % 5 > 0 then 'k' || o || ':retry:' || o end as deduplication_key, 'Pending' as status, greatest(o % 10, 5)::int as priority, case when o % 4 = 0 then 3 else 7 end as max_attempts from j""")
def retried_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM14: jobs retried by hand as new rows beside the old ones; waiting and running ones are refused."""
    n = c("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(
        n.alias("id"), F.lit("kind").alias("job_type"), F.lit("tenders").alias("queue"), F.when(n % 2 == 0, F.concat(F.lit("job"), n)).alias("job_name"), F.when(n % 5 > 0, F.concat(F.lit("k"), n)).alias("deduplication_key"), F.lit("{}").alias("payload"),
        F.when(c("o_orderstatus") == "F", "DeadLetter").when(c("o_orderstatus") == "O", "Running").otherwise("Pending").alias("status"), (n % 10).cast("int").alias("priority"), F.when(n % 4 > 0, 7).otherwise(0).alias("max_attempts"), F.lit(9).alias("attempt_count"),
    )
    last = jobs.agg(F.max("id")).first()[0] or 0
    out = commands.retried(jobs, jobs.filter("id % 3 = 0").select("id"), F.lit("2026-01-01").cast("timestamp_ntz"), last, 5, 3)
    return out.select("id", "original_id", "job_name", "deduplication_key", "status", "priority", "max_attempts")


@query("""with j as (select o_orderkey as id, o_orderkey % 9 as m, o_custkey + 1 as n from orders)
select id, case when m = 8 then null else 'Tenders' end as source_module, case when m = 0 then 'Own' when m in (6, 8) then null else 'RawNotice' end as business_type, case when m = 0 then 77 when m in (6, 8) then null else n end as business_id, case when m = 0 then '77' when m in (6, 8) then null when m = 1 then 'c' else cast(n as varchar) end as correlation_id from j""")
def inferred_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM15: a job's business object from its payload at any depth, its key or its result, in that order."""
    k, n = c("o_orderkey"), (c("o_custkey") + 1).cast("string")
    m, none = k % 9, F.lit(None).cast("string")
    text = lambda cases: F.coalesce(*[F.when(m == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])) for i, parts in cases.items()])
    jobs = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(m == 8, "other.job").when(m == 7, "TENDERS.x").otherwise("x").alias("job_type"), F.when(m >= 7, "q").otherwise("Tenders").alias("queue"),
        text({0: ['{"rawNoticeId":', n, "}"], 1: ['{"a":{"b":[{"rawNoticeId":0},{"RawNoticeId":"', n, '"}]}}'], 2: ["no json rawNoticeId:", n], 6: ['{"note":"\\"rawNoticeId\\":', n, '"}'], 8: ['{"rawNoticeId":', n, "}"]}).alias("payload"),
        text({2: ["tenders:attachment-process:t:v:", n, ":9"], 3: ["Tenders:manual-reparse:t:", n], 4: ["tenders:other:raw:", n], 5: ["other:manual-reparse:t:5"]}).alias("deduplication_key"),
        text({5: ["done; rawNoticeId = ", n, " ok"], 6: ["rawNoticeIds = 5"], 7: ['{"x":[{"rawNoticeId":"', n, '"}]}']}).alias("result"),
        none.alias("source_module"), F.when(m == 0, " Own ").alias("business_type"), F.when(m == 0, 77).when(m == 1, -1).cast("long").alias("business_id"), F.when(m == 1, "c").alias("correlation_id"),
    )
    return commands.inferred_links(jobs, "Tenders").select("id", "source_module", "business_type", "business_id", "correlation_id")


@query("""with s as (select o_custkey, min(o_orderkey // 100) as lo, max(o_orderkey // 100) as hi from orders where o_orderkey % 6 = 0 group by 1)
select o_orderkey as id, case when o_orderkey % 2 = 1 then 1 when lo = hi then lo end as notice_id from orders left join s using (o_custkey)""")
def propagated_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CM11: links without a procurement notice get the one that their group's sources agree on."""
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), "o_custkey")
    links = rows.withColumn("notice_id", F.when(c("id") % 2 == 1, 1).cast("long"))
    sources = rows.filter("id % 6 = 0").select("o_custkey", F.floor(c("id") / 100).alias("notice_id"))
    return commands.propagated(links, sources, ["o_custkey"], "notice_id").select("id", "notice_id")


@query("""with m as (select c_custkey % 300 as k, c_custkey, case when c_custkey % 4 > 0 then 'contact' || c_custkey end as contact, case when c_custkey % 5 > 0 then 'region' || c_custkey end as region, c_custkey % 7 = 0 as blank from customer),
n as (select k, arg_max(contact, c_custkey) filter (contact is not null) as contact, arg_max(region, c_custkey) filter (region is not null) as region, max(c_custkey) as top from m where not blank group by 1),
o as (select k, case when k % 2 = 0 then 'old region' end as region, 'old contact' as contact from (select distinct k from m where k % 3 = 0))
select coalesce(n.k, o.k) as k, case when o.k is not null then 'known' || o.k || '有限公司' else 'C' || n.k || '电力有限公司' end as name, coalesce(o.region, n.region) as region, coalesce(n.contact, o.contact) as contact from n full join o on n.k = o.k""")
def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA14: mentions of organisations under several spellings put together by their match key, then filled into or updating the master data."""
    k = c("c_custkey") % 300
    body = F.concat(F.lit("C"), k, F.lit("电力有限公司"))
    spelled = F.when(c("c_custkey") % 7 == 0, " ").when(c("c_custkey") % 3 == 0, F.concat(F.lit("供应商名称："), body)).when(c("c_custkey") % 3 == 1, F.concat(body, F.lit("。"))).otherwise(body)
    text = lambda ok, x: F.when(ok, F.concat(F.lit(x), c("c_custkey")))
    seen = table(spark, sf_dir, "customer").select(k.alias("k"), spelled.alias("name"), text(c("c_custkey") % 4 > 0, "contact").alias("contact"), text(c("c_custkey") % 5 > 0, "region").alias("region"), c("c_custkey").alias("n"))
    old = seen.filter("k % 3 = 0").select("k").distinct().select(F.concat(F.lit("C"), "k", F.lit("电力有限公司")).alias("match_key"), F.concat(F.lit("known"), "k", F.lit("有限公司")).alias("name"), F.when(c("k") % 2 == 0, "old region").alias("region"), F.lit("old contact").alias("contact"))
    out = merging.upsert_organisations(old, seen, "name", ["region"], ["contact"], [F.desc("n")])
    key = F.regexp_extract("match_key", "^C([0-9]+)", 1).cast("long")
    return out.select(key.alias("k"), codes.clean_org_name(c("name")).alias("name"), "region", "contact")


@query("select p_partkey, p_name as exact, p_brand as folded, '' as unknown from part")
def cells_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ4: cells by name: exact, ignoring case, else empty."""
    part = table(spark, sf_dir, "part")
    cell = lambda name: search.cell_text(c("r"), part.columns, name)
    return part.select("p_partkey", F.struct("*").alias("r")).select("p_partkey", cell("p_name").alias("exact"), cell(" P_Brand ").alias("folded"), cell("p_none").alias("unknown"))
