"""Text functions, tables and notices: texts are made of whole business tables, read back, and held against the columns they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, codes, json_rows, masking, money, parsers, tables, text
from ..session import table
from ..sources import files
from .registry import query


def _pick(n: Column | str, *values: str | None | Column) -> Column:
    """The value at the place that n modulo their number gives."""
    n = F.col(n) if isinstance(n, str) else n
    each = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.get(F.array(*[v.cast("string") for v in each]), F.pmod(n, F.lit(len(each))).cast("int"))


def _s(*parts: str | Column) -> Column:
    """Parts joined; strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cents(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


@query("""select o_orderkey, cast(case o_orderkey % 7 when 0 then p when 1 then p * 10000 when 2 then p * 10000 when 3 then p when 6 then p end as double) as amount
from (select o_orderkey, cast(o_totalprice as decimal(18,2)) as p from orders)""")
def parsed_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, SC8: amounts with units beside, in the header or around; rates and scores are none."""
    p = _cents("o_totalprice")
    n = F.col("o_orderkey")
    written = _pick(n, _s(F.format_number(p, 2), "元"), _s("人民币", p, "万元"), _s(p), _s(p), _s("费率 ", p, "%"), _s("评分 ", p, " 分"), _s("报价", p, " 元 整"))
    header = _pick(n, "", "", "成交金额（万元）", "成交金额（元）", "成交金额", "得分", "")
    around = _pick(n, "", "", "", "单位：万元", "单位：万元", "", "")
    rows = table(spark, sf_dir, "orders").select(n, written.alias("t"), header.alias("h"), around.alias("c"))
    return rows.select("o_orderkey", money.parse_money(F.col("t"), money.unit_context(F.col("h"), F.col("c"))).cast("double").alias("amount"))


@query("""with r as (select l_orderkey, l_linenumber, cast(round(l_discount * 100) as int) as d, (l_orderkey + l_linenumber) % 5 as m, cast(l_quantity as int) as q from lineitem)
select l_orderkey, l_linenumber, case m when 0 then 'ReductionRate' when 1 then 'DiscountRate' when 2 then 'Coefficient' when 3 then 'DiscountRate' end as rate_type,
case m when 0 then d / 100.0 when 1 then (100 - d) / 100.0 when 2 then (100 - d) / 100.0 when 3 then (100 - d) / 100.0 end::double as rate_value,
(case when q < 10 then q / 10.0 else q / 100.0 end)::double as fold from r""")
def parsed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, SC14: reductions, discounts, coefficients and folds, the last also in written and formal numerals."""
    d = F.round(F.col("l_discount") * 100).cast("int")
    left = F.lit(100) - d
    as_fold = _s((left / 10).cast("decimal(4,1)"))
    written = _pick(F.col("l_orderkey") + F.col("l_linenumber"), _s("下浮率", d, "%"), _s("折扣率", left, "%"), _s("报价系数", (left / 100).cast("decimal(4,2)")), _s(as_fold, " 折"), _s(d))
    numerals = F.translate(F.col("l_quantity").cast("int").cast("string"), "0123456789", "〇壹二叁四伍六柒八玖")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", written.alias("w"), numerals.alias("f"))  # made once, then read
    rows = rows.select("l_orderkey", "l_linenumber", money.parse_rate(F.col("w")).alias("r"), money.parse_fold(F.col("f")).cast("double").alias("fold"))
    return rows.select("l_orderkey", "l_linenumber", F.col("r.rate_type").alias("rate_type"), F.col("r.rate_value").cast("double").alias("rate_value"), "fold")


KINDS = ["成交金额", "预算 金额", "投标保证金", "最高限价", "代理服务费", "综合单价", "中标价", "下浮率", "其他", "投标报价"]


@query("""with r as (select o_orderkey, o_orderkey % 10 as k, o_orderkey % 3 as u, cast(o_totalprice as decimal(18,2)) as p, o_orderkey % 11 = 0 as none from orders)
select o_orderkey, case k when 0 then 'DealAmount' when 1 then 'BudgetAmount' when 2 then 'Deposit' when 3 then 'CeilingPrice' when 4 then 'AgencyFee' when 5 then 'UnitPrice' when 6 then 'WinningPrice' when 7 then 'ReductionRate' when 8 then 'Unknown' else 'BidQuote' end as kind,
case u when 0 then '元' when 1 then '万元' else '亿元' end as unit, (p * (case u when 0 then 1 when 1 then 10000 else 100000000 end))::double as amount,
case when none then 'Unresolved' when k in (0, 6, 9) then 'Recommended' when k between 1 and 5 then 'Rejected' else 'Unresolved' end as status,
case when none then '未能归一化金额/费率数值。' when k in (0, 6, 9) then '' when k = 1 then '预算金额不是最终中标/成交金额。' when k = 2 then '保证金不是中标/成交金额。' when k = 3 then '最高限价不是最终中标/成交金额。' when k = 4 then '代理服务费不是中标/成交金额。'
  when k = 5 then '单价不是包级最终金额。' when k = 7 then '费率/折扣率需要结合基准金额推导。' else '金额类型未知，需人工判定。' end as reason,
(case when none then 0.4 when k in (0, 6, 9) then 0.9 when k in (1, 3) then 0.78 when k in (2, 4) then 0.82 when k = 5 then 0.7 when k = 7 then 0.68 else 0.55 end)::double as confidence from r""")
def amount_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11, SC12, SC13: kinds by the words around, normalised amounts, and status with reason and confidence."""
    n = F.col("o_orderkey")
    kind = money.classify_amount(_s(_pick(n, *KINDS), "：", _cents("o_totalprice")))
    value = money.normalize_money(_s(F.format_number(_cents("o_totalprice"), 2)), _pick(n, "元", "万", ""), _pick(n, "", "", "金额单位 亿元"))
    rows = table(spark, sf_dir, "orders").select(n, kind.alias("kind"), value.alias("m"), F.when(F.pmod(n, F.lit(11)) != 0, F.lit(1)).alias("known"))
    state = rows.withColumn("s", money.amount_status(F.col("kind"), F.col("known")))
    return state.select("o_orderkey", "kind", F.col("m.unit").alias("unit"), F.col("m.amount").cast("double").alias("amount"), F.col("s.status").alias("status"), F.col("s.reason").alias("reason"), F.col("s.confidence").cast("double").alias("confidence"))


@query("""with r as (select o_orderkey as k, cast(cast(o_totalprice as decimal(18,2)) as varchar) as p, o_orderkey % 90 + 10 as pct from orders),
m as (select k, length('第一行' || chr(10) || '成交金额：') as place, p || ' 万元' as raw, 'money' as form, cast(p as decimal(18,2)) * 10000 as value, '万元' as unit, 'DealAmount' as amount_type, 'Recommended' as status, 2 as line, p, pct from r)
select k as o_orderkey, place, raw, form, value::double as value, unit, amount_type, status, line from m
union all select k, place + length(raw) + length('，整体下浮') + 60, pct || '%', 'percent', pct / 100.0, 'rate', 'ReductionRate', 'Unresolved', 3 from m
union all select k, place + length(raw) + length('，整体下浮') + 60 + length(pct || '%') + 60, '捌伍折', 'fold', 0.85, 'discount', 'DiscountRate', 'Unresolved', 4 from m
union all select k, place + length(raw) + length('，整体下浮') + 60 + length(pct || '%') + 60 + 63, 'CNY 7', 'money', 7, '元', 'Unknown', 'Unresolved', 5 from m""")
def extracted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: money, percent, fold in formal numerals and a currency before a number, each with its place, line, kind and status."""
    far = F.lit("。" * 59 + "\n")
    pct = F.pmod(F.col("o_orderkey"), F.lit(90)) + 10
    t = F.concat(_s("第一行\n成交金额：", _cents("o_totalprice"), " 万元"), far, _s("，整体下浮", pct, "%"), far, _s("捌伍折"), far, _s("CNY 7"))
    rows = tables.extract_amounts(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")), "o_orderkey")
    return rows.select("o_orderkey", F.col("at").alias("place"), "raw", "form", F.col("value").cast("double").alias("value"), "unit", "amount_type", "status", "line")


@query("""select p_partkey, case p_partkey % 8 when 0 then true when 1 then true else false end as unknown, case p_partkey % 8 when 4 then false when 5 then false when 7 then false when 6 then false else true end as missing,
case p_partkey % 8 when 4 then true when 5 then true else false end as unreadable from part""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, SC4, SC5: unknown markers, missing values, unreadable text."""
    x = _pick("p_partkey", " n/a ", "未识别", "-", " 　", "??12", "？-?", _s("名称", F.col("p_name")), _s(F.col("p_name"), "?"))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_unknown_marker(x).alias("unknown"), text.is_missing(x).alias("missing"), text.looks_unreadable(x).alias("unreadable"))


@query("select doc_id, length(h) - length(replace(h, chr(10), '')) + 1 as line from (select doc_id, substr(coalesce(text, ''), 1, length(coalesce(text, '')) * 7 // 10) as h from documents)")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15: the line of a place in each text."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.source_line(t, F.floor(F.length(t) * 7 / 10).cast("int")).alias("line"))


@query("""select s_suppkey, case s_suppkey % 6 when 5 then '甲' || s_suppkey else 'S' || s_suppkey || '电力(北京)有限公司' end as name,
case s_suppkey % 6 when 5 then '甲' || s_suppkey else 'S' || s_suppkey || '电力北京有限公司' end as match_key, case s_suppkey % 6 when 5 then false when 3 then false else true end as compatible from supplier""")
def organisation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16, SC17, JN13: names behind ranks and labels, their match keys, and whether a shortened name is the same supplier."""
    body = _s("S", F.col("s_suppkey"), "电力(北京)有限公司")
    x = _pick("s_suppkey", _s("第一中标候选人：", body, " 等"), _s("2、", body), _s("第二名 投标人: ", body, "；"), _s("三）供应商名称=", body), _s("  ", body, "。"), _s("名称：甲", F.col("s_suppkey")))
    other = _pick("s_suppkey", body, _s("AB", body), _s("1. ", body), _s("ABC", body), _s("A ", body), _s("乙", F.col("s_suppkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", codes.clean_org_name(x).alias("name"), codes.org_match_key(x).alias("match_key"), codes.supplier_compatible(x, other).alias("compatible"))


@query("""with r as (select o_orderkey, lpad(cast(o_orderkey % 10000 as varchar), 4, '0') as c, o_orderkey % 4 as m from orders)
select o_orderkey, case m when 0 then 'AB' || c when 1 then 'X_' || c || '_9' when 2 then 'ZB' || c else '' end as project_code, case when m < 3 then 'L' || c || '-1' else '' end as lot_no, case when m < 3 then '变电' || c || ' 设备' else '' end as lot_name,
case when m < 3 then '改造：' || c || ' 期' else '' end as project_name, case m when 0 then 'AB' || c when 1 then 'X_' || c || '_9' when 2 then 'ZB' || c else '' end as code_key, case m when 0 then 'AB' || c else '' end as lot_code from r""")
def project_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18, SC19, SC22: labelled codes, lots and names in notices, plain or as HTML, and codes at the head of lot numbers."""
    c = F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")
    rest = _s("\n分标编号（包）：L", c, "-1。分标名称: 变电", c, " 设备；项目名称：改造：", c, " 期\n")
    n = F.col("o_orderkey")
    x = _pick(n, _s("公告\n项目编号：ab", c, "-001", rest), _s("招标编号 (批次) = x_", c, "_9", rest), _s("<p>采购编号</p><p>：zb", c, "/7</p>", rest), _s("项目编号：URL 没有"))
    rows = table(spark, sf_dir, "orders").select(n, x.alias("x"), _pick(n, _s("ab", c, "-1包"), _s("a", c, "-1包"), "", "包1").alias("lot"))
    return rows.select(
        "o_orderkey", codes.extract_project_code(F.col("x")).alias("project_code"), codes.extract_lot_no(F.col("x")).alias("lot_no"), codes.extract_lot_name(F.col("x")).alias("lot_name"), codes.extract_project_name(F.col("x")).alias("project_name"),
        codes.project_code_key(F.regexp_replace(codes.extract_project_code(F.col("x")), "_", " _")).alias("code_key"), codes.code_from_lot_no(F.col("lot")).alias("lot_code"),
    )


@query("""select l_orderkey, l_linenumber, case (l_orderkey + l_linenumber) % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then l_linenumber end as rank from lineitem""")
def parsed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20: ranks in words and numbers."""
    x = _pick(F.col("l_orderkey") + F.col("l_linenumber"), "第一名", "第2中标候选人", " 推荐第三", _s("排名 ", F.col("l_linenumber")), "无")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codes.parse_rank(x).alias("rank"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'url:' || sha256(cast(c_custkey as varchar)) else 'C(' || c_custkey || ')-A/1' end as code, '139****' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') as phone, 'c***@x' || c_custkey || '.com' as email,
'10.2.' || c_custkey % 256 || '.*' as ip, 'C' || repeat('*', length('ustomer' || c_custkey)) as name, '***REDACTED***' as token, '110101********00' || c_custkey % 10 || 'X' as id_card, 'No.******eet' as address, '6222********' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') as bank_card from customer""")
def masked_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC28, SC30: business codes with the URL's hash as a last resort, and a mask for each kind of value."""
    k = F.col("c_custkey")
    code = codes.business_code(F.when(k % 3 != 0, _s(" c（", k, "）－a／1 ")), F.sha2(k.cast("string"), 256))
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    m = masking.mask
    return table(spark, sf_dir, "customer").select(
        k, code.alias("code"), m(_s("1390000", four), "phone").alias("phone"), m(_s("cust@x", k, ".com"), "email").alias("email"), m(_s("10.2.", k % 256, ".77"), "ip").alias("ip"), m(_s("Customer", k), "name").alias("name"), m(_s("t", k), "token").alias("token"),
        m(_s("1101011990123400", k % 10, "X"), "id_card").alias("id_card"), m(_s("No. ", k, " Long Street"), "address").alias("address"), m(_s("622202020000", four), "bank_card").alias("bank_card"),
    )


@query("""select event_id, '{"user": ' || user_id || ', "Api-Key": "***REDACTED***", "in": {"list": [{"accessToken": "***REDACTED***", "kind": "' || event_type || '"}], "n": null}}' as masked, event_type as kind, cast(user_id as varchar) as channel, null::varchar as none from events""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC31, SC32: sensitive keys masked at any depth, values found by name at any depth."""
    x = _s('{"user":', F.col("user_id"), ', "Api-Key":"k', F.col("event_id"), '", "in":{"list":[{"accessToken":["a"], "kind":"', F.col("event_type"), '"}], "n":null}}')
    rows = table(spark, sf_dir, "events").select("event_id", x.alias("masked"))
    values = json_rows.found(rows, "event_id", "masked", ["KIND", "User", "n"])
    return json_rows.masked(rows, "event_id", "masked").join(values, "event_id").select("event_id", "masked", F.col("KIND").alias("kind"), F.col("User").alias("channel"), F.col("n").alias("none"))


@query("""select event_id, '{"a":{"z":' || user_id || '},"filter":[{"kind":"' || event_type || '"}],"page":1}' as canonical, sha256('{"a":{"z":' || user_id || '},"filter":[{"kind":"' || event_type || '"}],"page":1}') as fingerprint from events""")
def json_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC33: the canonical form of requests without the caller's identity, keys in order, and its digest."""
    x = _s('{"page": 1, "tenantId": ', F.col("event_id"), ', "filter": [ {"userId":[', F.col("event_id"), '], "kind":"', F.col("event_type"), '"} ], "a":{"storeId":{"x":1},"z":', F.col("user_id"), "}}")
    rows = json_rows.canonical(table(spark, sf_dir, "events").select("event_id", x.alias("x")), "event_id", "x", "canonical")
    return rows.select("event_id", "canonical", F.sha2("canonical", 256).alias("fingerprint"))


@query("""select o_orderkey, case o_orderstatus when 'F' then 100 when 'O' then 40 else 5 end as progress, case when o_orderkey % 3 = 0 then 'Confirm' when o_orderkey % 3 = 1 then 'Ignore' else 'Keep' end as choice,
case when o_orderstatus = 'P' then 'Archived' when o_orderdate < timestamp '1995-06-17' then 'Expired' when o_orderdate <= timestamp '1995-07-17' then 'ExpiringSoon' else 'Valid' end as evidence,
case o_orderkey % 3 when 0 then cast(o_orderkey as varchar) when 1 then o_orderkey || '.5' else o_orderkey || '.125' end as plain from orders""")
def stages_and_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC36, SC37, SC38, SC42: evidence status by expiry, progress by stage, listed choices, plain numbers."""
    n = F.col("o_orderkey")
    day = F.lit("1995-06-17").cast("timestamp_ntz")
    number = n.cast("decimal(18,6)") + _pick(n, "0", "0.5", "0.125").cast("decimal(18,6)")
    return table(spark, sf_dir, "orders").select(
        n, classify.stage_progress(F.col("o_orderstatus"), {"F": 100, "O": 40}, 5).alias("progress"), classify.normalized_choice(_pick(n, " CONFIRM", "ignore ", "what"), ["Confirm", "Ignore"], "Keep").alias("choice"),
        classify.evidence_status(F.col("o_orderstatus") == "P", F.col("o_orderdate").cast("timestamp_ntz"), day).alias("evidence"), money.plain_number(number).alias("plain"),
    )


@query("""select o_orderkey, case o_orderkey % 7 when 0 then 'OpenBidding' when 1 then 'InvitedBidding' when 2 then 'Prequalification' when 3 then 'NonBidding' when 4 then 'NonBidding' when 5 then 'Bidding' else 'Unknown' end as process,
(case o_orderkey % 7 when 0 then 0.95 when 1 then 0.95 when 2 then 0.9 when 3 then 0.9 when 4 then 0.82 when 5 then 0.85 else 0.5 end)::double as confidence, case o_orderkey % 7 when 0 then true when 3 then true else false end as no_award from orders""")
def notice_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC39, SC40: the process that a notice's words tell, first tier first, and statuses in place of a supplier."""
    n = F.col("o_orderkey")
    signal = _pick(n, "公开招标公告，投标人须知", "邀请招标 公告", "资格预审公告（公开招标）", "单一来源采购文件", "成交公告", "中标候选人公示", _s(n))
    name = _pick(n, "包1 流标", "某某有限公司", "某有限公司因前次流标后重新参加采购并最终成交", "废标", "", "甲公司", "乙公司")
    p = classify.notice_process(signal)
    return table(spark, sf_dir, "orders").select(n, p["process"].alias("process"), p["confidence"].cast("double").alias("confidence"), classify.is_non_award(name).alias("no_award"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _joined(rows: DataFrame, line: Column, before: str, after: str, sep: str = "") -> DataFrame:
    """l_orderkey, text: an order's lines in order, between before and after."""
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", line.alias("t"))))
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit(before), F.array_join(F.transform(own, lambda x: x["t"]), sep), F.lit(after)).alias("text"))


AWARD_SQL = """with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i, cast(l_extendedprice as decimal(18,2)) as p from lineitem)
select l_orderkey, cast(i as int) as row_index, cast(max(case when i % 2 = 0 then l_linenumber end) over (partition by l_orderkey order by i) as varchar) as package_no, 'S' || l_suppkey || '电力有限公司' as supplier, (p * 10000)::double as amount from r"""


@query(AWARD_SQL)
def award_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB1, TB2, TB3, WN8: HTML tables of awards, package cells left blank filled down, the unit in the header."""
    rows = _lines(spark, sf_dir).withColumn("i", F.row_number().over(_by_line()) - 1)
    line = _s("<tr><td>", F.when(F.col("i") % 2 == 0, _s("包0", F.col("l_linenumber"))).otherwise(""), "</td><td>1、S", F.col("l_suppkey"), "电力有限公司</td><td>", F.format_number(_cents("l_extendedprice"), 2), "</td></tr>")
    docs = _joined(rows, line, "公告<table><tr><th>分包编号</th><th>中标人</th><th>中标金额（万元）</th></tr>", "</table>完")
    out = tables.award_rows(tables.parse_tables(docs, "l_orderkey", told="award"), "l_orderkey")
    return out.select("l_orderkey", "row_index", "package_no", "supplier", F.col("amount").cast("double").alias("amount"))


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i from lineitem)
select l_orderkey, cast(i as int) as row_index, cast(l_linenumber as varchar) as package_no, 1 as rank, 'S' || l_suppkey || '电力有限公司' as supplier, null::double as amount from r where l_orderkey % 2 = 0
union all select l_orderkey, cast(i as int), cast(l_linenumber as varchar), 2, 'T' || l_partkey || '电气有限公司', null from r where l_orderkey % 2 = 0
union all select l_orderkey, cast(i as int), cast(l_linenumber as varchar), cast(i as int) + 1, 'S' || l_suppkey || '电力有限公司', cast(l_extendedprice as decimal(18,2))::double from r where l_orderkey % 2 = 1""")
def candidate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB4: pipe tables of candidates, across (first, second) and down (rank, name, quote)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(_by_line()))
    s, t = _s("S", F.col("l_suppkey"), "电力有限公司"), _s("T", F.col("l_partkey"), "电气有限公司")
    wide = _joined(rows.filter("l_orderkey % 2 = 0"), _s("| 包", F.col("l_linenumber"), " | ", s, " | ", t, " |"), "公示\n| 包号 | 第一候选人 | 第二候选人 |\n| --- | --- | --- |\n", "\n", "\n")
    down = _joined(rows.filter("l_orderkey % 2 = 1"), _s("| ", F.col("l_linenumber"), " | ", F.col("i"), " | ", s, " | ", _cents("l_extendedprice"), " |"), "| 包号 | 排名 | 候选人名称 | 投标报价（元） |\n", "\n", "\n")
    out = tables.candidate_rows(tables.parse_tables(wide.union(down), "l_orderkey"), "l_orderkey")
    return out.select("l_orderkey", "row_index", "package_no", "rank", "supplier", F.col("amount").cast("double").alias("amount"))


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i, cast(l_extendedprice as decimal(18,2)) as p from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 1))
select l_orderkey, cast(i as int) as row_index, cast(l_linenumber as varchar) as package_no, '包件' || l_partkey as package_name, '供货' || l_suppkey as scope, (p * 10000)::double as budget, p::double as ceiling, (cast(l_quantity as int) * 10000)::double as guide, '资质' || l_linenumber as qualification from r""")
def tender_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB5: tables set apart by blanks, with scope, budget, ceiling and guide price, qualification."""
    rows = table(spark, sf_dir, "lineitem")
    line = _s("包", F.col("l_linenumber"), "   包件", F.col("l_partkey"), "\t供货", F.col("l_suppkey"), "  ", _cents("l_extendedprice"), "  ", _cents("l_extendedprice"), "元  ", F.col("l_quantity").cast("int"), "万元  资质", F.col("l_linenumber"))
    docs = _joined(rows, line, "分包编号  分包名称  采购范围  预算金额（万元）  最高限价  指导价  资格要求\n", "\n", "\n")
    out = tables.tender_rows(tables.parse_tables(docs, "l_orderkey"), "l_orderkey")
    return out.select("l_orderkey", "row_index", "package_no", "package_name", "scope", *[F.col(c).cast("double").alias(c) for c in ("budget", "ceiling", "guide")], "qualification")


@query("""select l_orderkey, cast(2 + sum(case when l_linenumber % 2 = 0 then 3 else 4 end) over w - case when l_linenumber % 2 = 0 then 1 else 2 end as int) as line, cast(l_linenumber as varchar) as package_no, 'S' || l_suppkey || '电力有限公司' as supplier,
case when l_linenumber % 2 = 1 then cast(l_extendedprice as decimal(18,2)) end::double as amount from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB9: suppliers line by line under the package named above, each with the amount before the next."""
    odd = F.col("l_linenumber") % 2 == 1
    line = _s("包", F.col("l_linenumber"), "\n中标人：S", F.col("l_suppkey"), "电力有限公司\n", F.when(odd, _s("中标金额（元）：", _cents("l_extendedprice"), "元\n")).otherwise(""), "其他")
    docs = _joined(_lines(spark, sf_dir), line, "公告\n\n", "\n", "\n")
    out = parsers.outcome_lines(docs, "l_orderkey")
    return out.select("l_orderkey", "line", "package_no", "supplier", F.col("amount").cast("double").alias("amount"))


@query("""select o_orderkey, 'PR' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') as project_code, '工程' || o_orderkey as project_name, 'C' || o_custkey || '供电公司' as buyer_name, '招标' || o_orderkey % 50 || '中心' as agency_name, (cast(o_totalprice as decimal(18,2)) * 10000)::double as budget,
cast(o_orderdate as timestamp) as publish_time, case when o_orderkey % 2 = 0 then cast(o_orderdate as timestamp) + interval 20 day + interval '9:30' hour to minute end as open_bid_time from orders""".replace("interval '9:30' hour to minute", "interval 570 minute"))
def notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB10: labelled fields and dates of notices."""
    n = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    t = _s(
        "项目编号：pr", F.lpad((n % 10000).cast("string"), 4, "0"), "-1\n项目名称：工程", n, "\n采购人：C", F.col("o_custkey"), "供电公司\n采购代理机构：招标", n % 50, "中心\n预算金额：", _cents("o_totalprice"), "万元\n发布时间：", F.date_format(day, "yyyy年M月d日"),
        F.when(n % 2 == 0, _s("\n开标时间：", F.date_format(day + F.expr("INTERVAL 20 DAYS"), "yyyy-MM-dd"), " 9:30")).otherwise(""),
    )
    out = parsers.notice_fields(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")), "o_orderkey")
    return out.select("o_orderkey", "project_code", "project_name", "buyer_name", "agency_name", F.col("budget").cast("double").alias("budget"), "publish_time", "open_bid_time")


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i from lineitem)
select l_orderkey, cast(i as int) as row_index, cast(l_linenumber as varchar) as package_no, 'S' || l_suppkey || '电力有限公司' as supplier, cast(l_extendedprice as decimal(18,2))::double as amount from r""")
def word_box_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16, TB6: word boxes of pages to rows, and those to award rows: packages, wrapped names and amounts."""
    rows = _lines(spark, sf_dir).withColumn("i", F.row_number().over(_by_line()) - 1)
    top = (F.col("i") + 1) * 20.0
    word = lambda t, x0, y0: F.struct((F.lit(t) if isinstance(t, str) else t.cast("string")).alias("text"), F.lit(float(x0)).alias("x0"), y0.alias("y0"), F.lit(float(x0 + 60)).alias("x1"), (y0 + 8.0).alias("y1"))
    head = [("分包编号", 0), ("中标人", 100), ("中标金额（元）", 300)]
    # The name's second half stands on a line of its own below the first.
    cells = F.array(
        word(_s("包", F.col("l_linenumber")), 0, top), word(_s("S", F.col("l_suppkey")), 100, top), word(_s(_cents("l_extendedprice")), 300, top), word("电力有限公司", 100, top + 10.0)
    )
    words = rows.select("l_orderkey", F.inline(cells)).unionByName(rows.select("l_orderkey").distinct().select("l_orderkey", F.inline(F.array(*[word(t, x, F.lit(0.0)) for t, x in head]))))
    out = tables.award_rows(files.word_tables(words.withColumn("page", F.lit(1)), "l_orderkey", "award"), "l_orderkey")
    return out.select("l_orderkey", "row_index", "package_no", F.regexp_replace("supplier", " ", "").alias("supplier"), F.col("amount").cast("double").alias("amount"))


@query("""with r as (select o_orderkey as k, o_orderkey % 7 as m, o_orderpriority as t, o_clerk from (select *, 'Clerk é ' || o_custkey as o_clerk from orders))
select 'f' || k || ['.txt', '.CSV', '.html', '.bin', '.docx', '.xlsx', '.zip'][m + 1] || case when m = 6 then '!in/a.txt' else '' end as path, case when m = 6 then 1 else 0 end as depth,
case m when 0 then t || chr(10) || o_clerk when 1 then 'a,b' || chr(10) || k || ',"' || o_clerk || '"' when 2 then 'T ' || t || ' & ' || o_clerk when 3 then 'ascii ' || k || chr(10) || 'wide ' || k when 4 then o_clerk || chr(10) || '| k | t |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' | ' || t || ' |'
when 5 then '# Sheet é' || chr(10) || '| A |  | ' || t || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || k || ' | 2 |  |' else 'in ' || t end as text, null::varchar as error from r
union all select 'f' || k || '.zip!../bad.txt', 1, null, 'unsafe path' from r where m = 6
union all select 'f' || k || '.zip!deep.zip!b.html', 2, o_clerk, null from r where m = 6""")
def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, SRC10, SRC12, SRC13, SRC15, SRC17: text of files by kind: plain, CSV, HTML, printable runs, DOCX, XLSX, archives in archives."""
    k, t = F.col("o_orderkey"), F.col("o_orderpriority")
    clerk = _s("Clerk é ", F.col("o_custkey"))
    raw = lambda x: F.encode(x, "UTF-8")
    entry = lambda name, x: F.struct(F.lit(name).alias("name"), raw(x).alias("content"))
    p = lambda x: _s("<w:p><w:r><w:t>", x, "</w:t></w:r></w:p>")
    row = lambda *cells: F.concat(F.lit("<w:tr>"), *[_s("<w:tc>", p(c), "</w:tc>") for c in cells], F.lit("</w:tr>"))
    document = _s('<w:document xmlns:w="x"><w:body>', p(clerk), "<w:tbl>", row(F.lit("k"), F.lit("t")), row(k, t), "</w:tbl></w:body></w:document>")
    sheet = _s('<worksheet><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row><c r="A2"><v>', k, '</v></c><c r="B2"><v>2</v></c></row></sheetData></worksheet>')
    xlsx = [entry("xl/workbook.xml", F.lit('<workbook><sheets><sheet name="Sheet é"/></sheets></workbook>')), entry("xl/sharedStrings.xml", _s("<sst><si><t>", t, "</t></si><si><t>A</t></si></sst>")), entry("xl/worksheets/sheet1.xml", sheet)]
    inner = files.zipped(F.array(entry("b.html", _s("<style>x</style><b>", clerk, "</b>"))))
    archive = F.array(entry("in/a.txt", _s("in ", t)), entry("../bad.txt", F.lit("x")), F.struct(F.lit("deep.zip").alias("name"), F.col("inner").alias("content")))
    plain = F.get(
        F.array(
            raw(_s("\ufeff", t, "\n", clerk)), raw(_s("a,b\n", k, ',"', clerk, '"')), raw(_s("<p>T <b>", t, "</b> &amp; ", clerk, "</p><script>no</script>")),
            F.concat(F.lit(bytes([1, 2])), raw(_s("ascii ", k)), F.lit(bytes([0, 1, 0])), F.encode(_s("wide ", k), "UTF-16LE")),
        ),
        (k % 7).cast("int"),
    )
    rows = table(spark, sf_dir, "orders").select(k, t, "o_custkey").withColumn("inner", inner)
    packed = F.when(k % 7 == 4, F.array(entry("word/document.xml", document))).when(k % 7 == 5, F.array(*xlsx)).when(k % 7 == 6, archive).otherwise(F.array().cast("array<struct<name:string,content:binary>>"))
    name = _s("f", k, _pick(k, ".txt", ".CSV", ".html", ".bin", ".docx", ".xlsx", ".zip"))
    content = rows.select(name.alias("path"), F.when(k % 7 < 4, plain).otherwise(files.zipped(packed)).alias("content"))
    files.register_table_function(spark)
    return spark.sql("select t.path, t.depth, t.text, t.error from {found} f, lateral file_text(f.path, f.content) t", found=content)


@query(AWARD_SQL.replace("p * 10000", "p").replace("cast(max(case when i % 2 = 0 then l_linenumber end) over (partition by l_orderkey order by i) as varchar)", "cast(l_linenumber as varchar)"))
def wrapped_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB7: text tables whose records are told apart by sequence numbers and whose names wrap over two lines."""
    rows = _lines(spark, sf_dir).withColumn("i", F.row_number().over(_by_line()))
    line = F.concat(F.rpad(F.col("i").cast("string"), 8, " "), F.rpad(_s("包", F.col("l_linenumber")), 8, " "), F.rpad(_s("S", F.col("l_suppkey"), "电力"), 20, " "), _cents("l_extendedprice").cast("string"), F.lit("\n" + " " * 16 + "有限公司"))
    head = "结果公告\n\n" + "序号".ljust(8) + "包号".ljust(8) + "中标人".ljust(20) + "中标金额（元）\n"
    out = tables.award_rows(tables.wrapped_tables(_joined(rows, line, head, "\n\n以上。\n", "\n"), "l_orderkey", told="award"), "l_orderkey")
    return out.select("l_orderkey", "row_index", "package_no", "supplier", F.col("amount").cast("double").alias("amount"))


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, cast(l_extendedprice as decimal(18,2)) as p from lineitem),
g as (select l_orderkey, 'FB' || l_orderkey as lot_no, cast(l_linenumber % 2 + 1 as varchar) as package_no, count(*) as n_rows, min(i) as i0, min(case when l_quantity > 10 then i end) as iq, min(case when i > 1 then i end) as ib from r group by 1, 2, 3)
select g.l_orderkey, g.lot_no, '线路' as lot_name, g.package_no, n_rows, a.l_linenumber % 2 + 1 || '包 材料' || a.l_partkey as package_name, cast(q.l_quantity as int)::double as quantity, (b.p * 10000)::double as budget, a.p::double as max_price, '地点' || a.l_suppkey as place
from g join r a on a.l_orderkey = g.l_orderkey and a.i = g.i0 left join r q on q.l_orderkey = g.l_orderkey and q.i = g.iq left join r b on b.l_orderkey = g.l_orderkey and b.i = g.ib""".replace("'包 材料'", "' 材料'").replace("a.l_linenumber % 2 + 1 || ' 材料'", "'包' || (a.l_linenumber % 2 + 1) || ' 材料'"))
def procurement_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB8: procurement lists with other header words: lots carried down, package numbers inside names, rows of a package put together."""
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(_by_line()))
    first = F.col("i") == 1
    line = _s(
        "| ", F.when(first, _s("FB", F.col("l_orderkey"))).otherwise(""), " | ", F.when(first, "线路").otherwise(""), " | 包", F.col("l_linenumber") % 2 + 1, " 材料", F.col("l_partkey"), " | ", F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int").cast("string")).otherwise(""),
        " | ", F.when(~first, _cents("l_extendedprice").cast("string")).otherwise("-"), " | ", _cents("l_extendedprice"), "元 | 地点", F.col("l_suppkey"), " |",
    )
    docs = _joined(rows, line, "采购清单\n| 分标号 | 标段名称 | 标包名称 | 采购数量 | 概算金额（万元） | 行报价最高限价 | 交货地点 |\n| --- | --- | --- | --- | --- | --- | --- |\n", "\n", "\n")
    out = tables.procurement_packages(tables.parse_tables(docs, "l_orderkey", told="listed"), "l_orderkey")
    return out.select("l_orderkey", "lot_no", "lot_name", "package_no", "n_rows", "package_name", *[F.col(c).cast("double").alias(c) for c in ("quantity", "budget", "max_price")], "place")


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i, cast(l_extendedprice as decimal(18,2)) as p from lineitem),
s as (select *, 'S' || l_suppkey || '电力有限公司' as name, l_partkey % 7 as m, cast(1 + l_linenumber % 10 as varchar) as no from r),
t as (select *, row_number() over (partition by l_orderkey order by i) - 1 as spot from s where l_linestatus = 'O'), u as (select *, 1 + row_number() over (partition by l_orderkey order by i) as spot from s where l_linestatus <> 'O')
select l_orderkey, 'table' as part, spot::bigint as place, no as package_no, name as supplier, (p * 10000)::double as amount, 0.93 as confidence from t where m <> 5 qualify row_number() over (partition by l_orderkey, no, name, p order by spot) = 1
union all select l_orderkey, 'sentence', spot, no, name, null, 0.72 from (select * from u where m not in (3, 4) qualify row_number() over (partition by l_orderkey, no, name, m order by spot) = 1)""")
def award_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB3: awards of tables and sentences of one text: forms of package numbers, labels in between, other labels, refused rows."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(_by_line()) - 1)
    n = 1 + c("l_linenumber") % 10
    name, m = _s("S", c("l_suppkey"), "电力有限公司"), c("l_partkey") % 7
    written = F.get(F.array(*[F.lit(x) for x in "一二三四五六七八九十"]), (n - 1).cast("int"))
    # Sentences: forms of the package and the label, a competing label, a name without an ending, two clauses of which the second counts.
    told = _pick(m, _s("包", n, "：", name), _s("经评审，第", written, "包 中标人：", name, "中标"), _s("标包0", n, " = 成交供应商 ", name), _s("包", n, "：招标人：", name), _s("分包", n, "：某个人"), _s("采购包", written, " ", name, " 等"), _s("包9：评委：甲，包", n, "　成交人：", name))
    refused = F.when(m == 5, "流标").otherwise("已成交")
    row = _s("<tr><td>包", n, "</td><td>", name, "</td><td>", _cents("l_extendedprice"), "</td><td>", refused, "</td></tr>")
    lines = rows.select("l_orderkey", "i", F.when(c("l_linestatus") != "O", told).alias("told"), F.when(c("l_linestatus") == "O", row).otherwise("<tr></tr>").alias("row"))
    own = F.array_sort(F.collect_list(F.struct("i", "told", "row")))
    sentences = F.array_join(F.transform(F.filter("own", lambda x: x["told"].isNotNull()), lambda x: x["told"]), "。\n")
    made = F.concat(F.lit("公告\n"), sentences, F.lit("；\n<table><tr><th>包号</th><th>中标人</th><th>中标金额（万元）</th><th>状态</th></tr>"), F.array_join(F.transform("own", lambda x: x["row"]), ""), F.lit("</table>"))
    docs = lines.groupBy("l_orderkey").agg(own.alias("own")).select("l_orderkey", made.alias("text"))
    return parsers.award_evidence(docs, "l_orderkey").select("l_orderkey", "part", "place", "package_no", "supplier", c("amount").cast("double").alias("amount"), "confidence")
