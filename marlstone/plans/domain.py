"""Functions, scores, linkage and ingestion over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, masking, text
from ..functions.money import parse_rate
from ..operators import joins as J
from ..operators import linkage, merging
from ..operators import scoring
from ..operators.pricing import price_decision
from ..session import table
from ..streaming.ingest import classify_upsert
from .registry import query


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
case when l_returnflag = 'N' then round_even(cast(l_extendedprice as decimal(18,2)), 2) when l_returnflag = 'A' and l_tax > 0 then cast(round_even(cast(p_retailprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,6))), 2) as decimal(18,2))
when l_returnflag = 'A' then cast(p_retailprice as decimal(18,2)) end::double as amount,
case when l_returnflag = 'N' then 'DirectAwardAmount' when l_returnflag = 'A' and l_tax > 0 then 'InferredFromReductionRate' when l_returnflag = 'A' then 'DefaultedFromProcurementPackageAmount' else 'Unknown' end as kind
from lineitem join part on p_partkey = l_partkey""")
def price_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA5: direct, rate times base, default, unknown."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    award = F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice").cast("decimal(18,2)"))
    rate_type = F.when((F.col("l_returnflag") == "A") & (F.col("l_tax") > 0), "ReductionRate")
    null = F.lit(None)
    price = F.col("p_retailprice").cast("decimal(18,2)")
    package = F.when(F.col("l_returnflag") == "A", "1").otherwise("")
    decided = price_decision(award, null, null, F.lit(0), rate_type, F.col("l_discount").cast("decimal(18,6)"), price, null, null, package)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return rows.select(*keys, decided.alias("d")).select(*keys, F.col("d.amount").cast("double").alias("amount"), "d.kind")


@query("""with r as (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1), s as (select o_orderkey, greatest(0, least(100,
45 + case when o_totalprice >= 1000000 then 30 when o_totalprice >= 300000 then 20 when o_totalprice >= 100000 then 10 else 0 end - least(20, coalesce(n, 0) * 8))) as score from orders left join r on l_orderkey = o_orderkey)
select o_orderkey, cast(score as double) as score, case when score >= 75 then 'High' when score >= 50 then 'Medium' else 'Low' end as level from s""")
def value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA3: worth less risk."""
    risks = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(risks, "o_orderkey", "left")
    return rows.select("o_orderkey", scoring.value_score(F.col("o_totalprice"), F.col("n")).alias("s")).select("o_orderkey", F.col("s.score").cast("double").alias("score"), "s.level")


@query("""with l as (select l_suppkey, count(*) as needed, count(*) filter (l_returnflag <> 'R') as valid, count(*) filter (l_returnflag = 'R') as missing from lineitem where l_quantity >= 45 group by 1),
b as (select s_suppkey, s_acctbal, s_nationkey, coalesce(needed, 0) as needed, coalesce(valid, 0) as valid, coalesce(missing, 0) as missing from supplier left join l on l_suppkey = s_suppkey),
s as (select *, greatest(0, least(100, round_even(20 + case when s_nationkey % 3 = 0 then 25 else 8 end + case when s_nationkey < 10 then 10 else 3 end + greatest(0, least(100, cast(floor(s_acctbal / 100) as decimal(10,2)))) / 10
+ case when needed = 0 then 25 else round_even(cast(30 as decimal(10,4)) * valid / needed, 2) end, 2))) as score from b)
select s_suppkey, cast(score as double) as score, case when score >= 75 and missing = 0 then 'High' when score >= 50 then 'Medium' else 'Low' end as level,
case when score >= 70 and missing = 0 then 'Candidate' when score >= 50 then 'Caution' else 'NotRecommended' end as recommendation,
concat_ws(',', case when s_nationkey % 3 <> 0 then 'CategoryMismatch' end, case when s_nationkey >= 10 then 'RegionMismatch' end, case when missing > 0 then 'MissingEvidence' end) as flags from s""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA1: a supplier's score, level, advice and flags."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    proof = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("needed"), F.count_if(F.col("l_returnflag") != "R").alias("valid"), F.count_if(F.col("l_returnflag") == "R").alias("missing"))
    rows = table(spark, sf_dir, "supplier").join(proof, "s_suppkey", "left").fillna(0, ["needed", "valid", "missing"])
    zero = F.lit(0)
    score = scoring.supplier_match(
        F.lit("category"), F.col("s_nationkey") % 3 == 0, F.lit(1), F.col("s_nationkey") < 10, F.floor(F.col("s_acctbal") / 100), F.col("needed"), F.col("valid"), F.col("missing"), zero, zero
    )
    return rows.select("s_suppkey", score.alias("s")).select("s_suppkey", F.col("s.score").cast("double").alias("score"), "s.level", "s.recommendation", "s.flags")


@query("""with s as (select o_orderkey, (case when o_orderkey % 2 = 0 then 450 else 0 end + case when o_orderkey % 3 = 0 then 220 else 0 end + case when o_orderkey % 5 = 0 then 120 else 0 end
+ case when o_orderkey % 7 = 0 then 130 else 0 end + case when o_orderstatus = 'F' then 120 when o_orderstatus = 'O' then 100 else 0 end + case when o_orderstatus = 'F' and o_orderkey % 11 = 0 then 80 else 0 end) as base,
o_orderdate <= timestamp '2000-01-01' as early from orders), t as (select o_orderkey, case when early then base + 80 else greatest(0, base - 150) end as total from s)
select o_orderkey, least(1000, total) / 1000 as confidence, case when total >= 750 then 'High' when total >= 450 then 'Medium' else 'Low' end as level from t""")
def notice_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA6: weighted evidence, less if published too late."""
    k = F.col("o_orderkey")
    stage = F.when(F.col("o_orderstatus") == "F", "Candidate").when(F.col("o_orderstatus") == "O", "Tender")
    m = scoring.notice_match(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 11 == 0, stage, F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m.confidence").cast("double").alias("confidence"), "m.level")


ISSUE_RULES = [
    ("AmountTooSmall", "Medium", "o_totalprice", "o_totalprice < 1000"),
    ("AmountTooLarge", "High", "o_totalprice", "o_totalprice > 400000"),
    ("StillOpen", "Low", "o_orderstatus", "o_orderstatus = 'O'"),
    ("MissingLotOrPackage", "High", "o_orderpriority", "o_orderpriority = '5-LOW' and o_orderstatus = 'P'"),
    ("Urgent", "Medium", "o_orderpriority", "o_orderpriority = '1-URGENT'"),
]
ISSUES = " union all ".join(f"select o_orderkey, '{t}' as issue_type, '{s}' as severity, '{f}' as field from orders where {c}" for t, s, f, c in ISSUE_RULES)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.quality_issues(table(spark, sf_dir, "orders"), "o_orderkey", [(t, s, f, F.expr(c)) for t, s, f, c in ISSUE_RULES])


@query(ISSUES)
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA9, DA10: rules broken, as rows, in one scan."""
    return _issues(spark, sf_dir)


@query(f"""with i as ({ISSUES}), a as (select o_orderkey, sum(case severity when 'High' then 30 when 'Medium' then 15 else 5 end) as lost, count(*) as n, count(*) filter (severity = 'High') as high,
count(*) filter (severity = 'Medium') as medium, count(*) filter (issue_type = 'MissingLotOrPackage') as again from i group by 1),
s as (select o.o_orderkey, greatest(0, 100 - coalesce(lost, 0)) as score, coalesce(n, 0) as n, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(again, 0) as again from orders o left join a using (o_orderkey)),
r as (select *, case when score < 60 or high > 0 then 'High' when score < 85 or medium > 0 then 'Medium' else 'Low' end as risk from s)
select o_orderkey, score, risk, n as issue_count, high as high_count, case when risk = 'Low' then 'BatchConfirmCandidate' when risk = 'High' and again > 0 then 'NeedsReparse' else 'NeedsReview' end as recommendation from r""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA9: score, risk and advice for every row."""
    return scoring.quality_score(table(spark, sf_dir, "orders").select("o_orderkey"), _issues(spark, sf_dir), "o_orderkey", ["MissingLotOrPackage"])


@query("""with n as (select distinct p_name, regexp_replace(p_name, '[\\s[:punct:]]', '', 'g') as k from part), p as (select a.p_name as a, b.p_name as b, a.k as x, b.k as y from n a join n b on a.p_name < b.p_name and len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0)
select a, b, case when lower(x) = lower(y) then 1.0 when contains(lower(x), lower(y)) or contains(lower(y), lower(x)) then 0.88
else round(len(list_intersect(string_split(x, ''), string_split(y, ''))) / greatest(length(x), length(y)), 6) end as similarity from p""")
def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC21, SE4, JN17: shared characters of distinct names that share a word, which is the block."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("word", F.explode(F.array_distinct(F.split("p_name", " "))))
    pairs = J.pairs_in_block(names, ["word"], "p_name", []).select("p_name_a", "p_name_b").distinct()
    return pairs.select(F.col("p_name_a").alias("a"), F.col("p_name_b").alias("b"), F.round(text.similarity(F.col("p_name_a"), F.col("p_name_b")), 6).alias("similarity"))


@query("select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC25."""
    return table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("hash"))


@query("""select page_id, sha256(rtrim(lower(regexp_extract(url, '^([^?#]*)', 1)), '/') || case when regexp_extract(url, '\\?([^#]*)', 1) <> '' then '?' || regexp_extract(url, '\\?([^#]*)', 1) else '' end
|| case when regexp_extract(url, '#(.*)$', 1) <> '' then '#' || regexp_extract(url, '#(.*)$', 1) else '' end) as hash from pages""")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC26."""
    return table(spark, sf_dir, "pages").select("page_id", hashing.url_hash(F.col("url")).alias("hash"))


@query("select o_orderkey, sha256(concat_ws(chr(31), cast(o_custkey as varchar), trim(o_orderstatus), trim(o_orderpriority), '')) as hash from orders")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC27, JN18."""
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.source_hash(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None)).alias("hash"))


@query("""select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
'&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')) as text from pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: tags off, entities decoded, blanks joined."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


MASKED = r"""with t as (select doc_id, coalesce(text, '') || ' 139' || lpad(cast(doc_id % 100000000 as varchar), 8, '0') || ',1101011990' || lpad(cast(doc_id % 10000000 as varchar), 7, '0') || 'X;' || repeat('7', cast(12 + doc_id % 9 as int)) || '.' as t from documents),
e as (select doc_id, regexp_replace(t, '(?i)([A-Z0-9._%+-])[A-Z0-9._%+-]{0,63}(@[A-Z0-9.-]+\.[A-Z]{2,})', '\1***\2', 'g') as t from t),
p as (select doc_id, regexp_replace(t, '(^|[^0-9])(1[3-9]\d)\d{4}(\d{4})($|[^0-9])', '\1\2****\3\4', 'g') as t from e),
p2 as (select doc_id, regexp_replace(t, '(^|[^0-9])(1[3-9]\d)\d{4}(\d{4})($|[^0-9])', '\1\2****\3\4', 'g') as t from p),
i as (select doc_id, regexp_replace(t, '\b(\d{6})\d{8}(\d{3}[\dXx])\b', '\1********\2', 'g') as t from p2),
b as (select doc_id, regexp_replace(t, '\b(\d{4})\d{7,11}(\d{4})\b', '\1********\2', 'g') as t from i),
s as (select doc_id, regexp_replace(t, '(?i)((?:password|passwd|pwd|token|secret|api[-_]?key)\s*[:=])\s*[^,\s;}]+', '\1***REDACTED***', 'g') as t from b)
select doc_id, regexp_replace(t, '\b\d{15,19}\b|\b\d{17}[\dXx]\b', '***REDACTED***', 'g') as masked from s""".replace("\\\\", "\\")


@query(MASKED)
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC29: all six rules over every text, with a phone, an identity card and a card number set behind each."""
    n = F.col("doc_id")
    digits = lambda k: F.lpad((n % 10**k).cast("string"), k, "0")
    x = F.concat(F.coalesce("text", F.lit("")), F.lit(" 139"), digits(8), F.lit(",1101011990"), digits(7), F.lit("X;"), F.repeat(F.lit("7"), (n % 9 + 12).cast("int")), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", masking.mask_text(x).alias("masked"))


@query("""select doc_id, token, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s*(?:%|元|万)')) as token from documents) group by 1, 2""")
def amount_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10 without offsets: amounts and percents in texts."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?\s*(?:%|元|万)"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("select doc_id, (doc_id % 100 / 100.0)::double as rate from documents")
def rates_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9: the rate of texts whose first number is a percentage, set before each whole text."""
    x = F.concat(F.lit("占比 "), F.col("doc_id") % 100, F.lit("% "), F.coalesce("text", F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", parse_rate(x).alias("r")).filter("r.rate_type = 'Unknown'")
    return found.select("doc_id", F.col("r.rate_value").cast("double").alias("rate"))


@query("select min(doc_id) as doc_id, hash, count(*) as copies from (select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as hash from documents) group by hash")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6, SC25: one id per content."""
    rows = table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""with o as (select o_orderkey, o_custkey, o_orderpriority, date_trunc('month', o_orderdate) as m from orders), j as (select *, lag(m) over w as was from o window w as (partition by o_custkey, o_orderpriority order by m, o_orderkey)),
g as (select *, sum(case when was is null or m > was + interval 1 month then 1 else 0 end) over (partition by o_custkey, o_orderpriority order by m, o_orderkey) as grp from j)
select node, label from (select o_orderkey as node, min(o_orderkey) over w as label, count(*) over w as n from g window w as (partition by o_custkey, o_orderpriority, grp)) where n > 1""")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA11: orders of a customer and priority that follow each other within a month merge: neighbours by month are the links, never all pairs."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("month", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.trunc("o_orderdate", "MM").alias("month"))
    chained = orders.select("o_orderkey", "month", F.lag("o_orderkey").over(w).alias("before"), F.lag("month").over(w).alias("was"))
    return J.components(chained.filter(F.months_between("month", "was") <= 1), "before", "o_orderkey")


@query("""with old as (select doc_id as id, sha256(coalesce(text, '')) as h, source from documents where source <> 'src1'), new as (select doc_id as id, sha256(coalesce(text, '') || case when lang = 'de' then '!' else '' end) as h,
case when lang = 'fr' then 'moved' else source end as source from documents)
select new.id, case when old.id is null then 'Created' when old.h <> new.h then 'Changed' when old.source <> new.source then 'IdentityUpdated' else 'Refreshed' end as outcome from new left join old using (id)""")
def upsert_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG3: what a full load does to each row of a table that lacks one source."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    old = docs.filter("source <> 'src1'").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), "source")
    changed = F.concat("text", F.when(F.col("lang") == "de", "!").otherwise(""))
    new = docs.select(F.col("doc_id").alias("id"), F.sha2(changed, 256).alias("h"), F.when(F.col("lang") == "fr", "moved").otherwise(F.col("source")).alias("source"))
    return classify_upsert(new, old, "id", "h", ["source"]).select("id", "outcome")


@query("""with k as (select *, 'Lot ' || o_orderstatus || ' of project ' || o_custkey % 9 as name, 'P' || o_custkey % 9 as project from orders),
t as (select * from k where o_orderkey = (select min(o_orderkey) from orders where o_orderpriority = '1-URGENT')),
w as (select unnest(list_filter(string_split(name, ' '), lambda x: length(x) >= 2)) as word from t),
c as (select o.o_custkey, o.o_orderkey, o.o_totalprice, least(100,
(case when o.o_orderpriority = t.o_orderpriority then 35 else 0 end) + (case when o.o_orderstatus = t.o_orderstatus then 25 else 0 end) + (case when year(o.o_orderdate) = year(t.o_orderdate) then 35 else 0 end)
+ (case when exists (select 1 from w where contains(lower(o.name || ' ' || o.o_orderpriority), lower(word)) and word not in ('Lot', 'of', 'project')) then 20 else 0 end) + (case when o.project = t.project then 10 else 0 end) + (case when o.o_orderstatus = 'F' then 5 else 0 end)) as s
from k o, t where o.o_orderkey <> t.o_orderkey), r as (select *, row_number() over (partition by o_custkey order by s desc, o_totalprice desc, o_orderkey) as rn from c where s > 0)
select o_custkey, o_orderkey, s / 100 as score from r where rn = 1 order by s desc, o_totalprice desc, o_orderkey limit 50""")
def historical_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA15: score of all six terms against one package (one row), best per supplier, top 50."""
    c = F.col
    project = (c("o_custkey") % 9).cast("string")
    orders = table(spark, sf_dir, "orders").withColumns({"name": F.concat(F.lit("Lot "), "o_orderstatus", F.lit(" of project "), project), "project": F.concat(F.lit("P"), project), "year": F.year("o_orderdate")})
    target = orders.filter("o_orderpriority = '1-URGENT'").orderBy("o_orderkey").limit(1)
    words = F.filter(text.keywords(c("name")), lambda w: ~w.isin("Lot", "of", "project"))
    t = target.select(c("o_orderkey").alias("t_key"), c("o_orderpriority").alias("t_priority"), c("o_orderstatus").alias("t_status"), c("year").alias("t_year"), words.alias("t_words"), c("project").alias("t_project"))
    rows = orders.join(F.broadcast(t), c("o_orderkey") != c("t_key"))
    said = F.lower(F.concat_ws(" ", "name", "o_orderpriority"))
    keyword = F.exists("t_words", lambda w: F.contains(said, F.lower(w)))
    score = scoring.lead_score(c("o_orderpriority") == c("t_priority"), c("o_orderstatus") == c("t_status"), c("year") == c("t_year"), keyword, c("project") == c("t_project"), c("o_orderstatus") == "F")
    rows = rows.withColumn("score", score).filter("score > 0")
    best = rows.groupBy("o_custkey").agg(F.max(F.struct("score", "o_totalprice", -F.col("o_orderkey"))).alias("m")).select("o_custkey", "m.score", "m.o_totalprice", (-F.col("m.col3")).alias("o_orderkey"))
    return best.orderBy(F.desc("score"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_custkey", "o_orderkey", F.col("score").cast("double").alias("score"))


@query("""select user_id, case when n_error > 0 and (last_ok is null or last_error >= last_ok) then 'Failed' when last_ok is null then 'NeverSucceeded'
when date_diff('second', last_ok, timestamp '2024-01-30') / 60.0 > 2880 then 'Stale' when date_diff('second', last_ok, timestamp '2024-01-30') / 60.0 >= 1440 then 'Due' else 'Healthy' end as health
from (select user_id, count(*) filter (event_type = 'error') as n_error, max(ts) filter (event_type = 'error') as last_error, max(ts) filter (event_type = 'purchase') as last_ok from events group by 1)""")
def channel_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA18, FIL17: ordered rules over the latest success and failure."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("bad"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("ok")
    )
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    minutes = (F.unix_seconds(F.lit("2024-01-30 00:00:00").cast("timestamp")) - seconds(F.col("ok"))) / 60
    health = (
        F.when(F.col("bad").isNotNull() & (F.col("ok").isNull() | (F.col("bad") >= F.col("ok"))), "Failed")
        .when(F.col("ok").isNull(), "NeverSucceeded").when(minutes > 2880, "Stale").when(minutes >= 1440, "Due").otherwise("Healthy")
    )
    return rows.select("user_id", health.alias("health"))


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, (l_orderkey + l_linenumber) % 9 as m, cast(l_extendedprice as decimal(18,2)) as p, cast(l_discount as decimal(18,6)) as d, l_partkey % 2 = 0 as e from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, case m when 0 then 'DirectAwardAmount' when 1 then 'CandidateFinalQuote' when 2 then 'CandidateFinalQuote' when 5 then 'InferredFromReductionRate' when 6 then 'InferredFromCoefficient' when 8 then 'DefaultedFromProcurementPackageAmount' else 'Unknown' end as kind,
case m when 1 then 'CandidateNotice' when 2 then 'CandidateNotice' when 3 then 'Unknown' when 8 then 'TenderNotice' else 'AwardNotice' end as stage, (case m when 0 then p when 1 then p + 1 when 2 then p + 1 when 5 then round_even(p * (1 - d), 2) when 6 then round_even(p * d, 2) when 8 then p end)::double as amount,
case m when 5 then 'PackageGuidePrice' when 6 then 'PackageMaxPrice' when 8 then case when e then 'PackageBudget' else 'PackageMaxPrice' end else 'Unknown' end as base_type, (case m when 0 then 0.98 when 1 then 0.95 when 2 then 0.88 when 5 then 0.84 when 6 then 0.78 when 8 then 0.72 else 0 end)::double as confidence,
m not in (0, 1) as needs_review from r""")
def price_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA5: all seven rules: direct award, quotes by rank or by a single match, unclear rates, inferred from guide or ceiling, default, baseless, nothing."""
    m = (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    p, none = F.col("l_extendedprice").cast("decimal(18,2)"), F.lit(None)
    even = F.col("l_partkey") % 2 == 0
    on = lambda *k: m.isin(*k)
    decided = price_decision(
        F.when(on(0), p), F.when(on(1, 2, 3), p + 1), F.when(on(1), 1).when(on(2, 3), 2), F.when(on(2), 1).otherwise(2), F.when(on(4), "Unknown").when(on(5), "ReductionRate").when(on(6), "Coefficient").when(on(7), "DiscountRate"), F.col("l_discount").cast("decimal(18,6)"),
        F.when(on(5), p).otherwise(none), F.when(on(6) | on(5) | (on(8)), p), F.when(on(8) & even, p), F.when(on(5, 6, 8), "1").otherwise(" "),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", decided.alias("d"))
    keys = rows.columns[:-1]
    return rows.select(*keys, "d.kind", "d.stage", F.col("d.amount").cast("double").alias("amount"), "d.base_type", F.col("d.confidence").cast("double").alias("confidence"), "d.needs_review")


RECORDS = """with b as (select l_orderkey as notice, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, ['ai', 'pdf', 'text'][l_partkey % 3 + 1] as source, case when l_returnflag = 'N' then 'Awarded' else 'Candidate' end as outcome_type,
  case when l_partkey % 2 = 1 then l_suppkey % 2 + 1 end as rank, 'S' || l_suppkey % 2 || '电力有限公司' as supplier, case when l_partkey % 4 > 0 then cast(l_linenumber % 2 as varchar) end as package_no, case when l_suppkey % 3 > 0 then cast(l_suppkey % 3 as varchar) end as sequence_no, l_partkey % 2 as page,
  'row ' || l_suppkey % 3 || ' of the evidence' as evidence, case when l_partkey % 5 > 2 then 'L' || l_linenumber % 2 end as lot_no, case when l_quantity % 3 > 0 then cast(l_quantity % 3 as decimal(18,2)) end as amount, l_partkey % 3 * 30 as trust, l_suppkey * 7 % 100 as strength, cast(l_tax as decimal(5,4)) as confidence from lineitem),
p as (select x.id as x, y.id as y from b x join b y on x.notice = y.notice and x.id < y.id where x.outcome_type = y.outcome_type and x.supplier = y.supplier and coalesce(x.rank = y.rank, true) and coalesce(x.package_no = y.package_no, true) and coalesce(x.lot_no = y.lot_no, true)
  and 40 + 25 + 15 + 10 + case when x.package_no = y.package_no then 25 else 0 end + case when x.sequence_no = y.sequence_no and x.page = y.page then 30 else 0 end + case when x.evidence = y.evidence then 30 else 0 end + case when abs(x.amount - y.amount) < 0.01 then 10 else 0 end + case when x.page = y.page then 10 else 0 end
  >= case when (x.source = 'ai' and y.source = 'pdf') or (x.source = 'pdf' and y.source = 'ai') then 65 when 'ai' in (x.source, y.source) or 'pdf' in (x.source, y.source) then 70 else 85 end),
"""


@query("with recursive " + RECORDS[5:] + """e as (select x, y from p union all select y, x from p), r as (select id as node, id as label from b union select e.y, r.label from r join e on e.x = r.node), g as (select node, min(label) as grp from r group by 1),
t as (select b.*, grp, row_number() over (partition by grp order by trust desc, strength desc, lot_no is not null desc, package_no is not null desc, amount is not null desc, confidence desc, id) as place, row_number() over (partition by grp order by strength desc, id) as turn from b join g on node = id),
f as (select grp, count(*) as members, arg_min(rank, turn) filter (rank is not null) as rank, arg_min(package_no, turn) filter (package_no is not null) as package_no, arg_min(lot_no, turn) filter (lot_no is not null) as lot_no, arg_min(amount, turn) filter (amount is not null) as amount from t group by 1)
select t.notice, t.id, f.members, coalesce(t.rank, f.rank) as rank, coalesce(t.package_no, f.package_no) as package_no, coalesce(t.lot_no, f.lot_no) as lot_no, coalesce(t.amount, f.amount)::double as amount from t join f using (grp) where place = 1""")
def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DA11: records of a notice that tell of one outcome: scored pairs over their threshold, components, a survivor, its gaps filled."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    c = F.col
    text_if = lambda condition, x: F.when(condition, x.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("notice"), (c("l_orderkey") * 1000 + i).alias("id"), F.get(F.array(F.lit("ai"), F.lit("pdf"), F.lit("text")), (c("l_partkey") % 3).cast("int")).alias("source"), F.when(c("l_returnflag") == "N", "Awarded").otherwise("Candidate").alias("outcome_type"),
        F.when(c("l_partkey") % 2 == 1, c("l_suppkey") % 2 + 1).alias("rank"), F.concat(F.lit("S"), c("l_suppkey") % 2, F.lit("电力有限公司")).alias("supplier"), text_if(c("l_partkey") % 4 > 0, c("l_linenumber") % 2).alias("package_no"), text_if(c("l_suppkey") % 3 > 0, c("l_suppkey") % 3).alias("sequence_no"),
        (c("l_partkey") % 2).alias("page"), F.concat(F.lit("row "), c("l_suppkey") % 3, F.lit(" of the evidence")).alias("evidence"), F.when(c("l_partkey") % 5 > 2, F.concat(F.lit("L"), c("l_linenumber") % 2)).alias("lot_no"), F.lit(None).cast("string").alias("lot_name"),
        F.when(c("l_quantity") % 3 > 0, (c("l_quantity") % 3).cast("decimal(18,2)")).alias("amount"), (c("l_partkey") % 3 * 30).alias("trust"), (c("l_suppkey") * 7 % 100).alias("strength"), c("l_tax").cast("decimal(5,4)").alias("confidence"),
    )
    there = lambda x: c(x).isNotNull().desc()
    best = [F.desc("trust"), F.desc("strength"), there("lot_no"), there("package_no"), there("amount"), F.desc("confidence"), c("id")]
    merged = merging.merge_records(merging.with_keys(rows), ["notice", "outcome_type"], "id", [*merging.COMPARED, merging.SUPPLIER_KEY], merging.outcome_pair_score(), merging.outcome_threshold(), best, ["rank", "package_no", "lot_no", "amount"], [F.desc("strength"), c("id")], "members")
    return merged.select("notice", "id", "members", "rank", "package_no", "lot_no", c("amount").cast("double").alias("amount"))


SIMILAR = """with n as (select distinct p_size, regexp_replace(p_name || p_type || p_brand || p_container, '[\\s[:punct:]]', '', 'g') as k from (select *, chr(cast(65 + p_partkey % 26 as int)) || chr(cast(97 + p_partkey % 19 as int)) as p_container from part)),
p as (select a.p_size, a.k as a, b.k as b, case when lower(a.k) = lower(b.k) then 1.0 when contains(lower(a.k), lower(b.k)) or contains(lower(b.k), lower(a.k)) then 0.88
else len(list_intersect(string_split(a.k, ''), string_split(b.k, ''))) / greatest(length(a.k), length(b.k)) end as score from n a join n b on a.p_size = b.p_size and a.k < b.k)
select p_size, a, b, round(score, 6) as score from p where score >= 0.6"""


@query(SIMILAR)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12, SC21: all pairs of like names of a group, compared cell by cell."""
    n = F.col("p_partkey")
    ends = F.concat(F.chr(65 + n % 26), F.chr(97 + n % 19))
    names = table(spark, sf_dir, "part").select("p_size", text.name_core(F.concat("p_name", "p_type", "p_brand", ends)).alias("k"))
    pairs = J.similar_within(names, ["p_size"], "k", 0.6)
    return pairs.select("p_size", "a", "b", F.round("score", 6).alias("score"))


@query("""with r as (select o_orderkey as id, o_orderstatus as s, o_custkey % 50 as package, 'S' || o_custkey % 7 || '电力有限公司' as supplier, p_name || ' ' || p_brand || ' ' || p_type as name from orders join part on p_partkey = o_custkey % (select max(p_partkey) from part) + 1),
k as (select *, regexp_replace(name, '[\\s[:punct:]]', '', 'g') as k from r),
m as (select a.id as award_id, b.id as candidate_id, case when lower(a.k) = lower(b.k) then 1.0 when contains(lower(a.k), lower(b.k)) or contains(lower(b.k), lower(a.k)) then 0.88 else len(list_intersect(string_split(a.k, ''), string_split(b.k, ''))) / greatest(length(a.k), length(b.k)) end as score
from k a join k b on a.package = b.package and a.supplier = b.supplier and a.s = 'F' and b.s = 'P'),
n as (select *, row_number() over (partition by award_id order by score desc, candidate_id) as n from m where score >= 0.55)
select award_id, candidate_id, round(score, 6) as score from n where n = 1""")
def award_links_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12, JN13: the candidate of each award where no code tells: by package, compatible supplier and the likest project name."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    names = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("project_name"))
    most = part.agg(F.max("p_partkey").alias("most"))
    rows = orders.join(F.broadcast(most)).withColumn("p_partkey", F.col("o_custkey") % F.col("most") + 1).join(J.shuffled(names), "p_partkey")
    rows = rows.select(F.col("o_orderkey").alias("id"), "o_orderstatus", (F.col("o_custkey") % 50).cast("string").alias("package_no"), *[F.lit("").alias(c) for c in ("lot_no", "lot_name", "project_code")], "project_name", F.concat(F.lit("S"), F.col("o_custkey") % 7, F.lit("电力有限公司")).alias("supplier"))
    of = lambda s, key: rows.filter(F.col("o_orderstatus") == s).drop("o_orderstatus").withColumnRenamed("id", key)
    out = linkage.link(of("F", "award_id"), of("P", "candidate_id"), "award_id", "candidate_id", True)
    return out.select("award_id", F.col("o_candidate_id").alias("candidate_id"), F.round("match", 6).alias("score"))
