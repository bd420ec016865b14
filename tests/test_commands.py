"""Commands as merges: promotion of trees, amounts, retries, inferred links, organisations."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from marlstone.operators import merging, search
from marlstone.streaming import commands as C


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_a_tree_is_promoted_once(spark):
    tree = "staging_id long, parent_id long"
    notices, packages, asked = spark.createDataFrame([(1, 50), (2, 50), (3, 51)], tree), spark.createDataFrame([(11, 1), (12, 2), (13, 3), (14, 1)], tree), spark.createDataFrame([(21, 11), (22, 12), (23, 14), (24, 99)], tree)
    formal = spark.createDataFrame([(51,)], "raw_id long")
    n, p, q = C.promoted_tree(notices, packages, asked, formal, {"notices": 7, "packages": 0, "requirements": 40})
    assert rows(n, "staging_id", "formal_parent_id", "id") == [(1, 50, 8)]
    assert rows(p, "staging_id", "formal_parent_id", "id") == [(11, 8, 1), (14, 8, 2)]
    assert rows(q, "staging_id", "formal_parent_id", "id") == [(21, 1, 41), (23, 2, 42)]
    again = C.promoted_tree(notices, packages, asked, spark.createDataFrame([(50,), (51,)], "raw_id long"), {"notices": 0, "packages": 0, "requirements": 0})
    assert [f.count() for f in again] == [0, 0, 0]


def test_amount_actions(spark):
    schema = "id long, link_id long, amount_type string, amount_value decimal(18,2), status string, reject_reason string, confidence decimal(5,4)"
    cands = spark.createDataFrame([(1, 7, "DealAmount", D(5), "Selected", None, D("0.5")), (2, 7, "Unknown", D(6), "Unresolved", "r", D("0.99")), (3, 8, "Deposit", D(7), "Selected", None, D("0.1")), (4, 8, "BidQuote", D(8), "Rejected", "old", D("0.1"))], schema)
    acts = spark.createDataFrame([(1, 1, "Reject", None, "bad"), (2, 1, "Reject", None, "x"), (2, 2, "MarkType", "BidQuote", None), (3, 1, "MarkType", "BidQuote", None), (4, 1, "Restore", None, None), (9, 1, "Reject", None, "x")], "id long, ordinal int, action string, amount_type string, reason string")
    links = spark.createDataFrame([(7, D(5), "Manual"), (8, D(7), "Manual")], "link_id long, final_amount decimal(18,2), final_source string")
    out, after = C.amount_actions(cands, acts, links)
    assert rows(out, "id", "amount_type", "status", "reject_reason", "confidence") == [(1, "DealAmount", "Rejected", "bad", D("0.5000")), (2, "BidQuote", "Recommended", None, D("0.9900")), (3, "BidQuote", "Selected", None, D("0.9000")), (4, "BidQuote", "Recommended", None, D("0.1000"))]
    assert rows(after, "link_id", "final_amount", "final_source") == [(7, None, "Missing"), (8, D("7.00"), "Manual")]


JOBS = "id long, job_type string, queue string, payload string, result string, deduplication_key string, source_module string, business_type string, business_id long, correlation_id string"


def test_links_are_inferred(spark):
    def link(payload=None, result=None, key=None, job_type="tenders.x", queue="q", module=None, kind=None, id_=None, correlation=None):
        df = spark.createDataFrame([(1, job_type, queue, payload, result, key, module, kind, id_, correlation)], JOBS)
        return tuple(C.inferred_links(df, "Tenders").select("source_module", "business_type", "business_id", "correlation_id").first())

    assert link('{"a":[{"rawNoticeId":"12"}],"RawNoticeId":13}') == ("Tenders", "RawNotice", 12, "12")
    assert link('{"rawNoticeId":-3,"x":{"rawNoticeId":007}}') == ("Tenders", None, None, None)  # no JSON: a number with leading zeros
    assert link('{"rawNoticeId":"x"}', key="tenders:structured-parse:t:2:34:5") == ("Tenders", "RawNotice", 34, "34")
    assert link(key="tenders:manual-reparse:t:0:raw:9") == ("Tenders", "RawNotice", 9, "9")
    assert link(key="else:manual-reparse:t:5") == ("Tenders", None, None, None)
    assert link(result="rawNoticeId=44, done") == ("Tenders", "RawNotice", 44, "44")
    assert link(result="myrawNoticeId=44") == ("Tenders", None, None, None)
    assert link('{"rawNoticeId":1}', job_type="x", module="Other") == ("Other", None, None, None)
    assert link('{"rawNoticeId":1}', id_=5, kind=" K ", correlation="c") == ("Tenders", "K", 5, "c")


def test_backfill_goes_on_behind_its_last_batch(spark):
    df = spark.createDataFrame([(i, "tenders.x", "q", f'{{"rawNoticeId":{i}}}', None, None, None, None, None, None) for i in range(1, 8)], JOBS)
    seen, at = [], 0
    while at is not None:
        changed, at = C.backfill_batch(df, "Tenders", at, 3)
        seen.append(rows(changed, "id", "business_id"))
    assert seen == [[(1, 1), (2, 2), (3, 3)], [(4, 4), (5, 5), (6, 6)], [(7, 7)], []]


def test_retries_are_copies(spark):
    jobs = spark.createDataFrame([(1, "t", "", "k", "DeadLetter", 1, 0, 3), (2, "t", "J", None, "Pending", 1, 5, 0), (3, "t", "J", None, "Cancelled", 9, 5, 0)], "id long, job_type string, job_name string, deduplication_key string, status string, priority int, max_attempts int, attempt_count int")
    out = C.retried(jobs, jobs.select("id").union(spark.range(77, 78)), F.lit("2026-01-01").cast("timestamp_ntz"), 100, 5, 3)
    assert rows(out, "id", "original_id", "job_name", "deduplication_key", "status", "priority", "max_attempts", "attempt_count") == [(101, 1, "t", "k:retry:1", "Pending", 5, 3, 0), (102, 3, "J (manual retry)", None, "Pending", 9, 5, 0)]


def test_organisations_under_several_spellings(spark):
    seen = spark.createDataFrame([("供应商名称：甲乙有限公司", None, "c1", 1), ("甲乙有限公司。", "r2", None, 2), ("", "x", "x", 3), (None, "x", "x", 4), ("丙丁 有限公司", "r5", " ", 5)], "name string, region string, contact string, n int")
    old = spark.createDataFrame([("丙丁有限公司", None, "old", "c")], "match_key string, name string, region string, contact string")
    got = merging.upsert_organisations(old, seen, "name", ["region"], ["contact"], [F.desc("n")])
    assert rows(got, "match_key", "name", "region", "contact") == [("丙丁有限公司", "丙丁 有限公司", "old", "c"), ("甲乙有限公司", "甲乙有限公司。", "r2", "c1")]


def test_cells_by_name(spark):
    df = spark.createDataFrame([(1, "x")], "Id long, name string").select(F.struct("*").alias("r"))
    pick = lambda wanted: df.select(search.cell_text(F.col("r"), ["Id", "name"], wanted)).first()[0]
    assert [pick(w) for w in ("name", "NAME", "id", "none")] == ["x", "x", "1", ""]
