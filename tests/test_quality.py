"""The evaluator's rules on notices and results written out."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from marlstone.operators import quality as Q

PACKAGES = "notice_id long, package_id long, lot_no string, lot_name string, package_no string, package_name string, budget decimal(18,2), max_price decimal(18,2)"
RECORDS = "notice_id long, record_id long, supplier string, outcome_type string, rank int, lot_no string, lot_name string, package_no string, package_name string, award_amount decimal(18,2), evidence string, tender_package_id long"


def got(df):
    return sorted((r["notice_id"], r["item_id"] or 0, r["issue_type"], r["severity"], r["field"]) for r in df.collect())


def test_notices(spark):
    notices = spark.createDataFrame([(1, "采购公告", "P-1"), (2, "其他", None), (3, "Tender", "unknown"), (4, "其他", "x")], "notice_id long, notice_type string, project_code string")
    packages = spark.createDataFrame(
        [(1, 11, "A", None, "1", "n", None, None), (1, 12, " a ", None, "1", "n", None, None), (1, 13, None, "无", "2", "n", D(7), None), (1, 14, "-", None, "2", "", None, None)],
        PACKAGES,
    )
    asked = spark.createDataFrame([(1, "PERSONNEL", None), (1, None, "须提供资质证书")], "notice_id long, requirement_type string, original_text string")
    details = spark.createDataFrame(
        [(1, 21, None, '{"预算（万元）": "1,234.5", "金额(万元)": 3}', D("1234.5")), (1, 22, None, '{"预算（万元）": "3"}', D(30000)), (1, 23, 13, '{"费率": "7%"}', D(9)), (1, 24, None, "no json", D(9)), (4, 25, None, " ", None)],
        "notice_id long, detail_id long, package_id long, original_row string, amount decimal(18,2)",
    )
    assert got(Q.notice_issues(notices, packages, asked, details, ["amount"])) == sorted([
        (1, 0, "MissingPerformanceRequirement", "Low", "requirements"), (1, 0, "DuplicatePackageIdentity", "High", "package_no"), (1, 0, "DuplicatePackageIdentity", "High", "package_no"),
        (1, 13, "MissingLotOrPackage", "Medium", "lot_no"), (1, 14, "MissingLotOrPackage", "Medium", "lot_no"), (1, 14, "MissingLotOrPackage", "Medium", "package_name"), (1, 23, "RateOrDiscountInAmountColumn", "High", "budget"),
        (1, 21, "AmbiguousAmountUnit", "High", "amount"),
        (3, 0, "MissingProjectCode", "Medium", "project_code"), (3, 0, "MissingLotOrPackage", "High", "packages"), (3, 0, "MissingQualificationRequirement", "Medium", "requirements"),
        (4, 0, "MissingLotOrPackage", "High", "packages"), (4, 0, "MissingQualificationRequirement", "Medium", "requirements"), (4, 0, "OriginalEvidenceMissing", "Medium", "original_row"),
    ])


def test_results(spark):
    notices = spark.createDataFrame([(1, "公示", "候选人"), (2, "结果公告", ""), (3, "公告", "其他"), (4, "成交", "")], "notice_id long, notice_type string, title string")
    packages = spark.createDataFrame([(1, 11, "A", "", "1", "甲包", None, None), (1, 12, "B", "", "1", "乙包", None, None), (1, 13, "C", "", "2", "丙包", None, None)], PACKAGES)
    records = spark.createDataFrame(
        [
            (1, 1, "S", "candidate", 1, "", "", "1", "", D(5), "5万元", None), (1, 2, "无", "Awarded", None, "b", "", "1", "", D("97.5"), "折扣率 97.5", None), (1, 3, "S", "Candidate", None, "", "", "", "丙 包", D(5), "5元", None),
            (1, 4, "S", "Awarded", None, "", "", "", "", None, "5万元", None), (1, 5, "S", "Awarded", None, "", "", "9", "", D(50000), "共5 万元", 13), (2, 6, "S", "Candidate", None, "", "", "9", "", D(5), "5%", None),
        ],
        RECORDS,
    )
    assert got(Q.outcome_issues(notices, records, packages)) == sorted([
        (4, 0, "OriginalEvidenceMissing", "High", "outcome_suppliers"),
        (1, 1, "LifecycleMatchConflict", "High", "package_no"), (1, 1, "AmbiguousAmountUnit", "High", "award_amount"),
        (1, 2, "MissingSupplierName", "High", "supplier"), (1, 2, "RateOrDiscountInAmountColumn", "High", "award_amount"),
        (1, 3, "MissingLotOrPackage", "High", "package_no"), (1, 3, "MissingCandidateRank", "Medium", "rank"),
        (1, 4, "MissingLotOrPackage", "High", "package_no"), (1, 4, "LifecycleMatchMissing", "Medium", "package_no"),
        (2, 6, "RateOrDiscountInAmountColumn", "High", "award_amount"),
    ])
    assert Q.outcome_issues(notices.limit(0), records.limit(0), packages.limit(0)).agg(F.count("*")).first()[0] == 0
