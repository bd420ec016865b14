"""The review of parsed notices and of their results: which of the evaluator's rules each breaks.

Every rule is a condition over a notice, its packages, requirements, details or result records; issues of one kind of row are made in one pass,
rules over groups (duplicates, coverage, matches) are partial aggregates by notice. No notice is gathered: its children stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import read_decimal
from ..functions.text import contains_any

# Markers of missing values and words of the documents' language.
MISSING = ["UNSPECIFIED", "UNKNOWN", "N/A", "NA", "NULL", "-", "/", "未识别", "无"]
PROCUREMENT_TYPES = ["PROCUREMENT", "TENDER", "采购", "招标"]
RESULT_WORDS = ["Award", "Result", "Candidate", "Shortlist", "中标", "成交", "结果", "候选", "入围"]
CANDIDATE_WORDS = ["Candidate", "Shortlist", "候选", "入围"]
COVERED = {"Qualification": ["资质", "资格", "许可证", "证书"], "Performance": ["业绩", "合同案例", "类似项目"], "Personnel": ["人员", "项目负责人", "负责人", "项目经理"]}
RATE_WORDS = ["%", "％", "折扣", "费率", "税率", "比例", "权重", "评分", "价格参数"]
MONEY_WORDS = ["金额", "限价", "预算", "估算", "报价", "保证金", "价格"]
TEN_THOUSANDS = ["万元", "万人民币", "金额(万", "金额（万", "限价(万", "限价（万"]
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
REPARSE = ["MissingLotOrPackage", "AmbiguousAmountUnit", "RateOrDiscountInAmountColumn", "OriginalEvidenceMissing", "DuplicatePackageIdentity"]
ISSUE = "struct<issue_type:string,severity:string,field:string>"


def plain(c: str | Column) -> Column:
    """A value without blanks, upper case: how keys compare."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.translate(F.trim(F.coalesce(c, F.lit(""))), " 　", ""))


def missing(c: str | Column) -> Column:
    key = plain(c)
    return (key == "") | key.isin(MISSING)


def _holds(x: Column, words: list[str]) -> Column:
    """One of the words stands in the text, ignoring case."""
    return contains_any(F.lower(F.coalesce(x, F.lit(""))), [w.lower() for w in words])


def _broken(rules: list[tuple[str, str, str, Column]]) -> Column:
    """The issues of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for t, s, f, bad in rules]))


def _issues(rows: DataFrame, item: Column, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    return rows.select("notice_id", item.cast("long").alias("item_id"), F.inline(_broken(rules)))


def _amount_suspects(rows: DataFrame, label: str, text: str, held: str) -> DataFrame:
    """rows with issue_type, field: numbers that stand in the wrong unit or field. held: array<struct<field, value>>.

    A rate whose number equals a held amount (to 0.01) stands in an amount field; a number of ten thousands that equals one
    bare, while none is ten thousand times it, was not scaled.
    """
    number = F.regexp_extract(F.replace(F.col(text), F.lit(","), F.lit("")), NUMBER, 0)
    number = read_decimal(number, "decimal(22,4)")
    flat = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(" "), F.lit(""))
    rate = _holds(F.col(label), RATE_WORDS)
    many = contains_any(flat(label), TEN_THOUSANDS) | contains_any(flat(text), TEN_THOUSANDS)
    near = lambda value: F.filter(held, lambda a: F.abs(a["value"] - value) <= F.lit(0.01).cast("decimal(4,2)"))
    met = rows.withColumns({"__n": number, "__rate": rate, "__many": many}).filter(F.col("__n").isNotNull() & (F.col("__rate") | F.col("__many")))
    met = met.withColumns({"__bare": near(F.col("__n")), "__scaled": near(F.round(F.col("__n") * 10000, 2))})
    kind = F.when(F.col("__rate"), "RateOrDiscountInAmountColumn").when(F.size("__scaled") == 0, "AmbiguousAmountUnit")
    out = met.filter(F.size("__bare") > 0).withColumns({"issue_type": kind, "severity": F.lit("High"), "field": F.col("__bare")[0]["field"]})
    return out.filter("issue_type is not null").select("notice_id", "item_id", "issue_type", "severity", "field")


def _held(fields: list[str]) -> Column:
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("decimal(22,4)").alias("value")) for f in fields])
    return F.filter(values, lambda a: a["value"] > 0)


def notice_issues(notices: DataFrame, packages: DataFrame, requirements: DataFrame, details: DataFrame, amounts: list[str]) -> DataFrame:
    """notice_id, item_id, issue_type, severity, field of procurement notices; item_id is the package or detail in question, if it is one.

    notices: notice_id, notice_type, project_code. packages: notice_id, package_id, lot_no, lot_name, package_no, package_name, budget, max_price.
    requirements: notice_id, requirement_type, original_text. details: notice_id, detail_id, package_id, original_row (JSON) and the columns `amounts`.
    Only notices with packages or details, or of a procurement type, are looked at.
    """
    none = F.lit(None).cast("long")
    counts = packages.groupBy("notice_id").agg(F.count("*").alias("n_packages"))
    lacking = details.groupBy("notice_id").agg(F.count("*").alias("n_details"), F.count_if(F.trim(F.coalesce("original_row", F.lit(""))) == "").alias("n_bare"))
    said = F.concat_ws(" ", "requirement_type", "original_text")
    has = [F.bool_or((F.lower("requirement_type") == kind.lower()) | _holds(said, words)).alias(kind) for kind, words in COVERED.items()]
    covered = requirements.groupBy("notice_id").agg(*has)
    one = notices.join(counts, "notice_id", "left").join(lacking, "notice_id", "left").join(covered, "notice_id", "left").fillna(0, ["n_packages", "n_details", "n_bare"]).fillna(False, list(COVERED))
    one = one.filter((F.col("n_packages") > 0) | (F.col("n_details") > 0) | contains_any(plain("notice_type"), PROCUREMENT_TYPES))
    lost = {k: ~F.col(k) for k in COVERED}
    all_lost = lost["Qualification"] & lost["Performance"] & lost["Personnel"]
    rules = [("MissingProjectCode", "Medium", "project_code", missing("project_code")), ("MissingLotOrPackage", "High", "packages", F.col("n_packages") == 0), ("MissingQualificationRequirement", "Medium", "requirements", all_lost)]
    rules += [(f"Missing{k}Requirement", "Low", "requirements", lost[k] & ~all_lost) for k in COVERED]
    rules.append(("OriginalEvidenceMissing", "Medium", "original_row", F.col("n_bare") > 0))
    whole = _issues(one, none, rules)
    lots = missing("lot_no") & missing("lot_name")
    each = _issues(packages, F.col("package_id"), [("MissingLotOrPackage", "Medium", "package_no", missing("package_no")), ("MissingLotOrPackage", "Medium", "package_name", missing("package_name")), ("MissingLotOrPackage", "Medium", "lot_no", lots)])
    named = packages.filter(~missing("package_no")).select("notice_id", F.when(~lots, F.concat_ws("|", plain("lot_no"), plain("lot_name"))).otherwise("").alias("lot"), plain("package_no").alias("no"))
    twice = named.groupBy("notice_id", "lot", "no").agg(F.count("*").alias("n")).filter("n > 1")
    twice = twice.select("notice_id", none.alias("item_id"), F.lit("DuplicatePackageIdentity").alias("issue_type"), F.lit("High").alias("severity"), F.lit("package_no").alias("field"))
    own = packages.select("package_id", F.col("budget").alias("__budget"), F.col("max_price").alias("__max_price"))
    cells = details.join(own, "package_id", "left").withColumn("__held", F.concat(_held(amounts), F.transform(_held(["__budget", "__max_price"]), lambda a: F.struct(F.substring(a["field"], 3, 99).alias("field"), a["value"].alias("value")))))
    cells = cells.select("notice_id", F.col("detail_id").alias("item_id"), "__held", F.explode(F.from_json("original_row", "map<string,string>")).alias("__header", "__text"))
    return whole.unionByName(each).unionByName(twice).unionByName(_amount_suspects(cells, "__header", "__text", "__held"))


def outcome_issues(notices: DataFrame, records: DataFrame, packages: DataFrame) -> DataFrame:
    """notice_id, item_id, issue_type, severity, field of result notices; item_id is the record in question.

    notices: notice_id, notice_type, title. records: notice_id, record_id, supplier, outcome_type, rank, lot_no, lot_name, package_no,
    package_name, award_amount, evidence, tender_package_id. packages: notice_id, package_id, lot_no, lot_name, package_no, package_name.
    """
    none = F.lit(None).cast("long")
    text = F.concat_ws(" ", "notice_type", "title")
    counts = records.groupBy("notice_id").agg(F.count("*").alias("n_records"))
    empty = notices.join(counts, "notice_id", "left_anti").filter(_holds(text, RESULT_WORDS))
    whole = _issues(empty, none, [("OriginalEvidenceMissing", "High", "outcome_suppliers", F.lit(True))])
    kinds = notices.select("notice_id", _holds(text, CANDIDATE_WORDS).alias("__shortlist"))
    rows = records.join(kinds, "notice_id").join(packages.select("notice_id").distinct().withColumn("__has", F.lit(True)), "notice_id", "left")
    each = _issues(
        rows,
        F.col("record_id"),
        [
            ("MissingSupplierName", "High", "supplier", missing("supplier")),
            ("MissingLotOrPackage", "High", "package_no", missing("lot_no") & missing("package_no")),
            ("MissingCandidateRank", "Medium", "rank", F.col("__shortlist") & (F.lower("outcome_type") == "candidate") & F.col("rank").isNull()),
        ],
    )
    matched = _package_matches(rows.filter(F.col("tender_package_id").isNull() & F.col("__has")), packages)
    matches = _issues(matched, F.col("record_id"), [("LifecycleMatchConflict", "High", "package_no", F.col("__n") > 1), ("LifecycleMatchMissing", "Medium", "package_no", F.col("__n") == 0)])
    numbers = records.filter("award_amount is not null and trim(coalesce(evidence, '')) <> ''")
    token = F.explode(F.regexp_extract_all("evidence", F.lit(rf"{NUMBER}\s*(?:万元|万人民币|万|元|%|％)?"), F.lit(0))).alias("__text")
    numbers = numbers.withColumn("__held", F.array(F.struct(F.lit("award_amount").alias("field"), F.col("award_amount").cast("decimal(22,4)").alias("value"))))
    numbers = numbers.select("notice_id", F.col("record_id").alias("item_id"), "__held", F.col("evidence").alias("__all"), token)
    # A rate word anywhere in the evidence makes its numbers rates, as a percent sign behind one of them does.
    label = F.when(_holds(F.col("__all"), RATE_WORDS), F.lit("%")).otherwise(F.col("__text"))
    return whole.unionByName(each).unionByName(matches).unionByName(_amount_suspects(numbers.withColumn("__label", label), "__label", "__text", "__held"))


def _package_matches(records: DataFrame, packages: DataFrame) -> DataFrame:
    """records with __n, the packages of their notice that they may mean: by number, else by name, and by what lots both tell."""
    keys = {k: plain(k) for k in ("lot_no", "lot_name", "package_no", "package_name")}
    r = records.select("notice_id", "record_id", *[v.alias(f"r_{k}") for k, v in keys.items()])
    p = packages.select("notice_id", "package_id", *[v.alias(f"p_{k}") for k, v in keys.items()])
    by_no = r.filter("r_package_no <> ''").withColumn("key", F.concat(F.lit("no:"), "r_package_no"))
    by_name = r.filter("r_package_no = '' and r_package_name <> ''").withColumn("key", F.concat(F.lit("name:"), "r_package_name"))
    each = F.array(F.concat(F.lit("no:"), "p_package_no"), F.concat(F.lit("name:"), "p_package_name"))
    both = lambda c: (F.col(f"r_{c}") != "") & (F.col(f"p_{c}") != "")
    same = lambda c: ~both(c) | (F.col(f"r_{c}") == F.col(f"p_{c}"))
    free = (F.col("r_lot_no") == "") & (F.col("r_lot_name") == "")
    met = by_no.unionByName(by_name).join(p.withColumn("key", F.explode(each)), ["notice_id", "key"]).filter(free | (same("lot_no") & same("lot_name") & (both("lot_no") | both("lot_name"))))
    found = met.groupBy("record_id").agg(F.count("*").alias("__n"))
    return records.join(found, "record_id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
