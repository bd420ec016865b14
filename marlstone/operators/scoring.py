"""Additive scores and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import RATE_OR_SCORE, TEN_THOUSAND
from ..functions.text import contains_any
from .joins import contained_pairs

SCORE = "decimal(5,2)"


def points(rules: list[tuple[Column, float]]) -> Column:
    """Sum of the weights of all rules that hold."""
    out = F.lit(0).cast("decimal(10,4)")
    for condition, weight in rules:
        out = out + F.when(F.coalesce(condition, F.lit(False)), F.lit(weight).cast("decimal(10,4)")).otherwise(F.lit(0).cast("decimal(10,4)"))
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low).cast(SCORE), F.least(F.lit(high).cast(SCORE), x.cast("decimal(10,2)"))).cast(SCORE)


def supplier_match(category: Column, category_matched: Column, capabilities: Column, region_matched: Column, quality: Column, needed: Column, valid: Column, missing: Column, expiring: Column, mandatory_missing: Column) -> Column:
    """struct(score, level, recommendation, flags) of a supplier for a package."""
    part = (
        F.lit(20)
        + F.when(category_matched, 25).when(F.trim(F.coalesce(category, F.lit(""))) != "", F.when(capabilities > 0, 8).otherwise(0)).otherwise(15)
        + F.when(region_matched, 10).otherwise(3)
    ).cast("decimal(10,2)")
    own = F.when(quality.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), quality)).cast("decimal(10,2)") / 10).otherwise(F.lit(5)).cast("decimal(10,3)")
    proof = F.when(needed == 0, F.lit(25)).otherwise(F.bround(F.lit(30).cast("decimal(10,4)") * valid / needed, 2)).cast("decimal(10,2)")
    score = clamp(F.bround(part + own + proof, 2), 0, 100)
    gap = (missing == 0) & (mandatory_missing == 0)
    flags = F.array_compact(
        F.array(
            F.when(~category_matched & (F.trim(F.coalesce(category, F.lit(""))) != ""), "CategoryMismatch"),
            F.when(~region_matched, "RegionMismatch"),
            F.when(missing > 0, "MissingEvidence"),
            F.when(expiring > 0, "ExpiringSoonEvidence"),
            F.when(mandatory_missing > 0, "MandatoryRequirementGap"),
        )
    )
    return F.struct(
        score.alias("score"),
        F.when((score >= 75) & (missing == 0), "High").when(score >= 50, "Medium").otherwise("Low").alias("level"),
        F.when((score >= 70) & gap, "Candidate").when(score >= 50, "Caution").otherwise("NotRecommended").alias("recommendation"),
        F.array_join(flags, ",").alias("flags"),
    )


def value_score(amount: Column, reject_risks: Column) -> Column:
    """struct(score, level) of an opportunity: 45, more for large amounts, less for each reject risk."""
    worth = F.when(amount >= 1_000_000, 30).when(amount >= 300_000, 20).when(amount >= 100_000, 10).otherwise(0)
    score = clamp(F.lit(45) + worth - F.least(F.lit(20), F.coalesce(reject_risks, F.lit(0)) * 8), 0, 100)
    return F.struct(score.alias("score"), F.when(score >= 75, "High").when(score >= 50, "Medium").otherwise("Low").alias("level"))


def notice_match(code: Column, name: Column, lot: Column, package: Column, supplier: Column, stage: Column, published: Column) -> Column:
    """struct(confidence, level) of a related notice. stage: its kind is the expected one (Candidate or Tender, null if neither); published: in time (null if unknown)."""
    base = points([(code, 0.45), (name, 0.22), (lot, 0.12), (package, 0.13), (supplier & (stage == "Candidate"), 0.08), (stage == "Candidate", 0.12), (stage == "Tender", 0.10), (published, 0.08)])
    late = F.coalesce(~published, F.lit(False))
    total = F.when(late, F.greatest(F.lit(0).cast("decimal(10,4)"), base - F.lit(0.15).cast("decimal(10,4)"))).otherwise(base)
    return F.struct(F.least(F.lit(1), F.bround(total, 3)).cast("decimal(5,4)").alias("confidence"), F.when(total >= 0.75, "High").when(total >= 0.45, "Medium").otherwise("Low").alias("level"))


def notice_text_match(code: Column, name_alike: Column, package: Column, expected: Column) -> Column:
    """struct(confidence, reasons, missing) of a notice by its text: its project code, a name alike (similarity, 0.72 or more), a package number, and its kind.

    expected: Candidate or Tender where the notice is of the kind that is looked for, else null.
    """
    rules = [
        (code, 0.45, "ProjectCode exact match"), (name_alike >= 0.72, 0.25, "ProjectName similarity match"), (package, 0.15, "PackageNo normalized hint matched"),
        (expected == "Candidate", 0.15, "Notice type/title indicates candidate announcement"), (expected == "Tender", 0.12, "Notice type/title indicates tender/procurement announcement"),
    ]
    total = points([(c, w) for c, w, _ in rules])
    return F.struct(
        F.least(F.lit(1), total).cast("decimal(5,4)").alias("confidence"),
        F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, _, r in rules])).alias("reasons"),
        F.when(total <= 0, "project code/name/package hint not matched").alias("missing"),
    )


def lead_score(same_package: Column, same_lot: Column, category: Column, keyword: Column, same_project: Column, awarded: Column) -> Column:
    """Score of a historical supplier lead, 1 at most."""
    return F.least(F.lit(1), points([(same_package, 0.35), (same_lot, 0.25), (category, 0.35), (keyword, 0.2), (same_project, 0.1), (awarded, 0.05)])).cast("decimal(5,4)")


def strength(completeness: Column, evidence: Column, trust: Column) -> Column:
    """(45c + 30e + 25t) / 100 in whole numbers."""
    return F.floor((completeness * 45 + evidence * 30 + trust * 25) / 100).cast("int")


def quality_issues(rows: DataFrame, key: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """key, issue_type, severity, field: one row for each rule (type, severity, field, condition) that a row breaks, in one pass."""
    made = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for t, s, f, bad in rules]
    return rows.select(key, F.inline(F.array_compact(F.array(*made))))


def quality_score(keys: DataFrame, issues: DataFrame, key: str, reparse: list[str]) -> DataFrame:
    """key, score, risk, issue_count, high_count, recommendation for every key: 100 less 30, 15, 5 an issue by severity."""
    each = issues.groupBy(key).agg(
        F.sum(F.when(F.col("severity") == "High", 30).when(F.col("severity") == "Medium", 15).when(F.col("severity") == "Low", 5).otherwise(0)).alias("lost"),
        F.count("*").alias("issue_count"),
        F.count_if(F.col("severity") == "High").alias("high_count"),
        F.count_if(F.col("severity") == "Medium").alias("medium_count"),
        F.count_if(F.col("issue_type").isin(reparse)).alias("reparse_count"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    out = keys.join(each, key, "left").withColumn("score", F.greatest(F.lit(0), F.lit(100) - n("lost")))
    risk = F.when((F.col("score") < 60) | (n("high_count") > 0), "High").when((F.col("score") < 85) | (n("medium_count") > 0), "Medium").otherwise("Low")
    out = out.withColumn("risk", risk)
    advice = F.when(F.col("risk") == "Low", "BatchConfirmCandidate").when((F.col("risk") == "High") & (n("reparse_count") > 0), "NeedsReparse").otherwise("NeedsReview")
    return out.select(key, "score", "risk", n("issue_count").alias("issue_count"), n("high_count").alias("high_count"), advice.alias("recommendation"))


def evidence_checks(requirements: DataFrame, documents: DataFrame, block: list[str], as_of: Column) -> DataFrame:
    """Each requirement with its best document and state: Missing, Expired, ExpiringSoon or Valid.

    requirements: block columns, required_type and others; documents: block columns, document_id, document_type,
    document_name, status, valid_to. A document fits if its type or name holds the required one or lies in it; valid ones go before
    others, then the latest expiry, then the smallest id. A block may be large: documents are reduced to the best of each text, and
    only distinct texts meet, by a run of characters.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rank = F.struct((F.col("status") == "Valid").alias("good"), F.coalesce(F.col("valid_to"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("until"), (-F.col("document_id")).alias("first"), "status", "valid_to")
    # The best document of each text; then of each asked type over the texts that fit, before it meets the requirements.
    held = documents.withColumn("__r", rank).select(*block, "__r", F.explode(F.array(low("document_type"), low("document_name"))).alias("__text")).groupBy(*block, "__text").agg(F.max("__r").alias("__r"))
    asked = requirements.withColumn("__asked", low("required_type"))
    texts = held.select(*block, "__text")
    pairs = contained_pairs(asked, texts, block, "__asked", "__text").unionByName(contained_pairs(texts, asked, block, "__text", "__asked").select(*block, "__asked", "__text")).distinct()
    best = pairs.join(held, [*block, "__text"]).groupBy(*block, "__asked").agg(F.max("__r").alias("__d"))
    state = (
        F.when(F.col("__d").isNull(), "Missing").when((F.col("__d.status") == "Expired") | (F.col("__d.valid_to") < as_of), "Expired")
        .when((F.col("__d.status") == "ExpiringSoon") | (F.col("__d.valid_to") <= as_of + F.expr("INTERVAL 30 DAYS")), "ExpiringSoon").otherwise("Valid")
    )
    return asked.join(best, [*block, "__asked"], "left").select(*requirements.columns, (-F.col("__d.first")).alias("document_id"), F.coalesce(state, F.lit("Valid")).alias("state"))


def resolved_amounts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, amount, source: of the columns in order, the first whose positive amounts, to two decimals, are one value in the group."""
    amount = lambda c: F.bround(F.when(F.col(c) > 0, F.col(c).cast("decimal(18,4)")), 2)
    each = rows.groupBy(key).agg(*[F.min(amount(c)).alias(f"__lo_{c}") for c in columns], *[F.max(amount(c)).alias(f"__hi_{c}") for c in columns])
    one = [F.when(F.col(f"__lo_{c}") == F.col(f"__hi_{c}"), F.struct(F.col(f"__lo_{c}").alias("amount"), F.lit(c).alias("source"))) for c in columns]
    return each.select(key, F.coalesce(*one).alias("__a")).select(key, F.col("__a.amount").alias("amount"), F.col("__a.source").alias("source"))


def completeness(supplier: Column, outcome: Column, package_no: Column, package_name: Column, lot_no: Column, lot_name: Column, evidence: Column, figures: Column, project: Column) -> Column:
    """Points for what an extract holds, 100 at most; `figures` and `project` tell whether any of theirs is there."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    rules = [(there(supplier), 25), (there(outcome), 10), (there(package_no) | there(package_name), 15), (there(lot_no), 20), (there(lot_name), 10), (there(evidence), 10), (figures, 5), (project, 5)]
    return F.least(F.lit(100), points(rules).cast("int"))


def evidence_points(text: Column, row_text: Column, placed: Column, supplier: Column, package_no: Column, lot_no: Column, lot_name: Column, field_evidence: Column) -> Column:
    """Points for how far the source text bears an extract out, 100 at most; without text 20 if single fields have evidence.

    `placed` tells of a sequence or page number; names are looked for in the text without case.
    """
    own = F.trim(F.coalesce(F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(row_text), F.lit("")))
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    holds = lambda c: there(c) & F.contains(F.lower(own), F.lower(F.trim(F.coalesce(c, F.lit("")))))
    package = there(package_no) & F.contains(own, F.concat(F.lit("包"), package_no))
    score = F.when(F.length(own).between(12, 2000), 15).otherwise(5) + points([(there(row_text), 5), (placed, 5), (holds(supplier), 30), (package, 20), (~package & F.contains(own, F.lit("包")), 12), (holds(lot_no), 25), (holds(lot_name), 10)]).cast("int")
    return F.when(own == "", F.when(field_evidence, 20).otherwise(0)).otherwise(F.least(F.lit(100), score))


def unit_suspects(rows: DataFrame, key: str, cells: str, amounts: list[str]) -> DataFrame:
    """key, issue_type, field, header: cells of an original row that tell of a wrong unit or of a rate in an amount field.

    cells: a JSON object of header and text. A rate whose number equals an amount (to 0.01) stands in the wrong field; a cell in
    ten thousands whose bare number equals an amount, while ten thousand times it equals none, was not scaled. Rows whose JSON can't
    be read have no cells.
    """
    shown = F.from_json(F.col(cells), "map<string,string>")
    held = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("decimal(18,4)").alias("value")) for c in amounts]), lambda a: a["value"].isNotNull())
    each = rows.select(key, held.alias("held"), F.explode(shown).alias("header", "text"))
    number = F.regexp_extract(F.replace(F.col("text"), F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("decimal(18,4)")
    rate = contains_any(F.col("header"), RATE_OR_SCORE) | contains_any(F.col("text"), ["%", "％"])
    many = contains_any(F.col("header"), TEN_THOUSAND + ["（万", "(万"]) | contains_any(F.col("text"), ["万"])
    near = lambda value: F.filter("held", lambda a: F.abs(a["value"] - value) < F.lit(0.01).cast("decimal(18,4)"))
    met = each.withColumns({"n": number, "rate": rate, "many": many}).filter(F.col("n").isNotNull() & (F.col("rate") | F.col("many")))
    met = met.withColumns({"bare": near(F.col("n")), "scaled": near(F.col("n") * 10000)})
    issue = F.when(F.col("rate"), "RateOrDiscountInAmountColumn").when(F.size("scaled") == 0, "AmbiguousAmountUnit")
    return met.filter(F.size("bare") > 0).select(key, issue.alias("issue_type"), F.col("bare")[0]["field"].alias("field"), "header").filter("issue_type is not null")


def maintenance(active: DataFrame, deadline: str, changed: str, watched: Column, action_due: Column, now: Column, warning_days: int, stale_days: int) -> DataFrame:
    """One row: active opportunities, those with a deadline near, overdue and urgent ones, watched ones with an action or deadline due, stale ones."""
    due = F.col(deadline) <= now + F.expr(f"INTERVAL {warning_days} DAYS")
    return active.agg(
        F.count("*").alias("opportunities"),
        F.count_if(due).alias("risks"),
        F.count_if(F.col(deadline) < now).alias("overdue"),
        F.count_if((F.col(deadline) >= now) & (F.col(deadline) <= now + F.expr("INTERVAL 3 DAYS"))).alias("urgent"),
        F.count_if(watched & (action_due | F.coalesce(due, F.lit(False)))).alias("watched"),
        F.count_if(F.col(changed) < now - F.expr(f"INTERVAL {stale_days} DAYS")).alias("stale"),
    )
