"""The price of a package from what its notices disclose: the first rule that has an amount."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.classify import ladder
from ..functions.money import plain_number
from ..functions.text import let

AMOUNT = "decimal(18,2)"


def base_amount(guide: Column, ceiling: Column, budget: Column, package_no: Column, budget_first: bool) -> Column:
    """struct(amount, type): the guide price, else ceiling or budget where only one is given or both agree."""
    one = lambda a, t: F.struct(a.cast(AMOUNT).alias("amount"), F.lit(t).alias("type"))
    c, b = one(ceiling, "PackageMaxPrice"), one(budget, "PackageBudget")
    both = F.when(ceiling == budget, b if budget_first else c)
    return F.when(F.trim(F.coalesce(package_no, F.lit(""))) != "", F.when(guide.isNotNull(), one(guide, "PackageGuidePrice")).when(ceiling.isNotNull() & budget.isNotNull(), both).when(ceiling.isNotNull(), c).when(budget.isNotNull(), b))


def price_decision(award: Column, quote: Column, quote_rank: Column, quote_matches: Column, rate_type: Column, rate: Column, guide: Column, ceiling: Column, budget: Column, package_no: Column) -> Column:
    """struct(amount, kind, stage, base_amount, base_type, formula, confidence, needs_review).

    Direct award, then the candidate's quote at rank 1 or where the supplier matched one candidate only, then rate times
    base, then the procurement amount, then unknown. A rate without a clear meaning stops the search.
    """
    inputs = F.struct(
        award.cast(AMOUNT).alias("award"), quote.cast(AMOUNT).alias("quote"), quote_rank.eqNullSafe(F.lit(1)).alias("first"), (quote_matches == 1).alias("only"), rate_type.alias("rate_type"), rate.cast("decimal(18,6)").alias("rate"),
        base_amount(guide, ceiling, budget, package_no, False).alias("base"), base_amount(guide, ceiling, budget, package_no, True).alias("fallback"),
    )
    return let(inputs, _decided)


# The rules by number: (kind, stage, confidence, confidence with a guide price, needs review); None where the inputs tell.
DIRECT, QUOTED, UNCLEAR, INFERRED, DEFAULTED, BASELESS, NOTHING = range(7)
RULES = {
    DIRECT: ("DirectAwardAmount", "AwardNotice", 0.98, 0.98, False),
    QUOTED: ("CandidateFinalQuote", "CandidateNotice", 0.88, 0.88, None),
    UNCLEAR: ("Unknown", "AwardNotice", 0.0, 0.0, True),
    INFERRED: (None, "AwardNotice", 0.78, 0.84, True),
    DEFAULTED: ("DefaultedFromProcurementPackageAmount", "TenderNotice", 0.72, 0.76, True),
    BASELESS: ("Unknown", "AwardNotice", 0.0, 0.0, True),
    NOTHING: ("Unknown", "Unknown", 0.0, 0.0, True),
}


def _decided(t: Column) -> Column:
    """The rule's number first, from the inputs computed once; then each field by that number."""
    rate_known = t["rate_type"].isNotNull()
    number = ladder(
        [
            (t["award"].isNotNull(), DIRECT),
            (t["quote"].isNotNull() & (t["first"] | t["only"]), QUOTED),
            (t["rate_type"] == "Unknown", UNCLEAR),
            (rate_known & t["base"].isNotNull(), INFERRED),
            (t["fallback"].isNotNull(), DEFAULTED),
            (rate_known, BASELESS),
        ],
        NOTHING,
    )
    return let(number, lambda rule: _fields(t, rule))


def _fields(t: Column, rule: Column) -> Column:
    reduced = t["rate_type"] == "ReductionRate"
    inferred, base = rule == INFERRED, F.when(rule == INFERRED, t["base"]).when(rule == DEFAULTED, t["fallback"])
    guided = F.coalesce(base["type"] == "PackageGuidePrice", F.lit(False))
    at = lambda k: F.get(F.array(*[F.lit(r[k]) for r in RULES.values()]), rule)
    amount = F.when(rule == DIRECT, t["award"]).when(rule == QUOTED, t["quote"]).when(inferred, F.bround(t["base"]["amount"] * F.when(reduced, 1 - t["rate"]).otherwise(t["rate"]), 2)).when(rule == DEFAULTED, t["fallback"]["amount"])
    kind = F.when(inferred, F.when(reduced, "InferredFromReductionRate").when(t["rate_type"] == "Coefficient", "InferredFromCoefficient").otherwise("InferredFromDiscountRate")).otherwise(at(0))
    shown = lambda x: plain_number(x)
    formula = F.when(inferred, F.when(reduced, F.concat(shown(t["base"]["amount"]), F.lit(" * (1 - "), shown(t["rate"]), F.lit(")"))).otherwise(F.concat(shown(t["base"]["amount"]), F.lit(" * "), shown(t["rate"]))))
    confidence = F.when((rule == QUOTED) & t["first"], F.lit(0.95)).when(guided, at(3)).otherwise(at(2))
    return F.struct(
        amount.cast(AMOUNT).alias("amount"),
        kind.alias("kind"),
        at(1).alias("stage"),
        base["amount"].alias("base_amount"),
        F.coalesce(base["type"], F.lit("Unknown")).alias("base_type"),
        formula.alias("formula"),
        confidence.cast("decimal(5,4)").alias("confidence"),
        F.when(rule == QUOTED, ~t["first"]).otherwise(at(4)).alias("needs_review"),
    )
