"""Ordered rules: classes, statuses, ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_value, contains_any

# Words of the documents' language that tell the kind of process, in order.
PROCESS_RULES = [
    ("Prequalification", 0.9, ["资格预审公告"]),
    ("InvitedBidding", 0.95, ["邀请招标"]),
    ("OpenBidding", 0.95, ["公开招标"]),
    ("NonBidding", 0.9, ["竞争性谈判", "公开谈判", "询价", "单一来源", "非招标"]),
    ("NonBidding", 0.82, ["成交结果公告", "成交公告", "采购文件", "应答人", "应答文件"]),
    ("Bidding", 0.9, ["招标编号"]),
    ("Bidding", 0.85, ["中标结果公告", "中标候选人公示", "中标公告", "招标采购", "投标人", "招标文件"]),
]
FAILURE_WORDS = ["流标", "废标", "采购失败", "招标失败", "成交失败", "中标失败"]


def ladder(rules: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def notice_process(signal: Column) -> Column:
    """struct(process, confidence) of a notice's title and text."""
    make = lambda p, c: F.struct(F.lit(p).alias("process"), F.lit(c).cast("decimal(5,4)").alias("confidence"))
    return ladder([(contains_any(signal, words), make(p, c)) for p, c, words in PROCESS_RULES], make("Unknown", 0.5))


def is_non_award(name: Column) -> Column:
    """A status in place of a supplier: at most 16 characters that hold a failure word."""
    flat = F.regexp_replace(clean_value(name), r"(?U)[\s\p{P}|]", "")
    return (F.length(flat) <= 16) & contains_any(flat, FAILURE_WORDS)


def due_state(due: Column, as_of: Column) -> Column:
    """struct(days, state): whole days left, and Overdue, Urgent (3 days), DueSoon or None."""
    days = F.datediff(due, as_of)
    return F.struct(days.alias("days"), ladder([(due.isNull(), "None"), (days < 0, "Overdue"), (days <= 3, "Urgent")], "DueSoon").alias("state"))


def evidence_status(archived: Column, valid_to: Column, as_of: Column) -> Column:
    return ladder([(archived, "Archived"), (valid_to < as_of, "Expired"), (valid_to <= as_of + F.expr("INTERVAL 30 DAYS"), "ExpiringSoon")], "Valid")


def backoff_seconds(attempt: Column, initial: float, most: float) -> Column:
    """min(most, initial * 2^(attempt - 1))."""
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 1))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds; null unless both are there, never negative."""
    ms = lambda x: F.unix_millis(x.cast("timestamp"))
    return F.greatest(F.lit(0), ms(end) - ms(start))


def stage_progress(stage: Column, steps: dict[str, int], default: int = 0) -> Column:
    """Progress of a stage by a map of its names."""
    pairs = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, stage), F.lit(default))


def normalized_choice(x: Column, choices: list[str], default: str) -> Column:
    """The listed spelling of a value, ignoring case, else the default."""
    return ladder([(F.lower(F.trim(x)) == c.lower(), c) for c in choices], default)
