"""Order-dependent parsers of notices: one document a call."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.analytics import first_per_key
from .arrow import from_texts
from .codes import ORG_ENDS, clean_org_name, extract_lot_no, extract_project_code, extract_project_name, normalize_package_no
from .money import parse_money
from .tables import award_rows, parse_tables
from .text import let, text_or_empty

# Line labels of the documents' language.
PACKAGE_LINE = re.compile(r"(?:分包编号|包件编号|标包编号|分包|标包|包号|第)?\s*包\s*[:：]?\s*([0-9一二三四五六七八九十]{1,3})|(?:分包编号|包号)\s*[:：]\s*([A-Za-z0-9一二三四五六七八九十]{1,10})")
SUPPLIER_LINE = re.compile(r"(?:中标人|成交人|中标供应商|成交供应商|供应商名称|中标单位|成交单位|第[一二三]中标候选人)\s*[:：]\s*(.{2,120})")
AMOUNT_LINE = re.compile(r"(?:中标金额|成交金额|中标价|成交价|报价)\s*(?:[（(][^）)]*[）)])?\s*[:：]\s*(\S.{0,60})")
DATES = {"publish_time": "发布时间|公告时间|发布日期", "bid_deadline": "投标截止时间|递交截止时间|截标时间", "open_bid_time": "开标时间", "signup_deadline": "报名截止时间|获取截止时间"}
BUYER_LABELS, AGENCY_LABELS = "采购人|招标人|采购单位", "采购代理机构|招标代理机构|代理机构"


def _outcomes(text: str) -> list[list]:
    rows: list[list] = []
    package, last = "", None
    for n, line in enumerate(text.split("\n"), 1):
        # Words that every label holds tell most lines without a search.
        if "包" in line and (m := PACKAGE_LINE.search(line)):
            package, last = m[1] or m[2], None
        if not (":" in line or "：" in line):
            continue
        if ("人" in line or "供应商" in line or "单位" in line) and (m := SUPPLIER_LINE.search(line)):
            last = [n, package, m[1], None]
            rows.append(last)
        if last is not None and last[3] is None and ("金额" in line or "价" in line) and (m := AMOUNT_LINE.search(line)):
            last[3] = m[1]
    return rows


def outcome_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line, package_no, supplier, amount: suppliers named line by line, each under the package last named above, with the amount that follows it before the next."""
    found = from_texts(docs, key, text, _outcomes, "line int, package string, name string, amount string")
    return found.select(key, "line", normalize_package_no(F.col("package")).alias("package_no"), clean_org_name(F.col("name")).alias("supplier"), parse_money(F.col("amount")).alias("amount"))


PACKAGE = re.compile(r"(?:采购包|分包|标包|包|第)\s*[0-9一二三四五六七八九十]+(?:\s*包)?")
WINNERS = ("中标供应商", "成交供应商", "中标单位", "成交单位", "中标人", "成交人")
BETWEEN = re.compile(r"[:：=\s]*")
NAME = re.compile(r"[一-龥A-Za-z0-9（）()·\-\s]+")
ENDING = re.compile(f"(?:{ORG_ENDS})")
LONGEST_NAME = 120


def award_of_sentence(sentence: str) -> tuple[str, str] | None:
    """(package, supplier) of the first clause that names both: a package, a mark or blank, perhaps a winner's label, a name.

    A name is as far as name characters go, up to the last ending of organisations in it. Another label behind the package ends its
    clause, for its colon is no part of a name; then the next package is tried.
    """
    for package in PACKAGE.finditer(sentence):
        at = BETWEEN.match(sentence, package.end()).end()
        if at == package.end():
            continue
        label = next((w for w in WINNERS if sentence.startswith(w, at)), "")
        at = BETWEEN.match(sentence, at + len(label)).end()
        stretch = NAME.match(sentence, at, at + LONGEST_NAME + 8)
        ends = [m.end() for m in ENDING.finditer(stretch[0]) if m.start() >= 2] if stretch else []
        if ends:
            return package[0], stretch[0][: ends[-1]]
    return None


def _awards(text: str) -> list[tuple]:
    found = []
    parts = [p for p in (" ".join(unescape(x).split()) for x in re.split("[\r\n。；;]", text)) if p]
    for n, sentence in enumerate(parts, 1):
        if award := award_of_sentence(sentence):
            found.append((n, *award, sentence))
    return found


def award_sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, sentence (from 1), package_no, supplier, raw: awards told in sentences, one a sentence."""
    found = from_texts(docs, key, text, _awards, "sentence int, package string, name string, raw string")
    named = found.select(key, "sentence", normalize_package_no(F.col("package")).alias("package_no"), clean_org_name(F.col("name")).alias("supplier"), "raw")
    return named.filter("supplier <> ''")


def award_evidence(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, part (table or sentence), place, package_no, lot_no, lot_name, supplier, amount, confidence, raw: all awards of a text, the surest of equal ones.

    Rows of tables with an amount count 0.93, without one 0.88, sentences 0.72. Equal are package, supplier and text.
    """
    rows = award_rows(parse_tables(docs, key, text), key)
    sure = F.when(F.col("amount").isNotNull(), 0.93).otherwise(0.88)
    of_tables = rows.select(key, F.lit("table").alias("part"), (F.col("table_index") * 100_000 + F.col("row_index")).cast("long").alias("place"), "package_no", "lot_no", "lot_name", "supplier", "amount", sure.alias("confidence"), "raw")
    blank = F.lit("")
    told = award_sentences(docs, key, text).select(key, F.lit("sentence").alias("part"), F.col("sentence").cast("long").alias("place"), "package_no", blank.alias("lot_no"), blank.alias("lot_name"), "supplier", F.lit(None).cast("decimal(18,2)").alias("amount"), F.lit(0.72).alias("confidence"), "raw")
    return first_per_key(of_tables.unionByName(told), [key, "package_no", "supplier", "raw"], [F.desc("confidence"), F.desc("part"), F.col("place")])


def _date(x: Column, labels: str) -> Column:
    pattern = rf"(?:{labels})\s*[:：]?\s*(\d{{4}})[-年/.](\d{{1,2}})[-月/.](\d{{1,2}})日?(?:\s*(\d{{1,2}})[:：时](\d{{2}}))?"

    def read(found: Column) -> Column:
        """The parts of the match alone: the text is searched once."""
        part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(found, pattern, i), F.lit("")), F.lit(default))
        day = F.concat_ws("-", part(1, ""), F.lpad(part(2, ""), 2, "0"), F.lpad(part(3, ""), 2, "0"))
        return F.when(found != "", F.concat(day, F.lit(" "), F.lpad(part(4, "0"), 2, "0"), F.lit(":"), part(5, "00")).try_cast("timestamp_ntz"))

    return let(F.regexp_extract(x, pattern, 0), read)


def notice_fields(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the labelled fields of a notice: project, lot, buyer, agency, budget and dates."""
    x = text_or_empty(F.col(text))
    labelled = lambda labels: F.trim(F.regexp_extract(x, rf"(?:{labels})\s*[:：]\s*([^\r\n。；;]{{2,120}})", 1))
    return docs.select(
        key,
        extract_project_code(x).alias("project_code"),
        extract_project_name(x).alias("project_name"),
        extract_lot_no(x).alias("lot_no"),
        let(labelled(BUYER_LABELS), clean_org_name).alias("buyer_name"),
        let(labelled(AGENCY_LABELS), clean_org_name).alias("agency_name"),
        let(labelled("预算金额|采购预算|项目预算"), lambda v: parse_money(v)).alias("budget"),
        *[_date(x, labels).alias(name) for name, labels in DATES.items()],
    )
