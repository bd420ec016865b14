"""Tables and amounts inside document text: one document a call, rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache
from html.parser import HTMLParser
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import from_texts
from .codes import ORG_ENDS, ORG_LABELS, clean_org_name, normalize_package_no, parse_rank
from .money import TEN_THOUSAND, WRITTEN_DIGITS, amount_kind, amount_status, declares_many, normalize_money, parse_fold, parse_money, read_decimal, unit_context
from .text import ENTITIES, clean_text, clean_value, contains_any, let

# Header words of the documents' language by the field that they name.
FIELDS = {
    "package_no": ["分包编号", "包件编号", "标包编号", "包号", "分包号", "标包号", "包件号"],
    "package_name": ["分包名称", "包件名称", "标包名称", "包名称"],
    "lot_no": ["分标编号", "标段编号", "标段号"],
    "lot_name": ["分标名称", "标段名称"],
    "supplier": ["中标人", "成交人", "中标供应商", "成交供应商", "供应商名称", "候选人名称", "单位名称", "中标单位", "成交单位"],
    "rank": ["排名", "名次", "排序", "推荐顺序"],
    "amount": ["中标金额", "成交金额", "中标价", "成交价", "投标报价", "最终报价", "报价"],
    "budget": ["预算金额", "预算", "概算"],
    "ceiling": ["最高限价", "限价", "控制价"],
    "guide": ["指导价", "指导价格", "参考价"],
    "scope": ["采购范围", "项目概况", "采购内容"],
    "qualification": ["资格要求", "专用资格", "资质要求"],
    "status": ["中标状态", "成交状态", "状态"],
}
NOT_AWARDED = ["未中标", "未成交", "流标", "废标", "否决"]
CANDIDATES = ["第一", "第二", "第三"]
# Of procurement lists: the words of the columns that describe a package, and of those that ask something of suppliers.
LISTED = {
    "lot_no": ["分标编号", "分标号", "标段编号"],
    "lot_name": ["分标名称", "标段名称"],
    "package_no": ["包号", "包件号", "标包号", "分包编号", "分包号"],
    "package_name": ["包名称", "包件名称", "标包名称"],
    "project_name": ["项目名称", "子项目名称"],
    "period": ["服务期", "服务期限", "框架协议有效期", "工期", "首批交货日期"],
    "place": ["实施地点", "服务地点", "交货地点", "履约地点"],
    "quantity": ["数量", "采购数量"],
    "budget": ["预算金额", "概算金额", "估算金额", "分项估算金额", "包估算金额", "采购金额", "预估金额"],
    "max_price": ["最高限价", "最高应答限价", "行报价最高限价", "最高投标限价", "应答限价", "报价限价", "控制价", "指导价"],
}
ASKED = {"Qualification": ["资质要求", "资格要求"], "Performance": ["业绩要求", "业绩"], "Personnel": ["人员要求", "人员"], "Other": ["资格条件其他", "其他要求"]}
SEQUENCE = "序号"


class _Tables(HTMLParser):
    """Rows of cells of every table; nested tables are their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self._close()
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self._close()
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.open:
            self._close()
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


_TABLE_TAG = re.compile(r"<(/?)table\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_RULE = re.compile(r":?-{2,}:?")
_LINES, _BLANKS = re.compile(r"\r\n?|\n"), re.compile(r"\t+|\s{2,}")


def _html_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost HTML tables; one that never ends reaches as far as its last row or cell tag's line."""
    tags = [(m.start(), m.end(), bool(m[1])) for m in _TABLE_TAG.finditer(text)]
    out: list[tuple[int, int]] = []
    depth, begin = 0, 0
    for at, end, closes in tags:
        if not closes:
            begin = begin if depth else at
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((begin, end))
    if depth:
        last = max((m.end() for m in re.finditer(r"</?(?:table|t[hdr])\b[^>]*>", text[begin:], re.I)), default=0) + begin
        line = text.find("\n", last)
        out.append((begin, len(text) if line < 0 else line))
    return out


# A table of nothing but rows of cells without attributes, references or other tags: most are, and two patterns read them.
_REGULAR = re.compile(r"<table>(?:<tr>(?:<t[dh]>[^<&\r]*</t[dh]>)*</tr>)*</table>")
_ROW, _CELL = re.compile(r"<tr>(.*?)</tr>", re.S), re.compile(r"<t[dh]>([^<]*)")


def _html(text: str) -> list[list[list[str]]]:
    if _REGULAR.fullmatch(text):
        return [[[" ".join(c.split()) for c in _CELL.findall(row)] for row in _ROW.findall(text)]]
    parser = _Tables()
    parser.feed(text)
    parser.close()
    while parser.open:
        parser._close()
        parser.done.append(parser.open.pop())
    return parser.done


def _runs(text: str) -> list[list[list[str]]]:
    """Runs of neighbouring lines of one form, pipes or blanks, with at least two cells each."""
    out: list[list[list[str]]] = []
    run: list[list[str]] = []
    form = None
    for line in [*_LINES.split(text), ""]:
        cells, own = next(((c, cut) for cut in (_pipe, _blank) if (c := cut(line)) and len(c) >= 2), ([], None))
        if own is not form:
            if len(run) >= 2:
                out.append(run)
            run, form = [], own
        if own:
            run.append(cells)
    return out


def _pipe(line: str) -> list[str] | None:
    if line.count("|") < 2:
        return None
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return cells


def _blank(line: str) -> list[str] | None:
    return None if "|" in line or not line.strip() else _BLANKS.split(line.strip())


def tables_of(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of all tables in text order: HTML, pipe tables and columns set apart by blanks.

    Lines of an HTML table are not read again; other tags between the tables are dropped before lines are read.
    """
    spans = _html_spans(text)
    bare = (lambda t: _TAG.sub("", t)) if spans else (lambda t: t)
    found, at = [], 0
    for start, end in spans:
        found += _runs(bare(text[at:start])) + _html(text[start:end])
        at = end
    found += _runs(bare(text[at:]))
    out = []
    for rows in found:
        rows = [r for r in rows if any(r) and not all(_RULE.fullmatch(c or "--") for c in r)]
        if len(rows) >= 2:
            out.append((rows[0], rows[1:]))
    return out


# What columns are looked for, by group: fields of results and tenders, of procurement lists, what is asked of suppliers, candidates side by side.
WANTED = {"fields": FIELDS, "listed": LISTED, "asked": ASKED, "candidates": {"first": [CANDIDATES[0]], "second": [CANDIDATES[1]], "third": [CANDIDATES[2]], "any": CANDIDATES}}
_PLACES = ", ".join(f"{group}: struct<{', '.join(f'{name}: int' for name in names)}>" for group, names in WANTED.items())
TOLD = {
    "award": "struct<package: string, package_no: string, lot_no: string, lot_name: string, supplier: string, amount: decimal(18,2), odd: boolean>",
    "listed": "struct<lot_no: string, lot_name: string, package_no: string, package_name: string, quantity: decimal(18,4), budget: decimal(18,2), max_price: decimal(18,2), place: string, period: string, odd: boolean>",
}
ROWS = f"table_index int, row_index int, headers array<string>, cells array<string>, raw string, places struct<{_PLACES}>, many array<boolean>"


@lru_cache(maxsize=4096)
def places_of(headers: tuple[str, ...]) -> dict:
    """The 0-based place of every wanted column among a table's headers: the first header that holds an alias, earlier aliases first."""
    clean = [re.sub(r"[\s（）()：:]", "", h, flags=re.ASCII) for h in headers]
    first = lambda words: next((k for w in words for k, h in enumerate(clean) if w in h), None)
    return {group: {name: first(words) for name, words in names.items()} for group, names in WANTED.items()}


_SPACE = re.compile(r"[^\S\r\n\x1c-\x1f]+")


@lru_cache(maxsize=4096)
def many_of(headers: tuple[str, ...]) -> list[bool]:
    """Whether each header declares ten thousands: what declares_many tells of its text, told once a table."""

    def declares(header: str) -> bool:
        if "万" not in header:
            return False
        for name, char in ENTITIES * 2:  # as often as the text is cleaned
            header = header.replace(name, char)
        flat = _SPACE.sub("", header)
        return any(w in flat for w in TEN_THOUSAND)

    return [declares(h) for h in headers]


# What a row says where its cells have plain forms, which most have: the same as the columns below tell of them. Other rows are odd, and are left to the columns.
_DIGITS, _PLAIN_NO = re.compile("[0-9]"), re.compile("包?0*([0-9]*)")
_NO_INSIDE = re.compile("包[ \t\n\x0b\f\r]*([0-9一二三四五六七八九十]+)")
_AMOUNT = re.compile(r"([0-9]{1,11})(?:\.([0-9]{1,8}))?(元|万元?)?")
_QUANTITY = re.compile(r"[0-9]{1,14}(?:\.[0-9]{1,4})?")
_ORG = re.compile(f"(?![0-9一二三四五六七八九十第]|{ORG_LABELS})[一-龥A-Za-z0-9（）()· ]+")
_ORG_INSIDE, _ORG_WHOLE, _ORG_HEAD = re.compile(f".{{2}}(?:{ORG_ENDS})"), re.compile(f"[一-龥A-Za-z0-9（）()·]{{2,}}(?:{ORG_ENDS})"), re.compile(f".*(?:{ORG_ENDS})")


def _plain_package(value: str) -> str | None:
    """normalize_package_no of an empty text or a number; None if it is neither."""
    if not value:
        return ""
    m = _PLAIN_NO.fullmatch(value)
    return (m[1] or "0") if m and value != "包" else None


def _plain_money(value: str, many: bool) -> tuple[Decimal | None, bool]:
    """parse_money of a number with or without its unit, or of a text without digits; and whether it is neither."""
    value = value.replace(",", "")
    if not _DIGITS.search(value):
        return None, False
    m = _AMOUNT.fullmatch(value)
    if not m:
        return None, True
    number = Decimal(f"{m[1]}.{m[2]}" if m[2] else m[1])
    return (number * 10000 if (many if m[3] is None else m[3] != "元") else number).quantize(_CENT, ROUND_HALF_EVEN), False


_CENT = Decimal("0.01")


def _plain_org(value: str) -> str | None:
    """clean_org_name of a text of name characters and blanks without number, rank or label before it; None for others."""
    if not value:
        return ""
    if not _ORG.fullmatch(value):
        return None
    if _ORG_WHOLE.fullmatch(value) or not _ORG_INSIDE.search(value):
        return value
    return _ORG_HEAD.match(value)[0]


def _awards(places: dict, many: list[bool], body: list[list[str]]) -> Iterator[dict]:
    """TOLD of each row: what award_rows tells of it, blanks of merged cells filled; the supplier is empty in rows that are none."""
    p = places["fields"]
    above = ["", "", ""]
    for cells in body:
        at = lambda f: clean_text(cells[p[f]]) if p[f] is not None and p[f] < len(cells) else ""
        above = [at(f) or old for f, old in zip(("package_no", "lot_no", "lot_name"), above)]
        name, status = at("supplier"), at("status")
        if any(w in status for w in NOT_AWARDED):
            name = ""
        package, supplier = _plain_package(above[0]), _plain_org(name)
        amount, odd = _plain_money(at("amount"), p["amount"] is not None and many[p["amount"]])
        yield {"package": above[0], "package_no": package, "lot_no": above[1], "lot_name": above[2], "supplier": supplier, "amount": amount, "odd": odd or package is None or supplier is None}


def _listed(places: dict, many: list[bool], body: list[list[str]]) -> Iterator[dict]:
    """TOLD of each row: what procurement_packages tells of it, lots carried down."""
    p = places["listed"]
    above = ["", ""]
    for cells in body:
        at = lambda f: clean_text(cells[p[f]]) if p[f] is not None and p[f] < len(cells) else ""
        money = lambda f: _plain_money(at(f), p[f] is not None and many[p[f]])
        above = [at(f) or old for f, old in zip(("lot_no", "lot_name"), above)]
        name = at("package_name" if p["package_name"] is not None else "project_name")
        m = _NO_INSIDE.search(name)
        package = _plain_package(m[1]) if m else _plain_package(at("package_no"))
        quantity = at("quantity").replace(",", "")
        number = Decimal(quantity) if (whole := _QUANTITY.fullmatch(quantity)) else None
        (budget, odd), (most, strange) = money("budget"), money("max_price")
        odd = odd or strange or package is None or not whole and bool(_DIGIT.search(quantity))
        yield {"lot_no": above[0], "lot_name": above[1], "package_no": package, "package_name": name, "quantity": number, "budget": budget, "max_price": most, "place": at("place"), "period": at("period"), "odd": odd}


_DIGIT = re.compile(r"\d")


def told_rows(told: str | None) -> str:
    """The columns of table_rows."""
    return f"{ROWS}, {told} {TOLD[told]}" if told else ROWS


def table_rows(found: list[tuple[list[str], list[list[str]]]], told: str | None = None) -> list[tuple]:
    """ROWS of tables given as headers and rows; the places of columns are found once a table. `told`: what each row says as an award or as listed, null in tables of another kind."""
    out: list[tuple] = []
    for ti, (headers, body) in enumerate(found):
        places, many = places_of(tuple(headers)), many_of(tuple(headers))
        rows = [(ti, ri, headers, cells, " | ".join(cells), places, many) for ri, cells in enumerate(body)]
        if told:
            fits = places["fields"]["supplier"] is not None if told == "award" else places["listed"]["package_no"] is not None or places["listed"]["package_name"] is not None
            rows = [(*r, x) for r, x in zip(rows, (_awards if told == "award" else _listed)(places, many, body) if fits else repeat(None))]
        out += rows
    return out


def parse_tables(docs: DataFrame, key: str, text: str = "text", told: str | None = None) -> DataFrame:
    """key, table_index, row_index, headers, cells, raw, places, many (which headers declare ten thousands): one row per table row of each text; null text has none.

    `told` ("award" for award_rows, "listed" for procurement_packages) has the parser tell what plain rows say, so that columns are asked about odd rows only.
    """
    return from_texts(docs, key, text, lambda t: table_rows(tables_of(t), told), told_rows(told))


def with_places(tables: DataFrame) -> DataFrame:
    """tables with `places` and `many`, also where they come from elsewhere: found once for each list of headers."""
    if "many" in tables.columns:
        return tables
    if "places" in tables.columns:
        tables = tables.drop("places")
    groups = [F.struct(*[find_column(F.col("headers"), words).cast("int").alias(name) for name, words in names.items()]).alias(group) for group, names in WANTED.items()]
    many = F.transform("headers", lambda h: declares_many(unit_context(h, F.lit(""))))
    known = tables.select("headers").distinct().withColumns({"places": F.struct(*groups), "many": many})
    return tables.join(known, "headers").select(*tables.columns, "places", "many")


def find_column(headers: Column, aliases: list[str]) -> Column:
    """0-based place of the first header that holds an alias, earlier aliases first; null if none does."""
    clean = F.transform(headers, lambda h: F.regexp_replace(h, r"[\s（）()：:]", ""))
    words = F.array(*[F.lit(a) for a in aliases])

    def first(own: Column) -> Column:
        places = F.transform(words, lambda w: F.array_position(F.transform(own, lambda h: F.contains(h, w)), True))
        return F.get(F.filter(places, lambda p: p > 0), F.lit(0)) - 1

    return let(clean, first)


def cell(field: str, group: str = "fields") -> Column:
    """Text of the cell under a field's header; empty if there is none."""
    return clean_value(F.get("cells", F.col(f"places.{group}.{field}")))


def _money(field: str, group: str = "fields") -> Column:
    """The amount of the cell under a field's header, in the unit that the header declares."""
    return parse_money(cell(field, group), many=F.coalesce(F.get("many", F.col(f"places.{group}.{field}")), F.lit(False)))


def filled(tables: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank cells of merged rows take the last value above them, within a table."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "table_index").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tables.withColumns({c: F.coalesce(F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w), F.lit("")) for c in columns})


def award_rows(tables: DataFrame, key: str) -> DataFrame:
    """Award evidence: package, lot, supplier, amount of each row that names a supplier and whose status is no refusal."""
    if "award" in tables.columns:
        return _told_awards(tables, key)
    rows = with_places(tables).withColumns({"package": cell("package_no"), "lot_no": cell("lot_no"), "lot_name": cell("lot_name"), "name": cell("supplier")})
    rows = filled(rows, key, ["package", "lot_no", "lot_name"]).filter("name <> ''").filter(~contains_any(cell("status"), NOT_AWARDED))
    amount = _money("amount")
    return rows.select(key, "table_index", "row_index", normalize_package_no(F.col("package")).alias("package_no"), "lot_no", "lot_name", clean_org_name(F.col("name")).alias("supplier"), amount.alias("amount"), "raw")


def _told_awards(tables: DataFrame, key: str) -> DataFrame:
    """award_rows of what the parser has told; columns are asked where a row is odd. Blanks are filled already."""
    told = lambda f, else_: F.when(F.col("award.odd"), else_).otherwise(F.col(f"award.{f}")).alias(f)
    rows = tables.filter("award is not null and (award.odd or award.supplier <> '')")
    rows = rows.filter(~F.col("award.odd") | ((cell("supplier") != "") & ~contains_any(cell("status"), NOT_AWARDED)))
    package = F.col("award.package")
    return rows.select(key, "table_index", "row_index", told("package_no", normalize_package_no(package)), "award.lot_no", "award.lot_name", told("supplier", clean_org_name(cell("supplier"))), told("amount", _money("amount")), "raw")


def candidate_rows(tables: DataFrame, key: str) -> DataFrame:
    """Candidate evidence, ranked by a column, or unpivoted from the first to third candidate's columns."""
    rows = filled(with_places(tables).withColumn("package", cell("package_no")), key, ["package"])
    package = normalize_package_no(F.col("package")).alias("package_no")
    # One pass: the candidate of a row that names one, and those of the columns side by side.
    one = F.struct(parse_rank(cell("rank")).alias("rank"), cell("supplier").alias("name"), _money("amount").alias("amount"))
    none = F.lit(None).cast("decimal(18,2)").alias("amount")
    across = [F.struct(F.lit(i + 1).alias("rank"), cell(place, "candidates").alias("name"), none) for i, place in enumerate(("first", "second", "third"))]
    wide = F.col("places.candidates.any").isNotNull()
    named = F.filter(F.concat(F.array(one), F.when(wide, F.array(*across)).otherwise(F.array().cast("array<struct<rank:int,name:string,amount:decimal(18,2)>>"))), lambda c: c["name"] != "")
    found = rows.select(key, "table_index", "row_index", package, F.inline(named))
    return found.select(key, "table_index", "row_index", "package_no", "rank", clean_org_name(F.col("name")).alias("supplier"), "amount")


def tender_rows(tables: DataFrame, key: str) -> DataFrame:
    """Tender packages: scope, budget, ceiling price, guide price, qualification."""
    rows = with_places(tables).withColumn("package", cell("package_no")).filter("package <> ''")
    money = lambda f: _money(f).alias(f)
    return rows.select(key, "table_index", "row_index", normalize_package_no(F.col("package")).alias("package_no"), cell("package_name").alias("package_name"), cell("scope").alias("scope"), money("budget"), money("ceiling"), money("guide"), cell("qualification").alias("qualification"))


def procurement_packages(tables: DataFrame, key: str) -> DataFrame:
    """Packages of procurement lists: key, lot_no, lot_name, package_no, n_rows, and of each other field the first value that a row of the package has.

    Lots are carried down; a package's number stands in its name or in a column of its own; rows without one are left out.
    Amounts are in yuan by their header's unit.
    """
    at = lambda f: F.col(f"places.listed.{f}")
    value = lambda f: cell(f, "listed")
    name = F.when(at("package_name").isNotNull(), value("package_name")).otherwise(value("project_name"))
    inside = normalize_package_no(F.regexp_extract(name, "(?:包|标包)\\s*([0-9一二三四五六七八九十]+)", 1))
    number = F.when(inside != "", inside).otherwise(normalize_package_no(value("package_no")))
    money = lambda f: _money(f, "listed")
    shown = {"package_name": name, "quantity": F.replace(value("quantity"), F.lit(","), F.lit("")).try_cast("decimal(18,4)"), "budget": money("budget"), "max_price": money("max_price"), "place": value("place"), "period": value("period")}
    if "listed" in tables.columns:
        # The parser has told all of it, lots carried down; columns are asked where a row is odd.
        told = lambda f, else_: F.when(F.col("listed.odd"), else_).otherwise(F.col(f"listed.{f}"))
        number, shown = told("package_no", number), {f: told(f, x) for f, x in shown.items()}
        rows = tables.filter("listed is not null").withColumns({f: F.col(f"listed.{f}") for f in ("lot_no", "lot_name")})
    else:
        rows = with_places(tables).filter(at("package_no").isNotNull() | at("package_name").isNotNull())
        rows = filled(rows.withColumns({f: value(f) for f in ("lot_no", "lot_name")}), key, ["lot_no", "lot_name"])
    rows = rows.withColumns({"package_no": number, **shown}).filter("package_no <> ''")
    order = F.struct("table_index", "row_index")
    there = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.groupBy(key, "lot_no", "lot_name", "package_no").agg(F.count("*").alias("n_rows"), *[F.min_by(c, F.when(there(c), order)).alias(c) for c in shown])


def asked_of_suppliers(tables: DataFrame, key: str) -> DataFrame:
    """key, table_index, row_index, kind, text: what the columns of a list ask of suppliers."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), cell(k, "asked").alias("text")) for k in ASKED])
    return with_places(tables).select(key, "table_index", "row_index", F.inline(each)).filter("text <> ''")


def wrapped_of(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of tables whose cells wrap over lines: a header with a sequence column, then records numbered 1, 2, ...

    A record begins at a line that starts with the next number; other lines go on with it. Text belongs to the column that
    begins last at or before it. A blank line behind a record, or one that starts left of the second column without the next
    number, ends the table.
    """
    out: list[tuple[list[str], list[list[str]]]] = []
    starts: list[int] = []
    headers: list[str] = []
    rows: list[list[str]] = []

    def end() -> None:
        if rows:
            out.append((headers, list(rows)))
        rows.clear()
        starts.clear()

    for line in [*text.split("\n"), ""]:
        found = [(m.start(), m.group()) for m in re.finditer(r"\S+(?: \S+)*", line)]
        if found and found[0][1] == SEQUENCE and len(found) > 1:
            end()
            headers, starts = [t for _, t in found], [at for at, _ in found]
            continue
        if not starts:
            continue
        first = found[0][1] if found and found[0][0] < starts[1] else None
        if not found or (first is not None and first != str(len(rows) + 1)):
            end()
            continue
        if first is not None:
            rows.append([""] * len(starts))
        if not rows:
            end()
            continue
        for at, piece in found:
            k = max(i for i, s in enumerate(starts) if s <= at) if at >= starts[0] else 0
            have = rows[-1][k]
            glue = " " if have and have[-1].isascii() and piece[0].isascii() else ""
            rows[-1][k] = have + glue + piece
    return out


def wrapped_tables(docs: DataFrame, key: str, text: str = "text", told: str | None = None) -> DataFrame:
    """key, table_index, row_index, headers, cells, raw, places, many of tables with wrapped cells; null text has none. `told` as in parse_tables."""
    return from_texts(docs, key, text, lambda t: table_rows(wrapped_of(t), told), told_rows(told))


# Currencies, units and words around a number that make it money.
CURRENCIES = ("人民币", "RMB", "CNY", "￥", "¥")
UNITS = ("亿元", "亿", "万元", "万", "元")
MONEY_WORDS = ("金额", "报价", "价格", "单价", "总价", "限价", "预算", "保证金", "费用", "服务费", "中标价", "成交价")
AROUND = 42
NUMBER = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?")
WRITTEN = re.compile(f"[{''.join(WRITTEN_DIGITS)}]+")


def _grouped(digits: str) -> str:
    """As much of a number as its commas group by thousands: 1,234 whole, of 12,34 the 12."""
    whole, dot, rest = digits.partition(".")
    groups = whole.split(",")
    if len(groups) == 1 or (0 < len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:])):
        return digits
    return groups[0]


def scan_amounts(text: str) -> list[tuple[int, int, str, str, str, bool]]:
    """(start, end, form, number, unit, with a currency) of all amounts, percents and folds, form by form, in text order.

    Every number is money with the currency before it and the unit behind it, blanks between; a percent sign
    or a fold behind it makes it that as well; folds may be one or two written digits. Which of them count is for the caller.
    """
    money, percents, folds = [], [], []

    def behind(at: int) -> int:
        while at < len(text) and text[at].isspace():
            at += 1
        return at

    def before(at: int) -> int:
        while at and text[at - 1].isspace():
            at -= 1
        return at

    for m in NUMBER.finditer(text):
        at = m.start()
        while at < m.end():
            number = _grouped(text[at : m.end()])
            end, after = at + len(number), behind(at + len(number))
            edge = before(at)
            currency = next((c for c in CURRENCIES if text.endswith(c, 0, edge)), "")
            unit = next((u for u in UNITS if text.startswith(u, after)), "")
            start = edge - len(currency) if currency else at
            money.append((start, after + len(unit) if unit else end, "money", number, unit, bool(currency)))
            plain = number.rpartition(",")[2]
            if text[after : after + 1] in ("%", "％"):
                percents.append((end - len(plain), after + 1, "percent", plain, "", False))
            elif text.startswith("折", after):
                folds.append((end - len(plain), after + 1, "fold", plain, "", False))
            at = end
            while at < m.end() and not text[at].isdigit():
                at += 1
    for m in WRITTEN.finditer(text):
        after = behind(m.end())
        if text.startswith("折", after):
            number = m.group()[-2:]
            folds.append((m.end() - len(number), after + 1, "fold", number, "", False))
    return money + percents + sorted(folds)


def amounts_of(text: str) -> list[tuple]:
    """(place, text, form, number, unit, surroundings, line) of the amounts that count, each span by the first form that reads it."""
    rows, taken = [], set()
    for start, end, form, number, unit, currency in scan_amounts(text):
        around = text[max(0, start - AROUND) : end + AROUND]
        if (start, end) in taken or form == "money" and not (unit or currency or any(w in around for w in MONEY_WORDS)):
            continue
        taken.add((start, end))
        rows.append((start, text[start:end].strip(), form, number, unit, around, text.count("\n", 0, start) + 1))
    return rows


def _kinds_of(text: str) -> list[tuple]:
    """amounts_of with the kind that classify_amount gives; surroundings stay only where a unit is still to be found in them."""
    return [(*row[:5], "" if row[4] else row[5], row[6], amount_kind(row[5])) for row in amounts_of(text)]


def extract_amounts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, at, raw, form, value, unit, amount_type, status, reason, confidence, line: amounts, percents and folds with their places.

    A span is claimed by the first form that reads it. A bare number counts only among words of money. Context is
    what stands within AROUND characters, on both sides.
    """
    found = from_texts(docs, key, text, _kinds_of, "at int, raw string, form string, number string, unit string, around string, line int, kind string")
    money = normalize_money(F.col("number"), F.col("unit"), F.col("around"))
    out = found.withColumns({"m": money, "share": F.bround(read_decimal(F.col("number"), "decimal(18,8)") / 100, 6).cast("decimal(18,6)"), "fold": parse_fold(F.col("number"))})
    value = F.when(F.col("form") == "money", F.col("m.amount").cast("decimal(24,6)")).when(F.col("form") == "percent", F.col("share")).otherwise(F.col("fold"))
    type_ = F.when(F.col("form") == "money", F.col("kind")).when(F.col("form") == "fold", F.lit("DiscountRate")).when(F.col("kind").isin("DiscountRate", "ReductionRate"), F.col("kind")).otherwise(F.lit("Rate"))
    unit = F.when(F.col("form") == "money", F.col("m.unit")).when(F.col("form") == "percent", F.lit("rate")).otherwise(F.lit("discount"))
    out = out.withColumns({"value": value, "amount_type": type_, "unit": unit}).filter("value is not null")
    return out.withColumn("s", amount_status(F.col("amount_type"), F.col("value"))).select(key, "at", "raw", "form", "value", "unit", "amount_type", "s.status", "s.reason", "s.confidence", "line")
