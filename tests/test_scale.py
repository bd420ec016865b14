"""Steps that once cost more than their input: each is held against plain Python and a bound."""

import re

from pyspark.sql import functions as F

from marlstone import session
from marlstone.functions import codes, json_rows, parsers
from marlstone.operators import joins


def plan_size(df) -> int:
    return len(df._jdf.queryExecution().analyzed().toString())


def labelled(text: str, labels: str, allowed: str, least: int, most: int) -> str:
    """The walk over clauses and separators that the pattern stands for."""
    for clause in re.split("[\r\n。；;]", text):
        parts = re.split("[:：=]", clause)
        at = 0
        for p in parts[:-1]:
            at += len(p) + 1
            rest = re.match(rf"[ \t\x0b\f]*({allowed}{{{least},{most}}})", clause[at:])
            label = re.sub(r"[ \t\x0b\f]*[（(][^（）()]*[）)][ \t\x0b\f]*$", "", p)
            if re.search(rf"(?i:{labels})[ \t\x0b\f]*$", label) and rest:
                return rest[1]
    return ""


LABELLED = [
    "项目编号：ab-1", "项目编号（一）：ab-1", "项目编号（一）（二）：abc", "项目编号 ( 批次 ) =\tx_9", "项目编号：\nabc", "项目编号：a；采购编号：bcd", "x：项目编号：bcd", "项目编号（含：一）：abc", "projectcode=zz9。项目编号：y11",
    "招标项目编号=QQQ项目编号：RRR", "项目编号：  ", "项目编号：URL", "（项目编号）：abc", "项目编号abc", "编号：abc", "项目编号：：abc", "项目编号（x\n）：abc", "",
]


def test_labels_by_one_pattern(spark):
    """one search a label gives what the walk over clauses gives, and plans stay small."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(LABELLED)], "i int, t string")
    allowed = r"[A-Za-z0-9_.\-/－—–／（）()]"
    got = {r.i: r.v for r in rows.select("i", codes._labelled(F.col("t"), codes.CODE_LABELS, allowed, 3, 100).alias("v")).collect()}
    for i, t in enumerate(LABELLED):
        flat = re.sub(r"\s+", " ", t).strip()
        assert got[i] == (labelled(t, codes.CODE_LABELS, allowed, 3, 100) or labelled(flat, codes.CODE_LABELS, allowed, 3, 100)), t
    assert plan_size(rows.select(codes.extract_project_code(F.col("t")), codes.extract_lot_no(F.col("t")))) < 60_000
    assert plan_size(parsers.notice_fields(rows.select("i", F.col("t").alias("text")), "i")) < 150_000


def test_alike_pairs_meet_once_beyond_the_common_letters(spark):
    """names of more different characters than one number has bits; no pair twice, none lost."""
    import random

    from marlstone.operators import joins as J

    rnd = random.Random(5)
    alphabet = [chr(0x4E00 + k) for k in range(90)] + list("abcdefgh")
    names = sorted({"".join(rnd.choices(alphabet[:97] if k % 3 else alphabet[-12:], k=rnd.randint(3, 9))) for k in range(260)})
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = [(r["a"], r["b"], round(r["score"], 9)) for r in J.similar_pairs(df, df.withColumnRenamed("a", "b"), [], "a", "b", 0.55).collect()]
    assert len(got) == len(set(got))
    want = set()
    for x in names:
        for y in names:
            score = 1.0 if x == y else 0.88 if x in y or y in x else len(set(x) & set(y)) / max(len(x), len(y))
            if score >= 0.55:
                want.add((x, y, round(score, 9)))
    assert set(got) == want and len(J.alike_pairs(df, df.withColumnRenamed("a", "b"), [], "a", "b", 0.55).collect()) == len(set(r for r in [(a, b) for a, b, _ in got] if len(set(r[0]) & set(r[1])) / max(map(len, r)) >= 0.55))


def test_links_of_equal_rows_are_made_once(spark):
    """a thousand awards and as many candidates of one name are one pair of classes; each award still gets the least candidate."""
    from marlstone.operators import joins as J
    from marlstone.operators import linkage

    rows = spark.range(1000).select("id", F.lit("1").alias("package_no"), F.when(F.col("id") % 2 == 0, "L1").alias("lot_no"), F.lit("").alias("lot_name"), F.lit("").alias("project_code"), F.lit("电站改造").alias("project_name"), F.concat(F.lit("AB"), (F.col("id") % 2).cast("string"), F.lit("电力有限公司")).alias("supplier"))
    met = []
    real, linkage.similar_pairs = linkage.similar_pairs, lambda *a: met.append(a[:2]) or J.similar_pairs(*a)
    try:
        got = linkage.link(rows.withColumnRenamed("id", "award_id"), rows.withColumnRenamed("id", "candidate_id"), "award_id", "candidate_id", True).select("award_id", "o_candidate_id", "match").collect()
    finally:
        linkage.similar_pairs = real
    assert {tuple(r) for r in got} == {(i, i % 2, 1.0) for i in range(1000)} and len(got) == 1000
    assert all(side.count() <= 8 for side in met[0])


def test_regular_tables_and_units(spark):
    """The short way through a table, and units told once a table, give what the parser and the columns give."""
    from marlstone.functions import money, tables

    texts = [
        "<table></table>", "<table><tr></tr><tr><td> a  b\n</td><th>c > d</th></tr></table>", "<table><tr><td>1</th><td></td></tr></table>", "<table><tr><td>a&amp;b</td></tr></table>", "<table><tr><td>a<br>b</td></tr></table>",
        "<table><tr><td>a</td>x<td>b</tr></table>", "<TABLE><tr><td>a</td></tr></TABLE>", "<table><tr><td><table><tr><td>i</td></tr></table></td></tr></table>",
    ]
    regular = 0
    for t in texts:
        parser = tables._Tables()
        parser.feed(t)
        parser.close()
        assert tables._html(t) == parser.done, t
        regular += bool(tables._REGULAR.fullmatch(t))
    assert regular == 3
    headers = ["金额（万元）", "金额（元）", "金额", "单位：万元", "单位： 万 元", "元 / 万", "万", "人民币&nbsp;万", "金额(元)单位:万", "万人民币", "&amp;nbsp;/万", "第万号", "单位： 万"]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(headers)], "k int, h string")
    want = {r.k: r.m for r in rows.select("k", money.declares_many(money.unit_context(F.col("h"), F.lit(""))).alias("m")).collect()}
    assert tables.many_of(tuple(headers)) == [want[k] for k in range(len(headers))] and 0 < sum(want.values()) < len(headers)


def test_shared_values_become_arrow_once():
    """lists that rows share are converted once and keep their places, null among them."""
    import pyarrow as pa

    from marlstone.functions.arrow import _array

    one, two = ["a"], ["b", None]
    assert _array([one, two, one, None, one], pa.list_(pa.string())).to_pylist() == [["a"], ["b", None], ["a"], None, ["a"]]


def dealt(df, on: str) -> list[int]:
    """The numbers of tasks to which the plan deals rows by `on`."""
    return [int(n) for n in re.findall(rf"hashpartitioning\({on}, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


def test_documents_are_dealt_before_they_are_cut(spark, monkeypatch):
    """tokens are not shuffled, and tasks are as many as the documents need."""
    monkeypatch.setattr(session, "TASK_SIZE", 1024)
    df = spark.createDataFrame([(i, '{"a": [%d]}' % i) for i in range(40)], "k long, j string")
    assert dealt(json_rows.tokens(df, "k", "j"), r"k#\d+L")[0] > 8
    for out in (json_rows.tokens(df, "k", "j"), json_rows.canonical(df, "k", "j", "c"), json_rows.masked(df, "k", "j"), json_rows.found(df, "k", "j", ["a"])):
        assert all(n > 8 for n in dealt(out, r"k#\d+L"))
    assert {r["c"] for r in json_rows.canonical(df, "k", "j", "c").collect()} == {'{"a":[%d]}' % i for i in range(40)}


def test_as_of_rows_are_dealt_by_size(spark, monkeypatch):
    """what is sorted by key and day goes to as many tasks as it needs."""
    monkeypatch.setattr(session, "TASK_SIZE", 2048)
    left = spark.createDataFrame([(i, "2020-01-05") for i in range(9)], "k long, d string").withColumn("d", F.to_timestamp("d"))
    right = spark.createDataFrame([(i % 9, i, f"2020-01-{1 + i % 20:02d}") for i in range(180)], "k long, n long, e string").withColumn("e", F.to_timestamp("e"))
    out = joins.asof_within(left, right, ["k"], "d", "e", ["k"], 2, 3, [F.col("n")]).select("k", "n", "place")
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    want = []
    for k in range(9):
        rows = sorted((-(1 + i % 20), i) for i in range(180) if i % 9 == k and 1 + i % 20 <= 7)[:3]
        want += [(k, i, p) for p, (_, i) in enumerate(rows, 1)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_blocks_have_their_components_in_one_pass(spark, monkeypatch):
    """least labels of blocks that spread over several batches, without rounds, and each pair scored once."""
    import random

    from marlstone.operators import merging

    rnd = random.Random(3)
    edges = [(d, f"k{d}-{a:04}", f"k{d}-{b:04}") for d, n in ((1, 900), (2, 3), (3, 40)) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(n)) if a != b]
    least = {x: x for _, a, b in edges for x in (a, b)}
    for _ in range(len(least)):
        before = dict(least)
        for _, a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(edges, "doc int, a string, b string")
        assert {r["node"]: r["label"] for r in joins.block_components(df, ["doc"], "a", "b", len(edges)).collect()} == least
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(joins, "components", None)  # its rounds are not needed
    scored = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def points(a, b):
        scored.add(1)
        return 70 if a == b else 0

    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (2, 4, "x")], "doc int, id long, name string")
    got = merging.merge_records(df, ["doc"], "id", ["name"], points.asNondeterministic()("name_a", "name_b"), 65, [F.col("id")], [], members="n").collect()
    assert sorted((r.id, r.n) for r in got) == [(1, 2), (3, 1), (4, 1)]
    assert scored.value == 3


def test_values_without_digits_are_never_cast(spark):
    """clean values are told in one walk, folds and rates read as before, and texts that are no numbers raise nothing."""
    from marlstone.functions import money, text

    before = r"(?U)[&?？�　]|^\s|\s$|\s\s|[^\S ]"
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a\n", "a b", "a　b", "a b", "a᠎b", "a\u001cb", "a&b", "a?", "折 9.5 折", "９", "壹贰", "12.5 %x", "下浮 12..5%", "1.2 3%", "8 折", "折扣 1e2", "1e2", "x1", "5", "-3", ".5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(text.CLEAN).alias("clean"), F.col("t").rlike(before).alias("dirty"), money.read_decimal(F.col("t"), "decimal(18,8)").alias("a"), F.col("t").try_cast("decimal(18,8)").alias("b")).collect()
    assert [r.t for r in got if r.clean == r.dirty] == []
    assert [r.t for r in got if r.a != r.b] == []


def test_kinds_of_amounts_are_told_where_the_text_is(spark):
    """the kind of surroundings is the one that the column expression gives."""
    from marlstone.functions import money

    texts = ["代理 服务费", "招标代理服务费", "中标\n价", "中标 金额", "下浮率", "费&nbsp;率", "总报价", "折", "最高&amp;限价", "评审价格", "", "x"] + [w for _, words in money.AMOUNT_TYPES for w in words]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", money.classify_amount(F.col("t")).alias("kind")).collect()
    assert [r.t for r in got if r.kind != money.amount_kind(r.t)] == []


def test_lines_without_a_labels_words_are_not_searched(monkeypatch):
    """a line is searched for a label only where it holds words of it; the rows found stay the same."""
    searched = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def search(self, line):
            searched.append(line)
            return self.pattern.search(line)

    text = "公告\n\n包1\n中标人：S1公司\n中标金额（元）：5元\n报价：6元\n其他\n其他：无\n第二包 报价 : 7\n第一中标候选人:S2公司\n成交价: 8"
    for name in ("PACKAGE_LINE", "SUPPLIER_LINE", "AMOUNT_LINE"):
        monkeypatch.setattr(parsers, name, Counted(getattr(parsers, name)))
    assert parsers._outcomes(text) == [[4, "1", "S1公司", "5元"], [10, "1", "S2公司", "8"]]
    assert len(searched) == 6


def test_lines_of_reviews_are_dealt_by_their_number(spark, monkeypatch):
    """the tasks that number the lines of orders grow with the lines, whatever the session's setting."""
    from marlstone.plans import reviews

    monkeypatch.setattr(session, "TASK_SIZE", 6_000)
    rows = reviews._lines(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= rows.count() * joins.ROW_SIZE // 6_000


def alike(a: str, b: str) -> float:
    x, y = a.lower(), b.lower()
    return 1.0 if x == y else 0.88 if x in y or y in x else len(set(a) & set(b)) / max(len(a), len(b))


def test_names_are_compared_in_cells_and_not_broadcast(spark, monkeypatch):
    """of a group of many names a task holds two parts, whatever the optimizer thinks of the tables, and no pair is lost between parts."""
    import random

    rnd = random.Random(11)
    monkeypatch.setattr(joins, "CELL", 16)
    groups = {g: sorted({"".join(rnd.choices("abcABCdefgh" if g != "wide" else [chr(0x4E00 + k) for k in range(400)], k=rnd.randint(1, 8))) for _ in range(n)}) for g, n in (("one", 90), ("wide", 60), (None, 5), ("alone", 1))}
    df = spark.createDataFrame([(g, n) for g, names in groups.items() for n in names], "g string, a string")
    within = joins.similar_within(df, ["g"], "a", 0.55)
    got = [(r.g, r.a, r.b, r.score) for r in within.collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, a, b, alike(a, b)) for g, names in groups.items() for a in names for b in names if a < b and alike(a, b) >= 0.55}
    both = joins.similar_pairs(df, df.withColumnRenamed("a", "b"), ["g"], "a", "b", 0.55)
    assert sorted(map(str, ((r.g, r.a, r.b, r.score) for r in both.collect()))) == sorted(str((g, a, b, alike(a, b))) for g, names in groups.items() for a in names for b in names if alike(a, b) >= 0.55)
    for pairs in (within, both):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner" not in plan and plan.count("strategy=broadcast") == plan.count("Join LeftOuter") > 0 and "Filter" in plan.split("strategy=broadcast")[1]


def test_the_likest_of_each_kind(spark, monkeypatch):
    """of each kind of other rows a name keeps one, the likest with the least key, and the rest never leaves its cell."""
    import random

    rnd = random.Random(12)
    monkeypatch.setattr(joins, "CELL", 16)
    names = sorted({"".join(rnd.choices("abcABCdefgh", k=rnd.randint(1, 8))) for _ in range(120)})
    left = [("g", n) for n in names[::2]]
    right = [("g", n, 1000 - k, rnd.choice(["x", "y", None])) for k, n in enumerate(names + names)]
    got = joins.similar_pairs(spark.createDataFrame(left, "g string, a string"), spark.createDataFrame(right, "g string, b string, id long, lot string"), ["g"], "a", "b", 0.55, "id", ["lot"]).collect()
    best: dict = {}
    for _, a in left:
        for _, b, i, lot in right:
            if alike(a, b) >= 0.55:
                best[a, lot] = min(best.get((a, lot), (0, 0)), (-alike(a, b), i))
    lots = {i: lot for _, _, i, lot in right}
    cells = {}
    for r in got:
        cells[r.a, lots[r.id]] = min(cells.get((r.a, lots[r.id]), (0, 0)), (-r.score, r.id))
    assert cells == best and len(got) <= len(left) * 3 * -(-len(right) // 16)


ODD = ["", " ", "1", "包", "包3", "包03", "包000", "第二包", "标包7", "二", "1,234.5", "12.345元", "0.125", "3万元", "3万", "2.675", "123456789012.5", "5 元", "5%", "5分", "报价", "-", "NULL", " n/a ", "未识别", "??", "?1?", "a?b", "a  b", "a　b", " a", "a b", "&nbsp;7", "&amp;lt;", "流标",
       "S1 电力有限公司", "S1电力有限公司", "甲乙", "1、甲电力公司", "中标人：甲电力公司", "第一名 甲公司", "甲公司 乙公司 丙", "甲（北京）公司", "公司", "A-B公司", "甲公司。", "包2 材料", "标包 五 材料", "1e3", "٣", "包 12", "12345678901.125", "9,9"]


def told_tables() -> list:
    import random

    rnd = random.Random(8)
    heads = [["包号", "分标编号", "分标名称", "中标人", "中标金额（万元）", "状态"], ["分包编号", "供应商名称", "成交金额（元）"], ["序号", "报价"], ["分标号", "标段名称", "标包名称", "采购数量", "概算金额（万元）", "行报价最高限价", "交货地点", "工期"], ["包号", "项目名称", "数量", "预算金额", "中标人"]]
    return [(h, [[rnd.choice(ODD) for _ in range(len(h) - (rnd.random() < 0.1))] for _ in range(60)]) for h in heads]


def test_rows_told_by_the_parser_are_those_of_the_columns(spark):
    """plain rows are told where the cells are at hand, without a window behind; all rows, odd ones too, are what the columns give."""
    from marlstone.functions import tables, text

    got = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", text.clean_value(F.col("t")).alias("c")).collect()
    assert [r.t for r in got if r.c != text.clean_text(r.t)] == [] and text.clean_text(None) == ""
    key = lambda rows: sorted(map(str, rows))
    for told, read in (("award", tables.award_rows), ("listed", tables.procurement_packages)):
        plain, short = (spark.createDataFrame([(1, *r) for r in tables.table_rows(told_tables(), t)], f"id int, {tables.told_rows(t)}") for t in (None, told))
        odd = [r[told].odd for r in short.collect() if r[told]]
        assert 0 < sum(odd) < len(odd)
        out = read(short, "id")
        assert key(out.collect()) == key(read(plain, "id").collect()) and out.count() > 40
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_words_look_up_only_as_far_as_rows_reach():
    """a page's words are read in time that grows with the words and not with their square."""
    from marlstone.sources.files import Word, rows_of_words

    asked = [0]

    class Top(float):
        def __le__(self, other):
            asked[0] += 1
            return float(self) <= other

    words = [Word(f"w{k}-{x}", float(x), Top(k * 20.0), x + 60.0, k * 20.0 + 8) for k in range(300) for x in (0, 100)]
    rows = rows_of_words(words)
    assert rows == [[f"w{k}-0", f"w{k}-100"] for k in range(300)] and asked[0] < 2000


def test_batches_are_worked_on_piece_by_piece(spark):
    """however many pages a batch holds, only so many are turned into Python rows at a time, and none is lost or taken twice."""
    from marlstone.functions import arrow
    from marlstone.sources import files

    rows = spark.range(0, 2500, 1, 1)
    out = arrow.added(rows, ["id"], lambda batch: (None, [[batch.num_rows] * batch.num_rows]), "held long").collect()
    assert sorted(r.id for r in out) == list(range(2500)) and max(r.held for r in out) <= arrow.PIECE
    words = spark.createDataFrame([(k, 1, t, float(x), float(y), x + 60.0, y + 8.0) for k in range(1200) for t, x, y in (("包号", 0, 0), ("中标人", 100, 0), (f"包{k}", 0, 20), (f"S{k}公司", 100, 20))], "k int, page int, text string, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    got = files.word_tables(words, "k", "award").select("k", "cells", "award.supplier").collect()
    assert sorted((r.k, r.cells, r.supplier) for r in got) == [(k, [f"包{k}", f"S{k}公司"], f"S{k}公司") for k in range(1200)]
