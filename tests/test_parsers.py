"""Parsers, snapshots and named exports."""

import json
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marlstone.context import AccessContext
from marlstone.functions import parsers
from marlstone.sources import exports, snapshots
from marlstone.sources.sinks import ExportColumn

NOTICE = "项目名称：变电站改造\n项目编号：AB12CD-7\n采购人：某某电力有限公司\n预算金额：150万元\n开标时间：2026年6月4日 9:30\n包1\n中标人：甲有限公司\n中标金额：86万元\n包2\n成交供应商：乙有限公司\n"


def test_parsers(spark):
    docs = spark.createDataFrame([(1, NOTICE), (2, None), (3, "")], "id long, text string")
    got = [(r.id, r.package_no, r.supplier, r.amount) for r in parsers.outcome_lines(docs, "id").orderBy("line").collect()]
    assert got == [(1, "1", "甲有限公司", D("860000.00")), (1, "2", "乙有限公司", None)]
    f = {r.id: r for r in parsers.notice_fields(docs, "id").collect()}
    assert (f[1].project_code, f[1].project_name, f[1].buyer_name, f[1].budget, f[1].open_bid_time) == ("AB12CD", "变电站改造", "某某电力有限公司", 1500000, datetime(2026, 6, 4, 9, 30))
    assert f[2].publish_time is None and f[3].project_code == ""


def test_snapshots(spark, tmp_path):
    pages = [{"menu": "a", "page": 1, "items": [{"id": "1", "title": "X-1 one", "url": "u1", "published": "2026-01-01"}, {"id": "2", "title": "two", "url": "u2", "published": None}]}, {"menu": "b", "page": 1, "items": [{"id": "1", "title": "x-1 newer", "url": "u1", "published": "2026-01-02"}]}]
    (tmp_path / "j").mkdir()
    (tmp_path / "h").mkdir()
    (tmp_path / "j/p.json").write_text("\n".join(map(json.dumps, pages)))
    (tmp_path / "h/c-2.html").write_text("<ul><li><a href='/n/9'>x-1 &amp; html</a> <span>2026-03-04</span></li></ul>")
    found = snapshots.search_fan_out([snapshots.json_pages(spark, str(tmp_path / "j")), snapshots.html_pages(spark, str(tmp_path / "h"))], "X-1")
    assert sorted((r.notice_id, r.menu, r.title) for r in found.collect()) == [("/n/9", "c", "x-1 & html"), ("1", "b", "x-1 newer")]
    assert len(snapshots.json_pages(spark, str(tmp_path / "j")).collect()) == 3


def test_exports(spark, tmp_path):
    ctx = AccessContext(datetime(2026, 1, 1), 1)
    exports.EXPORTS["numbers"] = exports.Export(lambda s, c, q: s.range(q["n"]), [ExportColumn("id", "Id")], lambda: [F.col("id")], "export.numbers")
    assert exports.fingerprint({"n": 3, "userId": 5}) == exports.fingerprint({"tenant_id": 9, "n": 3})
    with pytest.raises(PermissionError):
        exports.run_export(spark, "numbers", ctx, set(), {"n": 3}, str(tmp_path))
    assert exports.run_export(spark, "numbers", ctx, {"export.numbers"}, {"n": 3}, str(tmp_path)).count() >= 2


def test_awards_in_sentences():
    from marlstone.functions.parsers import award_of_sentence

    cases = {
        "包1：广州丙建设有限公司": ("包1", "广州丙建设有限公司"),
        "第二包 中标人：北京甲科技有限公司中标": ("第二包", "北京甲科技有限公司"),
        "标包03 = 成交供应商 某某勘察院（北京）研究院": ("标包03", "某某勘察院（北京）研究院"),
        "包1：招标人：甲有限公司": None,
        "包1：招标人：甲有限公司，包2 成交人 乙丙电力公司": ("包2", "乙丙电力公司"),
        "包1甲乙有限公司": None,
        "包1：公司": None,
        "包1：某个人": None,
        "": None,
    }
    assert {s: award_of_sentence(s) for s in cases} == cases


def test_award_evidence_of_one_text(spark):
    from marlstone.functions.parsers import award_evidence

    text = "项目编号：P-003\n包1：广州丙建设有限公司。包1：广州丙建设有限公司；\n| 包号 | 成交人 | 成交金额（万元） | 状态 |\n| 包2 | 甲乙有限公司 | 65.88 | 成交 |\n| 包3 | 丁戊有限公司 | 1 | 流标 |\n| 包4 | 己庚有限公司 |  | |"
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, text), (None, text), (7, None)], "id long, text string").coalesce(1)
    got = sorted((r["id"] or 0, r["part"], r["package_no"], r["supplier"], float(r["amount"] or 0), float(r["confidence"])) for r in award_evidence(docs, "id").collect())
    one = [("sentence", "1", "广州丙建设有限公司", 0.0, 0.72), ("table", "2", "甲乙有限公司", 658800.0, 0.93), ("table", "4", "己庚有限公司", 0.0, 0.88)]
    assert got == [(0, *r) for r in one] + [(big, *r) for r in one]


def test_parsers_keep_large_ids_beside_nulls(spark):
    from marlstone.functions import parsers, tables

    big = 2**53 + 1
    text = "包1\n中标人：甲乙有限公司\n中标金额：5万元\n| 包号 | 中标人 |\n| 包2 | 丙丁有限公司 |"
    docs = spark.createDataFrame([(big, text), (None, text), (None, None)], "id long, text string").coalesce(1)
    for frame in (parsers.outcome_lines(docs, "id"), tables.parse_tables(docs, "id"), tables.extract_amounts(docs, "id")):
        assert {r["id"] for r in frame.collect()} == {big, None}
    assert tables.parse_tables(docs.filter("text is null"), "id").collect() == []


def test_file_text_in_sql(spark):
    import pytest

    from marlstone.sources import files

    files.register_table_function(spark)
    rows = spark.createDataFrame([("a.txt", b"x\ny"), ("b.html", b"<p>T</p>"), ("c.zip", b"broken"), (None, b"x"), ("d.txt", None)], "path string, content binary")
    rows.createOrReplaceTempView("some_files")
    got = sorted(tuple(r) for r in spark.sql("select t.path, t.line, t.text, t.error is not null from some_files f, lateral file_text(f.path, f.content, lines => true) t").collect() if r["path"] != "c.zip")
    assert got == [("a.txt", 1, "x", False), ("a.txt", 2, "y", False), ("b.html", 1, "T", False)]
    assert spark.sql("select t.* from some_files f, lateral file_text(f.path, f.content) t where t.error is not null").count() == 1
    with pytest.raises(Exception, match="file_text"):
        spark.sql("select * from file_text(1, 2)").collect()
