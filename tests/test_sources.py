"""Files, tables in text, exports, ingestion streams."""

import io
import zipfile
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marlstone.context import AccessContext
from marlstone.functions import tables as T
from marlstone.sources import files, sinks
from marlstone.streaming import ingest


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = zipped({
    "xl/workbook.xml": "<workbook><sheets><sheet name='S'/></sheets></workbook>",
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>5</v></c></row></sheetData></worksheet>",
})


def test_files(spark, tmp_path):
    nested = zipped({"in.txt": "inner", "../bad.txt": "x", "deep.zip": zipped({"d.html": "<p>d<script>x</script></p>"})})
    for name, data in {"a.txt": "é".encode(), "b.html": b"<p>x &amp; y</p>", "c.docx": DOCX, "d.xlsx": XLSX, "e.zip": nested, "f.bin": b"\x00abcd\x01" + "wide".encode("utf-16-le"), "g.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.extract_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "é" and got["b.html"].text == "x & y" and got["c.docx"].text == "Hello\n| a |  |\n| --- | --- |\n| 1 |  |"
    assert got["d.xlsx"].text == "# S\n| name |  | 5 |\n| --- | --- | --- |" and got["e.zip!in.txt"].text == "inner" and got["e.zip!deep.zip!d.html"].text == "d"
    assert got["bad.txt"].error == "unsafe path" and "wide" in got["f.bin"].text and got["g.docx"].error.startswith("BadZipFile")


def test_word_boxes():
    words = [files.Word("No", 0, 0, 10, 10), files.Word("Name", 50, 0, 80, 10), files.Word("1", 0, 20, 5, 30), files.Word("Acme", 50, 20, 70, 30), files.Word("Co", 75, 20, 85, 30), files.Word("Ltd", 50, 40, 60, 50)]
    assert files.rows_of_words(words) == [["No", "Name"], ["1", "Acme Co Ltd"]]


AWARD = "<table><tr><th>包号</th><th>成交供应商</th><th>成交金额（万元）</th></tr><tr><td>包1</td><td>甲有限公司</td><td>65.88</td></tr><tr><td></td><td>乙有限公司</td><td>3</td></tr></table>"
CAND = "| 包号 | 第一中标候选人 | 第二中标候选人 |\n| --- | --- | --- |\n| 包2 | 甲有限公司 | 乙有限公司 |"


def test_tables(spark):
    docs = spark.createDataFrame([(1, AWARD), (2, CAND), (3, "A  B\n1  2\n\nplain"), (4, None), (5, "")], "id long, text string")
    t = T.parse_tables(docs, "id")
    assert sorted((r.id, r.row_index, r.raw) for r in t.collect()) == [(1, 0, "包1 | 甲有限公司 | 65.88"), (1, 1, " | 乙有限公司 | 3"), (2, 0, "包2 | 甲有限公司 | 乙有限公司"), (3, 0, "1 | 2")]
    got = [(r.package_no, r.supplier, r.amount) for r in T.award_rows(t.filter("id = 1"), "id").orderBy("row_index").collect()]
    assert got == [("1", "甲有限公司", D("658800.00")), ("1", "乙有限公司", D("30000.00"))]
    assert [(r.package_no, r["rank"], r.supplier) for r in T.candidate_rows(t.filter("id = 2"), "id").orderBy("rank").collect()] == [("2", 1, "甲有限公司"), ("2", 2, "乙有限公司")]
    tender = spark.createDataFrame([(1, "| 包号 | 预算金额 | 最高限价 |\n| 包3 | 150万元 | 140万元 |")], "id long, text string")
    assert [(r.package_no, r.budget, r.ceiling) for r in T.tender_rows(T.parse_tables(tender, "id"), "id").collect()] == [("3", 1500000, 1400000)]


def test_tables_of_mixed_forms(spark):
    blank = "包号  成交供应商  成交金额（万元）\n包7  丙有限公司  8"
    pipes = "| 包号 | 预算金额 |\n| --- | --- |\n| 包3 | 150万元 |"
    mixed = f"<p>公告</p>\n{blank}\n{pipes}\n<div>{AWARD}</div>\n{CAND}\n<p>完</p>"
    cut = f"{CAND}\n<table><tr><th>A</th><th>B</th></tr>\n<tr><td>1</td><td>2</td>\n{pipes}"
    docs = spark.createDataFrame([(1, mixed), (2, cut), (3, f"{blank}\n\n{CAND}")], "id long, text string")
    t = T.parse_tables(docs, "id")
    assert [(r.id, r.table_index, r.row_index, r.raw) for r in t.orderBy("id", "table_index", "row_index").collect()] == [
        (1, 0, 0, "包7 | 丙有限公司 | 8"), (1, 1, 0, "包3 | 150万元"), (1, 2, 0, "包1 | 甲有限公司 | 65.88"), (1, 2, 1, " | 乙有限公司 | 3"), (1, 3, 0, "包2 | 甲有限公司 | 乙有限公司"),
        (2, 0, 0, "包2 | 甲有限公司 | 乙有限公司"), (2, 1, 0, "1 | 2"), (2, 2, 0, "包3 | 150万元"), (3, 0, 0, "包7 | 丙有限公司 | 8"), (3, 1, 0, "包2 | 甲有限公司 | 乙有限公司"),
    ]
    assert [r.supplier for r in T.award_rows(t.filter("id = 1"), "id").orderBy("table_index", "row_index").collect()] == ["丙有限公司", "甲有限公司", "乙有限公司"]
    assert T.candidate_rows(t.filter("id = 1 and table_index = 3"), "id").count() == 2 and T.tender_rows(t.filter("id = 1"), "id").count() == 4


def test_amounts(spark):
    text = "成交金额：65.88万元\n" + "-" * 50 + "\n预算金额 150 万元\n" + "-" * 50 + "\n投标保证金：5000元\n" + "-" * 50 + "\n折扣率：八五折\n" + "-" * 50 + "\n下浮率：12.5%\n" + "-" * 50 + "\n综合费率：1.5%"
    got = [(r.amount_type, float(r.value), r.status, r.line) for r in T.extract_amounts(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").orderBy("at").collect()]
    assert got == [("DealAmount", 658800.0, "Recommended", 1), ("BudgetAmount", 1500000.0, "Rejected", 3), ("Deposit", 5000.0, "Rejected", 5), ("DiscountRate", 0.85, "Unresolved", 7), ("ReductionRate", 0.125, "Unresolved", 9), ("Rate", 0.015, "Unresolved", 11)]


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("Ada", D("12.345"), datetime(2026, 6, 4, 1, 2), "s", 'q"x')], "name string, amount decimal(10,3), created timestamp_ntz, secret string, note string")
    columns = [sinks.ExportColumn("name", "Name", order=3), sinks.ExportColumn("amount", "Amount", "number", "0.00", 1), sinks.ExportColumn("created", "Created", "datetime", "yyyy-MM-dd HH:mm", 2), sinks.ExportColumn("secret", "Secret", hidden=True), sinks.ExportColumn("note", "Note", order=4)]
    head, body = sinks.export_lines(rows, columns, [F.col("name")])
    assert (head, [r.value for r in body.collect()]) == ("Amount,Created,Name,Note", ['12.35,2026-06-04 01:02,Ada,"q""x"'])
    ids = spark.range(1, 8)
    manifest = sinks.write_csv(ids, [sinks.ExportColumn("id", "Id")], [F.col("id")], str(tmp_path / "out"), max_rows=5).collect()
    text = "".join(open(r.file.removeprefix("file:"), encoding="utf-8").read() for r in manifest)
    assert text == "﻿Id\n1\n2\n3\n4\n5\n" and all(r.bytes and len(r.sha256) == 64 for r in manifest)


def test_stamps(spark):
    ctx = AccessContext(datetime(2026, 1, 1), 7, user_id=3)
    got = sinks.stamped(spark.createDataFrame([(1, None), (2, 7)], "id long, tenant_id long"), ctx)
    assert [(r.tenant_id, r.created_by, r.version) for r in got.collect()] == [(7, 3, 1)] * 2
    with pytest.raises(Exception, match="another tenant"):
        sinks.stamped(spark.createDataFrame([(1, 8)], "id long, tenant_id long"), ctx).collect()
    live = got.withColumns({"deleted_at": F.lit(None).cast("timestamp_ntz"), "deleted_by": F.lit(None).cast("long")})
    gone = sinks.soft_deleted(live, spark.createDataFrame([(2,)], "id long"), "id", ctx)
    assert sorted((r.id, r.is_deleted, r.deleted_by) for r in gone.collect()) == [(1, False, None), (2, True, 3)]


def test_queue(spark):
    schema = "id long, status string, outcome string, attempt_count int, max_attempts int, lease_until timestamp_ntz, cancel_requested boolean"
    late, soon = datetime(2026, 1, 1), datetime(2026, 1, 3)
    jobs = [(1, "Running", "Succeeded", 1, 3, soon, False), (2, "Running", "Failed", 2, 3, soon, False), (3, "Running", None, 3, 3, late, False), (4, "Pending", None, 0, 3, None, True), (5, "Running", None, 1, 3, soon, False), (6, "Running", "Failed", 1, 3, soon, True)]
    as_of = F.lit("2026-01-02 00:00:00").cast("timestamp")
    got = {r.id: r.s for r in spark.createDataFrame(jobs, schema).select("id", ingest.next_job_state(as_of, 30, 3600).alias("s")).collect()}
    assert [got[i].status for i in range(1, 7)] == ["Succeeded", "Pending", "DeadLetter", "Cancelled", "Running", "Cancelled"] and got[2].next_attempt_at == datetime(2026, 1, 2, 0, 1)
    queue = spark.createDataFrame([(1, "a", "Running"), (2, "b", "Succeeded")], "id long, deduplication_key string, status string")
    new = spark.createDataFrame([(3, "a", "Pending"), (4, "b", "Pending"), (5, "b", "Pending"), (6, None, "Pending")], "id long, deduplication_key string, status string")
    assert sorted(r.id for r in ingest.enqueue(queue, new).collect()) == [4, 6]


def test_cursor(spark):
    state = spark.createDataFrame([("c", 5, 2, 10, 1, 0, 0, 3)], "ch string, high_watermark long, low_watermark long, scanned long, created long, changed long, failed long, next_cursor long")
    batch = spark.createDataFrame([("c", 7, "Created"), ("c", 1, "Refreshed"), ("d", 4, "Failed")], "ch string, t long, outcome string")
    got = {r.ch: tuple(r)[1:] for r in ingest.advance_cursor(state, batch, ["ch"], "t", incremental=False).collect()}
    assert got == {"c": (7, 1, 12, 2, 0, 0, 4), "d": (4, 4, 1, 0, 0, 1, 1)} and not ingest.run_is_done(batch)
