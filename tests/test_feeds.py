"""Data sources for lists and exports, and keyed state in streams."""

import hashlib
import json
import os
import subprocess
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from marlstone.sources import csv_export, notice_list, sinks, stores
from marlstone.streaming import state

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def save(path, menu, page, text, kind="json", name="a"):
    os.makedirs(f"{path}/menu={menu}/page={page}", exist_ok=True)
    with open(f"{path}/menu={menu}/page={page}/{name}.{kind}", "w", encoding="utf-8") as f:
        f.write(text)


def item(i, title="T", published="2026-01-02"):
    return json.dumps({"id": i, "title": title, "url": f"u/{i}", "published": published})


def read(spark, path, **options):
    reader = notice_list.register(spark).read.format("notice_list").option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_lists_in_two_protocols(spark, tmp_path):
    save(tmp_path, "a", 1, '{"items": [' + item("x1") + "," + item("x2", None, "no day") + "]}")
    save(tmp_path, "a", 2, item("x3") + "\n\n" + item("x4"))
    save(tmp_path, "b", 1, "<ul><li class=q><a class='t' href='d?a=1&amp;b=2'>A &amp; <b>B</b></a><i>2026-03-04 05:06</i></li><li>no link</li><li><a href='e'>E</a></li></ul>", "html")
    save(tmp_path, "b", 2, "noise", "css")
    got = sorted(tuple(r) for r in read(spark, tmp_path).select("menu", "page", "position", "notice_id", F.coalesce("title", F.lit("-")).alias("t"), F.coalesce(F.col("published").cast("string"), F.lit("-")).alias("p")).collect())
    assert got == [
        ("a", 1, 1, "x1", "T", "2026-01-02 00:00:00"), ("a", 1, 2, "x2", "-", "-"), ("a", 2, 1, "x3", "T", "2026-01-02 00:00:00"), ("a", 2, 2, "x4", "T", "2026-01-02 00:00:00"),
        ("b", 1, 1, "d?a=1&b=2", "A & B", "2026-03-04 05:06:00"), ("b", 1, 2, "e", "E", "-"),
    ]
    assert [r["notice_id"] for r in read(spark, tmp_path, search="a &").collect()] == ["d?a=1&b=2"]
    assert read(spark, tmp_path, menus="c").collect() == [] and read(spark, tmp_path / "none").collect() == []


def test_filters_leave_pages_unread(spark, tmp_path):
    for n in range(1, 6):
        save(tmp_path, "a", n, item(f"x{n}"))
    save(tmp_path, "a", 6, "not json")
    save(tmp_path, "b", 1, "not json")
    rows = read(spark, tmp_path).filter("menu = 'a' and page > 3 and page <= 5 and title = 'T'")
    assert sorted(r["notice_id"] for r in rows.collect()) == ["x4", "x5"]
    assert rows.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="JSON"):
        read(spark, tmp_path).collect()


def test_a_list_stream_goes_on_behind_its_offset(spark, tmp_path):
    pages, seen = tmp_path / "pages", []

    def run():
        stream = notice_list.register(spark).readStream.format("notice_list").option("path", str(pages)).load()
        stream.writeStream.foreachBatch(lambda df, i: seen.append(sorted(r["notice_id"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)

    save(pages, "a", 1, item("x1"))
    run()
    run()  # nothing new
    save(pages, "a", 1, "not read again", name="late")
    save(pages, "a", 2, item("x2"))
    save(pages, "b", 1, item("y1"))
    run()
    assert [s for s in seen if s] == [["x1"], ["x2", "y1"]]


def test_an_export_is_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(3, 'q"x'), (1, None), (2, "a,b")], "id long, note string").repartition(3)
    path = f"{tmp_path}/out/x.csv"
    got = csv_export.write_file(rows, [sinks.ExportColumn("id", "Id"), sinks.ExportColumn("note", "Note")], [F.col("id")], path).first()
    data = open(path, "rb").read()
    assert data.decode() == '﻿Id,Note\n1,\n2,"a,b"\n3,"q""x"\n'
    assert (got["bytes"], got["rows"], got["sha256"]) == (len(data), 3, hashlib.sha256(data).hexdigest())
    assert sorted(os.listdir(tmp_path / "out")) == ["x.csv", "x.csv.manifest.json"]
    again = csv_export.write_file(rows.limit(0), [sinks.ExportColumn("id", "Id")], [F.col("id")], path).first()
    assert again["rows"] == 0 and open(path, "rb").read().decode() == "﻿Id\n"


FAULTS = """
import os, sys
from pyspark.sql import functions as F, types as T
from marlstone.session import local_session
from marlstone.sources import csv_export, sinks
spark = local_session("2, 3", 3, "1g")
folder, often = sys.argv[1], sys.argv[2] == "always"

def fail(batches):
    from pyspark import TaskContext
    for batch in batches:
        yield batch
    c = TaskContext.get()
    if c.partitionId() == 1 and (often or c.attemptNumber() == 0):
        os._exit(1)  # the worker dies behind its last row

rows = csv_export.register(spark).range(0, 300, 1, 3).select(F.col("id").cast("string").alias("value")).mapInArrow(fail, "value string")
rows.write.format("csv_export").mode("append").option("path", f"{folder}/x.csv").option("header", "Id").option("job", "j").save()
"""


@pytest.mark.parametrize("kind", ["once", "always"])
def test_a_task_that_dies_leaves_nothing(tmp_path, kind):
    out = subprocess.run([sys.executable, "-c", FAULTS, str(tmp_path), kind], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    if kind == "once":
        assert out.returncode == 0, out.stderr[-2000:]
        assert open(tmp_path / "x.csv", encoding="utf-8").read() == "﻿Id\n" + "".join(f"{n}\n" for n in range(300))
        assert sorted(os.listdir(tmp_path)) == ["x.csv", "x.csv.manifest.json"]
    else:
        assert out.returncode != 0 and os.listdir(tmp_path) == []


def test_paths_and_addresses(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("hello")
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        (file,) = stores.files_under(path)
        assert b"".join(stores.pieces(stores.opened(path)[0], file)) == b"hello"


def arrivals(spark, path, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        yield spark.readStream.schema(schema).parquet(f"{path}/in")


def test_newest_by_key_tells_what_happened(spark, tmp_path):
    schema, path, big = "id long, at long, h string, src string", str(tmp_path), 2**53 + 1
    batches = [(big, 2, "a", "s"), (None, 1, "n", "s"), (big, 1, "old", "s")], [(big, 3, "a", "s"), (5, None, "x", "s")], [(big, 1, "late", "s"), (None, 2, "n", "moved")], [(big, 4, "b", "s"), (5, 1, "x", "s")]
    for source in arrivals(spark, path, schema, *batches):
        state.run_to_log(state.newest_by_key(source, ["id"], ["at"], "h", ["src"]), path).awaitTermination(120)
    log = state.log(spark, path)
    got = sorted((r["turn"], r["id"] or 0, r["h"], r["outcome"]) for r in log.collect())
    assert got == [(0, 0, "n", "Created"), (0, big, "a", "Created"), (1, 5, "x", "Created"), (1, big, "a", "Refreshed"), (2, 0, "n", "IdentityUpdated"), (2, big, "a", "Late"), (3, 5, "x", "Refreshed"), (3, big, "b", "Changed")]
    assert {(r["id"], r["at"], r["h"], r["src"]) for r in state.current(log, ["id"]).collect()} == {(big, 4, "b", "s"), (None, 2, "n", "moved"), (5, 1, "x", "s")}


def test_a_batch_that_breaks_off_is_run_again_once(spark, tmp_path):
    """The sink fails behind its write: the batch comes again, and neither state nor log counts it twice."""
    path, schema, broken = str(tmp_path), "id long, text string", []

    def fail(batch):
        broken.append(batch.count())
        if len(broken) == 1:
            raise RuntimeError("crash")
        return batch

    for source in arrivals(spark, path, schema, [(1, "a"), (1, "a"), (2, "b")]):
        with pytest.raises(Exception, match="crash"):
            state.run_to_log(state.inbox(source, ["id"]), path, "append", fail).awaitTermination(120)
        state.run_to_log(state.inbox(source, ["id"]), path, "append", fail).awaitTermination(120)
    for source in arrivals(spark, path, schema, [(1, "again"), (3, "c")]):
        state.run_to_log(state.inbox(source, ["id"]), path, "append").awaitTermination(120)
    assert sorted((r["turn"], r["id"], r["text"]) for r in state.log(spark, path).collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 3, "c")]


def test_deliveries_wait_for_their_timer(spark, tmp_path):
    path, t = str(tmp_path), lambda s: datetime.fromtimestamp(1_000_000 + s, timezone.utc)
    batches = [(1, t(0), "Enqueued"), (1, t(10), "Failed"), (2, t(5), "Enqueued")], [(2, t(20), "Succeeded"), (1, t(39), "Tick")], [(9, t(50), "Tick")], [(1, t(60), "Failed"), (9, t(61), "Tick")], [(2, t(70), "Failed"), (1, t(61), "Enqueued")]
    for source in arrivals(spark, path, "id long, at timestamp, event string", *batches):
        state.run_to_log(state.deliveries(source, ["id"], "at", "event", most=2), path, "append").awaitTermination(120)
    got = sorted((r["id"], r["attempt"], r["due"].replace(tzinfo=timezone.utc), r["action"]) for r in state.log(spark, path).collect())
    assert got == [(1, 1, t(0), "Dispatch"), (1, 2, t(40), "Dispatch"), (1, 2, t(60), "DeadLetter"), (2, 1, t(5), "Dispatch")]


def test_deliveries_of_a_batch_that_breaks_off_and_late_events(spark, tmp_path):
    """Deliveries run in built-in functions: a repeated batch counts once, two failures start two timers, late events and null keys are as before."""
    path, t, broken = str(tmp_path), lambda s: datetime.fromtimestamp(1_000_000 + s, timezone.utc), []

    def fail(batch):
        broken.append(batch.count())
        assert "Python" not in batch._jdf.queryExecution().executedPlan().toString()
        if len(broken) == 2:
            raise RuntimeError("crash")
        return batch

    batches = [(1, t(0), "Enqueued"), (1, t(10), "Failed"), (1, t(11), "Failed"), (None, t(3), "Enqueued")], [(None, t(5), "Failed"), (3, t(11), "Enqueued"), (4, t(50), "Enqueued")], [(None, t(60), "Succeeded"), (1, t(70), "Failed"), (4, t(51), "Failed")], [(9, t(500), "Tick")]
    for n, source in enumerate(arrivals(spark, path, "id long, at timestamp, event string", *batches)):
        run = lambda: state.run_to_log(state.deliveries(source, ["id"], "at", "event", most=3), path, "append", fail).awaitTermination(120)  # noqa: B023, E731
        if n == 1:
            with pytest.raises(Exception, match="crash"):
                run()
        run()
    got = sorted((r["turn"], r["id"] or 0, r["attempt"], r["due"].replace(tzinfo=timezone.utc), r["action"]) for r in state.log(spark, path).collect())
    assert got == [
        (0, 0, 1, t(3), "Dispatch"), (0, 1, 1, t(0), "Dispatch"), (1, 1, 2, t(40), "Dispatch"), (1, 1, 3, t(41), "Dispatch"), (1, 4, 1, t(50), "Dispatch"),
        (2, 1, 3, t(70), "DeadLetter"), (3, 4, 2, t(81), "Dispatch"),
    ]
    assert sorted(os.listdir(f"{path}/table")) == ["turn=2", "turn=3"]


def test_an_inbox_of_bare_keys_runs_without_python(spark, tmp_path):
    path, big = str(tmp_path), 2**53 + 1
    for source in arrivals(spark, path, "id long, kind string", [(big, "a"), (big, "a"), (None, "a")], [(big, "a"), (None, "a"), (None, None), (big, "b")]):
        run = state.run_to_log(state.inbox(source, ["id", "kind"]), path, "append")
        run.awaitTermination(120)
        assert "Python" not in run._jsq.explainInternal(False)
    assert sorted((r["turn"], r["id"] or 0, r["kind"] or "") for r in state.log(spark, path).collect()) == [(0, 0, "a"), (0, big, "a"), (1, 0, ""), (1, big, "b")]
