"""Operators on literal rows."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marlstone.context import AccessContext
from marlstone.operators import analytics as A
from marlstone.operators import joins as J
from marlstone.operators import linkage, merging, scoring
from marlstone.operators import search as S
from marlstone.operators.pricing import price_decision
from marlstone.sources.catalog import Catalog, TableScope
from marlstone.streaming import commands as C

NOW = datetime(2026, 6, 4)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scopes(spark):
    data = spark.createDataFrame([(1, 100, 1, False), (2, 200, 1, False), (3, 100, 2, False), (4, 100, 1, True)], "id long, tenant_id long, store_id long, is_deleted boolean")
    cat = Catalog(spark, frames={"t": data, "s": data, "o": data, "n": data}, scopes={"t": TableScope(), "s": TableScope("shared"), "o": TableScope("store_only"), "n": TableScope("none")})
    ctx = AccessContext(NOW, 100, 2, (1,))
    ids = lambda *a, **k: [r.id for r in cat.scan(*a, **k).orderBy("id").collect()]
    assert ids("t", ctx) == [1, 3] and ids("t", AccessContext(NOW, 999), tenant_id=100) == [1, 3] and ids("t", AccessContext(NOW)) == []
    assert ids("s", ctx) == [1] and ids("o", ctx) == [3] and ids("o", AccessContext(NOW, 100)) == [] and ids("n", ctx) == [1, 2, 3]
    assert ids("t", ctx, policy="own") == [] and ids("t", ctx, policy="what") == [] and ids("t", ctx, policy="current_store") == [3]
    assert [r.id for r in cat.by_id("t", ctx, 2).collect()] == [] and [r.id for r in cat.after("t", 2, 5).collect()] == [3, 4]
    plan = cat.scan("t", ctx)._jdf.queryExecution().optimizedPlan().toString()
    assert "tenant_id" in plan and "100" in plan


def test_search(spark):
    data = spark.createDataFrame([(i, f"Name {i % 3}", float(i)) for i in range(50)], "id long, name string, v double")
    spec = S.SearchSpec(["name"], {"v": ["v desc"]}, "v", "id", "id")
    assert [r.id for r in S.page(S.search(data, spec, "NAME 1"), 2, 5).rows.collect()] == [34, 31, 28, 25, 22]
    page = S.page(S.search(data, spec), 0, 0)
    assert (page.total, page.index, page.size) == (50, 1, 20) and S.clamp(3, 999) == (3, 200)
    assert [r.id for r in S.search(data, spec, "7").collect()] == [7]
    with pytest.raises(ValueError):
        S.range_filter("v", 2, 1)
    for wrong in (["x"], ["id", "ID"], [" "]):
        with pytest.raises(ValueError):
            S.pick_columns(data, wrong)
    exact = spark.createDataFrame([('{"channelId":1}',), ('{"channelId":12}',)], "p string")
    assert exact.filter(S.json_value_filter("p", "$.channelId", 1)).count() == 1  # a text probe would find both


def test_windows_do_not_depend_on_partitions(spark):
    data = [(i, i % 7, (i * 37) % 11, None if i % 4 else f"k{i}") for i in range(200)]
    schema = "id long, g long, v long, k string"
    for f in (
        lambda d: A.first_per_key(d, ["g"], [F.desc("v"), F.col("id")]),
        lambda d: A.fill_down(d, ["g"], [F.col("id")], "k", "filled"),
        lambda d: A.limited_by_type(d, "g", [F.desc("v"), F.col("id")], 3, 10),
        lambda d: A.unique_best(d, ["g"], [F.desc("v")]),
    ):
        one, many = f(spark.createDataFrame(data, schema).coalesce(1)), f(spark.createDataFrame(data[::-1], schema).repartition(8))
        assert rows(one, "*") == rows(many, "*")


def test_greedy_limit_equals_walk(spark):
    data = [(i, "ab"[i % 5 == 0], (i * 7) % 13) for i in range(60)]
    taken, used = [], {}
    for r in sorted(data, key=lambda r: (-r[2], r[0])):
        if len(taken) < 12 and used.get(r[1], 0) < 4:
            taken.append(r)
            used[r[1]] = used.get(r[1], 0) + 1
    got = A.limited_by_type(spark.createDataFrame(data, "id long, t string, v long"), "t", [F.desc("v"), F.col("id")], 4, 12)
    assert rows(got, "id", "t", "v") == sorted(taken, key=str)


def test_aggregates(spark):
    data = spark.createDataFrame([("A", 1.0), ("a", 2.0), (" ", 3.0), (None, 3.0)], "k string, v double")
    assert rows(A.bucket_top(data, F.col("k"), 5), "label", "n") == [("A", 2), ("Unknown", 2)]
    assert rows(A.zero_filled(data, F.col("k"), ["a", "z"], extra=True).filter("label in ('a', 'z', 'A')"), "label", "n") == [("A", 1), ("a", 1), ("z", 0)]
    got = data.groupBy().agg(A.unique_value(F.col("v")).alias("u"), A.rollup_status(F.col("v") == 1, F.col("v") == 3).alias("s")).first()
    assert (got.u, got.s) == (None, "SomeConfirmed")
    assert data.agg(A.ratio_percent(F.count_if(F.col("v") == 1), F.count("*")).alias("r")).first().r == 25 and data.limit(0).agg(A.ratio_percent(F.count("*"), F.count("*")).alias("r")).first().r == 0


def test_components_equal_union_find(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 9), (20, 20), (30, 29), (29, 28), (28, 27)]
    got = rows(J.components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "label")
    want = {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 20: 20, 27: 27, 28: 27, 29: 27, 30: 27}
    assert got == sorted(want.items(), key=str)


def test_joins(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "a long, n string, c string")
    right = spark.createDataFrame([(7, "x", "z"), (8, "w", "q"), (9, "x", "p")], "b long, m string, d string")
    hit = J.cascade(left, right, "a", "b", [(F.col("n") == F.col("m")) & (F.col("c") == F.col("d")), F.col("c") == F.col("d")])
    assert rows(hit, "a", "b", "rule") == [(1, 9, 1), (2, 8, 2)]
    names = spark.createDataFrame([("g", "Acme Co"), ("g", "acme"), ("h", "Acme")], "g string, n string")
    assert rows(J.without_fragments(names, ["g"], "n"), "g", "n") == [("g", "Acme Co"), ("h", "Acme")]
    notices = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 7)), (1, datetime(2024, 2, 1)), (1, None)], "k long, t timestamp_ntz")
    award = spark.createDataFrame([(1, datetime(2024, 1, 2))], "k long, at timestamp_ntz")
    got = J.asof_within(award, notices, ["k"], "at", "t", ["k"], 7, 2, [F.col("t")])
    assert [r.t for r in got.orderBy("place").collect()] == [datetime(2024, 1, 7), datetime(2024, 1, 1)]


PRICE = "award decimal(18,2), quote decimal(18,2), rank int, n int, rt string, rate decimal(18,6), guide decimal(18,2), ceiling decimal(18,2), budget decimal(18,2), p string"


@pytest.mark.parametrize(
    "row,amount,kind,formula,review",
    [
        ((None, 860000, 1, 1, None, None, None, None, 1000000, "1"), 860000, "CandidateFinalQuote", None, False),
        ((800000, 860000, 1, 1, None, None, None, None, None, "1"), 800000, "DirectAwardAmount", None, False),
        ((None, None, None, 0, None, None, None, None, 1000000, "1"), 1000000, "DefaultedFromProcurementPackageAmount", None, True),
        ((None, None, None, 0, "DiscountRate", "0.9", 1000000, None, None, "1"), 900000, "InferredFromDiscountRate", "1000000 * 0.9", True),
        ((None, None, None, 0, "ReductionRate", "0.1", None, 500000, None, "1"), 450000, "InferredFromReductionRate", "500000 * (1 - 0.1)", True),
        ((None, None, None, 0, "Unknown", "0.9", 1000000, None, None, "1"), None, "Unknown", None, True),
        ((None, None, None, 0, None, None, None, 5, 6, "1"), None, "Unknown", None, True),
    ],
)
def test_prices(spark, row, amount, kind, formula, review):
    typed = tuple(D(x) if i in (0, 1, 5, 6, 7, 8) and x is not None else x for i, x in enumerate(row))
    d = spark.createDataFrame([typed], PRICE).select(price_decision(*[F.col(c) for c in "award quote rank n rt rate guide ceiling budget p".split()]).alias("d")).first().d
    assert (d.amount, d.kind, d.formula, d.needs_review) == (amount, kind, formula, review)


def test_linkage(spark):
    keys = "package_no string, lot_no string, lot_name string, project_code string, project_name string"
    awards = spark.createDataFrame([(1, "1", "L1", "", "P-1", "n", "北京某某电力设备有限公司", None, None, None), (2, "2", "", "", "", "totally other", "x", D(5), None, None)], f"award_id long, {keys}, supplier string, amount decimal(18,2), rate_type string, rate_value decimal(18,6)")
    cands = spark.createDataFrame([(11, "1", "L1", "", "P-1", "n", "某某电力设备有限公司", 1, D(86)), (12, "1", "L2", "", "P-1", "n", "某某电力设备有限公司", 2, D(90))], f"candidate_id long, {keys}, supplier string, rank int, quote decimal(18,2)")
    tenders = spark.createDataFrame([(21, "1", "", "", "P 1", "n", None, D(100), None)], f"tender_id long, {keys}, guide decimal(18,2), ceiling decimal(18,2), budget decimal(18,2)")
    got = {r.award_id: r for r in linkage.closures(awards, cands, tenders).collect()}
    assert (got[1].candidate_id, got[1].tender_id, got[1].decision.amount, got[1].needs_review) == (11, 21, 86, False)
    assert (got[2].candidate_id, got[2].decision.amount, list(got[2].missing)) == (None, 5, ["Candidate", "Tender"])


def test_merge_and_quality(spark):
    data = [(1, "d", "Acme", 5, None), (2, "d", "Acme", 3, "x"), (3, "d", "Other", 1, "y"), (4, "e", "Acme", 9, None)]
    df = spark.createDataFrame(data, "id long, doc string, name string, q long, note string")
    got = merging.merge_records(df, ["doc"], "id", ["name"], F.when(F.col("name_a") == F.col("name_b"), 70).otherwise(0), 65, [F.desc("q"), F.col("id")], ["note"])
    assert rows(got, "id", "note") == [(1, "x"), (3, "y"), (4, None)]
    kept = merging.greedy_uncovered(df, ["doc"], "id", [F.col("id")], F.col("name_a") == F.col("name_b"))
    assert rows(kept, "id") == [(1,), (3,), (4,)]
    issues = scoring.quality_issues(df, "id", [("A", "High", "q", F.col("q") > 4), ("B", "Low", "q", F.col("q") > 100)])
    got = scoring.quality_score(df.select("id"), issues, "id", ["A"])
    assert rows(got, "id", "score", "risk", "recommendation") == [(1, 70, "High", "NeedsReparse"), (2, 100, "Low", "BatchConfirmCandidate"), (3, 100, "Low", "BatchConfirmCandidate"), (4, 70, "High", "NeedsReparse")]
    old = spark.createDataFrame([("a", None, 1), ("b", "keep", 2)], "k string, f string, u long")
    new = spark.createDataFrame([("a", "new", 5), ("b", "no", None), ("c", "n", 7)], "k string, f string, u long")
    assert rows(merging.fill_or_update(old, new, "k", ["f"], ["u"]), "k", "f", "u") == [("a", "new", 5), ("b", "keep", 2), ("c", "n", 7)]


def test_commands(spark):
    links = spark.createDataFrame([(1, "Pending"), (2, "Confirmed")], "id long, status string")
    ids = spark.createDataFrame([(1,), (2,), (9,), (1,)], "id long")
    assert rows(C.moved(links, ids, "id", ["Pending"], "Confirmed"), "id", "outcome") == [(1, "Done"), (2, "Skipped"), (9, "Missing")]
    cand = spark.createDataFrame([(1, 7, "Selected", 1.0, "a"), (2, 7, "Recommended", 2.345, "b"), (3, 8, "Selected", 3.0, "c")], "id long, link_id long, status string, amount_value double, source string")
    changed, final = C.selected_amount(cand, spark.createDataFrame([(7, 2)], "link_id long, id long"))
    assert rows(changed, "id", "status") == [(1, "Recommended"), (2, "Selected")] and final.count() == 1
    users = spark.createDataFrame([(1, 5, False), (2, 5, True)], "user_id long, tenant_id long, is_admin boolean")
    got = C.effective_permissions(users, spark.createDataFrame([(1, 3)], "user_id long, role_id long"), spark.createDataFrame([(3, "read"), (3, "secret")], "role_id long, permission string"), spark.createDataFrame([(5, "read"), (5, "write")], "tenant_id long, permission string"))
    assert rows(got, "user_id", "permission") == [(1, "read"), (1, "self"), (2, "read"), (2, "self"), (2, "write")]
    have = spark.createDataFrame([("g", 2)], "g string, n int")
    new = spark.createDataFrame([("g", 10), ("g", 11), ("h", 12)], "g string, id long")
    assert rows(C.appended(have, new, ["g"], "n", [F.col("id")]), "g", "n") == [("g", 3), ("g", 4), ("h", 1)]
