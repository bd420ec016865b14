"""Joins with an index of their own against all pairs, and what they spare."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import joins as J
from marlstone.operators import merging, numbering


def names(seed, n, letters="abcdefgh项目工程 采购ÄB"):
    rng = random.Random(seed)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return made + [m + "x" for m in made[:10]] + [m.upper() for m in made[10:20]] + [m[1:-1] for m in made[20:30]] + ["a", "A", "", "项"]


@pytest.mark.parametrize("least", [0.3, 0.55, 0.88])
def test_similar_pairs_are_those_of_all_pairs(spark, least):
    rng = random.Random(9)
    rows = [(rng.choice(["g", "h", None]), n) for n in names(1, 120)]
    df = spark.createDataFrame(rows, "g string, n string").select("g", text.name_core(F.col("n")).alias("a"))
    other = df.select("g", F.col("a").alias("b"))
    got = sorted((r["g"] or "", r["a"], r["b"], round(r["score"], 9)) for r in J.similar_pairs(df, other, ["g"], "a", "b", least).collect())
    both = df.distinct().alias("x").join(other.distinct().alias("y"), F.col("x.g").eqNullSafe(F.col("y.g"))).select("x.g", "a", "b", text.core_similarity(F.col("a"), F.col("b")).alias("score"))
    want = sorted((r["g"] or "", r["a"], r["b"], round(r["score"], 9)) for r in both.filter((F.col("score") >= least) & (F.col("a") != "") & (F.col("b") != "")).collect())
    assert got == want and len(got) > 50


def test_an_index_spares_most_pairs(spark):
    rng = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(800)]
    rows = [("1", "".join(rng.choice(letters) for _ in range(12))) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, a string")
    met = J.prefix_candidates(df, df.withColumnRenamed("a", "b"), ["g"], "a", "b", 0.55).count()
    assert 600 <= met < 600 * 600 / 10  # one key joins all pairs


def test_contained_pairs_against_all_pairs(spark):
    rows = [("g" if k % 3 else "h", n) for k, n in enumerate(names(2, 150, "abc"))]
    inner = spark.createDataFrame(rows, "g string, a string")
    outer = spark.createDataFrame([(g, n + "c") for g, n in rows], "g string, b string")
    got = sorted(tuple(r) for r in J.contained_pairs(inner, outer, ["g"], "a", "b").collect())
    want = sorted({(g, a, b + "c") for g, a in rows for h, b in rows if g == h and a and a in b + "c"})
    assert got == want


def times(rng, n):
    return [None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 40)) for _ in range(n)]


def test_band_join_with_a_hot_key_against_brute_force(spark):
    rng = random.Random(4)
    right = [(0 if rng.random() < 0.1 else rng.randint(1, 60), t, k) for k, t in enumerate(times(rng, 1500))]
    left = [(0 if k < 60 else rng.randint(1, 70), t, k) for k, t in enumerate(times(rng, 200))]
    a = spark.createDataFrame(left, "k long, at timestamp_ntz, award int")
    b = spark.createDataFrame(right, "k long, t timestamp_ntz, id int")
    got = J.asof_within(a, b, ["k"], "at", "t", ["award"], 7, 5, [F.col("id")])
    want = []
    for k, at, award in left:
        own = [r for r in right if r[0] == k and (r[1] is None or (at is not None and r[1] <= at + timedelta(days=7)))]
        own.sort(key=lambda r: (r[1] is None, -(r[1] or datetime(1970, 1, 1)).timestamp(), r[2]))
        want += [(award, r[2], place + 1) for place, r in enumerate(own[:5])]
    assert sorted((r["award"], r["id"], r["place"]) for r in got.collect()) == sorted(want)


def test_greedy_uncovered_against_the_walk(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc"), rng.randint(0, 12), rng.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, x int, w double").repartition(5)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if not any(k[1] == r[1] and abs(k[2] - r[2]) == 1 for k in kept):
            kept.append(r)
    got = merging.greedy_uncovered(df, ["g"], "id", [F.desc("w"), F.col("id")], F.abs(F.col("x_a") - F.col("x_b")) == 1)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in kept)
    assert merging.greedy_uncovered(df.limit(0), ["g"], "id", [F.col("id")], F.lit(True)).collect() == []


@pytest.mark.parametrize("parts", [1, 200])
def test_numbers_are_gapless_however_rows_lie(spark, parts):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(parts)
    assert sorted(r["n"] for r in numbering.numbered(df, "n", 7).collect()) == list(range(7, 1007))
    got = numbering.numbered(df, "n", 0, [F.desc("x")]).collect()
    assert all(r["x"] + r["n"] == 999 for r in got) and len(got) == 1000
    assert numbering.numbered(df.limit(0), "n").collect() == []


def test_inserts_fill_ids_and_defaults(spark):
    rows = spark.createDataFrame([(None, "a", None), (5, "b", "x"), (None, "c", "y")], "id long, ref string, note string")
    got = {r["ref"]: (r["id"], r["note"]) for r in numbering.for_insert(rows, "id", 9, {"note": F.lit("none")}, "ignore", [F.desc("ref")]).collect()}
    assert got == {"b": (5, "x"), "c": (10, "y"), "a": (11, "none")}
    assert {r["note"] for r in numbering.for_insert(rows, "id", 9, {"note": F.lit("none")}).collect()} == {None, "x", "y"}
    with pytest.raises(ValueError):
        numbering.for_insert(rows, "id", 9, {}, "drop")
    children = spark.createDataFrame([("a", None), ("z", 3)], "ref string, parent long")
    parents = spark.createDataFrame([("a", 11)], "ref string, id long")
    assert sorted((r["ref"], r["parent"]) for r in numbering.back_filled(children, parents, "ref", "id", "parent").collect()) == [("a", 11), ("z", 3)]


