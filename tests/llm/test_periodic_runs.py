import hashlib
import random
import zlib

import numpy as np

from marlstone.llm import periodic_runs as R


def brute(s, least=12):
    out = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and j > i and not any(s[i : i + n - d] == s[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings(seed, count, longest):
    rng = random.Random(seed)
    for _ in range(count):
        kinds, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, longest)
        s = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5:
            p = rng.randint(1, 20)
            block = [rng.randrange(kinds + 1) for _ in range(p)]
            s = s[: n // 3] + (block * 9)[: rng.randint(p, 9 * p)] + s[n // 3 :]
        if rng.random() < 0.3:
            s = s + s[: len(s) // 2]
        yield s


def test_all_runs_of_a_string_against_brute_force():
    for s in strings(1, 1500, 40):
        got = sorted(zip(*(x.tolist() for x in R.runs_of_string(np.array([*s, 99]))), strict=True), key=lambda r: (r[0], r[2]))
        assert got == brute(s, 2), s


def test_runs_of_many_documents_against_brute_force():
    docs = list(strings(2, 400, 90))
    for k in range(0, len(docs), 7):
        part = docs[k : k + 7]
        assert R.find_runs([np.array(s, np.int64) for s in part]) == [brute(s) for s in part]


def test_structured_strings():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a  # Fibonacci strings hold the most runs
    thue = [bin(i).count("1") % 2 for i in range(256)]  # no overlap at all
    for s in (b, thue, [7] * 300, [1, 2] * 100 + [1, 2, 3] * 60, list(range(50)) * 2, list(range(50)) * 2 + list(range(100, 130)) + list(range(50)) * 3):
        assert R.find_runs([np.array(s)])[0] == brute(s)
    assert brute(list(range(50)) * 2) == [(0, 100, 50)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(2**53 + 1, "a b " * 20, "x"), (None, "again and again " * 30, "x"), (None, None, None), (5, "", ""), (5, " \t\n", ""), (5, "one\x0btwo\x0cthree four five", "")]
    rows += [(i, " ".join(rng.choice("aé b cc ddd 漢".split()) for _ in range(rng.randint(0, 60))), "y") for i in range(150)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")  # a column named like a result
    got = R.periodic_runs(docs, cycles=True, keep=False).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(d, t)) for d, t, _ in rows)
    assert R.periodic_runs(docs.limit(0)).collect() == []


def test_runs_and_text_are_kept(spark):
    docs = spark.createDataFrame([(1, "x " + "go on " * 8 + "now")], "doc_id long, text string")
    row = R.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 16, 2)] and row["collapsed"] == "x go on now" and row["exponent_milli"] == 8000


def test_query_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = R.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    short = {d: t for d, t in docs if len(t or "") < 4000}
    assert len(got) == len(docs)
    assert sorted(tuple(r) for r in got if r["doc_id"] in short) == sorted(expected(d, t) for d, t in short.items())
