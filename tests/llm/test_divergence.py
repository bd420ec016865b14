import random
import re
from collections import Counter

import numpy as np

from marlstone.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    rows = [(x or "", lang or "", source or "") for x, lang, source in rows]
    found = [TERM.findall(x.translate(LOWER)) for x, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], f) for r, f in zip(rows, found, strict=True) if r[1] == lang]
        docs = Counter(t for _, f in own for t in set(f))
        kept = sorted(t for t, n in docs.items() if n >= least)

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        counts = {s: Counter(t for s2, f in own if s2 == s for t in f) for s in {s for s, _ in own}}
        ps, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in counts if o != s]
            best = [(f(ps[s][t], q[t]), t) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", best)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = [rng.choice(["the", "Über", "naïve", "漢字", "don't", "x1y", "ZED", "a_b"]) if rng.random() < 0.1 else "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda: rng.choice(["", None, "1 2 3"]) if rng.random() < 0.05 else " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.randint(1, 40)))
    return [(text(), rng.choice(["en", "en", "de", None, "", "lone"]), rng.choice(["s0", "s0", "s1", "S1", "é", None, ""])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string")


def test_terms():
    for x in ("Don't STOP", "É1é_ABC-ß", "", "a b", "\x00a\x7fb"):
        assert [t.decode() for t in D.terms(x.encode())] == TERM.findall(x.translate(LOWER))


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        rows += rows[:50] + [("only here", "xx", "s0"), (None, "yy", "s0"), (None, "yy", "s1")]
        got = sorted(tuple(r) for r in D.audit(frame(spark, rows).repartition(5)).collect())
        assert got == brute(rows)
        assert [r[4] for r in got if r[0] == "yy"] == [0, 0]


def test_a_narrow_sketch_changes_nothing(spark):
    rows = rows_of(3)
    assert sorted(tuple(r) for r in D.audit(frame(spark, rows), width=64).collect()) == brute(rows)


def test_empty_table(spark):
    assert D.audit(frame(spark, [("a", "b", "c")]).limit(0)).collect() == []


def test_sketch_never_underestimates():
    rng = random.Random(4)
    true, a, b = Counter(), D.Sketch(width=512), D.Sketch(width=512)
    for sketch in (a, b):
        counts = Counter(str(rng.randrange(900)).encode() for _ in range(3000))
        sketch.add("en", counts)
        true += counts
    whole = D.Sketch(width=512, counters=np.minimum(a.counters.astype(int) + b.counters, 255).astype(np.uint8))
    found = list(true)
    assert (whole.estimate("en", found) >= np.minimum([true[t] for t in found], 255)).all()


def test_large_counts_stay_exact(spark):
    p = D._probability(D.F.col("n"), "total", "kinds")
    row = spark.createDataFrame([(9 * 10**12, 10**15, 10**9)], "n long, total long, kinds long").select(p.alias("p")).first()
    assert row["p"] == 1 + 10**9 * (9 * 10**12 + 2) // (10**15 + 2 * 10**9)
