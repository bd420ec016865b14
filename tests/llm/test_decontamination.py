import random

import numpy as np

from marlstone.llm.decontamination import GAP, MATCH, MISMATCH, align, contaminated, without_contaminated
from marlstone.llm.shingles import words


def brute(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item):
        for j, b in enumerate(passage):
            h[i + 1, j + 1] = max(0, h[i, j] + (MATCH if a == b else MISMATCH), h[i, j + 1] + GAP, h[i + 1, j] + GAP)
    return int(h.max())


def test_align_equals_full_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        score, first, last = align(a, b)
        assert score == brute(a, b) and 0 <= first <= last <= len(b)


def test_copies_and_edits(llm_spark, make_docs, prose):
    items = [(i, prose(100 + i, 30)) for i in range(8)] + [(8, None), (9, ""), (10, "two words")]
    rnd = random.Random(3)
    edited = items[1][1].split()
    for k in (4, 12, 20):
        edited[k] = "changed"
    del edited[25]
    docs = [
        (1, prose(1, 60) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(2, 60)),
        (2, prose(3, 60) + "\n" + " ".join(edited) + " " + prose(4, 5000)),
        (3, prose(5, 200)),
        (4, None),
        (5, ""),
        (6, items[2][1]),
        (6, items[2][1]),
        (None, items[3][1] + " " + items[4][1]),
        (7, " ".join(rnd.sample(items[5][1].split(), 30))),
    ]
    bench = llm_spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in contaminated(make_docs(docs), bench).collect())
    assert got == [(0, 3), (0, 4), (1, 0), (2, 1), (6, 2), (6, 2)]
    blocks = sorted((r.doc_id or 0, r.item_id) for r in contaminated(make_docs(docs), bench, block_bytes=300).collect())
    assert blocks == got
    left = without_contaminated(make_docs(docs), bench)
    assert left.columns == make_docs(docs).columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]


def test_empty(llm_spark, make_docs):
    none = llm_spark.createDataFrame([], "item_id long, text string")
    assert contaminated(make_docs([(1, "a b c")]), none).count() == 0
    assert contaminated(make_docs([]), llm_spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


def test_against_aligning_all_pairs(llm_spark, make_docs, prose):
    """Seeds lose no match that aligning every item with every document finds, under random edits of any kind."""
    rnd = random.Random(8)
    items = [(i, prose(200 + i, rnd.choice([7, 12, 20, 35]), 60)) for i in range(14)]
    docs = []
    for d in range(150):
        own = rnd.choice(items)[1].split()
        k = rnd.randint(0, len(own) - 1)
        part = own[k : k + rnd.randint(1, len(own))] if d % 3 else own
        for _ in range(rnd.randint(0, max(1, len(part) // 5))):
            at = rnd.randint(0, len(part) - 1)
            part = rnd.choice([part[:at] + part[at + 1 :], [*part[:at], "new", *part[at:]], [*part[:at], "other", *part[at + 1 :]]]) or part
        docs.append((d, " ".join([prose(1000 + d, 25, 60), *part, prose(2000 + d, 25, 60)])))
    want = {}
    for d, t in docs:
        hashes = words(t)[0]
        for i, u in items:
            own = words(u)[0]
            share = brute(own, hashes) / (MATCH * len(own))
            if share >= max(0.5, min(1.0, 6 / len(own))):
                want[d, i] = share
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(make_docs(docs), llm_spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 40 and set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_short_and_long_items(llm_spark, make_docs, prose):
    long = prose(50, 30_000)
    own = long.split()
    items = [(1, "alpha beta gamma delta epsilon"), (2, long), (3, "two words")]
    docs = [(1, "so alpha beta gamma delta epsilon it is"), (2, "so alpha beta gamma delta it is"), (3, prose(51, 50) + " " + " ".join(own[20_000:20_150]) + " " + prose(52, 50)), (4, prose(53, 400)), (5, "two words more"), (6, "Two words!"), (7, " ".join(own[:9000] * 2))]
    got = {(r.doc_id, r.item_id) for r in contaminated(make_docs(docs), llm_spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 2), (6, 3), (7, 2)}
