import numpy as np

from marlstone.llm.minhash_dedup import dart_signature, near_duplicates, one_of_each
from marlstone.llm.shingles import jaccard, shingles


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 4, 400), rng.uniform(0.5, 4, 400)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    same = dart_signature(values, wa, 2048) == dart_signature(values, wb, 2048)
    assert abs(same.mean() - want) < 0.05
    assert len(dart_signature(values[:0], wa[:0])) == 0 and len(set(dart_signature(values[:1], wa[:1]).tolist())) == 64


def brute(rows):
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [shingles(t or "")[0] for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {frozenset(v) for v in groups.values()}


def rows_of(prose):
    base = [prose(k, 150) for k in range(12)]
    rows = []
    for k, t in enumerate(base):
        words = t.split()
        rows.append((10 * k, t))
        rows.append((10 * k + 1, " ".join([*words[:40], "edited", *words[41:]])))
        rows.append((10 * k + 2, " ".join(words[:75]) + " " + prose(900 + k, 75)))
    hub = prose(77, 200).split()
    for k in range(60):  # a star: every copy is near the hub, few are near each other
        w = list(hub)
        w[(3 * k) % 190 + 5] = f"other{k}"
        w[(7 * k) % 190 + 3] = f"more{k}"
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000, ""), (2001, None), (2002, "one two"), (2003, "One, two!"), (2004, "?"), (2005, "!"), (2006, base[0]), (2007, prose(5, 20_000)), (2008, "a " * 3000)]


def test_classes_equal_brute_force(make_docs, prose):
    rows = rows_of(prose)
    got = {}
    for r in near_duplicates(make_docs(rows)).collect():
        got.setdefault((r.class_id, r.class_key), []).append(r.doc_id)
    place = {r[0]: i for i, r in enumerate(rows)}
    assert {frozenset(place[d] for d in v) for v in got.values()} == brute(rows)
    assert all(min(v) == k[0] for k, v in got.items())
    kept = one_of_each(make_docs(rows))
    assert {r.doc_id for r in kept.collect()} ^ {min(v) for v in got.values()} == set() and kept.first().key == "clash"
    assert kept.count() == len(got)


def test_repeated_and_null_ids(make_docs, prose):
    t, u = prose(1, 50), prose(2, 50)
    rows = [(1, t), (1, t), (None, u), (None, u), (1, u)]
    assert [r.class_id for r in near_duplicates(make_docs(rows)).collect()] == [1] * 5
    assert sorted(r.text for r in one_of_each(make_docs(rows)).collect()) == sorted([t, u])
    assert [r.class_id for r in near_duplicates(make_docs([(None, t)])).collect()] == [None]
    assert near_duplicates(make_docs([])).count() == 0 and one_of_each(make_docs([])).count() == 0


def test_repeats_do_not_hide_copies(make_docs, prose):
    rows = []
    for k in range(20):
        t = prose(300 + k, 120)
        block = prose(500 + k, 12)
        rows += [(100 * k, t), (100 * k + 1, f"{t} {t}"), (100 * k + 2, " ".join([t] * 4))]
        rows += [(100 * k + 10, prose(700 + k, 120) + f" {block}"), (100 * k + 11, prose(700 + k, 120) + f" {block}" * 60)]
        rows += [(100 * k + 20, prose(800 + k, 120)), (100 * k + 21, prose(800 + k, 60))]
    got = {}
    for r in near_duplicates(make_docs(rows)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    want = {frozenset(rows[i][0] for i in c) for c in brute(rows)}
    assert {frozenset(v) for v in got.values()} == want
    assert all({100 * k, 100 * k + 1, 100 * k + 2} in want and {100 * k + 10, 100 * k + 11} in want for k in range(20))
