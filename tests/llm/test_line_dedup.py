import random

from marlstone.llm.line_dedup import BLANKS, line_dedup


def brute(rows):
    seen, gone = {}, {}
    for k, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
        gone[k] = set()
        for a in range(len(solid) - 2):
            at = solid[a : a + 3]
            key = tuple(lines[i].strip(BLANKS) for i in at)
            if key in seen:
                gone[k] |= set(at)
            seen.setdefault(key, k)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, (_, t) in enumerate(rows)]


def test_brute_force(make_docs):
    rnd = random.Random(9)
    rows = [(i, "\n".join(rnd.choice(["a", "b ", "c", "", "d", " e"]) for _ in range(rnd.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x\n" * 3000), (104, "x\n" * 10), (None, "p\nq\nr\ns"), (105, "q\nr\ns\nt"), (106, "only\ntwo")]
    got = {r.doc_id: r for r in line_dedup(make_docs(rows)).collect()}
    for (i, t), want in zip(rows, brute(rows), strict=True):
        assert got[i].text == want and got[i].key == "clash"
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert got[i].n_removed == (0 if t is None else t.count("\n") - want.count("\n") if want else got[i].n_removed)


def test_repeated_rows_and_empty(make_docs):
    got = line_dedup(make_docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]
    assert line_dedup(make_docs([])).count() == 0
