import numpy as np
from pyspark.sql import functions as F

from marlstone.llm.ann_search import Block, search


def brute(rows, top=20):
    own = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(own))
    x = np.array([own[i] for i in ids])
    out = {}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            score = (x * x[k]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if j != k][:top]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_order(llm_spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.5, 2)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)]  # one vector many times
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [float("inf")] * 16), (None, rows[0][1]), (3005, [1.0]), (0, rows[0][1])]
    df = llm_spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, b string, p int")
    got = {}
    for r in search(df, F.col("vec_id") % 20 == 0, block_rows=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21)) and all(v != q for _, v, _ in near)
        assert near == sorted(near, key=lambda x: (-x[2], x[1]))


def test_few_and_none(llm_spark):
    few = llm_spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.vec_id, r.score) for r in search(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 20, 2.0), (0, 1, 0.5), (0, 2, 0.5), (20, 0, 2.0), (20, 1, 1.5), (20, 2, 1.5)]
    assert search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_beside_long_vectors(llm_spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 32))
    x *= (rng.uniform(0.8, 1.2, 6000) / np.sqrt((x**2).sum(axis=1)))[:, None]
    x[:8] *= np.array([2, 3, 5, 8, 10, 15, 20, 30])[:, None]
    asked = list(range(40, 6000, 149))
    df = llm_spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in search(df, F.col("vec_id").isin(asked)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(got[q] & set(w)) for q, w in zip(asked, want.tolist(), strict=True)) >= 0.9 * want.size


def test_bands_of_any_norms():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 8)) * 10.0 ** rng.uniform(-120, 120, (3000, 1))
    block = Block(np.arange(3000), x)
    assert sorted([*block.rest, *(k for p in block.places for k in p)]) == list(range(3000))
    ids, score = block.search(5, x[5] / np.abs(x[5]).max(), 20)
    exact = x @ (x[5] / np.abs(x[5]).max())
    exact[5] = -np.inf
    assert ids.tolist() == np.argsort(-exact, kind="stable")[:20].tolist() and np.allclose(score, np.sort(exact)[::-1][:20])


def test_extreme_components_end(llm_spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 8))
    for scale, asked in ((1e155, 1e-200), (1e307, 1e-200), (1e-300, 1e10)):
        block = Block(np.arange(600), x * scale)
        ids, _ = block.search(3, x[3] * asked, 20)
        exact = x @ x[3]
        exact[3] = -np.inf
        assert ids.tolist() == np.argsort(-exact, kind="stable")[:20].tolist()
    rows = [(i, (v * 1e160).tolist()) for i, v in enumerate(x)]
    got = search(llm_spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert len(got) == 20


def test_recall_over_many_blocks():
    """Each of many blocks verifies a smaller share, and the best of all blocks are still found."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((8 * 8192, 48))
    x *= (rng.uniform(0.8, 1.2, len(x)) / np.sqrt((x**2).sum(axis=1)))[:, None]
    blocks = [Block(np.arange(k * 8192, (k + 1) * 8192), x[k * 8192 : (k + 1) * 8192], 8) for k in range(8)]
    hit = 0
    for q in range(0, 8192 * 8, 2621):
        score = x @ x[q]
        score[q] = -np.inf
        want = set(np.argsort(-score)[:20].tolist())
        found = [block.search(q, x[q], 20) for block in blocks]
        ids, scores = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        hit += len(want & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(range(0, 8192 * 8, 2621))
