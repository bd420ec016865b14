import random

import numpy as np

from marlstone.llm.common import held_out_py
from marlstone.llm.language_id import ByteGru, has_letter, packed, predict, train, units_of


def test_gradients_are_those_of_the_loss():
    net = ByteGru(["a", "b", "c"], hidden=5, embed=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, _ = packed([b"abc", b"z", b"hello"])
    y = np.array([0, 2, 1])
    _, grad = net.gradients(x, y)
    rng = np.random.default_rng(0)
    for k, w in net.p.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if k != "emb" else (ord("a"), 1)
        old, ends = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            ends.append(net.gradients(x, y)[0])
        w[at] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[k][at]) < 2e-3


def test_fast_scores_equal_plain_ones():
    net = ByteGru(["a", "b"], hidden=6)
    units = [b"abc", b"de", b"xyz", b"q"]
    x, _ = packed(units)
    both = np.concatenate([net._run(x, "f", False)[0], net._run(x, "b", False)[0]], axis=2)
    logits = both @ net.p["out"] + net.p["out_b"]
    logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    want = np.where((x < 256)[:, :, None], logp, 0).sum(axis=0)
    assert np.allclose(net.unit_scores(units), want, atol=1e-4)


def test_held_out_accuracy_and_odd_rows(llm_spark, make_docs):
    rnd = random.Random(3)
    parts = {"xx": ["ba", "no", "ti", "lu"], "yy": ["ströh", "ück", "chen", "ger"], "zz": ["señ", "ción", "rra", "ello"]}
    everything = [(i, " ".join("".join(rnd.choice(parts[k]) for _ in range(rnd.randint(1, 4))) for _ in range(30)), k) for i in range(300) for k in [["xx", "yy", "zz"][i % 3]]]
    docs = make_docs([*everything, (900, None), (901, "123 !?", "xx"), (902, ""), (903, "ciónello " * 20_000, None), (904, "banoti", "xx"), (904, "banoti", "xx")])
    net = train(docs)
    got = {r.doc_id: r for r in predict(docs, net).collect()}
    rows = [r for r in everything if held_out_py(r[0])]
    assert len(rows) > 30 and sum(got[i].lang_pred == k for i, _, k in rows) >= 0.95 * len(rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "zz"] and all(0 <= r.score <= 1 for r in got.values())
    # Pooled plainly: the network over each word and its blank, every position counted.
    plain = lambda t: max(zip(sum(net.unit_scores([u])[0] for w in t.split() for u in units_of(w)), net.labels, strict=True))[1]
    assert all(got[i].lang_pred == plain(t) for i, t, _ in everything[:40])
    assert got[0].key == "clash" and train(make_docs([])) is None and predict(make_docs([(1, "a")]), None).first().lang_pred == "und"


def test_letters_and_units(make_docs):
    assert [has_letter(t) for t in ("½ ² ① Ⅷ", "12 _ !", "½a", "ª", "語", "")] == [False, False, True, True, True, False]
    net = ByteGru(["a", "b"])
    assert [r.lang_pred == "und" for r in predict(make_docs([(1, "½ Ⅷ ②"), (2, "a 1")]), net).orderBy("doc_id").collect()] == [True, False]
    long = "é" * 100 + "a" * 60
    assert b"".join(units_of(long)) == long.encode() and all(u.decode() and len(u) <= 48 for u in units_of(long)) and units_of("ab") == [b"ab"]


def test_late_text_teaches(make_docs):
    # The first 4,000 characters of all texts are alike: only what follows tells the languages apart.
    same = "lorem ipsum " * 340
    docs = make_docs([(i, same + ("zzkra vrrik " if i % 2 else "ouelle mioua ") * 340, "zz" if i % 2 else "ou") for i in range(60)])
    got = predict(make_docs([(1, "vrrik zzkra"), (2, "mioua ouelle")]), train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["zz", "ou"]
