import math
import random

import numpy as np

from marlstone.llm.common import held_out_py
from marlstone.llm.toxicity import KINDS, PRIOR, SCOPES, Matcher, Transducer, compose, in_order, predict, train


def test_grammar_marks():
    m = Matcher({}, PRIOR)
    kinds = lambda t: dict(zip(KINDS, m.features(t) > 0, strict=True))
    assert kinds("what trash.")["plain"] and kinds("you are an idiot")["directed"] and kinds("this is not trash")["negated"]
    assert kinds("he said that they are a moron")["reported"] and kinds("you will burn")["threat"] and not any(kinds("I burn wood").values())
    assert kinds("a moron, you")["directed"] and kinds("we will kill")["threat"] and kinds("kill them all")["threat"] and not kinds("they kill bacteria with heat")["threat"] and not kinds("we never hurt them")["threat"]
    assert kinds("she said they will kill")["reported threat"] and not kinds("she said they will kill")["threat"]
    assert m.score("you idiot. you moron.") > 0.5 > m.score("not trash") and m.score("") == m.score("a quiet day")


def test_compose_is_one_walk():
    a = Transducer.scope("n", 1, "~", "i", {"n", "i", "o"})
    b = Transducer.scope("o", 1, "!", "i", a.outputs)
    both, state, out = compose(a, b), (0, 0), []
    for s in "noii":
        state, o = both.step(state, s)
        out.append(o)
    assert out == ["n", "o", "i!", "i"]


def test_learns_and_handles_odd_rows(llm_spark, make_docs, prose):
    rows = [(i, prose(i, 40) + (" you zorbling grundle " if i % 3 == 0 else "")) for i in range(240)]
    labels = llm_spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = train(make_docs(rows), labels)
    got = {r.doc_id: r for r in predict(make_docs([*rows, (900, None), (901, ""), (902, "grundle " * 30_000)]), m).collect()}
    unseen = [i for i in range(240) if held_out_py(i)]
    assert len(unseen) > 30 and sum(got[i].predicted == (i % 3 == 0) for i in unseen) >= 0.95 * len(unseen)
    twice = predict(make_docs([rows[0], rows[0], (None, rows[0][1])]), m).collect()
    assert len(twice) == 3 and len({r.score for r in twice}) == 1 and twice[0].key == "clash"
    assert got[900].score == got[901].score < 0.5 < got[902].score and all(0 <= r.score <= 1 for r in got.values())
    assert predict(make_docs([]), train(make_docs([]), labels.limit(0))).count() == 0


def plain_patterns(m, words):
    """The grammar said in rules: distances between words of a clause, without automata."""
    got = [m._read(w) for w in words]
    sym = [s for s, _ in got]
    near = lambda k, what, reach: any(sym[j] == what for j in range(max(0, k - reach), k))
    out, open_i, open_h = [], None, None
    for k, (s, weight) in enumerate(got):
        negated, reported, target = near(k, "n", SCOPES["negation"]), near(k, "r", SCOPES["report"]), near(k, "y", SCOPES["target"])
        if s == "i":
            open_i = (len(out), k, negated, reported)
            out.append(["negated" if negated else "reported" if reported else "directed" if target else "plain", weight])
        elif s == "h":
            intended = near(k, "f", SCOPES["intent"])
            if intended and not negated:
                out.append(["reported threat" if reported else "threat", weight])
            open_h = None if intended else (k, negated, reported, target, weight)
        elif s == "y":
            if open_i and k - open_i[1] <= SCOPES["behind"]:
                if not open_i[2] and not open_i[3]:
                    out[open_i[0]][0] = "directed"
                open_i = None
            if open_h and k - open_h[0] <= SCOPES["behind"]:
                if not open_h[1]:
                    out.append(["reported threat" if open_h[2] else "threat", open_h[4]])
                open_h = None
    return [tuple(x) for x in out]


def test_grammar_against_plain_rules():
    rnd = random.Random(9)
    m = Matcher({"grundle": 1.5, "zorbl*": 0.7}, PRIOR)
    vocabulary = "idiot grundle zorbling kill burn you them not said will hope tree stone quiet".split()
    for _ in range(4000):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 14))]
        assert m.patterns(words) == plain_patterns(m, words), words


def test_clauses_weigh_more_than_words():
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = dict(zip((*KINDS, "constant"), in_order(rng.normal(0, 4, 7)), strict=True))
        assert max(w["negated"], w["reported"]) <= w["plain"] < w["directed"] <= w["threat"] and w["reported threat"] <= w["directed"]
        assert w["threat"] * math.log(2) + w["constant"] > -1e-9
    m = Matcher({}, in_order(PRIOR))
    assert m.score("I will kill you tomorrow.") >= 0.5 and m.score("You are an idiot.") > m.score("What an idiot.") > m.score("They kill bacteria with heat.")
