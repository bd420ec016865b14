import hashlib
import random

import pytest

from marlstone.llm.sentencepiece_codec import Codec, decode, default_model, encode, token_digests

sentencepiece = pytest.importorskip("sentencepiece")
ODD = ["", " ", "  a", "▁▁a b", "aaaaaaaaa", "<s></s><unk><0x41>", "a\x00b", "😀😀é漢", "!" * 300, " " * 200 + "x", "\t\n=====---===", "a" * 5000, " " * 5000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=default_model())


def test_equals_library(library):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abab  aaa\n▁éß漢😀!?.the in") for _ in range(rnd.randint(1, 60))) for _ in range(800)]
    codec = Codec(default_model())
    for text, (n, ids, decoded) in zip(texts, codec.digests(texts), strict=True):
        want = library.encode(text, add_eos=True)
        assert codec.encode(text) == want and n == len(want)
        assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(library.decode(want).encode()).hexdigest()
        assert codec.model.decode(want) == library.decode(want)


def test_columns(llm_spark, make_docs, library):
    rows = [(1, "some text here"), (1, "some text here"), (2, None), (None, "")]
    got = decode(encode(make_docs(rows))).collect()
    assert [list(r.ids) for r in got] == [library.encode(t or "", add_eos=True) for _, t in rows]
    assert [r.decoded for r in got] == [t or "" for _, t in rows] and got[0].key == "clash"
    assert [r.n_tokens for r in token_digests(make_docs(rows)).collect()][2:] == [1, 1]
    assert token_digests(make_docs([])).count() == 0
