import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from marlstone.llm import packing as P

ODD = [" ", "  ", "\n", "\t", " ", "a", "b'", "'s", "1", "é", "漢", "​", "\x1c", "\x85", "᠎", "　", "<|endoftext|>", "!", "😀", "\r", " ", "́", "﻿", "'ll", "word", " "]


def reference():
    t = Tokenizer.from_str(P.default_model())
    t.encode_special_tokens = True
    return t


def test_words_encode_like_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [f"a{chr(c)}1 {chr(c)}b '{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    got = list(P.WordEncoder(P.default_model()).encode(texts))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in reference().encode_batch(texts, add_special_tokens=False)]


def held(counts, most):
    """Number of sequences, after checking that every piece has one place and no sequence overflows or has a hole."""
    placed, n = P.pack(counts, most)
    seen, spans = Counter(), defaultdict(list)
    for length, first, times, sequence, offset in placed:
        assert first == seen[length] and times > 0
        seen[length] += times
        for s in range(sequence, sequence + times):
            spans[s].append((offset, length))
    assert seen == Counter({k: v for k, v in counts.items() if v}) and sorted(spans) == list(range(n))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return n


def least(counts, most):
    """The fewest sequences, by trying everything."""
    items = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[k]}:
            at = bins.index(room)
            go(k + 1, [*bins[:at], room - items[k], *bins[at + 1 :]])
        go(k + 1, [*bins, most - items[k]])

    go(0, [])
    return best[0]


def test_pack_against_the_best_packing():
    rng, worse = random.Random(5), 0
    for _ in range(150):
        most = rng.choice([8, 12, 20])
        counts = Counter(rng.randint(1, most) for _ in range(rng.randint(1, 9)))
        n, best = held(counts, most), least(counts, most)
        assert n <= best + 1
        worse += n > best
    assert worse <= 8


def test_exact_complements_fill_sequences():
    assert held({1000: 5, 1048: 5}, 2048) == 5
    assert held({1000: 4, 500: 4, 548: 4}, 2048) == 4
    assert held({1000: 3, 348: 6, 352: 3}, 2048) == 3
    assert held({2048: 7}, 2048) == 7 and held({1024: 5}, 2048) == 3 and held({683: 9}, 2048) == 5
    assert held({10: 100_000}, 2048) <= 491 and held({}, 2048) == 0
    rng = random.Random(6)
    counts = {n: rng.randint(1, 50) for n in range(1, 2049)}
    assert held(counts, 2048) <= 1.02 * sum(n * c for n, c in counts.items()) / 2048


def test_cut_lengths():
    assert [P.cut_lengths(n, 10) for n in (1, 10, 11, 20, 25)] == [[1], [10], [1, 10], [10, 10], [5, 10, 10]]


def checked(rows, got, most=2048):
    """Every piece is that of its text, sequences are gapless."""
    t, want = reference(), Counter()
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for piece, n in enumerate(P.cut_lengths(len(ids), most)):
            want[doc_id, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(spans)


def test_rows_of_any_kind(spark):
    rng = random.Random(7)
    rows = [(2**53 + 1, "a"), (None, None), (None, "b " * 3000), (3, ""), (3, ""), (4, "x" * 9000)]
    rows += [(i, "word " * rng.randint(0, 900)) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(7)
    got = P.pack_documents(docs, ids=True).collect()
    total = sum(r["length"] for r in got)
    assert checked(rows, got) <= 1.01 * total / 2048 + 1
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)
    assert P.pack_documents(docs.limit(0)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = P.op12_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert checked(rows, got) <= sum(r["length"] for r in got) / 2048 * 1.01 + 1
