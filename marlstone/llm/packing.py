"""Best-fit packing of token sequences by exact-complement hashing.

Pieces of one length are alike, so lengths with their counts (as many as a sequence has tokens, at most) say all that packing needs: the
driver packs that table, never pieces. Bins of one filling are a run as well. From the longest length down, a run's gap is looked up among
sums of single, pair and triple lengths that are still to be had; the combination found is used as often as all its counts
allow. A gap that no combination fills takes the best-fitting length and is looked up again with what is left.

Tokens are counted in one pass over the texts. Texts of plain characters are encoded by merge ranks alone, which gives the same ids; of others the
words, each with the blank before it, are encoded once a worker: the byte-level pre-tokenizer never joins characters across a blank that a visible
character follows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_lines, map_arrow, settle, table

LENGTH = 2048
END_ID = 0
REMEMBERED = 100_000  # words that a worker keeps encoded; beyond that it starts anew
# Fixed value: how byte-level tokenizer files of this kind cut a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\x00-\u024f]*")  # characters whose classes all libraries agree on
STEP = 1000  # characters among which a text of words has a blank and something else


def of_words(text: str) -> bool:
    """Whether a text has no long stretch without a blank or of nothing else: merging such a stretch by ranks takes more than linear time."""
    return all(text.find(" ", k, k + STEP) >= 0 and not text[k : k + STEP].isspace() for k in range(0, len(text) - STEP + 1, STEP))
# Blanks in front of visible characters. Characters that some library may take for white space are no cut: fewer cuts do no harm.
CUT = re.compile(r" (?=[^\s\x1c-\x1f\x85᠎​-‍ - ⁠﻿])")


class WordEncoder:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit numbers, from a tokenizer file's contents."""

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part; threads would only hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        parts = json.loads(model)
        step = parts.get("pre_tokenizer") or {}
        # Only then do ids of a word not depend on the words around it.
        self.by_words = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not parts.get("normalizer") and not parts.get("truncation")
        self.quick = _ranked(parts) if self.by_words else None
        self.known: dict[str, bytes] = {}  # words with the blank before them

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of short texts by the merge ranks alone where that is the same, else by the tokenizer."""
        if not self.quick:
            return self._by_tokenizer(texts)
        odd = [t for t in texts if len(t) >= STEP or not PLAIN.fullmatch(t)]
        there = dict(zip(odd, self._by_tokenizer(odd), strict=True))
        ids = self.quick.encode_ordinary
        return [there[t] if t in there else struct.pack(f"<{len(x := ids(t))}I", *x) for t in texts]

    def _by_tokenizer(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        if not self.by_words:
            for text in texts:
                yield self._by_tokenizer([text])[0]
            return
        quick = self.quick.encode_to_numpy if self.quick else None
        for text in texts:
            if quick and PLAIN.fullmatch(text) and of_words(text):
                yield quick(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                yield self._by_words(CUT.split(text))

    def _by_words(self, words: list[str]) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known = {}
        rest = list(set(words[1:]) - self.known.keys())
        self.known.update(zip(rest, self._encoded([" " + x for x in rest]), strict=True))
        return self._encoded(words[:1])[0] + b"".join(map(self.known.__getitem__, words[1:]))


def _ranked(parts: dict):
    """An encoder by merge ranks of the same vocabulary; None where merges are not ordered like the ids of what they make."""
    import tiktoken

    model = parts["model"]
    vocabulary, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    bytes_ = _alphabet()
    if model.get("type") != "BPE" or sorted(set(made)) != made or any(c not in vocabulary for c in bytes_):
        return None
    wanted = [*bytes_, *(a + b for a, b in pairs)]
    ranks = {bytes(bytes_[c] for c in token): vocabulary[token] for token in wanted}
    if max(vocabulary[c] for c in bytes_) > made[0]:
        return None
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def _alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level files: itself where it is visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(rest)}


_ENCODERS: dict[int, WordEncoder] = {}


def encoder_of(model: str) -> WordEncoder:
    """One encoder a worker process and model."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]


def default_model() -> str:
    """The public byte-level 50k model; callers may hand over another file's contents."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: the first may be shorter, all others are full."""
    return ([n % most] if n % most else []) + [most] * (n // most)


def pieces(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text", most: int = LENGTH, end: int = END_ID, ids: bool = True) -> DataFrame:
    """The pieces of every row's tokens: its id, piece (from 0), start, length, ids_crc32 and, if wanted, the ids.

    Tokens are the text's ids and one end id; null counts as the empty text. Rows of more than `most` tokens are cut, the first piece
    may then be shorter. One pass without a shuffle; null and 64-bit ids, repeated rows and other columns do no harm.
    """
    model = model if model is not None else default_model()
    tail = np.array([end], "<u4").tobytes()
    added = "piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def work(batch: pa.RecordBatch) -> tuple[list[int], list]:
        rows, cut = [], []
        texts = [t.decode() for t in arrow_lines(batch["text"])]
        for row, body in enumerate(encoder_of(model).encode(texts)):
            body = memoryview(body + tail)
            at = 0
            for piece, n in enumerate(cut_lengths(len(body) // 4, most)):
                part = body[4 * at : 4 * (at + n)]
                rows.append(row)
                cut.append((piece, at, n, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if ids else [])))
                at += n
        return rows, [list(c) for c in zip(*cut, strict=True)] if cut else [[] for _ in range(5 if ids else 4)]

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], work, added)


class Lengths:
    """Counts of the lengths still to be packed, with the sums of two available lengths."""

    def __init__(self, counts: dict[int, int], most: int):
        self.most = most
        self.count = np.zeros(most + 1, np.int64)
        for n, c in counts.items():
            self.count[n] = c
        self.left = int(self.count.sum())
        has = self.count > 0
        self.pairs = np.zeros(most + 1, np.int64)  # how many pairs a < b of available lengths have each sum
        for a in np.flatnonzero(has):
            self._pair(int(a), 1, has)
        self.pairs //= 2

    def _pair(self, a: int, sign: int, has: np.ndarray) -> None:
        others = np.flatnonzero(has[: self.most + 1 - a])
        self.pairs[others[others != a] + a] += sign

    def take(self, n: int, times: int) -> None:
        self.count[n] -= times
        self.left -= times
        if times and not self.count[n]:
            self._pair(n, -1, self.count > 0)

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two available lengths with that sum, the larger one as large as can be."""
        if gap < 2:
            return None
        if self.pairs[gap]:
            a = np.arange(gap - 1, gap // 2, -1)
            a = int(a[np.argmax((self.count[a] > 0) & (self.count[gap - a] > 0))])
            return a, gap - a
        if gap % 2 == 0 and self.count[gap // 2] > 1:
            return gap // 2, gap // 2
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three available lengths with that sum, under their counts."""
        a = np.flatnonzero(self.count[1 : max(1, gap - 1)] > 0)[::-1] + 1
        rest = gap - a
        maybe = (self.pairs[rest] > 0) | ((rest % 2 == 0) & (self.count[rest // 2] > 1))
        for x in a[maybe].tolist():
            self.count[x] -= 1  # not to be had twice where it is the last
            two = self.pair(gap - x)
            good = two and all(self.count[y] >= two.count(y) for y in two)
            self.count[x] += 1
            if good:
                return x, *two
        return None

    def fit(self, gap: int) -> int:
        """The best-fitting length, 0 where none fits."""
        has = np.flatnonzero(self.count[: min(gap, self.most) + 1])
        return int(has[-1]) if len(has) else 0


# One run of pieces of a length: the first of them, how many, the first one's sequence, their offset.
Placed = tuple[int, int, int, int, int]


def pack(counts: dict[int, int], most: int = LENGTH) -> tuple[list[Placed], int]:
    """Where the pieces of each length go: (length, first piece, pieces, first sequence, offset), and the number of sequences.

    The n-th piece of a run goes to the n-th sequence from its first one on. Lengths are 1 to `most`.
    """
    lengths, used, out, sequences = Lengths(counts, most), defaultdict(int), [], 0

    def place(n: int, times: int, first: int, offset: int) -> None:
        out.append((n, used[n], times, first, offset))
        used[n] += times
        lengths.take(n, times)

    while lengths.left:
        longest = lengths.fit(most)
        bins = int(lengths.count[longest])
        if 2 * longest <= most:  # they share bins: open no more than needed
            bins = max(1, bins // (most // longest))
        open_ = [(sequences, bins, longest)]  # first sequence, bins, filling
        place(longest, bins, sequences, 0)
        sequences += bins
        while open_:
            first, bins, filled = open_.pop()
            gap = most - filled
            if not gap or not lengths.left:
                continue
            parts = ((gap,) if lengths.count[gap] else None) or lengths.pair(gap) or lengths.triple(gap)
            if not parts:
                best = lengths.fit(gap)
                if not best:
                    continue
                parts = (best,)
            times = min(bins, *(int(lengths.count[n]) // parts.count(n) for n in parts))
            if times < bins:
                open_.append((first + times, bins - times, filled))
            for n in parts:
                place(n, times, first, filled)
                filled += n
            open_.append((first, times, filled))
    return out, sequences


def _count_ahead(rows: DataFrame, part: str, key: str, n: str) -> DataFrame:
    """part, key and __ahead: how many rows of the key stand in parts before."""
    counts = rows.groupBy(part, key).agg(F.max(n).alias("__in"))
    ahead = F.sum(F.col("__in") + 1).over(W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(part, key, F.coalesce(ahead, F.lit(0)).cast("long").alias("__ahead"))


def pack_pieces(cut: DataFrame, most: int = LENGTH) -> DataFrame:
    """The rows of cut, which have a `length` from 1 to `most`, with sequence_id and offset; no sequence holds more than `most`.

    Rows of a length are numbered within each partition in passing, and a running sum over partitions makes the numbers gapless: no
    length is sorted or gathered. The driver packs at most `most` counts. The table of placed runs, which all tasks get, has a size
    that `most` bounds (some ten thousand runs for 2048 tokens), whatever the number of rows. Rows are written once, so that a task that is run again
    finds the same numbers. An empty table stays empty.
    """
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            there = length[order]
            starts = np.searchsorted(there, there)  # the first of each length
            n = np.empty(len(length), np.int64)
            n[order] = seen[there] + np.arange(len(there)) - starts
            seen += np.bincount(length, minlength=most + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*columns, "__n"])

    known = cut.select(*columns).withColumn("__part", F.spark_partition_id())
    columns = known.columns
    rows = settle(known.mapInArrow(number, T.StructType([*known.schema, T.StructField("__n", T.LongType())])), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = pack(counts, most)
    by_length = defaultdict(list)
    for length, first, times, sequence, offset in placed:
        by_length[length].append((first, times, sequence, offset))
    by_length = {n: np.array(sorted(x), np.int64) for n, x in by_length.items()}
    sent = cut.sparkSession.sparkContext.broadcast(by_length)

    def find(batch: pa.RecordBatch) -> tuple[None, list]:
        length, n = batch["length"].to_numpy(zero_copy_only=False), batch["__n"].to_numpy(zero_copy_only=False) + batch["__ahead"].to_numpy(zero_copy_only=False)
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        order = np.argsort(length, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(n) else []:
            runs = sent.value[int(length[at[0]])]
            run = runs[np.searchsorted(runs[:, 0], n[at], side="right") - 1]
            sequence[at], offset[at] = run[:, 2] + n[at] - run[:, 0], run[:, 3]
        return None, [pa.array(sequence), pa.array(offset)]

    ahead = _count_ahead(rows, "__part", "length", "__n")
    return map_arrow(rows.join(ahead, ["__part", "length"]), [c for c in columns if c != "__part"], find, "sequence_id long, offset long")


def pack_documents(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text", most: int = LENGTH, end: int = END_ID, ids: bool = True) -> DataFrame:
    """Pieces of all rows with their sequence and offset; with `ids`, the ids to write there. Cases as for `pieces`."""
    # Pieces are settled before they are numbered, so that a task holds one Python worker, not two.
    return pack_pieces(settle(pieces(docs, model, doc_id, text, most, end, ids), "cut"), most)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), ids=False)
