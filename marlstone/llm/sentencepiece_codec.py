"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in flat numpy arrays. In each round every word finds its adjacent pair of the least
rank (segmented minimum), merges the leftmost occurrences that the library's one-at-a-time order would merge
as well, and the arrays are compacted; rounds go on until no pair is left. Words are cut where a blank mark follows
another character: no piece of the vocabulary crosses such a place (checked when the model is read), so
merges never do.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_lines, map_arrow, table

MARK = "▁"  # stands for a blank inside pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in the model file
NONE = np.iinfo(np.int64).max
REMEMBERED = 400_000  # words that a worker keeps encoded; beyond that it starts anew


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """Pieces, ranks of pairs and settings of a BPE model file with identity normalisation."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.unk, self.bos, self.eos, self.dummy_prefix, squeeze, charsmap = 0, 1, 2, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                own = dict(_fields(value))
                self.unk, self.bos, self.eos = own.get(40, 0), own.get(41, 1), own.get(42, 2)
                if not own.get(35):
                    raise ValueError("a model with byte fallback is needed")
            elif number == 3:
                own = dict(_fields(value))
                self.dummy_prefix, squeeze, charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
        if squeeze or charsmap:
            raise ValueError("a model with identity normalisation is needed")
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        # Rank of a piece: the place of its score. Pieces of one score (runs of marks) go by position alone.
        place = {x: r for r, x in enumerate(sorted(set(scores), reverse=True))}
        rank = {i: place[x] for i, x in enumerate(scores)}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * len(self.pieces) + b] = (rank[i], i)
        self.size = len(self.pieces)
        self.longest_run = max((len(p) for p in self.ids if not p.strip(MARK)), default=1)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.pair_ids = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair makes no piece) and the piece made; negative symbols never pair."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_ids[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (blanks already marks)."""
        out: list[list[int]] = [[] for _ in words]
        flat = "".join(words)
        if not flat:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        codes, where = np.unique(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        chars = [chr(c) for c in codes.tolist()]
        # Characters out of the vocabulary get negative symbols, which become bytes at the end.
        known = np.array([self.ids.get(c, -1 - k) for k, c in enumerate(chars)], np.int64)
        symbol = known[where].copy()
        rank, made = self._pairs(symbol, word, np.arange(len(symbol)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            run = np.repeat(best, np.diff(np.append(starts, len(rank))))
            # Words without a pair are finished and leave the arrays.
            open_ = run < NONE
            if not open_.all():
                done.append((word[~open_], symbol[~open_]))
                symbol, word, rank, made, run = symbol[open_], word[open_], rank[open_], made[open_], run[open_]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == run)
            # Of overlapping occurrences (a a a) every other one of a chain, from the left.
            chain = np.append(True, (np.diff(at) > 1))
            first = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            at = at[self._as_one_by_one(at, symbol, word, rank, made)]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols stand after the compaction
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[touched], made[touched] = self._pairs(symbol, word, touched)
        word, symbol = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        strange = set(word[symbol < 0].tolist())
        flat_ids = symbol.tolist()
        start = 0
        for w, end in enumerate(ends):
            ids = flat_ids[start:end]
            if w in strange:
                ids = [i for s in ids for i in ([s] if s >= 0 else self.byte_ids[list(chars[-1 - s].encode("utf-8", "surrogatepass"))].tolist())]
            out[w] = ids
            start = end
        return out

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at the given places."""
        nxt = np.minimum(at + 1, len(symbol) - 1)
        rank, made = self.rank(symbol[at], symbol[nxt])
        rank[(word[at] != word[nxt]) | (nxt == at)] = NONE
        return rank, made

    def _as_one_by_one(self, at, symbol, word, rank, made) -> np.ndarray:
        """Which of the chosen merges the one-at-a-time order also makes before any other.

        It does as long as no merge before, in the same word, opened a pair of a rank no greater: with what stands left
        of it by then, or with the raw symbol right of it. The merge that opens such a pair is itself made.
        """
        n = len(symbol)
        merged_before = np.zeros(n + 2, bool)
        merged_before[at + 2] = True  # a merge that ends right before
        left = np.where(at > 0, symbol[at - 1], -1)
        left_made = np.where(merged_before[at], made[np.maximum(at - 2, 0)], left)
        left_made = np.where((at > 0) & (word[np.maximum(at - 1, 0)] == word[at]), left_made, -1)
        right = np.where(at + 2 < n, symbol[np.minimum(at + 2, n - 1)], -1)
        right = np.where((at + 2 < n) & (word[np.minimum(at + 2, n - 1)] == word[at]), right, -1)
        opens = (self.rank(left_made, made[at])[0] <= rank[at]) | (self.rank(made[at], right)[0] <= rank[at])
        # Keep up to and including the first that opens, within each word.
        before = np.cumsum(opens) - opens
        start = np.append(True, word[at][1:] != word[at][:-1])
        base = np.maximum.accumulate(np.where(start, before, 0))
        return before == base

    def decode(self, ids: list[int]) -> str:
        """The library's text of ids: control pieces are silent, bytes join, one leading blank goes."""
        out, pending = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(_bytes_text(bytes(pending)))
                pending = bytearray()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        if pending:
            out.append(_bytes_text(bytes(pending)))
        text = "".join(out)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _bytes_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LONG_RUN = " " * 64


def _cut_run(word: str, longest: int) -> list[str]:
    """A word's leading run of marks cut into the longest pieces, which its left end fills one by one, but for the last few."""
    run = len(word) - len(word.lstrip(MARK))
    n = max(0, run // longest - 2)
    return [MARK * longest] * n + [word[n * longest :]]


class Codec:
    """Encodes texts through a bounded memory of words: their ids as text, and their decoded text where it is not the word."""

    def __init__(self, data: bytes):
        self.model = PieceModel(data)
        self.plain = [p.replace(MARK, " ") if k == NORMAL else None for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def _plain(self, ids: list[int]) -> str:
        """Text of a word's ids with every blank kept; the document drops its leading one."""
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # None stands for a byte
            return self.model.decode([*self.model.byte_ids[[32]].tolist(), *ids])[self.model.dummy_prefix ^ 1 :]

    def _learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.model.encode_words(words), strict=True):
            self.known[w] = " ".join(map(str, ids))
            if (text := self._plain(ids)) != w.replace(MARK, " "):
                self.odd[w] = text

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        words = self.words(text)
        self._know({w for w in words})
        return [int(i) for w in words for i in self.known[w].split()] + [self.model.eos]

    def _know(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.odd, new = {}, {}, words
            self._learn(sorted(new))

    def words(self, text: str) -> list[str]:
        """A text cut into the words that merge by themselves."""
        if not text:
            return []
        words = WORD.findall((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK))
        if LONG_RUN not in text:
            return words
        return [part for w in words for part in _cut_run(w, self.model.longest_run)]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, their digest, the digest of the decoded text) of each text."""
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(self.words(text))
            size += len(text)
            if size > 2_000_000:
                yield from self._digests(block)
                block, size = [], 0
        yield from self._digests(block)

    def _digests(self, block: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        self._know(set().union(*block))
        known, odd, eos = self.known, self.odd, str(self.model.eos)
        for words in block:
            ids = " ".join([known[w] for w in words] + [eos])
            text = "".join([odd.get(w, w) for w in words] if odd and not odd.keys().isdisjoint(words) else words).replace(MARK, " ")
            if self.model.dummy_prefix and text.startswith(" "):
                text = text[1:]
            yield ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_CODECS: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """One codec a worker process and model."""
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def default_model() -> bytes:
    """The public 32k model; callers may hand over another file's bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def token_digests(docs: DataFrame, model: bytes | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one pass without a shuffle.

    The model's bytes (half a megabyte, fixed) go along with the tasks. Null text counts as empty: one id, the end.
    Null ids, repeated rows and other columns do no harm; an empty table gives an empty result. Memory holds one
    Arrow batch and REMEMBERED words.
    """
    data = model if model is not None else default_model()

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        rows = list(codec_of(data).digests([t.decode() for t in arrow_lines(batch["text"])]))
        return None, [[r[k] for r in rows] for k in range(3)]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, ["doc_id"], work, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: bytes | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`, the text's ids with the end id last; cases as for token_digests, other columns stay."""
    data = model if model is not None else default_model()
    columns = [c for c in docs.columns if c != ids]

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        codec = codec_of(data)
        return None, [[list(codec.encode(t.decode())) for t in arrow_lines(batch[text])]]

    return map_arrow(docs, columns, work, f"`{ids}` array<int>")


def decode(docs: DataFrame, model: bytes | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with `text`, the text of their ids (null for null ids); other columns stay."""
    data = model if model is not None else default_model()
    columns = [c for c in docs.columns if c != text]

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        model_ = codec_of(data).model
        return None, [[None if x is None else model_.decode(x) for x in batch[ids].to_pylist()]]

    return map_arrow(docs, columns, work, f"`{text}` string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return token_digests(table(spark, sf_dir, "documents"))
