"""Comparing two lists of names in memory: what a cell of a similarity join does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

TILE = 1 << 18  # pairs that are compared at a time
FEW_WORDS = 4  # alphabets of more words of 64 letters are looked up by rare letters instead of compared with everything
INSIDE = 0.88


def inside_pairs(inner: list[str], outer: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j with inner[i] in outer[j], found by the run of three characters of inner[i] that the fewest outer texts hold (all of a shorter text)."""
    sizes = {min(len(t), 3) for t in inner}
    runs: dict[str, list[int]] = {}
    for j, t in enumerate(outer):
        for r in {t[k : k + n] for n in sizes for k in range(len(t) - n + 1)}:
            runs.setdefault(r, []).append(j)
    none: list[int] = []
    found: list[tuple[int, int]] = []
    for i, t in enumerate(inner):
        held = min((runs.get(t[k : k + 3], none) for k in range(max(1, len(t) - 2))), key=len)
        found += [(i, j) for j in held if t in outer[j]]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


class Letters:
    """Distinct characters of texts as rows of bits, the rarest first; lengths, and how many shared ones each text needs."""

    def __init__(self, left: list[str], right: list[str], least: float):
        texts = [*left, *right]
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        letters, at = np.unique(codes, return_inverse=True)
        own = np.unique(np.repeat(np.arange(len(texts)), self.n) * max(1, len(letters)) + at)  # each text's characters once
        row, at = own // max(1, len(letters)), own % max(1, len(letters))
        rank = np.empty(len(letters), np.int64)
        rank[np.argsort(np.bincount(at, minlength=len(letters)), kind="stable")] = np.arange(len(letters))
        at = rank[at]
        self.words = max(1, -(-len(letters) // 64))
        self.bits = np.zeros((len(texts), self.words), np.uint64)
        np.bitwise_or.at(self.bits, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        self.distinct = np.bincount(row, minlength=len(texts))
        self.need = np.ceil(least * self.n - 1e-9).astype(np.int64)
        self.order = np.lexsort((at, row))
        self.at = at[self.order]
        self.start = np.concatenate([[0], np.cumsum(self.distinct)])

    def prefix(self, k: int) -> np.ndarray:
        """The rarest characters of a text, of which any text that shares enough of them has one."""
        return self.at[self.start[k] : self.start[k] + self.distinct[k] - self.need[k] + 1]


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits each row of x shares with each row of y."""
    out = np.bitwise_count(x[:, None, 0] & y[None, :, 0])
    if x.shape[1] > 1:
        out = out.astype(np.int32)
        for w in range(1, x.shape[1]):
            out += np.bitwise_count(x[:, None, w] & y[None, :, w])
    return out


def letter_pairs(left: list[str], right: list[str], least: float, upper: bool = False, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and scores of the pairs whose shared distinct characters are at least `least` of the longer length, tile by tile.

    `upper`: both lists are one, and only i < j count. `known`: pairs left out, as sorted i * len(right) + j. Texts with fewer distinct characters
    than they need meet none. Small alphabets are compared by bits, all with all; of large ones a text meets those that share one of the rarest
    characters of both.
    """
    all_ = Letters(left, right, least)
    fit = all_.distinct >= all_.need
    p, q = np.flatnonzero(fit[: len(left)]), np.flatnonzero(fit[len(left) :])
    b = q + len(left)
    if not len(p) or not len(q):
        return
    known = np.empty(0, np.int64) if known is None else known
    if all_.words <= FEW_WORDS:
        x, y = all_.bits[p], all_.bits[b]
        kind = np.uint8 if all_.n.max() < 256 else np.int64
        need, n = all_.need.astype(kind), all_.n.astype(np.float64)
        known = known[fit[known // len(right)] & fit[len(left) + known % len(right)]]
        known_i, known_j = np.searchsorted(p, known // len(right)), np.searchsorted(q, known % len(right))
        step = max(1, TILE // len(q))
        for at in range(0, len(p), step):
            first = int(np.searchsorted(q, p[at], "right")) if upper else 0
            if first == len(q):
                break
            rows = slice(at, min(at + step, len(p)))
            shared = _shared(x[rows], y[first:])
            enough = shared >= np.maximum(need[p[rows], None], need[None, b[first:]])
            own = slice(*np.searchsorted(known_i, [rows.start, rows.stop]))
            there = known_j[own] >= first
            enough[known_i[own][there] - at, known_j[own][there] - first] = False
            if upper:
                for r in range(1, rows.stop - at):
                    enough[r, : int(np.searchsorted(q, p[at + r], "right")) - first] = False
            spot = np.flatnonzero(enough)
            i = spot // (len(q) - first)
            j = spot - i * (len(q) - first) + first
            i, j, shared = p[i + at], q[j], shared.ravel()[spot]
            score = shared / np.maximum(n[i], n[j + len(left)])
            fine = score >= least
            yield (i, j, score) if fine.all() else (i[fine], j[fine], score[fine])
        return
    held: dict[int, list[int]] = {}
    for j, k in enumerate(b):
        for c in all_.prefix(k):
            held.setdefault(int(c), []).append(j)
    lists = {c: np.array(own) for c, own in held.items()}
    for k in p:
        own = [lists[c] for c in map(int, all_.prefix(k)) if c in lists]
        if own:
            j = np.unique(np.concatenate(own))
            score = np.bitwise_count(all_.bits[k] & all_.bits[b[j]]).sum(axis=1) / np.maximum(all_.n[k], all_.n[b[j]])
            j, score = q[j[score >= least]], score[score >= least]
            new = (j > k if upper else np.ones(len(j), bool)) & ~np.isin(k * len(right) + j, known)
            yield np.full(int(new.sum()), k), j[new], score[new]


def name_pairs(left: list[str], right: list[str], low_left: list[str], low_right: list[str], least: float, inside: bool, upper: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and scores of like names: with `inside` 1 where they are equal but for case, 0.88 where one holds the other, else by shared characters."""
    known = np.empty(0, np.int64)
    if inside and left and right:
        i, j = inside_pairs(low_left, low_right)
        if upper:
            i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        else:
            j2, i2 = inside_pairs(low_right, low_left)
            i, j = np.concatenate([i, i2]), np.concatenate([j, j2])
        known = np.unique(i * len(right) + j)
        i, j = known // len(right), known % len(right)
        score = np.where(np.array([low_left[a] == low_right[b] for a, b in zip(i.tolist(), j.tolist())], bool), 1.0, INSIDE)
        yield i[score >= least], j[score >= least], score[score >= least]
    yield from letter_pairs(left, right, least, upper, known)


def best_of_kinds(met: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the pairs met, for each left place and each kind of right places the one with the highest score, of equal ones the first.

    Places of a kind are neighbours, and pairs come by left, then right place, so that a batch holds those of a left place and a kind one behind another.
    """
    width = int(kinds.max()) + 1
    least: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j, score in met:
        if len(i):
            k = i * width + kinds[j]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, starts), np.diff(np.r_[starts, len(k)])))
            top = top[np.r_[True, k[top][1:] != k[top][:-1]]]
            least.append((k[top], j[top], score[top]))
    if least:
        k, j, score = (np.concatenate(x) for x in zip(*least, strict=True))
        order = np.lexsort((j, -score, k))
        order = order[np.r_[True, k[order][1:] != k[order][:-1]]]
        yield k[order] // width, j[order], score[order]
