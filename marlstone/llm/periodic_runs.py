"""Maximal periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

Words of many documents lie in one integer string, cut by separators that occur once. A suffix tree is held as suffix
array, longest common prefixes and identifiers of all substrings of a power-of-two length, so that whole arrays of queries
are answered at once:

1. Lempel-Ziv blocks: the next block is the longest prefix that also starts earlier.
2. At both ends of each block, extensions forward and backward find squares ww that cover the leftmost place of every square.
3. From these, suffix-link walks (drop the first word, append it behind) visit all rotations in the tree, as long as the walked
   string occurs: steps along one leaf are taken in one jump, the edge beyond it is searched in the node. That completes
   the vocabulary.
4. Every square with a primitive root is located at all its leaves; places that follow one another with one period are one run.

Only stretches that can hold a run enter the string. A run of period q and at least max(12, 2q) words repeats, q words on, some 6-gram
at each of its places, so it lies within one stretch of words that are covered by 6-grams which their document repeats; a
run that leaves the stretch would be covered as well. This is exact, whatever the hash of 6-grams collides with.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_lines, map_arrow, table

LEAST = 12  # words of a run at least
GRAM = LEAST // 2  # words that a run repeats one period on, at least
BLOCK_BYTES = 4_000_000  # text that is worked on at once; a longer text is a block of its own
Run = tuple[int, int, int]  # start, length, period


class SuffixTree:
    """The suffix tree of an integer string whose last value occurs once, as arrays."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        ranks = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
        self.names = [np.append(ranks, 0)]  # of substrings of 1, 2, 4, ... values; 0 behind the end
        while int(ranks.max(initial=0)) < n:
            behind = np.zeros(n, np.int64)
            step = 1 << (len(self.names) - 1)
            if step < n:
                behind[: n - step] = ranks[step:]
            key = ranks * (n + 1) + behind
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            key = key[order]
            new[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
            ranks = new
            self.names.append(np.append(ranks, 0))
        self.rank = ranks - 1
        self.sa = np.empty(n, np.int64)
        self.sa[self.rank] = np.arange(n)
        common = np.zeros(n, np.int64)  # with the suffix before
        if n > 1:
            common[1:] = self.forward(self.sa[1:], self.sa[:-1])
        self.least = [common]  # least common prefix of 1, 2, 4, ... entries that end here
        while (step := 1 << (len(self.least) - 1)) < n:
            last = self.least[-1]
            self.least.append(np.append(np.zeros(step, np.int64), np.minimum(last[step:], last[:-step])))

    def forward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many values from i and k on are equal; i and k differ."""
        at, gap, i = i.copy(), k - i, i
        for j in range(len(self.names) - 1, -1, -1):
            name = self.names[j]
            at += (name[at] == name[at + gap]).astype(np.int64) << j
        return at - i

    def backward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many values from i and k back are equal; i < k, i may be -1."""
        at, gap = i + 1, k - i
        for j in range(len(self.names) - 1, -1, -1):
            name, low = self.names[j], at - (1 << j)
            from_ = np.maximum(low, 0)
            at -= ((low >= 0) & (name[from_] == name[from_ + gap])).astype(np.int64) << j
        return i + 1 - at

    def leaves(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, in the suffix array, of the suffixes that begin like the one at i for `depth` values."""
        low, high = self.rank[i].copy(), self.rank[i].copy()
        for j in range(len(self.least) - 1, -1, -1):
            least, step = self.least[j], 1 << j
            low -= ((low - step >= 0) & (least[low] >= depth)).astype(np.int64) << j
            up = high + step
            high += ((up < self.n) & (least[np.minimum(up, self.n - 1)] >= depth)).astype(np.int64) << j
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A suffix among leaves low to high whose value at `depth` has the rank `value`, -1 where none has."""
        first = self.names[0]
        a, b = low.copy(), high + 1  # the first leaf whose value there is not below
        while (open_ := a < b).any():
            mid = (a + b) // 2
            less = open_ & (first[np.minimum(self.sa[np.minimum(mid, self.n - 1)] + depth, self.n)] < value)
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        found = self.sa[np.minimum(a, self.n - 1)]
        return np.where((a <= high) & (first[np.minimum(found + depth, self.n)] == value), found, -1)


def _blocks(tree: SuffixTree) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    n, sa = tree.n, tree.sa.tolist()
    before, after, stack = [-1] * n, [-1] * n, []  # nearest earlier starts among the suffixes sorted before and behind
    for i in sa:
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    i, longest = np.arange(n), np.zeros(n, np.int64)
    for near in (np.array(before), np.array(after)):
        has = near >= 0
        longest[has] = np.maximum(longest[has], tree.forward(near[has], i[has]))
    starts, at, longest = [], 0, longest.tolist()
    while at < n:
        starts.append(at)
        at += max(1, longest[at])
    return np.array([*starts, n])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0-based number within the row) for counts of entries of rows."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _leftmost(tree: SuffixTree, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of squares that cover the leftmost place of each square."""
    h, h1 = starts[:-1], starts[1:]
    size = h1 - h
    row, k = _spread(np.where(h1 < tree.n, size, 0))  # the right half goes over the block's end
    k, end = k + 1, h1[row]
    q = end - k
    on, back = tree.forward(q, end), tree.backward(q - 1, end - 1)
    ok = (on + back >= k) & (on > 0)
    found = [(np.maximum(q - back, q - k + 1)[ok], k[ok])]
    row, k = _spread(size + np.append(size[1:], 0))  # the left half goes over the block's beginning
    k, begin = k + 1, h[row]
    use = (begin > 0) & (begin + k < tree.n)
    row, k, begin = row[use], k[use], begin[use]
    q = begin + k
    on, back = tree.forward(begin, q), tree.backward(begin - 1, q - 1)
    at = np.maximum(begin - back, begin - k + 1)
    ok = (on + back >= k) & (on > 0) & (back > 0) & (at + k <= h1[row])
    found.append((at[ok], k[ok]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _primitive(tree: SuffixTree, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the word of k values at i is no power of a shorter one."""
    ok, rest, prime = np.ones(len(i), bool), k.copy(), 2
    while (rest > 1).any():
        prime = prime if prime * prime <= rest.max() else None
        factor = rest if prime is None else np.where(rest % prime == 0, prime, 1)
        has = np.flatnonzero((factor > 1) & ok)
        part = k[has] // factor[has]
        ok[has] = tree.forward(i[has], i[has] + part) < k[has] - part
        rest = rest // factor
        if prime is None:
            break
        if not (rest % prime == 0).any():
            prime += 1
    return ok


def _walked(tree: SuffixTree, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First leaf, last leaf and half length of all rotations of the squares at i that occur as squares, each once."""
    left, known = k.copy(), np.empty((0, 2), np.int64)
    lows, highs, halves = [], [], []
    while len(i):
        far = np.minimum(tree.forward(i, i + k) - k, left - 1)  # suffix links along this leaf
        row, step = _spread(far + 1)
        at, half = i[row] + step, k[row]
        low, high = tree.leaves(at, 2 * half)
        lows, highs, halves = [*lows, low], [*highs, high], [*halves, half]
        known = np.unique(np.concatenate([known, np.stack([half, low], 1)]), axis=0)
        left = left - far - 1
        i = i + far
        go = left > 0
        i, k, left = i[go], k[go], left[go]
        depth = 2 * k - 1
        low, high = tree.leaves(i + 1, depth)  # the suffix link, then the edge that begins with the word dropped
        to = tree.child(low, high, depth, tree.names[0][i])
        i, k, left = to[to >= 0], k[to >= 0], left[to >= 0]
        low, _ = tree.leaves(i, 2 * k)
        base = tree.n + 1
        new = ~np.isin(k * base + low, known[:, 0] * base + known[:, 1])
        i, k, left = i[new], k[new], left[new]
    if not lows:
        return (np.empty(0, np.int64),) * 3
    low, high, half = np.concatenate(lows), np.concatenate(highs), np.concatenate(halves)
    once = np.unique(half * (tree.n + 1) + low, return_index=True)[1]
    return low[once], high[once], half[once]


def runs_of_string(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal run of at least two periods in an integer string whose last value occurs once."""
    if len(s) < 3:
        return (np.empty(0, np.int64),) * 3
    tree = SuffixTree(s)
    i, k = _leftmost(tree, _blocks(tree))
    plain = _primitive(tree, i, k)
    low, high, half = _walked(tree, i[plain], k[plain])
    row, step = _spread(high - low + 1)
    key = np.sort(half[row] * tree.n + tree.sa[low[row] + step])
    period, at = key // tree.n, key % tree.n
    new = np.append(True, (np.diff(key) != 1) | (np.diff(period) != 0)) if len(key) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(first) else first
    return at[first], at[last] - at[first] + 2 * period[first], period[first]


def _stretches(ids: list[np.ndarray], gram: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of the stretches of words covered by `gram` words that their document repeats."""
    long = [d for d, x in enumerate(ids) if len(x) >= 2 * gram]
    if not long:
        return []
    sizes = np.array([len(ids[d]) for d in long])
    flat = np.concatenate([ids[d] for d in long]).astype(np.uint64)
    doc = np.repeat(np.arange(len(long)), sizes)
    h = doc[: len(flat) - gram + 1].astype(np.uint64)
    for j in range(gram):
        h = (h + flat[j : j + len(h)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(doc[: len(h)] == doc[gram - 1 :])
    order = inside[np.argsort(h[inside])]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(flat) + 1, np.int64)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    again[twice] += 1
    again[twice + gram] -= 1
    covered = np.cumsum(again)[:-1] > 0
    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    edge = np.unique(np.concatenate([edge, np.intersect1d(np.cumsum(sizes)[:-1], np.flatnonzero(covered))]))  # documents end stretches
    begins = np.cumsum(sizes) - sizes
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if covered[a]:
            out.append((long[doc[a]], a - int(begins[doc[a]]), b - int(begins[doc[a]])))
    return out


def find_runs(ids: list[np.ndarray], least: int = LEAST) -> list[list[Run]]:
    """All runs (start, length, period) of at least `least` words and two periods, of each array of word numbers, by start, then period."""
    out: list[list[Run]] = [[] for _ in ids]
    parts = _stretches(ids, least // 2)
    if not parts:
        return out
    top = 1 + max(int(ids[d].max()) for d, _, _ in parts)
    # Each stretch ends with a value of its own.
    string = np.concatenate([np.append(ids[d][a:b], top + n) for n, (d, a, b) in enumerate(parts)])
    ends = np.cumsum([b - a + 1 for _, a, b in parts])
    start, length, period = runs_of_string(string)
    use = length >= least
    for s, n, p in zip(start[use].tolist(), length[use].tolist(), period[use].tolist(), strict=True):
        part = int(np.searchsorted(ends, s, side="right"))
        d, a, b = parts[part]
        out[d].append((s - int(ends[part]) + (b - a + 1) + a, n, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """The places of the words that stay: those no run contains behind its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:n]) == 0)


def cycled(n: int, seed: int) -> np.ndarray | None:
    """The places of the original words in the text as it is read: from some word on, cycles of the words there, for one seed in ten."""
    if seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _document(words: list[bytes], places: np.ndarray | None, runs: list[Run]) -> tuple:
    n = len(words)
    kept = collapsed(n, runs) if runs else None
    if places is not None:
        kept = places if kept is None else places[kept]
    text = b" ".join(words if kept is None else [words[i] for i in kept.tolist()])
    longest = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (
        len(runs),
        *(longest or (None, None, None)),
        longest and 1000 * longest[1] // longest[2],
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(text).hexdigest(),
        runs,
        text.decode(),
    )


def _blocks_of(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def described(texts: list[bytes], seeds: list[int | None]) -> Iterator[tuple]:
    """For each text (UTF-8): number of runs, the longest run and its exponent, the two digests, the runs and the collapsed text."""
    at = 0
    for block in _blocks_of(texts):
        number: dict[bytes, int] = {}
        words = [t.split() for t in block]  # bytes split at blank and 9 to 13
        places = [None if s is None else cycled(len(w), s) for w, s in zip(words, seeds[at : at + len(block)], strict=True)]
        at += len(block)
        for w in words:
            for x in w:
                number.setdefault(x, len(number))
        ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
        ids = [x if p is None else x[p] for x, p in zip(ids, places, strict=True)]
        for w, p, runs in zip(words, places, find_runs(ids), strict=True):
            yield _document(w, p, runs)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cycles: bool = False, keep: bool = True) -> DataFrame:
    """The id of every row, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256.

    Words are parted by blanks and the characters 9 to 13. A run is a stretch of at least max(12, 2 * period) words with that smallest
    period which no neighbouring word extends. The longest run (ties: smallest start, then period) is null without a run.
    With `keep` the runs themselves (array of start, length, period) and the collapsed text follow. With `cycles`, one document in ten (by the
    crc32 of its id; a null id counts as the empty text) is read as if it ran in cycles from some word on.

    One pass, no shuffle: each row depends on itself alone, so copies and hot sources are no groups. Null text has no words;
    null ids, 64-bit ids, repeated rows and other columns do no harm; an empty table gives an empty result. Memory is some 400 bytes for
    each word of the repeated stretches of BLOCK_BYTES of text, or of one longer text.
    """
    added = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if keep:
        added += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    seed = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) if cycles else F.lit(None).cast("long")

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        rows = list(described(arrow_lines(batch["text"]), batch["seed"].to_pylist()))
        columns = [[r[c] for r in rows] for c in range(9 if keep else 7)]
        if keep:
            columns[7] = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in columns[7]]
        return None, columns

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), seed.alias("seed")), ["doc_id"], work, added)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of which is read in cycles."""
    return periodic_runs(table(spark, sf_dir, "documents"), cycles=True, keep=False)
