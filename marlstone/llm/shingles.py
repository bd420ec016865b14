"""Word hashes and word shingles of texts, in numpy."""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE, _GOLD = 0x9E3779B97F4A7C15 | 1, np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 2**64)
_STATE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; grown by doubling and kept for the process."""
    have = _STATE.get(name)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        out = np.full(size, base % 2**64, np.uint64)
        out[0] = 1
        _STATE[name] = have = np.multiply.accumulate(out)
    return have[:n]


def _word_characters() -> np.ndarray:
    """True for code points that belong to words: letters, digits, the low line."""
    if "word" not in _STATE:
        _STATE["word"] = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
    return _STATE["word"]


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of a text's words in lower case: maximal runs of letters, digits and low lines.

    A word's hash is a polynomial of its code points, taken from differences of one running sum over the text.
    """
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_characters()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    n = len(codes)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n))])
    hashes = (run[ends] - run[starts]) * _powers("down", _INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def blocks_of(texts: list[str], size: int = 1_000_000):
    """Texts in blocks of about `size` characters: (place of the first text, texts)."""
    at, own, n = 0, [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n >= size:
            yield at, own
            at, own, n = at + len(own), [], 0
    if own:
        yield at, own


def words_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts in one array, where each text's begin; one more place at the end).

    One pass over the joined texts: the calls cost the same for one text as for hundreds.
    """
    low = [t.lower() for t in texts]
    hashes, starts, _ = words("\n".join(low))
    offsets = np.cumsum([0, *(len(t) + 1 for t in low)])
    return hashes, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words; a shorter text has one gram of all its words."""
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        hashes = np.concatenate([hashes, np.full(size - len(hashes), 0, np.uint64)])
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def shingles(text: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in ascending order, how often each occurs)."""
    return np.unique(grams(words(text)[0], size), return_counts=True)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of distinct values; 0 where both are empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)
