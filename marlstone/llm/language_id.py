"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text in units that end at white space, so equal units have equal results and are computed once a
worker. Every byte of a unit and the blank behind it is a position, whatever it holds: forward and backward states meet
there and give label probabilities for that position; a document pools the log probabilities of all its positions,
over its whole text. States start anew at white space. Training is backpropagation through time with Adam on units
drawn from the whole texts of a bounded number of labelled rows; that number is the only bound.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_lines, held_out, map_arrow, table

SAMPLE_ROWS = 3000  # labelled rows that the network is fitted on, at most; their whole texts count
HIDDEN, EMBED = 16, 10
UNIT = 48  # bytes of a unit; longer stretches without white space are cut there, between characters
REMEMBERED = 250_000  # units whose results a worker keeps before it starts anew
SHARPEN = 8.0
LETTERLIKE = re.compile(r"[^\W\d_]+")
NO_LANGUAGE = "und"


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def has_letter(text: str) -> bool:
    """Whether a text holds a character of the Unicode categories L; numerals such as fractions are none."""
    return any(m.group().isalpha() or any(map(str.isalpha, m.group())) for m in LETTERLIKE.finditer(text))


def units_of(word: str) -> list[bytes]:
    """The byte units of a stretch without white space: itself, or pieces of at most UNIT bytes of whole characters."""
    whole = word.encode("utf-8", "replace")
    if len(whole) <= UNIT:
        return [whole]
    out, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + UNIT)
        while end < len(whole) and whole[end] & 0xC0 == 0x80:
            end -= 1
        out.append(whole[at:end])
        at = end
    return out


def packed(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(steps x units) byte values, 256 as filler, and lengths; every unit ends with a blank."""
    sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
    out = np.full((int(sizes.max()), len(units)), 256, np.int64)
    flat = np.frombuffer(b" ".join(units) + b" ", np.uint8)
    cols = np.repeat(np.arange(len(units)), sizes)
    rows = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, cols] = flat
    return out, sizes


class ByteGru:
    """Bidirectional GRU with a softmax at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        g = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": (rng.standard_normal((257, embed)) * 0.3).astype(np.float32), "out": g(2 * hidden, len(labels)), "out_b": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"w_{d}": g(embed, 3 * hidden), f"u_{d}": g(hidden, 2 * hidden), f"c_{d}": g(hidden, hidden), f"b_{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States after each step of one direction; x: steps x units."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        # Input part of the gates for each of the 257 symbols, once.
        gates = self.p["emb"] @ self.p[f"w_{d}"] + self.p[f"b_{d}"]
        u, c = self.p[f"u_{d}"], self.p[f"c_{d}"]
        states, saved = np.empty((x.shape[0], x.shape[1], n), np.float32), []
        order = range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1)
        for t in order:
            live = x[t] < 256
            a = gates[x[t]]
            zr = _sigmoid(a[:, : 2 * n] + h @ u)
            z, r = zr[:, :n], zr[:, n:]
            cand = np.tanh(a[:, 2 * n :] + (r * h) @ c)
            new = np.where(live[:, None], (1 - z) * h + z * cand, h)
            if keep:
                saved.append((t, h, z, r, cand, live))
            h = new
            states[t] = h
        return states, saved

    def unit_scores(self, units: list[bytes]) -> np.ndarray:
        """For each unit the sum over its positions of the log probability of each label.

        Units of one length run together, both directions side by side, so no step needs a mask. The gates'
        logistic function is taken as a hyperbolic tangent of half its argument.
        """
        n, p = self.hidden, self.p
        out = np.zeros((len(units), len(self.labels)), np.float32)
        half = np.concatenate([np.full(2 * n, 0.5), np.ones(n)]).astype(np.float32)
        gates = np.stack([(p["emb"] @ p[f"w_{d}"] + p[f"b_{d}"]) * half for d in "fb"])
        u, c = np.stack([p["u_f"], p["u_b"]]) * np.float32(0.5), np.stack([p["c_f"], p["c_b"]])
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for k in range(0, len(same), 2048):
                part = same[k : k + 2048]
                x, _ = packed([units[i] for i in part.tolist()])
                steps = len(x)
                h, states = np.zeros((2, len(part), n), np.float32), np.empty((2, steps, len(part), n), np.float32)
                for t in range(steps):
                    a = np.stack([gates[0].take(x[t], axis=0), gates[1].take(x[steps - 1 - t], axis=0)])
                    zr = np.tanh(a[..., : 2 * n] + h @ u)
                    zr *= 0.5
                    zr += 0.5
                    cand = np.tanh(a[..., 2 * n :] + (zr[..., n:] * h) @ c)
                    cand -= h
                    cand *= zr[..., :n]
                    h = h + cand
                    states[0, t], states[1, steps - 1 - t] = h[0], h[1]
                logits = states[0] @ p["out"][:n] + states[1] @ p["out"][n:] + p["out_b"]
                logits -= logits.max(axis=2, keepdims=True)
                logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
                out[part] = logits.sum(axis=0)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        n = self.hidden
        (sf, kf), (sb, kb) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate([sf, sb], axis=2)
        logits = both @ self.p["out"] + self.p["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        mask = (x < 256).astype(np.float32)
        count = mask.sum()
        picked = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / count)
        delta = prob.copy()
        np.put_along_axis(delta, np.broadcast_to(y[None, :, None], (*x.shape, 1)), np.take_along_axis(delta, np.broadcast_to(y[None, :, None], (*x.shape, 1)), axis=2) - 1, axis=2)
        delta *= (mask / count)[..., None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["out_b"] = np.tensordot(both, delta, axes=([0, 1], [0, 1])), delta.sum(axis=(0, 1))
        back = delta @ self.p["out"].T
        for d, saved, part in (("f", kf, back[..., :n]), ("b", kb, back[..., n:])):
            dh = np.zeros((x.shape[1], n), np.float32)
            u, c = self.p[f"u_{d}"], self.p[f"c_{d}"]
            dgates = np.zeros((257, 3 * n), np.float32)
            for t, h, z, r, cand, live in reversed(saved):
                dh = dh + part[t]
                on = live[:, None]
                dnew = np.where(on, dh, 0)
                dcand = dnew * z * (1 - cand * cand)
                dz = dnew * (cand - h) * z * (1 - z)
                drh = dcand @ c.T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                grad[f"u_{d}"] += h.T @ dzr
                grad[f"c_{d}"] += (r * h).T @ dcand
                np.add.at(dgates, x[t], np.concatenate([dzr, dcand], axis=1))
                dh = np.where(on, dnew * (1 - z) + drh * r + dzr @ u.T, dh)
            dgates[256] = 0
            grad[f"w_{d}"] = self.p["emb"].T @ dgates
            grad[f"b_{d}"] = dgates.sum(axis=0)
            grad["emb"] += dgates @ self.p[f"w_{d}"].T
        return loss, grad

    def fit(self, units: list[Counter[bytes]], steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 3) -> float:
        """Adam with a falling rate on units drawn by how often each label's texts hold them, all labels alike.

        units: those of each label. Returns the last mean loss.
        """
        rng = np.random.default_rng(seed)
        named = [k for k, own in enumerate(units) if own]
        lists = {k: list(units[k]) for k in named}
        upto = {k: np.cumsum(np.fromiter(units[k].values(), np.int64, len(units[k]))) for k in named}
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            y = rng.permutation(np.resize(rng.permutation(named), batch))
            drawn = [lists[k][int(np.searchsorted(upto[k], rng.integers(upto[k][-1]), "right"))] for k in y.tolist()]
            x, _ = packed(drawn)
            now, grad = self.gradients(x, y)
            loss = now if step == 1 else 0.95 * loss + 0.05 * now
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * (1 - step / (steps + 1)) ** 0.5
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss


class Scorer:
    """Document probabilities through a bounded memory of words: label sums, positions and a letter mark of each."""

    def __init__(self, net: ByteGru):
        self.net, self.width = net, len(net.labels)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width + 2), np.float32)

    def _learn(self, words: list[str]) -> None:
        parts, owner = [], []
        begin = len(self.known)
        for at, w in enumerate(words, begin):
            self.known[w] = at
            own = units_of(w)
            parts += own
            owner += [at] * len(own)
        used = begin + len(words)
        if used > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(used, len(self.rows)), self.width + 2), np.float32)])
        np.add.at(self.rows, owner, np.column_stack([self.net.unit_scores(parts), [len(u) + 1 for u in parts], np.zeros(len(parts))]).astype(np.float32))
        self.rows[begin:used, -1] = [has_letter(w) for w in words]

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, pooled probability) of each whole text."""
        split = [t.split() for t in texts]
        known = self.known
        new = {w for words in split for w in words if w not in known}
        if new:
            if len(known) + len(new) > REMEMBERED:
                self._reset()
                known, new = self.known, {w for words in split for w in words}
            self._learn(sorted(new))
        sums = np.zeros((len(split), self.width + 2))
        for i, words in enumerate(split):
            if words:
                sums[i] = self.rows[[known[w] for w in words]].sum(axis=0, dtype=np.float64)
        # Log probabilities pool as a mean over positions, sharpened: positions of a word are not independent.
        mean = sums[:, :-2] / np.maximum(sums[:, -2:-1], 1) * SHARPEN
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        return [(self.net.labels[k], float(p[k])) if n else (NO_LANGUAGE, 0.0) for k, p, n in zip(best.tolist(), prob, sums[:, -1], strict=True)]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> ByteGru | None:
    """A network fitted on at most sample_rows rows of the training part, those with the smallest hash of their text.

    Each language gives as many rows, its first by that hash, so rare languages are seen; equal texts of a language are
    one row. With more languages than sample_rows, the commonest sample_rows give one row each. The hash hides ids and
    order. Whole texts are read. None where no row is labelled.
    """
    from pyspark.sql import Window as W

    rows = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # Two steps keep every language's rows bounded before texts move: a share by hash, then the first by hash.
    tally = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    counts = {r["lang"]: max(1, r["n"]) for r in tally.orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    span = 2**64
    bounds = [(k, int(-(2**63) + min(span - 1, span * min(1.0, (2 * each + 32) / n)))) for k, n in counts.items()]
    spark = docs.sparkSession
    few = rows.join(F.broadcast(spark.createDataFrame(bounds, "lang string, top long")), "lang").filter(F.col("h") <= F.col("top"))
    first = few.dropDuplicates(["lang", "h"]).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= each).select("lang", "text")
    labels = sorted(counts)
    at = {k: i for i, k in enumerate(labels)}
    units: list[Counter[bytes]] = [Counter() for _ in labels]
    for r in first.toLocalIterator():
        own = Counter(r["text"].split())
        for w, n in own.items():
            for u in units_of(w):
                units[at[r["lang"]]][u] += n
    net = ByteGru(labels)
    net.fit([Counter(dict(sorted(u.items()))) for u in units])
    return net


_SCORERS: dict[bytes, Scorer] = {}


def scorer_of(blob: bytes) -> Scorer:
    """One scorer a worker process and network."""
    if blob not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[blob] = Scorer(pickle.loads(blob))
    return _SCORERS[blob]


def predict(docs: DataFrame, net: ByteGru | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (`names`); every other column stays.

    `und` with score 0 where the text is null or has no letter, or where there is no network. Repeated rows and
    null ids keep their rows; an empty table stays empty. No shuffle; memory holds a batch and REMEMBERED words.
    """
    columns = [c for c in docs.columns if c not in names]
    blob = pickle.dumps(net)

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        scorer, got = scorer_of(blob) if net is not None else None, []
        for k in range(0, batch.num_rows, 512):
            part = batch[text].slice(k, 512)
            got += scorer.score([t.decode() for t in arrow_lines(part)]) if scorer else [(NO_LANGUAGE, 0.0)] * len(part)
        return None, [[g[0] for g in got], [g[1] for g in got]]

    return map_arrow(docs, columns, work, f"`{names[0]}` string, `{names[1]}` double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")
