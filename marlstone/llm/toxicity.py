"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into symbols (insult, harm, target, negation, reported speech, intent, other). Five small
transducers work on the symbols: three mark what stands in the scope of a negation, of a reporting verb and of a
target before it; the insult transducer closes an insult by a target behind it, and the threat transducer makes a
threat of harm that is intended or whose target follows. Composed, they read a clause in one walk and emit matched
patterns such as a directed or a negated insult or a reported threat. A document's score comes from the matched
clauses: the lexical weights of each kind of pattern are summed, damped and weighted. The insult lexicon and the weights
of the kinds are learned from a bounded number of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_lines, held_out, lines, map_arrow, table

SAMPLE_ROWS = 12_000  # labelled rows read for training, at most: two thirds for the lexicon, the rest for the weights
LEAST_TEXTS, LEAST_ODDS = 4, 2.5  # different toxic texts with a learned insult, and its log odds

# Cue words in the languages of the corpus.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile idiota imbécil estúpido basura connard abruti crétin ordure trottel dummkopf abschaum widerlich".split()
HARMS = "kill hurt destroy burn beat shoot stab töte schlage tuer frapper matar golpear".split()
INTENTS = "will shall gonna going ll hope deserve deserves werde werden wirst wird vais va allons voy va vamos merece mérite".split()
TARGETS = "you your yours u he she they him her them du dich dir ihr euch tu toi vous te tú usted ustedes".split()
NEGATIONS = "not never no isn't aren't nicht kein keine ne pas jamais nunca".split()
REPORTS = "said says say called calls wrote writes claimed quoted reported sagte schrieb nannte disait écrit dijo escribió llamó".split()

WORD = re.compile(r"\w+(?:'t)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
KINDS = ("plain", "directed", "negated", "reported", "threat", "reported threat")
STEM = 5  # letters of a stem: learned insults are whole words or stems, written with a star
PRIOR = np.array([2.0, 3.0, 0.3, 0.6, 2.8, 0.9, -3.0])  # of the kinds and the constant, before any data
MORE = 0.5  # what a directed insult weighs beyond a plain one
NEGATED, REPORTED, TARGETED, CLOSED, THREAT = "~", '"', "!", "^", "t"  # marks on a symbol
SCOPES = {"negation": 2, "report": 8, "target": 4, "behind": 3, "intent": 4}  # symbols that each reaches


class Transducer:
    """A deterministic transducer: arcs[state, symbol] = (next state, output); other symbols pass in `default`."""

    def __init__(self, start, arcs: dict, symbols: set[str]):
        self.start, self.arcs, self.symbols = start, arcs, symbols

    def step(self, state, symbol: str):
        return self.arcs[state, symbol]

    @classmethod
    def scope(cls, opener: str, length: int, mark: str, marked: str, symbols: set[str]) -> Transducer:
        """Marks symbols that start with a letter of `marked` within `length` symbols after `opener`."""
        arcs, out = {}, set()
        for left in range(length + 1):
            for s in symbols:
                hit = left > 0 and s[0] in marked
                to = length if s == opener else max(0, left - 1)
                arcs[left, s] = (to, s + mark if hit else s)
                out.add(arcs[left, s][1])
        self = cls(0, arcs, symbols)
        self.outputs = out
        return self


    @classmethod
    def closing(cls, opener: str, length: int, symbols: set[str], intent: int = 0) -> Transducer:
        """An opener (with its marks) waits `length` symbols for a target, which then bears CLOSED or THREAT and its marks.

        With `intent` the opener is harm, and a threat at once within so many symbols after an intent.
        """
        done = THREAT if intent else CLOSED
        marks = sorted({s[1:] for s in symbols if s[0] == opener})
        states = [(i, left, m) for i in range(intent + 1) for left in range(length + 1) for m in (marks if left else [""])]
        arcs, out = {}, set()
        for i, left, m in states:
            for s in symbols:
                near = intent if s[0] == "f" and intent else max(0, i - 1)
                if s[0] == opener:
                    to, o = ((near, 0, ""), s + done) if i else ((near, length, s[1:]), s)
                elif s[0] == "y" and left:
                    to, o = (near, 0, ""), s + done + m
                else:
                    to, o = (near, left - 1, m if left > 1 else "") if left else (near, 0, ""), s
                arcs[(i, left, m), s] = (to, o)
                out.add(o)
        self = cls((0, 0, ""), arcs, symbols)
        self.outputs = out
        return self


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the outputs of `first` to `second`, over the states that can be reached."""
    start, arcs, todo = (first.start, second.start), {}, [(first.start, second.start)]
    seen, outputs = {start}, set()
    while todo:
        a, b = todo.pop()
        for s in first.symbols:
            to_a, mid = first.step(a, s)
            to_b, out = second.step(b, mid)
            arcs[(a, b), s] = ((to_a, to_b), out)
            outputs.add(out)
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                todo.append((to_a, to_b))
    made = Transducer(start, arcs, first.symbols)
    made.outputs = outputs
    return made


def grammar() -> Transducer:
    """Negation, reported speech and target before; then insults and threats, closed by a target behind them."""
    symbols = {"i", "h", "y", "n", "r", "f", "o"}
    made = Transducer.scope("n", SCOPES["negation"], NEGATED, "ih", symbols)
    made = compose(made, Transducer.scope("r", SCOPES["report"], REPORTED, "ih", made.outputs))
    made = compose(made, Transducer.scope("y", SCOPES["target"], TARGETED, "ih", made.outputs))
    made = compose(made, Transducer.closing("i", SCOPES["behind"], made.outputs))
    return compose(made, Transducer.closing("h", SCOPES["behind"], made.outputs, SCOPES["intent"]))


def kind_of(marks: str) -> str:
    """The kind of an insult with these marks."""
    return "negated" if NEGATED in marks else "reported" if REPORTED in marks else "directed" if TARGETED in marks or CLOSED in marks else "plain"


class Matcher:
    """Scores of the matched clauses of a text."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.weight = {w: 1.0 for w in (*INSULTS, *HARMS)} | lexicon
        self.symbol = {w: "f" for w in INTENTS} | {w: "r" for w in REPORTS} | {w: "n" for w in NEGATIONS} | {w: "y" for w in TARGETS} | {w: "h" for w in HARMS} | {w: "i" for w in lexicon} | {w: "i" for w in INSULTS}
        self.cues = frozenset(w for w, s in self.symbol.items() if s in "ih")
        self.stems = {w[:-1] for w in lexicon if w.endswith("*")}
        self.grammar, self.weights = grammar(), weights

    def _hits(self, words: list[str]) -> bool:
        return not self.cues.isdisjoint(words) or (bool(self.stems) and not self.stems.isdisjoint([w[:STEM] for w in words]))

    def _read(self, word: str) -> tuple[str, float]:
        """Symbol and lexical weight of a word: its own, or its stem's."""
        if word not in self.symbol and word[:STEM] in self.stems:
            word = word[:STEM] + "*"
        return self.symbol.get(word, "o"), self.weight.get(word, 0.0)

    def patterns(self, words: list[str]) -> list[tuple[str, float]]:
        """(kind, lexical weight) of each pattern that the grammar matches in a clause's words."""
        state, out = self.grammar.start, []
        insult = harm = 0  # places in out of the last insult and weight of the last harm
        for w in words:
            symbol, weight = self._read(w)
            state, o = self.grammar.step(state, symbol)
            threat: str | None = None
            if o[0] == "i":
                insult = len(out)
                out.append((kind_of(o), weight))
            elif o[0] == "h":
                harm = weight
                if o.endswith(THREAT):
                    threat = o
            elif o[0] == "y":
                head, _, marks = o.partition(THREAT)
                if CLOSED in head:
                    out[insult] = (kind_of(head), out[insult][1])
                if THREAT in o:
                    threat = marks
            if threat is not None and NEGATED not in threat:
                out.append(("reported threat" if REPORTED in threat else "threat", harm))
        return out

    def features(self, text: str) -> np.ndarray:
        """Damped sum of the lexical weights of each kind of matched pattern, over the whole text."""
        sums = dict.fromkeys(KINDS, 0.0)
        low = text.lower()
        if self._hits(WORD.findall(low)):
            for clause in CLAUSE.split(low):
                words = WORD.findall(clause)
                if not self._hits(words):
                    continue
                for kind, weight in self.patterns(words):
                    sums[kind] += weight
        return np.log1p(np.array([sums[k] for k in KINDS]))

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def in_order(w: np.ndarray) -> np.ndarray:
    """Weights by what a clause says: negated and reported insults at most as much as plain ones, directed ones more, threats at least as much as these.

    One threat alone reaches an even score, whatever the constant. A single word never counts more than a clause that aims at somebody.
    """
    w = w.copy()
    plain, directed, negated, reported, threat, told, constant = range(7)
    w[plain] = max(w[plain], 0.0)
    w[[negated, reported]] = np.minimum(w[[negated, reported]], w[plain])
    w[directed] = max(w[directed], w[plain] + MORE)
    w[threat] = max(w[threat], w[directed], -w[constant] / math.log(2))
    w[told] = min(w[told], w[directed])
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR, then put in order."""
    if not len(y):
        return in_order(PRIOR)
    x = np.column_stack([x, np.ones(len(x))])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return in_order(w)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Matcher:
    """A matcher from at most sample_rows labelled rows of the training part (those first by a hash).

    A word's texts are counted by the three least hashes of their words, so that near copies of one text count once.
    The lexicon holds every word and stem that passes, and so no more than the vocabulary of the sample.
    Without labels the fixed cue words and the prior weights stand.
    """
    rows = labels.filter(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "toxic").limit(sample_rows))
    own = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).join(sample, "doc_id")
    own = own.withColumn("third", F.pmod(F.xxhash64("text"), F.lit(3)))
    words = own.filter("third > 0").select("toxic", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("words"))
    words = words.withColumn("text_key", F.xxhash64(F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, 3)))
    totals = words.groupBy("toxic").agg(F.countDistinct("text_key").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in totals}
    lexicon: dict[str, float] = {}
    if n.get(1) and n.get(0):
        each = words.select("toxic", "text_key", F.explode(F.array_distinct(F.concat("words", F.transform("words", lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))))).alias("word")).groupBy("word").agg(
            F.countDistinct(F.when(F.col("toxic") == 1, F.col("text_key"))).alias("t"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("text_key"))).alias("c")
        )
        odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
        top = each.filter(F.col("t") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
        lexicon = {r["word"]: min(2.0, r["odds"] / 4) for r in top.select("word", "odds").collect()}
    matcher = Matcher(lexicon, PRIOR)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [matcher.features(t).tolist() for t in lines(batch["text"])]
            yield pd.DataFrame({"toxic": batch["toxic"], "x": got})

    # Copies teach once.
    rest = own.filter("third = 0").select("toxic", "text").dropDuplicates().mapInPandas(features, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rest]).reshape(len(rest), len(KINDS))
    matcher.weights = fit_weights(x, np.array([float(r["toxic"]) for r in rest]))
    return matcher


def predict(docs: DataFrame, matcher: Matcher, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted; every other column stays, none of them is looked at.

    Null and empty texts get the score of a text without a match; repeated rows stay; an empty table stays
    empty. No shuffle; the matcher is bounded by the sample's vocabulary.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted")]

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        scores = [matcher.score(t.decode()) for t in arrow_lines(batch[text])]
        return None, [scores, [int(s >= 0.5) for s in scores]]

    return map_arrow(docs, columns, work, "score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    matcher = train(docs, table(spark, sf_dir, "labels"))
    return predict(docs.withColumn("held_out", held_out()), matcher).select("doc_id", "held_out", "score", "predicted")
