"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The word n-grams of the test items are counted over the whole corpus. In every stretch of consecutive n-grams of an item the
rarest one is a seed, so an item has seeds however common its words are, and any copied run of words
longer than a stretch holds one. A document that contains a seed is aligned with the item around the place where the seed
says it should lie; the score is the local alignment's share of a full copy's, so that edits, insertions and gaps lower it
without losing the match. Long items are aligned in overlapping passages.

One scan of the documents counts the n-grams of all items, sifted by a bit table of bounded size; seeds are chosen by windows over
the items' own n-grams. The items then go to the documents, in blocks of bounded size; documents are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_lines, lines, map_arrow, settle, table
from .shingles import blocks_of, grams, words, words_of_all
from .sieve import Sieve, bits_for, sieve_of

GRAM = 3  # words of a seed
STRETCH = 2  # consecutive n-grams of which the rarest is a seed: a run of 4 unchanged words always holds one
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5  # share of a full copy's alignment score from which a document is contaminated
LEAST_WORDS = 6  # a match is worth so many matched words at least, or all words of a shorter item
PASSAGE = 200  # words of an item that are aligned at a time; longer ones are cut into passages that overlap by half
ITEM_BLOCK_BYTES = 16_000_000  # of item text that tasks hold at a time


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (best score, first and last matched word of the passage).

    Two rows are held. A cell is its score in the high half of an integer and the place where its path began in the low one.
    """
    n = len(passage)
    unit, low = 1 << 32, (1 << 32) - 1
    fresh = np.arange(n + 1)  # a path of score 0 that begins here
    slide = fresh * (GAP * unit)
    row, best, where = fresh.copy(), 0, (0, 0)
    now = np.empty(n + 1, np.int64)
    for w in item:
        now[0] = 0
        now[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH * unit, MISMATCH * unit), row[1:] + GAP * unit)
        np.maximum(now, fresh, out=now)
        # A gap in the item: the best of what stands left, less the way.
        row = np.maximum(np.maximum.accumulate(now - slide) + slide, fresh)
        at = int(row.argmax())
        if (top := int(row[at]) >> 32) > best:
            best, where = top, (int(row[at]) & low, at)
    return best, *where


def enough(score: float, n: int, least: float) -> bool:
    """Whether a share of a full copy's score means that a text contains an item of n words."""
    return score >= max(least, min(1.0, LEAST_WORDS / n))


def passages(own: np.ndarray) -> list[np.ndarray]:
    """An item's words, cut where they are more than PASSAGE; the last passage is as long as the others."""
    if len(own) <= PASSAGE:
        return [own]
    starts = [*range(0, len(own) - PASSAGE, PASSAGE // 2), len(own) - PASSAGE]
    return [own[s : s + PASSAGE] for s in starts]


def sifted(texts: list[str], sieve: Sieve) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, its word hashes, places of n-grams that pass the sieve, those n-grams) for texts that hold any."""
    for at, block in blocks_of(texts):
        hashes, begins = words_of_all(block)
        every = grams(hashes, GRAM)
        maybe = np.flatnonzero(sieve.holds(every))
        # An n-gram belongs to the text of its first word and must end in it.
        owner = np.searchsorted(begins, maybe, "right") - 1
        whole = maybe + GRAM <= begins[np.minimum(owner + 1, len(begins) - 1)]
        maybe, owner = maybe[whole], owner[whole]
        cut = np.flatnonzero(np.diff(owner)) + 1
        for own in np.split(maybe, cut) if len(maybe) else []:
            k = int(np.searchsorted(begins, own[0], "right")) - 1
            yield at + k, hashes[begins[k] : begins[k + 1]], own - begins[k], every[own]
        # Texts shorter than an n-gram have one gram of all their words.
        short = np.flatnonzero((np.diff(begins) < GRAM) & (np.diff(begins) > 0))
        for k in short.tolist():
            own = hashes[begins[k] : begins[k + 1]]
            gram = grams(own, GRAM)
            if sieve.holds(gram)[0]:
                yield at + k, own, np.zeros(1, np.int64), gram


class Items:
    """Passages of the items of a block: ids, word hashes and seeds."""

    def __init__(self, rows: list[tuple[object, bytes, list[int]]]):
        self.ids = [r[0] for r in rows]
        self.words = [np.frombuffer(r[1], np.uint64) for r in rows]
        seeds = sorted((int(g[p]), k, p) for k, (r, g) in enumerate(zip(rows, [grams(w, GRAM) for w in self.words], strict=True)) for p in r[2])
        self.seed = np.array([s[0] for s in seeds], np.uint64)
        self.seed_item, self.seed_at = np.array([s[1] for s in seeds], np.int64), np.array([s[2] for s in seeds], np.int64)
        self.sieve = Sieve(bits_for(len(seeds)))
        self.sieve.add(np.unique(self.seed))

    def matches(self, texts: list[str], least: float) -> Iterator[tuple[int, object, float, int, int]]:
        """(text, item id, score, first and last word of the text) for each item that a text contains well enough."""
        if not len(self.seed):
            return
        for t, own, places, found in sifted(texts, self.sieve):
            first, last = np.searchsorted(self.seed, found, "left"), np.searchsorted(self.seed, found, "right")
            n = last - first
            at = np.repeat(places, n)
            seed = np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            item, begin = self.seed_item[seed], at - self.seed_at[seed]
            best: dict[object, tuple[float, int, int]] = {}
            for k in np.unique(item).tolist():
                target = self.words[k]
                slack = len(target) // 2 + 4
                # Seeds that want the passage at about one place are one region.
                starts = np.unique(begin[item == k])
                for region in np.split(starts, np.flatnonzero(np.diff(starts) > slack) + 1):
                    low, high = max(0, int(region[0]) - slack), min(len(own), int(region[-1]) + len(target) + slack)
                    score, a, b = align(target, own[low:high])
                    share = score / (MATCH * len(target))
                    if enough(share, len(target), least):
                        best[self.ids[k]] = max(best.get(self.ids[k], (0.0, 0, 0)), (share, low + a, low + b), key=lambda x: x[0])
            for i, b in best.items():
                yield (t, i, *b)


def item_passages(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """row (one number an item's row), id, part, words (64-bit hashes as bytes) of every passage of every item with words."""

    def cut(batch: pa.RecordBatch) -> tuple[list[int], list]:
        out = [(at, k, p.tobytes()) for at, t in enumerate(arrow_lines(batch["text"])) for k, p in enumerate(passages(words(t.decode())[0])) if len(p)]
        return [x[0] for x in out], [[x[1] for x in out], [x[2] for x in out]]

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    return settle(map_arrow(rows, ["row", "id"], cut, "part int, words binary"), "passages")


def gram_counts(docs: DataFrame, text: str, own: DataFrame) -> DataFrame:
    """gram, df: the number of rows of docs that hold each n-gram of own(gram) that any holds, from one scan of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(own, "gram"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [np.unique(found) for _, _, _, found in sifted(lines(batch["text"]), sent.value)]
            gram, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"gram": gram.view(np.int64), "n": n})

    told = docs.select(F.col(text).alias("text")).mapInPandas(count, "gram long, n long")
    return told.groupBy("gram").agg(F.sum("n").alias("df")).join(own.select("gram").distinct(), "gram", "left_semi")


def seeded(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """id, words, seeds (places of seed n-grams) of every passage: in every stretch the n-gram in the fewest documents, the first of equals."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, k, w in zip(batch["row"], batch["part"], batch["words"], strict=True):
                own = grams(np.frombuffer(w, np.uint64), GRAM)
                yield pd.DataFrame({"row": r, "part": k, "place": np.arange(len(own), dtype=np.int32), "gram": own.view(np.int64)})

    cut = item_passages(items, item_id, item_text)
    own = settle(cut.select("row", "part", "words").mapInPandas(take, "row long, part int, place int, gram long"), "grams")
    counts = settle(gram_counts(docs, text, own), "counts")
    rated = own.join(counts, "gram", "left").select("row", "part", "place", F.coalesce("df", F.lit(0)).alias("df"))
    key = W.partitionBy("row", "part")
    ahead = key.orderBy("place").rowsBetween(0, STRETCH - 1)
    least = rated.withColumn("n", F.count("*").over(key)).withColumn("seed", F.min(F.struct("df", "place")).over(ahead)["place"])
    seeds = least.filter(F.col("place") <= F.greatest(F.lit(0), F.col("n") - STRETCH)).groupBy("row", "part").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
    return settle(cut.join(seeds, ["row", "part"]), "seeded")


def chosen_items(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator:
    """A broadcast of each block of passages with their seeds: block_bytes of item text, about, in each."""
    ready_ = seeded(docs, text, items, item_id, item_text)
    size = ready_.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size == 0:
        return
    blocks = -(-size // block_bytes)  # a word hash takes about as many bytes as a word
    for k in range(blocks):
        part = ready_ if blocks == 1 else ready_.filter(F.pmod(F.xxhash64("row", "part"), F.lit(blocks)) == k)
        rows = [(r["id"], bytes(r["words"]), r["seeds"]) for r in part.orderBy("row", "part").collect()]
        yield docs.sparkSession.sparkContext.broadcast(Items(rows))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", score: float = SCORE, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: the test items that each document contains.

    Score is the best local alignment of the item with the document divided by that of a full copy (1.0); a document
    contains an item from `score` on, and where the match is worth LEAST_WORDS matched words, or a whole item of fewer. Items
    of more than PASSAGE words count as passages of that length, and the best one is told, so that an excerpt of a long item
    is found. Items of fewer than GRAM words match only texts of just these words. Words compare in
    lower case, without punctuation. Null texts and items and those without words never match; null ids keep their
    matches; repeated rows match each by itself; items of equal text match each; an empty table gives an empty result; other
    columns are not used. Whole texts are searched.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, added = dict(docs.dtypes)[doc_id], f"item_id {dict(items.dtypes)[item_id]}, score double, first_word int, last_word int"
    out = None
    for chosen in chosen_items(rows, "text", items, item_id, item_text, block_bytes):

        def search(batch: pa.RecordBatch, chosen=chosen) -> tuple[list[int], list]:
            found = list(chosen.value.matches([t.decode() for t in arrow_lines(batch["text"])], score))
            return [m[0] for m in found], [[m[k] for m in found] for k in range(1, 5)]

        part = map_arrow(rows, ["doc_id"], search, added)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, {added}")


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", score: float = SCORE, block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """The rows of docs that contain no test item, all columns kept; cases as for contaminated."""
    out = docs
    for chosen in chosen_items(docs, text, items, item_id, item_text, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], chosen=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = {m[0] for m in chosen.value.matches([t.decode() for t in arrow_lines(batch[text])], score)}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it contains."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items)
