"""How far the sources of a language differ in their use of terms: sketch-prefiltered exact counting.

1. Every task adds the document frequencies of its terms to a count-min sketch; sketches merge by adding. Counters stop at 255
   and never fall below the true frequency, so a term whose least counter is under the bound can't be frequent.
2. A second scan counts the terms that may be frequent, by language and source, within the task first; impossible ones are never
   shuffled. Exact frequencies then decide, so nothing depends on the sketch but how much is moved.
3. Divergences are sums over all kept terms of a language. Terms that two sources share meet in a join on the term; a term that a source lacks
   has one probability there, so the rest of the sum follows from how many terms have each count.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_lines, settle, table

LEAST_DOCS = 10
TOP = 10
ROWS, WIDTH = 4, 1 << 22  # counters of the sketch: ROWS * WIDTH bytes, whatever the corpus holds
SLICE = 1 << 14  # counters that merge together
SKETCH_TASKS = 2048  # sketches made, at most
HELD = 400_000  # terms that a task counts before it hands them on
UNIT = 1_000_000_000
# Letters of ASCII in lower case and all bytes of other characters stay, everything else parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: stretches of ASCII letters, in lower case, and of characters beyond ASCII."""
    return text.translate(FOLD).split()


class Sketch:
    """A count-min sketch of document frequencies by language and term."""

    def __init__(self, rows: int = ROWS, width: int = WIDTH, counters: np.ndarray | None = None):
        self.rows, self.width = rows, width
        self.counters = np.zeros(rows * width, np.uint8) if counters is None else counters

    def places(self, lang: str, found: list[bytes]) -> np.ndarray:
        """The counters of terms, a row for each row of the sketch."""
        h = pd.util.hash_array(np.array(found, object), categorize=False) ^ np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B1)
        out = np.empty((self.rows, len(found)), np.int64)
        for r in range(self.rows):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * r)
            out[r] = (h >> np.uint64(33)).astype(np.int64) % self.width + r * self.width
        return out

    def add(self, lang: str, counts: Counter) -> None:
        if not counts:
            return
        n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255)
        for places in self.places(lang, list(counts)):
            at, inverse = np.unique(places, return_inverse=True)
            sums = np.bincount(inverse, weights=n).astype(np.int64) + self.counters[at]
            self.counters[at] = np.minimum(sums, 255)

    def estimate(self, lang: str, found: list[bytes]) -> np.ndarray:
        """An upper bound of each term's frequency, 255 for any that is as large."""
        return self.counters[self.places(lang, found)].min(axis=0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    """lang, source and terms of each row."""
    for batch in batches:
        yield from zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), map(terms, arrow_lines(batch["text"])), strict=True)


def document_frequencies(rows: DataFrame, width: int = WIDTH) -> Sketch:
    """The merged sketch of the rows' terms (columns text, lang, source, no nulls).

    The driver gets ROWS * width bytes, a fixed bound. At most SKETCH_TASKS tasks make sketches, which merge slice by slice, as many at once
    as there are partitions; only slices in which a task counted anything are sent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = Sketch(width=width), defaultdict(Counter), 0
        for lang, _, found in _texts(batches):
            size -= len(held[lang])
            held[lang].update(set(found))
            size += len(held[lang])
            if size > HELD:
                for k, v in held.items():
                    sketch.add(k, v)
                held, size = defaultdict(Counter), 0
        for k, v in held.items():
            sketch.add(k, v)
        yield from _slices(sketch.counters)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counters in zip(batch["slice"].to_pylist(), batch["counters"], strict=True):
                got = np.frombuffer(zlib.decompress(counters.as_buffer()), np.uint8)
                old = sums.get(at)
                sums[at] = got if old is None else np.where(got > 255 - old, np.uint8(255), old + got)
        for at, counters in sums.items():
            yield _slice_rows([at], [zlib.compress(counters.tobytes(), 1)])

    schema = "slice int, counters binary"
    few = rows.coalesce(SKETCH_TASKS)
    merged = few.mapInArrow(count, schema).repartition("slice").mapInArrow(merge, schema)
    out = Sketch(width=width)
    for r in merged.collect():
        part = out.counters[r["slice"] * SLICE : (r["slice"] + 1) * SLICE]
        part[:] = np.frombuffer(zlib.decompress(r["counters"]), np.uint8)[: len(part)]
    return out


def _slice_rows(at: list[int], counters: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counters, pa.binary())], names=["slice", "counters"])


def _slices(counters: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = np.pad(counters, (0, -len(counters) % SLICE)).reshape(-1, SLICE)
    used = np.flatnonzero(parts.any(axis=1)).tolist()
    for k in range(0, len(used), 64):
        yield _slice_rows(used[k : k + 64], [zlib.compress(parts[i].tobytes(), 1) for i in used[k : k + 64]])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, width: int = WIDTH) -> DataFrame:
    """lang, source, term, n (occurrences) of the terms that stand in at least `least` rows of their language.

    Nulls count as empty strings. Every row is a document, also where rows repeat; other columns are not read. An empty table gives no counts.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(text).alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))
    sent = docs.sparkSession.sparkContext.broadcast(document_frequencies(rows, width).counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width=width, counters=sent.value)
        held, docs_, size = defaultdict(Counter), defaultdict(Counter), 0
        for lang_, source_, found in _texts(batches):
            key = (lang_, source_)
            size -= len(held[key])
            held[key].update(found)
            docs_[key].update(set(found))
            size += len(held[key])
            if size > HELD:
                yield from _counted(sketch, held, docs_, least)
                held, docs_, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from _counted(sketch, held, docs_, least)

    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    exact = settle(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term")
    return settle(exact.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-terms")


def _counted(sketch: Sketch, held: dict, docs: dict, least: int) -> Iterator[pa.RecordBatch]:
    """The counts of those terms that may be frequent."""
    for (lang, source), counts in held.items():
        if not counts:
            continue
        found = list(counts)
        use = np.flatnonzero(sketch.estimate(lang, found) >= least).tolist()
        in_docs = docs[lang, source]
        for k in range(0, len(use), 50_000):
            part = [found[i] for i in use[k : k + 50_000]]
            n = len(part)
            columns = [pa.array([lang] * n), pa.array([source] * n), pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64()), pa.array([in_docs[t] for t in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _probability(n: Column, total: str, kinds: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kinds)), exact for any count."""
    wide = lambda c: c.cast("decimal(19,0)")
    by = F.greatest(F.col(total) + 2 * F.col(kinds), F.lit(1))
    return 1 + _div(wide(n + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(by))


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: divergences between the sources of each language.

    p is 1 + floor(UNIT * (n + 2) / (N + 2 * V)) with n the term's count in the group, N the group's sum over kept terms and V the kept terms
    of the language; f = floor((p - q) ** 2 / (p + q)). Part `pair`: f summed over all V terms against every other source. Part `term`: the
    `top` terms that the group has, with p above the language's own. Values from large to small, then items by their UTF-8 bytes. Nulls count as
    empty strings, groups without terms take part, and a language without kept terms gives 0 to all its pairs.

    No text is shuffled, and terms only as counts of a task; hot sources, languages and terms are summed within tasks first. Results of part `pair` are
    as many as pairs of sources, and a shared term joins once for each pair of sources that have it.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = term_counts(docs, text, lang, source, least, width)
    groups = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    of_lang = settle(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")), "lang-terms")
    kinds = of_lang.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["total", "own", "kinds", "lang_total"])
    groups = settle(groups.withColumn("none", _probability(zero, "total", "kinds")), "groups")  # p of the terms it lacks
    known = counts.join(groups, ["lang", "source"]).withColumn("p", _probability(F.col("n"), "total", "kinds"))
    known = settle(known.select("lang", "source", "term", "n", "p", "none"), "term-probabilities")

    # All terms as if the other source had none of them, by the terms of each probability.
    tally = known.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_item"), F.col("own").alias("own_item"))
    alone = tally.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * _gap(F.col("p"), F.col("none_item"))).alias("one_sided"))
    # What shared terms add to that; f is symmetric, so one of two orders is enough.
    b = known.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("none_item"))
    more = _gap(F.col("p"), F.col("q")) - _gap(F.col("p"), F.col("none_item")) - _gap(F.col("none"), F.col("q")) + _gap(F.col("none"), F.col("none_item"))
    shared = known.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(more).alias("shared"))
    lacking = (F.col("kinds") - F.col("own") - F.col("own_item")) * _gap(F.col("none"), F.col("none_item"))
    half = groups.join(other, "lang").filter("source < item").withColumn("lacking", lacking).select("lang", "source", "item", "lacking")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one_sided").alias("back"))
    keys = ["lang", "source", "item"]
    half = half.join(alone, keys, "left").join(back, keys, "left").join(shared, keys, "left")
    total = F.col("lacking") + F.coalesce("one_sided", zero) + F.coalesce("back", zero) + F.coalesce("shared", zero)
    half = half.select(*keys, total.alias("value"))
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = [F.desc("value"), F.asc("item")]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)).alias("rank"))

    base = of_lang.join(kinds, "lang").select("lang", "term", _probability(F.col("n"), "lang_total", "kinds").alias("q"))
    best = known.join(base, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    best = _top(best, ["lang", "source"], order, top)
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


PARTS = 64


def _top(rows: DataFrame, key: list[str], order: list, top: int) -> DataFrame:
    """The first `top` rows of each key, with their rank: first of PARTS parts of a key by hash, then of what these leave."""
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS))
    place = lambda *k: F.row_number().over(W.partitionBy(*k).orderBy(*order))
    rows = rows.withColumn("__part", part)
    first = rows.withColumn("rank", place(*key, "__part")).filter(F.col("rank") <= top)
    return first.withColumn("rank", place(*key)).filter(F.col("rank") <= top).drop("__part")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources and their most telling terms."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
found as (select d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from found group by lang, term having count(distinct d) >= 10),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by all),
kinds as (select lang, count(*) as v from kept group by lang),
sums as (select lang, source, sum(n) as total from counts group by all),
dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v) as p
  from groups g join kept k using (lang) join kinds using (lang)
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join sums s on s.lang = g.lang and s.source = g.source),
whole as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (sum(sum(n)) over (partition by lang) + 2 * any_value(v)) as q
  from counts join kinds using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source as item, (select coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) from dense x join dense y using (lang, term)
  where x.lang = a.lang and x.source = a.source and y.source = b.source) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source),
best as (select d.lang, d.source, d.term as item, (d.p - w.q) * (d.p - w.q) // (d.p + w.q) as value
  from dense d join whole w using (lang, term) where d.n > 0 and d.p > w.q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from best) where rank <= 10)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""
