"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Each distinct five-word shingle is an element of weight one, however often it occurs, as in the check of candidates. An element throws
darts that depend on its hash alone into the plane of weight and rank, cell by cell, one a cell on
average; a text sees those darts that lie below its element's weight and below a rank bound that leaves a few
hundred darts whatever its length. Every dart has a coordinate; the earliest dart of each coordinate is the signature. Equal coordinates
occur with the weighted Jaccard similarity of two texts, which at equal weights is that of their shingle sets.

Bands of the signature are joined, and candidates are verified by the exact Jaccard similarity of their shingle sets.
Equal texts are one node. A bucket of few nodes gives all its pairs. A larger one is tied to its most central member, and
members which the links so far do not join to that one's component meet all other members in blocks: no bucket is
capped, and no pair within a component already joined is written out. Only texts of nodes with candidates are moved, and a node
with many candidates goes with them in blocks, so that its text is copied once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_lines, connected, map_arrow, no_id, plain_id, settle, table
from .shingles import jaccard, mix, shingles
from .sieve import passing, sieve_of

COORDINATES, ROWS = 64, 4  # coordinates of a signature, rows of a band: 16 bands
SIMILAR = 0.8
SMALL = 16  # nodes of a bucket whose pairs are all written out
BLOCK = 256  # candidates of a node that a task verifies at a time
BLOCK_BYTES = 8_000_000  # of text, about, of a large group that a task compares with as much other
REMEMBERED = 50_000  # texts whose bands a worker keeps, so that copies are signed once a worker
_U = np.uint64


def _poisson_steps() -> np.ndarray:
    """Cumulative chances of 0, 1, 2 ... darts in a cell of area one."""
    p, out = np.exp(-1.0), []
    for k in range(1, 20):
        out.append(p + (out[-1] if out else 0.0))
        p /= k
    return np.array(out)


STEPS = _poisson_steps()


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The k earliest darts (64-bit values) of a weighted set; empty for an empty set."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    bound = k * (np.log(k) + 3) / float(weights.sum())
    high = np.ceil(weights).astype(np.int64)
    who = np.repeat(np.arange(len(elements)), high)
    cell_weight = np.arange(len(who)) - np.repeat(np.cumsum(high) - high, high)
    column = mix(elements[who] + cell_weight.astype(np.uint64) * _U(0xA24BAED4963EE407))
    while True:
        strips = int(np.ceil(bound))
        cells = mix(column[:, None] + (np.arange(1, strips + 1, dtype=np.uint64) * _U(0x9FB21C651E98DF25))[None, :]).ravel()
        count = np.searchsorted(STEPS, (cells >> _U(11)).astype(np.float64) * 2.0**-53)
        at = np.repeat(np.arange(len(cells)), count)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        darts = mix(cells[at] + (turn.astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
        place, strip = at // strips, at % strips
        rank = strip + (darts >> _U(40)).astype(np.float64) * 2.0**-24
        weight = cell_weight[place] + ((darts >> _U(16)) & _U(0xFFFFFF)).astype(np.float64) * 2.0**-24
        hit = np.flatnonzero((rank < bound) & (weight < weights[who[place]]))
        hit = hit[np.argsort(-rank[hit], kind="stable")]
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        coordinate = ((darts[hit] & _U(0xFFFF)) % _U(k)).astype(np.int64)
        out[coordinate], filled[coordinate] = darts[hit], True  # the last written is the earliest
        if filled.all():
            return out
        bound *= 1.5


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, different for equal content in different bands."""
    if not len(signature):
        return np.zeros(0, np.int64)
    parts = signature.reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + parts[:, j])
    return key.view(np.int64)


def text_bands(text: str) -> np.ndarray:
    """Band keys of a text; none for a text without words."""
    elements = shingles(text)[0]
    return band_keys(dart_signature(elements, np.ones(len(elements))))


def _text_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first_id, bands: one row per distinct text, by its MD5 (null as empty), with its smallest id."""

    known: dict[bytes, np.ndarray] = {}  # each task has its own

    def work(batch: pa.RecordBatch) -> tuple[None, list]:
        bands = []
        for key, t in zip(batch["key"].to_pylist(), arrow_lines(batch["text"]), strict=True):
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = text_bands(t.decode())
            bands.append(known[key])
        return None, [bands]

    rows = docs.select(_text_key(text).alias("key"), plain_id(docs, doc_id).alias("id"), F.col(text).alias("text"))
    signed = map_arrow(rows, ["key", "id"], work, "bands array<long>")
    return signed.groupBy("key").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"))


def bucket_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b to verify; members bucket, key, hub of the larger buckets) from key, bands."""
    members = nodes.select(F.explode("bands").alias("bucket"), "key")
    # Aggregates are settled before they are joined back: the join then stands alone and a hot bucket can be split.
    sizes = settle(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = settle(members.join(sizes, "bucket"), "buckets")
    few = shared.filter(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("key")).alias("own"))
    pair = F.flatten(
        F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    close = few.select(F.inline(pair))
    # In a large bucket the member that shares most buckets with most others is the hub: texts copied often are that.
    many = shared.filter(F.col("n") > SMALL)
    central = many.groupBy("key").agg(F.sum("n").alias("met"))
    hubs = settle(many.join(central, "key").groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("top")).select("bucket", F.col("top.key").alias("hub")), "hubs")
    large = settle(many.select("bucket", "key").join(hubs, "bucket"), "large")
    star = large.filter("key <> hub").select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b"))
    return close.union(star).distinct(), large


def texts_of(keys: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, text for the given keys: one text per node, fetched by its id and key, so a text with many copies moves once.

    A sieve of the wanted rows keeps nearly all other texts where they are.
    """
    none = no_id(docs, doc_id)
    mark = F.xxhash64("key", "id")
    wanted = settle(keys.distinct().join(nodes.select("key", F.coalesce("first_id", none).alias("id")), "key").withColumn("mark", mark), "wanted")
    rows = docs.select(_text_key(text).alias("key"), F.coalesce(plain_id(docs, doc_id), none).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", mark)
    some = passing(rows, "mark", sieve_of(wanted, "mark"))
    return settle(some.join(wanted.select("key", "id").hint("shuffle_hash"), ["key", "id"]).dropDuplicates(["key"]).select("key", "text"), "texts")


def verify(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs a, b whose shingle sets have a Jaccard similarity of at least `similar`.

    The end of a pair that stands in more pairs takes the others with it, about BLOCK at a time: its text is copied once a
    block, and no task gets all candidates of one node.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    known = pairs.join(ends.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    led = known.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("key"), F.greatest("na", "nb").alias("n"))
    led = settle(led.withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int")).drop("n"), "led")
    ends_ = led.select("lead", "part", F.col("lead").alias("key")).distinct().withColumn("turn", F.lit(0))
    rows = led.select("lead", "part", "key", F.lit(1).alias("turn")).unionByName(ends_).join(texts, "key")
    dealt = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "turn", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for lead, key, turn, t in zip(batch["lead"], batch["key"], batch["turn"], batch["text"], strict=True):
                if turn == 0:
                    own = shingles(t)[0]
                elif jaccard(own, shingles(t)[0]) >= similar:
                    out.append((lead, key))
            yield pd.DataFrame(out, columns=["a", "b"])

    return dealt.mapInPandas(run, "a binary, b binary")


def link_apart(members: DataFrame, apart: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links a, b between nodes of different labels in a group: every node of `apart` against every one of `members`.

    members, apart: grp, key, label. Both are cut into blocks of about BLOCK_BYTES of text; a task compares two blocks and
    gives, for each node apart, one link to each other label that it reaches, never all pairs. A text is copied once for each
    block that its own meets, which is its group's text by BLOCK_BYTES.
    """
    sized = texts.select("key", (F.octet_length("text") + 64).alias("bytes"))
    blocks = lambda df, name: df.join(sized, "key").groupBy("grp").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias(name))
    sizes = blocks(members, "mb").join(blocks(apart, "ab"), "grp")
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = apart.join(sizes, "grp").select("grp", "key", "label", F.lit(True).alias("asks"), part("ab").alias("p"), every("mb").alias("q"))
    right = members.join(sizes, "grp").select("grp", "key", "label", F.lit(False).alias("asks"), every("ab").alias("p"), part("mb").alias("q"))
    both = left.unionByName(right).join(texts, "key")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["asks"].to_numpy()
        there, here = pdf[~ask], pdf[ask]
        out: list[tuple[bytes, bytes]] = []
        if len(there) and len(here):
            own = [shingles(t)[0] for t in there["text"]]
            sizes_ = np.array([len(x) for x in own])
            filled = np.flatnonzero(sizes_)
            labels, keys = there["label"].tolist(), there["key"].tolist()
            if len(filled):
                # Members by their number of shingles: a text meets only those whose number allows the similarity.
                filled = filled[np.argsort(sizes_[filled], kind="stable")]
                size = sizes_[filled]
                values, place = np.unique(np.concatenate([own[i] for i in filled]), return_inverse=True)
                upto = np.concatenate([[0], np.cumsum(size)])
                flag = np.zeros(len(values), np.int64)
                for key, label, text in zip(here["key"], here["label"], here["text"], strict=True):
                    mine = shingles(text)[0]
                    first, last = np.searchsorted(size, [len(mine) * similar * (1 - 1e-9), len(mine) / similar * (1 + 1e-9)], "left")
                    if first == last:
                        continue
                    at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                    at = at[values[at] == mine]
                    flag[at] = 1
                    both_ = np.add.reduceat(flag[place[upto[first] : upto[last]]], upto[first:last] - upto[first])
                    flag[at] = 0
                    near = filled[first:last][both_ >= similar * (size[first:last] + len(mine) - both_)]
                    out += [(key, k) for k in {labels[i]: keys[i] for i in near.tolist() if labels[i] != label}.values()]
        return pd.DataFrame(out, columns=["a", "b"])

    return both.groupBy("grp", "p", "q").applyInPandas(compare, "a binary, b binary")


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first_id, class_key, class_id of every distinct text; see near_duplicates."""
    nodes = settle(classes(docs, doc_id, text), "nodes")
    pairs, large = bucket_pairs(nodes)
    pairs = settle(pairs, "pairs")
    links = settle(verify(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), nodes, docs, doc_id, text)), "links")
    labels = connected(links)
    # Members of a large bucket outside its hub's component meet all other members of the buckets of that component.
    own = labels.withColumnRenamed("node", "key")
    named = large.join(own, "key", "left").join(labels.select(F.col("node").alias("hub"), F.col("label").alias("grp")), "hub", "left")
    named = settle(named.select(F.coalesce("grp", "hub").alias("grp"), "key", F.coalesce("label", "key").alias("label")).distinct(), "named")
    apart = named.filter("label <> grp")
    if not apart.isEmpty():
        members = named.join(apart.select("grp").distinct(), "grp", "left_semi")
        more = settle(link_apart(members, apart, texts_of(members.select("key"), nodes, docs, doc_id, text)), "more")
        if not more.isEmpty():
            labels = connected(links.union(more))
    marked = nodes.select("key", "first_id").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("class_key", F.coalesce("label", "key"))
    named_class = marked.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    return settle(marked.select("key", "first_id", "class_key").join(named_class, "class_key"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, class_key for every row of docs.

    Two texts are linked if they are equal or if their five-word shingle sets (words in lower case; a shorter text
    has one shingle) have a Jaccard similarity of 0.8 or more; a class is a connected component, class_id its smallest
    id, class_key the smallest text digest in it. Texts without words link to equal texts only. Null text counts as
    empty, null ids do not name a class (class_id is null if a class has no other); ids that are no whole numbers compare
    as strings, where null stands with the empty one; repeated rows keep their rows; other
    columns are not used; an empty table gives an empty result.
    """
    of_key = text_classes(docs, doc_id, text).select("key", "class_id", "class_key")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_key(text).alias("key"))
    return rows.join(of_key, "key").select("doc_id", "class_id", F.lower(F.hex("class_key")).alias("class_key"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with only one of each class: that of the smallest id (then the smallest text digest), all columns kept.

    Cases as for near_duplicates; of repeated rows one stays; in a class without any id the row of its first text stays.
    """
    none = no_id(docs, doc_id)
    of_key = text_classes(docs, doc_id, text).withColumn("__id", F.coalesce("first_id", none))
    chosen = of_key.groupBy("class_key").agg(F.min(F.struct(F.col("first_id").isNull(), "__id", "key")).alias("m")).select(F.col("m.key").alias("__key"), F.col("m.__id").alias("__id"))
    rows = docs.withColumns({"__key": _text_key(text), "__id": F.coalesce(plain_id(docs, doc_id), none)})
    kept = rows.join(chosen.hint("shuffle_hash"), ["__key", "__id"], "left_semi")
    # Rows that repeat both id and text are rare: only they are gathered by key.
    twice = settle(rows.groupBy("__key", "__id").count().filter("count > 1").select("__key", "__id"), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice, ["__key", "__id"], "left_anti")
    return once.unionByName(kept.join(twice, ["__key", "__id"], "left_semi").dropDuplicates(["__key", "__id"])).select(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")
