"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of one size are a run. Best fit decreasing takes runs from the largest size down, and as long as a bin has room for one more
group of a run it stays the tightest bin that has, so a run fills bins one after another and is packed as a whole: the result is that
of packing its groups one by one. The driver packs the table of sizes and their counts, never groups; Spark hands each
group its bin by its place within its run. Distinct sizes are at most the square root of twice all bytes, for 1 + 2 + ... + k groups' bytes are k (k + 1) / 2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table

SHARDS = 40
PARTS = 256  # by hash, of groups of one size and of the rows of a shard, that are numbered apart
BROADCAST_RUNS = 200_000  # sizes and bins that are sent to all tasks at most; a longer list is joined by size


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


def _height(node: _Node | None) -> int:
    return node.height if node else 0


def _raised(node: _Node) -> _Node:
    node.height = 1 + max(_height(node.left), _height(node.right))
    return node


def _turned(node: _Node, to_left: bool) -> _Node:
    """The subtree with its heavier child on top."""
    if to_left:
        top = node.right
        node.right, top.left = top.left, node
    else:
        top = node.left
        node.left, top.right = top.right, node
    _raised(node)
    return _raised(top)


def _balanced(node: _Node) -> _Node:
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _turned(node.left, True)
        return _turned(node, False)
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _turned(node.right, False)
        return _turned(node, True)
    return _raised(node)


def _with(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _with(node.left, key)
    else:
        node.right = _with(node.right, key)
    return _balanced(node)


def _without(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key < node.key:
        node.left = _without(node.left, key)
    elif key > node.key:
        node.right = _without(node.right, key)
    elif node.left is None or node.right is None:
        return node.left or node.right
    else:
        least = node.right
        while least.left:
            least = least.left
        node.key, node.right = least.key, _without(node.right, least.key)
    return _balanced(node)


class OpenBins:
    """Bins in a height-balanced tree by remaining capacity, then number."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, room: int, number: int) -> None:
        self.root = _with(self.root, (room, number))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """(room, number) of the bin with the least room for an item of this size, taken out; None where nothing fits."""
        node, found = self.root, None
        while node:
            if node.key[0] >= size:
                node, found = node.left, node.key
            else:
                node = node.right
        if found:
            self.root = _without(self.root, found)
        return found


Runs = list[tuple[int, int]]  # (size, groups of it), sizes falling
Cuts = list[tuple[int, list[tuple[int, int]]]]  # (size, (groups of the run up to here, bin) in order)


def pack(runs: Runs, capacity: int, bins: int | None) -> Cuts | None:
    """Best fit decreasing into `bins` bins, or None where they don't hold all; without a number, bins open as needed.

    There, a group above the capacity has a bin of its own. Sizes are 1 or more.
    """
    tree, opened, out = OpenBins(), 0, []
    if bins is not None:
        for opened in range(bins):
            tree.add(capacity, opened)
    for size, count in runs:
        done, cuts = 0, []
        while done < count:
            if (found := tree.take_tightest(size)) is None:
                if bins is not None:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, number = found
            n = min(count - done, room // size)
            done += n
            cuts.append((done, number))
            if room > n * size:
                tree.add(room - n * size, number)
        out.append((size, cuts))
    return out


def least_capacity(runs: Runs, bins: int) -> Cuts:
    """The packing at the least common capacity (to one part in 4096) at which `bins` bins hold all groups."""
    if not runs:
        return []
    low = max(-(-sum(s * n for s, n in runs) // bins), runs[0][0])
    high, best = low, pack(runs, low, bins)
    while best is None:
        high += max(1, high // 1024)
        best = pack(runs, high, bins)
    while high - low > max(1, low // 4096):
        mid = (low + high) // 2
        if (tried := pack(runs, mid, bins)) is None:
            low = mid
        else:
            high, best = mid, tried
    return best


def _within(cut: str) -> Column:
    """Groups of parts before a row's own: running counts less the own one, by __cut."""
    return F.sum("__in").over(W.partitionBy(cut).orderBy("__cut").rowsBetween(W.unboundedPreceding, 0)) - F.col("__in")


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with gapless 0-based places `name` within each key, in no more than a part of a key at a time.

    A key is cut into PARTS by a hash of `order`, whose values must tell the rows of a key apart or be alike in all that
    counts; a part begins where those before it end.
    """
    cut = rows.withColumn("__cut", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    starts = cut.groupBy(key, "__cut").agg(F.count("*").alias("__in")).withColumn("__start", _within(key)).drop("__in")
    place = F.row_number().over(W.partitionBy(key, "__cut").orderBy(*order)) - 1
    return cut.withColumn("__n", place).join(starts, [key, "__cut"]).withColumn(name, (F.col("__start") + F.col("__n")).cast("long")).drop("__cut", "__n", "__start")


def shard_groups(docs: DataFrame, group: list[str], size: str, shards: int | None = SHARDS, capacity: int | None = None, shard: str = "shard") -> DataFrame:
    """docs with the shard of each row; rows whose `group` columns are equal share a shard.

    With `shards`, that many shards of the least capacity that holds all groups; with `capacity` alone, the fewest shards of
    it that best fit decreasing needs, and a group above the capacity has one of its own. Groups are never split. Null sizes
    and those below 1 count 1 towards a group, null group columns are values like others. An empty table stays empty;
    other columns stay. Groups of one size are told apart by their columns alone, so the result is a function of the rows.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("either shards or capacity")
    spark = docs.sparkSession
    keys = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    names = [f"__g{i}" for i in range(len(group))]
    sums = settle(docs.groupBy(*keys).agg(F.sum(F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1))).cast("long").alias("__bytes")), "groups")
    tally = sums.groupBy("__bytes").agg(F.count("*").alias("n")).orderBy(F.desc("__bytes"))
    runs: Runs = [(r["__bytes"], r["n"]) for r in tally.collect()]
    cuts = least_capacity(runs, shards) if shards else pack(runs, capacity, None)
    # A run that fills no more than one bin needs no places: only the others are numbered.
    whole = spark.createDataFrame([(s, c[0][1]) for s, c in cuts if len(c) == 1], "__bytes long, __bin int")
    split = spark.createDataFrame([(s, [{"upto": u, "bin": b} for u, b in c]) for s, c in cuts if len(c) > 1], "__bytes long, __cuts array<struct<upto:long,bin:int>>")
    near = F.broadcast if len(cuts) <= BROADCAST_RUNS else (lambda df: df)
    one = sums.join(near(whole), "__bytes").select(*names, F.col("__bin").alias(shard))
    many = numbered(sums.join(near(split), "__bytes"), "__bytes", names, "__place")
    many = many.select(*names, F.filter("__cuts", lambda c: F.col("__place") < c["upto"])[0]["bin"].alias(shard))
    placed = one.unionByName(many)
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    on = same[0]
    for more in same[1:]:
        on = on & more
    columns = [c for c in docs.columns if c != shard]
    return docs.select(*columns).join(placed, on).select(*columns, shard)


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, by the law `bytes`.

    Size is the text's UTF-8 bytes (none for null) plus 16. Equal texts stay together; null counts as empty. Null ids, repeated
    rows and empty texts keep their rows, slots of equal rows are dealt among them; other columns are not carried; an empty
    table gives an empty result. Slots follow from the rows alone, whatever the session's settings. Texts never move.
    """
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_bytes) + 16).cast("long").alias("size"),
        F.crc32(text_bytes).cast("long").alias("text_crc32"),
        F.xxhash64(text_bytes).alias("h1"),
        F.xxhash64(F.lit("second"), text_bytes).alias("h2"),
    )
    placed = shard_groups(rows, ["h1", "h2"], "size", shards)
    slots = numbered(placed, "shard", ["doc_id", "h1", "h2"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
