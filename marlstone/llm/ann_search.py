"""Approximate nearest neighbours by collision counting with query-aware windows.

Vectors are cut into blocks. In a block every projection has its own array of projected values, sorted. Around a
query's projection a window opens in each array; a vector collides once for each window that holds it. Windows
widen together, step by step (virtual rehashing), and vectors whose collisions reach the threshold are verified with their
exact inner products, until enough have been. The projections are orthonormal directions, so that
the counts follow the distances closely.

Largest inner product is turned into smallest distance by one more coordinate that gives all vectors the largest
norm. That holds only among like norms, for beside a few long vectors all others differ in little but this coordinate:
a block is cut into bands of norms within a factor of RANGE, each lifted to its own largest norm, and every band
verifies as many vectors as the block as a whole would. Vectors of thinly filled bands are all verified.
Queries meet each block in batches; a block yields a query's best few, and the best of all blocks
are the result. A block holds fewer of a query's neighbours the more blocks there are, and those stand out more: the verified share
falls with the number of blocks, from BETA to a fixed multiple of the wanted neighbours. Counting remains queries times rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TOP = 20
BLOCK_ROWS = 32_768  # vectors of a block, about
QUERY_ROWS, FEW_QUERIES = 16_384, 512  # queries of a batch, at most, and where a batch is cut no finer to give all cores work
ALPHA = 0.82  # collision threshold, as a share of the projections
BETA, AT_LEAST = 0.05, 14  # verified: this share of a single block and so many times the wanted neighbours, or more
FALL = 0.4  # of several blocks, each verifies the share BETA / blocks**FALL
FIRST, STEP = 1.1, 1.03  # first window in standard deviations of the projected values, and its widening
LEAST_PROJECTIONS = 48
RANGE = 1.5  # largest norm of a band by its smallest


def directions(dim: int, seed: int = 5) -> np.ndarray:
    """dim x m orthonormal directions (m = dim), or several such frames where the dimension is low."""
    rng = np.random.default_rng(seed)
    frames = max(1, -(-LEAST_PROJECTIONS // dim))
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(frames)], axis=1)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, without overflow on the way."""
    high = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    return high[:, 0] * np.sqrt(((vectors / np.where(high > 0, high, 1.0)) ** 2).sum(axis=1))


def bands(norm: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(places of the vectors of each band of at least `least`, places of all others), both ascending."""
    order = np.argsort(-norm, kind="stable")
    falling = norm[order]
    out: list[np.ndarray] = []
    rest: list[np.ndarray] = []
    at = int(np.isinf(falling).sum())
    if at:
        rest.append(order[:at])
    while at < len(order):
        end = int(np.searchsorted(-falling, -falling[at] / RANGE, side="right"))
        (out if end - at >= least else rest).append(np.sort(order[at:end]))
        at = end
    return out, np.sort(np.concatenate(rest)) if rest else np.zeros(0, np.int64)


class Band:
    """Sorted projections of vectors of like norms, in units of the largest; `extra` is added to the number that is verified."""

    def __init__(self, vectors: np.ndarray, norm: float, extra: int):
        self.vectors, self.extra = vectors / norm, extra
        lift = np.sqrt(np.maximum(0.0, 1.0 - (self.vectors**2).sum(axis=1)))
        self.axes = directions(vectors.shape[1] + 1)
        projected = np.column_stack([self.vectors, lift]) @ self.axes
        self.n, self.m = len(vectors), self.axes.shape[1]
        self.where = np.argsort(projected, axis=0, kind="stable").T.ravel()
        values = np.sort(projected, axis=0, kind="stable").T
        # One ascending array of all projections: each is shifted behind the one before.
        self.shift = (np.arange(self.m) * (4.0 * float(np.abs(values).max(initial=1.0)) + 4.0))[:, None]
        self.values = (values + self.shift).ravel()
        self.starts = np.arange(self.m) * self.n
        self.spread = float(projected.std()) or 1.0
        self.need = int(np.ceil(ALPHA * self.m))
        # The first window: a step less than some of the block's own vectors need.
        self.first = FIRST * self.spread
        own = range(0, self.n, max(1, self.n // 8))
        self.first = min([self.collide(self.vectors[i], self.wanted(TOP))[1] for i in own]) / STEP if self.n else self.first

    def wanted(self, top: int) -> int:
        return min(self.n, int(AT_LEAST * top + self.extra))

    def collide(self, query: np.ndarray, wanted: int) -> tuple[np.ndarray, float]:
        """Vectors above the collision threshold, at least `wanted` of them, and the window that it took."""
        high = np.abs(query).max()  # twice scaled, so that neither very long nor very short queries overflow
        query = query / high
        target = (np.append(query / np.sqrt((query**2).sum()), 0.0) @ self.axes)[:, None] + self.shift
        # A vector outside a window has missed it. The windows hold most of an array, so misses are counted:
        # a vector collides in m - misses windows.
        missed, width = np.zeros(self.n, np.int64), self.first
        low, high = self.starts, self.starts + self.n
        while True:
            ends = np.searchsorted(self.values, np.concatenate([target - width, target + width], axis=1).ravel()).reshape(-1, 2)
            a, b = np.maximum(ends[:, 0], self.starts), np.minimum(ends[:, 1], self.starts + self.n)
            if low is self.starts:
                rings = [self.where[i:j] for i, j in zip(self.starts.tolist(), a.tolist(), strict=True)] + [self.where[i:j] for i, j in zip(b.tolist(), (self.starts + self.n).tolist(), strict=True)]
                missed += np.bincount(np.concatenate(rings), minlength=self.n)
            else:
                rings = [self.where[i:j] for i, j in zip(a.tolist(), low.tolist(), strict=True)] + [self.where[i:j] for i, j in zip(high.tolist(), b.tolist(), strict=True)]
                missed -= np.bincount(np.concatenate(rings), minlength=self.n)
            low, high = a, b
            found = np.flatnonzero(missed <= self.m - self.need)
            if len(found) >= wanted:
                return found, width
            width *= STEP  # all vectors are within a width of 2: the search ends


class Block:
    """One of `blocks` blocks of vectors, in bands of like norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, blocks: int = 1):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        norm, extra = norms(self.vectors), int(BETA * len(ids) / blocks**FALL)
        self.places, self.rest = bands(norm, AT_LEAST * TOP + extra)
        self.bands = [Band(self.vectors[k], float(norm[k].max()), extra) for k in self.places]

    def search(self, query_id: int, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best verified vectors, never the query's own row."""
        found = [self.rest, *(k[band.collide(query, band.wanted(top))[0]] for k, band in zip(self.places, self.bands, strict=True))]
        found = np.sort(np.concatenate(found))
        found = found[self.ids[found] != query_id]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.vectors[found] * query).sum(axis=1)
            if not np.isfinite(score).all():  # beyond doubles: by scaled vectors, so that only the result is infinite
                bad = np.flatnonzero(~np.isfinite(score))
                high, own = np.abs(query).max(), np.abs(self.vectors[found[bad]]).max(axis=1)
                score[bad] = ((self.vectors[found[bad]] / own[:, None]) * (query / high)).sum(axis=1) * own * high
        if len(found) > top:
            # Ties at the last place all stay in the choice; ids are ascending, so a stable sort prefers small ones.
            last = np.partition(score, len(score) - top)[len(score) - top]
            some = score >= last
            found, score = found[some], score[some]
        best = np.argsort(-score, kind="stable")[:top]
        return self.ids[found[best]], score[best]


def finite(vector: Column) -> Column:
    """Whether a vector is whole: not null, no null or non-finite component, not all zero."""
    inf = float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (x == F.lit(inf)) | (x == F.lit(-inf)))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each query row, by largest inner product.

    Candidates are all rows but those of the query's own id. Null, zero and non-finite vectors and null ids take no part,
    nor do vectors of another length than the most common one. Equal scores go to the smaller id; repeated ids count
    once (their largest vector, as arrays compare). An empty table gives an empty result. Other columns are not used.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    if dict(rows.dtypes)["v"] not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")))
    rows = rows.groupBy("id").agg(F.max("v").alias("v"), F.max("q").alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["d"]
    blocks = max(1, -(-sizes["n"] // block_rows))
    # Every batch of queries is sent to every block and every block to every batch: large batches move a block less often.
    asked, wanted = sizes["q"] or 0, -(-2 * spark.sparkContext.defaultParallelism // blocks)
    batches = max(1, -(-asked // QUERY_ROWS), min(wanted, -(-asked // FEW_QUERIES)))
    rows = rows.filter(F.size("v") == dim)
    # Every batch of queries meets every block: a row is sent to the pairs that it belongs to.
    here = rows.select(F.lit(False).alias("q"), "id", "v", F.pmod(F.xxhash64("id", F.lit("b")), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("p"))
    asks = rows.filter("q").select(F.lit(True).alias("q"), "id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b"), F.pmod(F.xxhash64("id", F.lit("p")), F.lit(batches)).cast("int").alias("p"))

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["q"].to_numpy()
        v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim)
        ids = pdf["id"].to_numpy()
        out: list[pd.DataFrame] = []
        if ask.any() and (~ask).any():
            block = Block(ids[~ask], v[~ask], blocks)
            for i, q in zip(ids[ask].tolist(), v[ask], strict=True):
                near, score = block.search(i, q, top)
                out.append(pd.DataFrame({"query_id": i, "vec_id": near, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = here.unionByName(asks).groupBy("b", "p").applyInPandas(pair, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
