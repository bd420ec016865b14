"""A bit table of bounded size that tells early what cannot be in a set of 64-bit values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIEVE_BITS = 28  # a table has 2**SIEVE_BITS bits (32 MB) at most, however large the set: beyond, it lets more pass


class Sieve:
    """Holds all of a set of values, and by chance a few others; the low bits of a value are its place."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << max(0, bits - 6), np.uint64) if table is None else table

    def add(self, values: np.ndarray) -> None:
        low = values & self.mask
        np.bitwise_or.at(self.table, (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))

    def holds(self, values: np.ndarray) -> np.ndarray:
        low = values & self.mask
        return (self.table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def bits_for(n: int) -> int:
    """Bits of a sieve for n values: 16 to 32 a value, within bounds."""
    return min(SIEVE_BITS, max(16, (32 * n - 1).bit_length() if n else 16))


def sieve_of(df: DataFrame, column: str) -> Sieve:
    """A sieve of the non-null values of a long column; tasks combine its words, so only the table reaches the driver."""
    bits = bits_for(df.select(F.approx_count_distinct(column)).first()[0] or 0)
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    cells = df.filter(F.col(column).isNotNull()).select(F.shiftright(low, 6).alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("word")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    table[cells["cell"].to_numpy()] = cells["word"].to_numpy().view(np.uint64)
    return Sieve(bits, table)


def passing(rows: DataFrame, column: str, sieve: Sieve) -> DataFrame:
    """The rows whose value of a long column passes the sieve; only that column goes to Python."""
    sent = rows.sparkSession.sparkContext.broadcast(sieve)

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series(sent.value.holds(values.to_numpy(np.int64).view(np.uint64)))

    return rows.filter(held(F.coalesce(F.col(column), F.lit(0).cast("long"))))
