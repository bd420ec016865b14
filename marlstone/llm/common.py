"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH_ROWS = "1000"  # documents in an Arrow batch, at most: long texts make large batches


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound Arrow batches, and make sure checkpoints have a folder.

    A batch holds BATCH_ROWS rows at most, fewer where the session says so. The checkpoint folder is the one the cluster
    names in spark.checkpoint.dir. Only a local master, where driver and tasks share one disk, may do without: it gets
    a temporary folder. Any other master without that setting is refused, for executors would not see each other's files.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if PACKAGE_PARENT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_PARENT, known) if x)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "0")) <= int(BATCH_ROWS):
        spark.conf.set(rows, BATCH_ROWS)
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marlstone-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def held_out_py(doc_id) -> bool:
    """held_out for one id in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def lines(column: pd.Series) -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [x if isinstance(x, str) else "" for x in column]


def _whole(df: DataFrame, doc_id: str) -> bool:
    return isinstance(df.schema[doc_id].dataType, T.IntegralType)


def plain_id(df: DataFrame, doc_id: str) -> Column:
    """The id as a long where it is a whole number, else as a string."""
    return F.col(doc_id).cast("long" if _whole(df, doc_id) else "string")


def no_id(df: DataFrame, doc_id: str) -> Column:
    """What stands for a null id beside plain_id: the least of all."""
    return F.lit(-(2**63)).cast("long") if _whole(df, doc_id) else F.lit("")


def arrow_lines(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column in UTF-8, null as the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, keep: list[str], work: Callable[[pa.RecordBatch], tuple[list[int] | None, list]], added: str) -> DataFrame:
    """df's `keep` columns and those that `work` adds to each Arrow batch, described by the DDL text `added`.

    work returns the row of the batch that each of its rows belongs to (None: one for each, in order) and its columns. Kept columns stay
    Arrow arrays, so that 64-bit ids beside nulls stay what they are; through pandas they would become floating-point numbers.
    """
    new = T._parse_datatype_string(added)
    schema = T.StructType([*df.select(*keep).schema, *new])
    kinds = list(to_arrow_schema(new).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = work(batch)
            kept = [batch[c] if rows is None else batch[c].take(pa.array(rows, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the shared checkpoint folder and read again: computed once, lineage cut.

    A lost executor costs no more than a task that reads the table. `discard` removes a table that is read no more.
    """
    spark = ready(df.sparkSession)
    return written(df, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read again."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def complete(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path if its writer ended well, else None."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a settled table; its rows must not be read again."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for the ends of all edges: label is the least node of the connected component.

    Least labels travel along edges, then labels jump to their labels' labels, until nothing changes; every round is
    a table in the shared folder, removed when the next one stands. Hubs cost a partial minimum, never a collected list.
    """
    both = settle(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).filter("x <> y").distinct(), "edges")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = settle(labels, "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        new = settle(jump.select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        discard(labels)
        moved = not new.filter("was <> label").isEmpty()
        labels = new.drop("was")
        labels.settled_path = new.settled_path
        if not moved:
            discard(both)
            return labels
