"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where nothing else tells them its place; a cluster ships it with --py-files."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if PACKAGE_PARENT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_PARENT, known) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir, which driver and executors share.

    Only a local master may do without: it gets a temporary folder. Any other master without that setting is refused.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marlstone-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own, not yet there, among the shared ones."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read again: computed once, lineage cut, safe from lost executors."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a superseded table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


TASK_SIZE = 64 * 1024 * 1024  # bytes that a task sorts at a time


def spread(rows: DataFrame, on: list[str], size: int) -> DataFrame:
    """rows dealt by `on` to as many tasks as `size` bytes need: what a task holds does not grow with the table.

    Windows, groups and joins by `on` and more columns behind it need no shuffle of their own. The optimizer's estimate is no measure here: it is
    boundless for rows that no file holds.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_SIZE)), *on)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; only Spark's own readers touch the path."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
