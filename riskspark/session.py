"""Session set-up and the one place that decides where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RISKSPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; on a cluster that would lose data with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors.")
        folder = tempfile.mkdtemp(prefix="riskspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class _Owners(threading.local):
    """Open ``intermediates`` blocks: each thread's own, as a stream's batches run beside other jobs."""

    def __init__(self) -> None:
        self.stack: list[list[str]] = []


_OWNERS = _Owners()


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that are written inside, when the block ends.

    For jobs that write their results before they leave the block: what a DataFrame still has to
    read is gone afterwards.
    """
    _OWNERS.stack.append([])
    try:
        yield
    finally:
        for path in _OWNERS.stack.pop():
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    path = f"{shared_folder(spark).rstrip('/')}/riskspark/{name}-{uuid.uuid4().hex}"
    if _OWNERS.stack:
        _OWNERS.stack[-1].append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs then read only the columns they need instead of recomputing their input, and
    what a lost executor held is still there. With ``partition_by`` a filter on that column
    reads only the files it needs.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that is no longer read, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(table: DataFrame) -> DataFrame:
    """Spread a table that was read in fewer tasks than there are cores; leave others alone.

    For work that is heavy per row on files too few or too small to split.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
