"""Session helpers: the shared folder for checkpoints, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this process has written to the shared folder.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster; in local mode, where that
    setting is missing, it is a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(spark, "_grove_shared", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="grove-")
            spark._grove_shared = path
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Write ``df`` as Parquet (with options of the writer) to the shared folder and read it back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grove-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; for the end of a job, when no DataFrame over them is used any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _tables:
        path = hadoop.Path(_tables.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _tidy() -> None:
    """At the end of the process, the tables that lie in a file system this machine sees."""
    for path in _tables:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for the size of its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
