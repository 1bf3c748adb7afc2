"""Where intermediate results live: the shared folder named by spark.checkpoint.dir.

Executors can be lost at any time, so a lineage is only ever cut by files that
every executor can read. Nothing here uses localCheckpoint or a machine-local
folder on a cluster; a temporary folder is taken only if the setting is absent,
as in tests on one machine.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set from spark.checkpoint.dir, or to a new one where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="kinfold-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Rows of small frames that one task writes, where their number is known: a file for each of hundreds of almost empty
#: partitions costs more than its rows.
ROWS_A_FILE = 1_000_000


def _gathered(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint of a small frame; rows: about how many it has, if known."""
    shared_dir(df.sparkSession)
    return _gathered(df, rows).checkpoint(eager=True)


def written_table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: for frames too large for checkpoint()'s row files.

    rows: about how many small rows it has, if known. Tables stay until release_tables()
    or until the folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _gathered(df, rows).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kinfold_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished queries now: its cleaner acts when the driver collects its garbage, which may be
    long after the disks have filled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(*tables: DataFrame) -> None:
    """Delete what written_table() wrote for these frames; only where every frame that reads them has itself been written."""
    for table in tables:
        _delete(table.sparkSession, table._kinfold_path)
    if tables:
        tidy(tables[0].sparkSession)


def release_tables(spark: SparkSession) -> None:
    """Delete what written_table() has left. Frames that read those tables are void afterwards."""
    _delete(spark, f"{shared_dir(spark)}/tables")


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH = "2m"


def bounded_batches(spark: SparkSession | None) -> None:
    """Batches by bytes, where the session doesn't say how large they may be: the default counts rows, whatever their length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)
