"""Session and shared-storage helpers used by every module."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", **conf) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wordloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of compressed files that a task gets of a table that is dealt out.
TASK_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data by name; a table of fewer files than there are cores is dealt to all of them, as a file may
    be a single unit of reading, and to more tasks the larger it is."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    names = rows.inputFiles()
    return rows.repartition(max(cores, -(-_bytes(spark, names) // TASK_BYTES))) if len(names) < cores else rows


def _bytes(spark: SparkSession, names: list[str]) -> int:
    """The size of files, given as Spark lists them."""
    found = (_files(spark, spark._jvm.java.net.URI(name)) for name in names)
    return sum(files.getFileStatus(where).getLen() for files, where in found)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables: the one set on the context, else the one that spark.checkpoint.dir
    names. A local session without either gets a folder of its own, which goes when the process ends; on a cluster that
    is an error, as a machine-local folder would be lost with its machine."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="wordloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a copy in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder for a table that is read more than once; it is deleted when the
    application ends, or earlier by dropped()."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _files(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{folder}/table"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    files, where = _files(spark, path)
    files.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, a bounded number at a time, without copies; Spark itself bounds a batch by bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
