"""A ledger that several writers append to at once: rows are written first, and become visible and numbered by a commit.

An append writes its rows as Parquet below data/, under a name of its own; Spark's writer makes that safe against lost tasks. It then
creates the next numbered file of log/, which names the append and, for each stage, how many runs came before it. Creating a
file that exists fails, so of two writers that take the same number one goes on to the next with the other's counts: no two
runs get the same id, and ids have no gaps. Rows of an append that never commits are not read.
"""

from __future__ import annotations

import errno
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.prefix import ranged, with_offsets

_LOG = "append string, counts array<struct<stage:string,n:bigint,before:bigint>>"


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _created(spark: SparkSession, name: str, text: str) -> bool:
    """Whether the file was not there and now is, with the text. A store has to refuse to create a file that exists; local
    folders, where Hadoop only looks first, are asked directly. A name is linked to text that is written already, so no reader
    sees half of it."""
    files, path = _files(spark, name)
    files.mkdirs(path.getParent())
    if files.getScheme() == "file":
        local, own = path.toUri().getPath(), f"{path.toUri().getPath()}.{uuid.uuid4().hex}.tmp"
        with open(own, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(own, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    try:
        out = files.create(path, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or getattr(e, "errno", None) == errno.EEXIST:
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(number, append, stage, n, before) of all commits."""
    files, folder = _files(spark, f"{path}/log")
    if not files.exists(folder):
        return spark.createDataFrame([], "number long, append string, stage string, n long, before long")
    rows = spark.read.schema(_LOG).option("pathGlobFilter", "*.json").json(f"{path}/log")
    named = rows.withColumn("number", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long"))
    return named.select("number", "append", F.explode("counts").alias("c")).select("number", "append", "c.*")


def append(runs: DataFrame, path: str, stage: str = "stage") -> int:
    """Adds runs in their order; the number of the commit. Runs of a failed append are deleted, and no commit names them. The
    driver sees a count per stage."""
    spark, name = runs.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/append={name}"
    try:
        runs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
        own = {r[0]: r[1] for r in spark.read.parquet(folder).groupBy(stage).count().collect()}
    except Exception:
        files, where = _files(spark, folder)
        files.delete(where, True)
        raise
    while True:
        log = entries(spark, path).groupBy("stage").agg(F.sum("n").alias("n"), F.max("number").alias("last")).collect()
        before, number = {r["stage"]: r["n"] for r in log}, max((r["last"] for r in log), default=-1) + 1
        counts = [{"stage": s, "n": n, "before": before.get(s, 0)} for s, n in sorted(own.items(), key=lambda x: (x[0] is None, x[0] or ""))]
        counts = counts or [{"stage": None, "n": 0, "before": before.get(None, 0)}]
        if _created(spark, f"{path}/log/{number:012d}.json", json.dumps({"append": name, "counts": counts})):
            return number


def read(spark: SparkSession, path: str, stage: str = "stage") -> DataFrame:
    """All committed runs with run_id: the stage and a number of three digits, or E and four for runs without a stage. Runs
    of a stage are numbered commit by commit, in the order of their append."""
    log = entries(spark, path).select(F.col("append").alias("_append"), F.col("stage").alias("_stage"), "before")
    rows = spark.read.parquet(f"{path}/data").withColumnRenamed("append", "_append")
    kept = rows.join(log, (rows["_append"] == log["_append"]) & rows[stage].eqNullSafe(log["_stage"])).drop(log["_append"]).drop("_stage")
    numbered = with_offsets(ranged(kept, ["_append", stage, "_row"]), ["_append", stage], ["_row"], F.lit(1), "_place")
    number = F.col("before") + F.col("_place") + 1
    name = F.when(F.col(stage).isNull(), F.format_string("E%04d", number)).otherwise(F.format_string("%s-%03d", F.col(stage), number))
    return numbered.select(*[c for c in rows.columns if c not in ("_append", "_row")], name.alias("run_id"))
