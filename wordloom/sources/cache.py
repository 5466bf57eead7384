"""Tables that several queries of a session share, written once per state of their input files and parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.session import dropped, scratch

#: By application and key: the state that the last table was made from, its path, and the path of the one before.
_tables: dict[tuple, tuple[str, str, str | None]] = {}


def state_of(spark: SparkSession, inputs: list[str]) -> str:
    """A hash over paths, sizes and modification times of all files below the inputs, in whatever store they are."""
    found = []
    for name in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            file = files.next()
            found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def kept(spark: SparkSession, key: tuple, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, from a table in the shared folder that is written when the files below inputs are not those of the last
    call with this key.

    The key names the query and every parameter. A table stays until its successor has a successor, so that a DataFrame made
    just before a change can still be read; all go when the application ends.
    """
    own, state = (spark.sparkContext.applicationId, *key), state_of(spark, inputs)
    last, path, before = _tables.get(own, ("", None, None))
    if last != state:
        if before:
            dropped(spark, before)
        fresh = scratch(spark, str(key[0]))
        build().write.parquet(fresh)
        _tables[own] = (state, fresh, path)
        path = fresh
    return spark.read.parquet(path)
