"""Running sums and scans inside groups of any size: no group has to fit in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wordloom.session import checkpointed


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """df cut into sorted ranges of `order`; the new column _chunk numbers the ranges in that order.

    Put a unique-ish column last in `order`, so that a large group is cut too.
    """
    cols = [F.col(c) for c in order]
    cut = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return checkpointed(cut.sortWithinPartitions(*cols).withColumn("_chunk", F.spark_partition_id()))


def with_offsets(df: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df (with _chunk) and `out`: the sum of value over all earlier rows of its group, by _chunk and then `order`.

    Sums per (group, _chunk) come first; a window over those few rows gives each chunk its start, and a window inside
    the chunk the rest. Null groups are groups.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_g{i}") for i, c in enumerate(group)]
    nulls = [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(group)]
    named = [f"_g{i}" for i in range(len(group))] + [f"_n{i}" for i in range(len(group))]
    keyed = df.select("*", *keys, *nulls, value.alias("_value"))
    inside = Window.partitionBy(*named, "_chunk").orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*named).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*named, "_chunk").agg(F.sum("_value").alias("_sum")).select(*named, "_chunk", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_start"))
    local = keyed.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return local.join(starts, [*named, "_chunk"]).select(*df.columns, (F.col("_start") + F.col("_local")).cast("long").alias(out))


def with_least(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df (with _chunk) and `out`: the least value of all rows up to and with each row, by _chunk and then `order`."""
    inside = Window.partitionBy("_chunk").orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_chunk").agg(F.min(value).alias("_least")).select("_chunk", F.min("_least").over(across).alias("_earlier"))  # a row per range
    return df.withColumn("_own", F.min(value).over(inside)).join(starts, "_chunk").select(*df.columns, F.least("_own", "_earlier").alias(out))


@dataclass(frozen=True)
class Monoid:
    """An associative way to join what is known of neighbouring stretches of rows, left then right; zero is that of no rows."""

    zero: tuple
    join: Callable[[tuple, tuple], tuple]


def _last(a: tuple, b: tuple) -> tuple:
    return b if b[0] else a


def _least(a: tuple, b: tuple) -> tuple:
    """Nulls count for nothing, NaN is above all numbers."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    return a if (a[0] != a[0], a[0]) <= (b[0] != b[0], b[0]) else b


#: (there, *values): the values of the last row.
LAST = Monoid((False,), _last)
#: (value,): the least value.
LEAST = Monoid((None,), _least)
#: (a, b): the map x -> a * x + b of one row after the other.
AFFINE = Monoid((1.0, 0.0), lambda f, g: (g[0] * f[0], g[0] * f[1] + g[1]))


def every(k: int) -> Monoid:
    """Rows that start anew, and the others counted since: (started, before, times, since): rows before the first start, how
    often the count reached a multiple of k after it, and the count now. A row is (True, 0, 0, 0) or (False, 1, 0, 1)."""

    def join(a: tuple, b: tuple) -> tuple:
        if not a[0]:
            before = a[1] + b[1]
            return (b[0], before, b[2], b[3] if b[0] else before)
        met = a[3] + b[1]
        return (True, a[1], a[2] + met // k - a[3] // k + b[2], b[3] if b[0] else met)

    return Monoid((False, 0, 0, 0), join)


def scanned(cut: DataFrame, group: tuple[str, ...], element: Column, monoid: Monoid, out: str, inclusive: bool = True) -> DataFrame:
    """cut and `out`, a struct of element's fields: the elements of all rows of the group up to the row, or before it, joined.

    cut is what ranged() gives, sorted by the group and then by an order, or rows made from that one by one. A range is read
    twice, row by row: once for what its last group comes to, of which the driver folds one row per range, and once from there.
    Null groups are groups.
    """
    key = F.to_json(F.struct(*[F.col(c) for c in group])) if group else F.lit("")
    ready = cut.select("*", element.alias("_element"), key.alias("_group"))
    names, at = ready.columns, (len(cut.columns), len(cut.columns) + 1)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[str, tuple]]:
        fields = batch.column(at[0]).flatten()
        return zip(batch.column(at[1]).to_pylist(), zip(*(f.to_pylist() for f in fields), strict=True), strict=True)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, first, last, state, kind = None, None, None, monoid.zero, None
        for batch in batches:
            for own, x in rows(batch):
                if own != last:
                    first, last, state = own if first is None else first, own, monoid.zero
                state = monoid.join(state, x)
            if batch.num_rows:
                chunk, kind = batch.column(names.index("_chunk"))[0].as_py(), batch.column(at[0]).type
        if chunk is not None:
            whole = pa.array([dict(zip([f.name for f in kind], state, strict=True)) if state != monoid.zero else None], kind)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([first]), pa.array([last]), whole], ["chunk", "first", "last", "state"])

    kind = ready.schema["_element"].dataType
    ends = ready.mapInArrow(folded, StructType([*StructType.fromDDL("chunk int, first string, last string").fields, StructField("state", kind)])).collect()  # a row per range
    starts, group_now, state = {}, None, monoid.zero
    for r in sorted(ends, key=lambda r: r["chunk"]):
        starts[r["chunk"]] = state if r["first"] == group_now else monoid.zero
        own = monoid.zero if r["state"] is None else tuple(r["state"])
        state = monoid.join(starts[r["chunk"]], own) if r["first"] == r["last"] else own
        group_now = r["last"]
    shared = cut.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, monoid.zero
        for batch in batches:
            found, kind = [], batch.column(at[0]).type
            for own, x in rows(batch):
                if own != last:
                    state = shared.value[batch.column(names.index("_chunk"))[0].as_py()] if last is None else monoid.zero
                    last = own
                before, state = state, monoid.join(state, x)
                found.append(state if inclusive else before)
            made = [dict(zip([f.name for f in kind], s, strict=False)) for s in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at[0])), pa.array(made, kind)], [*names[: at[0]], out])

    return ready.mapInArrow(run, StructType([*cut.schema.fields, StructField(out, kind)]))
