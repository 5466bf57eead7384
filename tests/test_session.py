"""Shared storage: checkpoints, scratch tables, cached tables, Arrow slices."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest

from wordloom import session
from wordloom.operators.prefix import ranged, with_least, with_offsets
from wordloom.sources.cache import kept


def stub(master, named=None):
    seen = []
    folder = SimpleNamespace(isDefined=lambda: bool(seen), get=lambda: seen[-1])
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)), getConf=lambda: SimpleNamespace(get=lambda *_: None), setCheckpointDir=seen.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: named)), seen


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(stub("spark://host:7077")[0])
    for master, named in (("spark://host:7077", "hdfs:///shared"), ("local[2]", "/shared")):
        spark, seen = stub(master, named)
        assert session.ensure_checkpoint_dir(spark) == named == session.ensure_checkpoint_dir(spark) and seen == [named]
    spark, seen = stub("local[2]")
    assert os.path.isdir(session.ensure_checkpoint_dir(spark))


def test_scratch_tables_can_be_dropped(spark):
    path = session.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    session.dropped(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_kept_tables_are_built_once_per_key_and_state(spark, tmp_path):
    calls, inputs = [], [str(tmp_path)]
    build = lambda: calls.append(1) or spark.range(4).toDF("id")
    assert [kept(spark, ("t", 1), inputs, build).count() for _ in range(3)] == [4, 4, 4] and len(calls) == 1
    kept(spark, ("t", 2), inputs, build)
    assert len(calls) == 2
    (tmp_path / "more").write_text("x")
    assert kept(spark, ("t", 1), inputs, build).count() == 4 and len(calls) == 3


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500))], ["x"])
    got = list(session.slices([batch, batch.slice(0, 0)], 1000))
    assert [b.num_rows for b in got] == [1000, 1000, 500] and pa.Table.from_batches(got)["x"].to_pylist() == list(range(2500))


def test_running_sums_and_minima_equal_plain_ones(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.randint(-50, 50)) for i in range(500)]
    cut = ranged(spark.createDataFrame(rows, "k long, v long").repartition(6), ["k"], 7)
    sums = {r.k: r.s for r in with_offsets(cut, [], ["k"], cut.v, "s").collect()}
    least = {r.k: r.m for r in with_least(cut, ["k"], "v", "m").collect()}
    for i, _ in rows:
        assert sums[i] == sum(v for _, v in rows[:i]) and least[i] == min(v for _, v in rows[: i + 1])
