"""Scans over ranges against one loop per group."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.operators import ledger
from wordloom.operators.prefix import AFFINE, LAST, LEAST, every, ranged, scanned

COUNTS = st.sampled_from([(True, 0, 0, 0), (False, 1, 0, 1)])


@settings(max_examples=300, deadline=None)
@given(st.lists(COUNTS, max_size=14), st.integers(0, 14), st.integers(0, 14), st.integers(1, 4))
def test_counts_join_in_any_grouping(rows, i, j, k):
    monoid = every(k)

    def fold(xs):
        state = monoid.zero
        for x in xs:
            state = monoid.join(state, x)
        return state

    i, j = sorted((i, j))
    parts = [fold(rows[:i]), fold(rows[i:j]), fold(rows[j:])]
    whole = fold(rows)
    assert fold(parts) == whole == monoid.join(parts[0], monoid.join(parts[1], parts[2]))
    since = times = 0
    started = False
    for start, *_ in rows:
        if start:
            started, since = True, 0
        else:
            since += 1
            times += started and since % k == 0
    assert (whole[2], whole[3]) == (times, since)


def frame(spark, n=400, seed=0):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None, "null", ""]), i, rng.choice([None, round(rng.random(), 2), 0.5]), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, i int, v double, _other string")


@pytest.mark.parametrize("inclusive", [True, False])
def test_scans_equal_a_loop(spark, inclusive):
    rows, made = frame(spark)
    cut = ranged(made, ["g", "i"], 7)
    least = scanned(cut, ("g",), F.struct(F.col("v").alias("value")), LEAST, "least", inclusive)
    line = F.struct(F.lit(0.5).alias("a"), F.coalesce("v", F.lit(0.0)).alias("b"))
    both = scanned(least, ("g",), line, AFFINE, "line", inclusive)
    done = scanned(both, ("g",), F.struct(F.lit(True).alias("there"), F.col("i").alias("i")), LAST, "last", inclusive)
    assert done.columns == ["g", "i", "v", "_other", "_chunk", "least", "line", "last"]
    got = {r.i: r for r in done.collect()}
    assert len(got) == len(rows) and len({r._chunk for r in got.values()}) == 7
    for g in {r[0] for r in rows}:
        lowest, x, last = None, 3.0, None
        for _, i, v, _ in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            seen = (lowest, x, last)
            lowest = v if lowest is None else lowest if v is None else min(lowest, v)
            x, last = 0.5 * x + (v or 0.0), i
            want = (lowest, x, last) if inclusive else seen
            r = got[i]
            assert r.least.value == want[0] and r.last.i == want[2]
            assert math.isclose(r.line.a * 3.0 + r.line.b, want[1], rel_tol=1e-12)


def test_one_stage_of_many_runs_is_cut_into_ranges(spark):
    n = 60_000
    runs = spark.range(n).select(F.lit("s").alias("stage"), F.col("id").alias("seq"), (F.abs(F.hash("id") % 1000) / 1000.0 + 0.1).alias("spread"), (1.5 + F.sin("id") / 9).alias("fertility"), (1 + F.cos(F.col("id") * 2) / 3).alias("weight"))
    rows = sorted(runs.collect(), key=lambda r: r.seq)
    streaks = {r.seq: r for r in ledger.failure_streaks(runs, ("stage",)).collect()}
    smooth = ledger.elasticity(runs, ("stage",))
    assert "collect_list" not in smooth._jdf.queryExecution().optimizedPlan().toString() and "Window" not in smooth._jdf.queryExecution().optimizedPlan().toString()
    got = {r.seq: r for r in smooth.collect()}
    best, fails, sigma, value, before = None, 0, 0.01, -0.15, None
    for r in rows:
        improved = best is None or r.spread < best
        best, fails = (r.spread, 0) if improved else (best, fails + 1)
        if fails and fails % 3 == 0:
            sigma = max(2e-4, sigma * 0.6)
        s = streaks[r.seq]
        assert (s.improved, s.fails) == (improved, fails) and math.isclose(s.sigma, sigma, rel_tol=1e-9)
        raw = None
        if before is not None:
            dw = math.log(r.weight) - math.log(before.weight)
            if abs(dw) > 1e-3:
                raw = (math.log(r.fertility) - math.log(before.fertility)) / dw
                if -2 < raw < -0.005:
                    value = value * 0.5 + raw * 0.5
        assert (got[r.seq].raw is None) == (raw is None) and math.isclose(got[r.seq].smoothed, value, rel_tol=1e-6)
        before = r


def test_no_rows(spark):
    _, made = frame(spark, 3)
    empty = ranged(made.where("false"), ["g", "i"], 3)
    assert scanned(empty, ("g",), F.struct(F.col("v").alias("value")), LEAST, "least").collect() == []
