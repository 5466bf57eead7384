import math
from fractions import Fraction

import numpy as np
import pytest

from wordloom.llm import topk


def whole(x):
    return math.floor(1024 * Fraction(float(x)))


def plain(rows, k=10, every=100):
    ok = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def invariants(tree):
    for node in range(len(tree.centre)):
        rows = tree.rows[node]
        far = np.linalg.norm(tree.points[rows] - tree.points[tree.centre[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-6
        kids = tree.children[node]
        if len(kids):
            assert sorted(np.concatenate([tree.rows[c] for c in kids]).tolist()) == sorted(rows.tolist()) and tree.centre[kids[0]] == tree.centre[node]
            assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-6 for c in kids)
            centres = tree.points[[tree.centre[c] for c in kids]]
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(kids), 1)]
            assert (gaps > tree.radius[node] / 2 - 1e-6).all()


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    points = np.floor(np.r_[rng.normal(size=(400, 3)) * 50, np.repeat(rng.normal(size=(5, 3)) * 900, 60, axis=0)])
    invariants(topk.CoverTree(points, leaf=5))


@pytest.mark.parametrize(("block", "group"), [(topk.BLOCK_ROWS, topk.GROUP_ROWS), (97, 3)])
def test_equals_brute_force(spark, block, group):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    want = plain([tuple(r) for r in rows.collect()])
    got = topk.exact_top_k(rows, block_rows=block, group_rows=group).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def clustered(n, clusters=12, dim=6, width=0.01, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, (centres[rng.integers(clusters)] + rng.normal(size=dim) * width).tolist()) for i in range(n)]


def test_queries_go_only_to_cells_that_can_beat_their_kth_score(spark, monkeypatch):
    rows = clustered(6000)
    frame, made, routes = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), [], topk._routes
    monkeypatch.setattr(topk, "_routes", lambda *x: made.append((x[1], routes(*x))) or made[-1][1])
    got = topk.exact_top_k(frame, block_rows=200).collect()
    assert {tuple(r) for r in got} == plain(rows)
    cells = len(made[0][0].radius)
    asked, further = (r.count() for _, r in made)
    assert cells >= 12 and asked == 60 and further <= 0.25 * asked * cells


@pytest.mark.parametrize(("low", "high"), [(0, 20), (30, 60), (200, 1023), (-8, 1023)])
def test_any_finite_doubles_are_exact(spark, low, high):
    rng = np.random.default_rng(high)
    rows = [(i, (rng.choice([-1, 1], 5) * np.ldexp(rng.random(5) + 1, rng.integers(low, high + 1, 5))).tolist()) for i in range(260)]
    rows += [(300 + i, [1.5, 0.0, -2.0, 3.25, 1e-3]) for i in range(40)] + [(400, [1.7e308] * 5), (401, [-1.7e308] * 5), (402, [0.0] * 5), (403, [5e-324] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {(q, r, j, cut(s)) for q, r, j, s in plain(rows, every=50)}
    for block, group in ((topk.BLOCK_ROWS, topk.GROUP_ROWS), (23, 2)):
        assert {tuple(r) for r in topk.exact_top_k(frame, query_divisor=50, block_rows=block, group_rows=group).collect()} == want


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1e200, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.5]) for i in range(900)] + [(5, [1e200, 2.0, 3.0])] * 50
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=100).collect()
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert sorted(tuple(r)[1:] for r in got if r.query_id == 300) == sorted((r, j, cut(s)) for q, r, j, s in plain_rows(rows, 300))


def plain_rows(rows, query):
    """Like plain, with repeated candidates."""
    own = next([whole(x) for x in v] for i, v in rows if i == query)
    scored = sorted((-sum(a * whole(b) for a, b in zip(own, w)), j) for j, w in rows if j != query)[:10]
    return [(query, r + 1, j, -s) for r, (s, j) in enumerate(scored)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1e30, -1e30]), (1, [0.5, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (200, [1.0]), (7, [3.0]), (None, [1.0, 2.0]), (300, [])]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<double>, score int, rank int")
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    got = {tuple(r) for r in topk.exact_top_k(frame).collect()}
    assert got == {(q, r, j, cut(s)) for q, r, j, s in plain(rows)}
    assert topk.exact_top_k(frame.where("false")).collect() == []
