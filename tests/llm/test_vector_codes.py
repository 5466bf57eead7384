import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from wordloom.llm import vector_codes as codes


def whole(x):
    return math.floor(1024 * Fraction(float(x)))


def plain(rows, entries=256, rounds=4, parts=4):
    """(vec_id, code, error, label_error) and the codebooks' hash by comparing every part with every entry."""
    ok = [(i, label, [whole(x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(ok[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in ok]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(c[p], books[p])[1] for c in cut]
            for e in set(found):
                own = [c[p] for c, f in zip(cut, found) if f == e]
                books[p][e] = [sum(xs) // len(own) for xs in zip(*own)]
    last = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in row) for row in last]
    by_label = {}
    for (_, label, _), error in zip(ok, errors):
        by_label[label] = by_label.get(label, 0) + error
    out = sorted((repr(i), "".join(f"{e:02x}" for _, e in row), error, by_label[label]) for (i, label, _), row, error in zip(ok, last, errors))
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def got(frame):
    rows = frame.collect()
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in rows), {r["codebooks_sha256"] for r in rows}


SCHEMA = "vec_id long, embedding array<double>, label int"


def made(n, dim=8, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    return [(i, (rng.integers(-3, 4, dim) * spread + rng.normal(size=dim) * 0.05).tolist(), int(rng.integers(3)) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("n", [40, 256, 700])
def test_equals_brute_force(spark, n):
    rows = made(n)
    want, sha = plain(rows)
    assert got(codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == (want, {sha})


def test_ties_repeated_rows_nulls_and_odd_vectors(spark):
    rows = made(300, dim=4, spread=1.0) + [(5, [0.0, 0.0, 0.0, 0.0], 1)] * 9 + [(None, [1.0, -1.0, 0.5, 0.0], None)] * 2
    bad = [(900, None, 1), (901, [1.0, None, 0.0, 0.0], 1), (902, [1.0, float("nan"), 0.0, 0.0], 1), (903, [float("-inf"), 0.0, 0.0, 0.0], None)]
    want, sha = plain(rows)
    assert got(codes.vector_codes(spark.createDataFrame(rows + bad, SCHEMA))) == (want, {sha})


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-5, 6, 8) * 10.0 ** rng.choice([0, 3, 5])).tolist(), 0) for i in range(300)]
    want, sha = plain(rows)
    assert got(codes.vector_codes(spark.createDataFrame(rows, SCHEMA))) == (want, {sha})
    huge = [(i, [1e306 * i, -3.0, 1e300, 0.5], 0) for i in range(-3, 300)]
    want, sha = plain(huge)
    want = [(i, code, error if error < 1 << 63 else None, total if total < 1 << 63 else None) for i, code, error, total in want]
    assert got(codes.vector_codes(spark.createDataFrame(huge, SCHEMA))) == (want, {sha})


def test_other_lengths_have_no_code_and_empty_tables_no_rows(spark):
    rows = made(50) + [(1000, [1.0, 2.0], 9), (1001, [], None)]
    found = {r["vec_id"]: r for r in codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == 52 and found[1000]["code"] is found[1000]["error"] is found[1000]["label_error"] is found[1001]["code"] is None
    want = {int(i): (code, error) for i, code, error, _ in plain(made(50))[0]}
    assert {i: (r["code"], r["error"]) for i, r in found.items() if i < 1000} == want
    empty = codes.vector_codes(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    nothing = codes.vector_codes(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in nothing] == [("00000000", 0, 0)] * 2


def test_rows_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0, 1.0, 2.0], f"c{i}", i, [i]) for i in range(30)], "vec_id long, embedding array<float>, code string, row int, part array<int>")
    coded, books = codes.compressed(rows, entries=8, rounds=2)
    found = coded.collect()
    assert {(r["row"]["vec_id"], r["row"]["code"], r["row"]["row"], r["row"]["part"][0]) for r in found} == {(i, f"c{i}", i, i) for i in range(30)}
    for r in found:  # what a code stands for is as far away as its error says
        vector = books.decoded(r["codes"])
        assert sum((math.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(r["row"]["embedding"], vector)) == r["error"]


def test_search_scans_inside_the_radius_only(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (64, 6))
    book = codes.Codebook(centres.tolist())
    x = (centres[rng.integers(64, size=5000)] + rng.integers(-40, 41, (5000, 6))).astype("f8")
    full = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    start = np.where(rng.random(5000) < 0.9, full.argmin(axis=1), rng.integers(64, size=5000))
    at, far = book.nearest(x, start)
    assert (at == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    within = (book._index("f8")[3][start] <= 4 * full[np.arange(5000), start][:, None]).sum(axis=1)
    assert (within == 1).mean() > 0.8  # most parts meet no other entry


def test_hot_labels_sum_as_others(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT", 4)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3 if i < 90 else i, i) for i in range(120)], "id long, label int, error long")
    want = {}
    for i in range(120):
        label = None if i % 3 == 0 else i % 3 if i < 90 else i
        want[label] = want.get(label, 0) + i
    assert all(r["s"] == want[r["label"]] for r in codes.group_sums(rows, "label", "error", "s").collect())
    assert codes.group_sums(rows, "label", "error", "s").count() == 120
