"""Learning over many tasks gives the merges of learning in one."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.operators import merges
from wordloom.operators.bpe import learn_merges, learned
from wordloom.plans import corpus_queries


def plain(words, n, least=1):
    """Recounts all pairs for each merge."""
    rows = [(list(w), k) for w, k in words if k > 0]
    out = []
    while len(out) < n:
        counts = {}
        for s, k in rows:
            for pair in zip(s, s[1:]):
                counts[pair] = counts.get(pair, 0) + k
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < least:
            return out
        out.append((*best, counts[best]))
        rows = [(_joined(s, best), k) for s, k in rows]
    return out


def _joined(s, pair):
    out, i = [], 0
    while i < len(s):
        if tuple(s[i : i + 2]) == pair:
            out.append(s[i] + s[i + 1])
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out


def got(frame):
    rows = sorted(frame.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(len(rows)))
    return [(r["left"], r["right"], r["n"]) for r in rows]


def vocabulary(seed, n=300, letters="abcde", longest=9, most=40):
    rng = random.Random(seed)
    found = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)}
    return [(w, rng.randrange(most)) for w in sorted(found)]


@pytest.mark.parametrize(("candidates", "runs"), [(4096, 1 << 17), (7, 1 << 17), (64, 25), (1, 1)])
def test_equals_recounting(spark, candidates, runs):
    words = vocabulary(1)
    frame = spark.createDataFrame(words, "word string, n long").repartition(5)
    assert got(merges.learn_merges_partitioned(frame, 25, candidates=candidates, runs=runs)) == plain(words, 25)


def test_ties(spark):
    """Two letters and equal counts: nearly every count is shared."""
    words = [(w, 1) for w, _ in vocabulary(3, 120, "ab", 12)]
    frame = spark.createDataFrame(words, "word string, n long").repartition(3)
    assert got(merges.learn_merges_partitioned(frame, 40)) == plain(words, 40)


def test_products_that_exist_already(spark):
    """Symbols of several letters, as glued syllables are: a product has several splits."""
    rng = random.Random(6)
    words = [([rng.choice(["a", "b", "ab", "ba", "abb"]) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 30)) for _ in range(60)]
    want = plain(words, 30)
    known = {"a", "b", "ab", "ba", "abb"}
    assert sum(a + b in known or known.add(a + b) is not None for a, b, _ in want) > 2
    assert got(merges.learn_merges_partitioned(spark.createDataFrame(words, "symbols array<string>, n long"), 30)) == want


def test_least_count_ends_learning(spark):
    words = vocabulary(4, 80)
    frame = spark.createDataFrame(words, "word string, n long")
    want = plain(words, 10_000, least=200)
    assert 0 < len(want) and got(merges.learn_merges_partitioned(frame, 10_000, least=200)) == want


def test_long_words_runs_of_one_letter_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(merges, "CHUNK", 50)
    words = [("a" * 40, 3), ("a" * 7 + "b" + "a" * 9, 5), ("ab" * 30, 2), ("x", 9)]
    frame = spark.createDataFrame(words, "word string, n long").coalesce(1)
    assert got(merges.learn_merges_partitioned(frame, 12, candidates=2)) == plain(words, 12)


def test_sums_beyond_64_bits(spark):
    words = [(w, n * (1 << 56)) for w, n in vocabulary(5, 60)]
    frame = spark.createDataFrame(words, "word string, n long")
    want = [(a, b, n) for a, b, n in learned([(list(w), n) for w, n in words], 10)]
    assert want == plain(words, 10) and want[0][2] >= 1 << 63
    with pytest.raises(Exception):  # the counts of the result are 64-bit numbers
        got(merges.learn_merges_partitioned(frame, 10))
    half = [(w, n << 48) for w, n in vocabulary(5, 60)]
    assert got(merges.learn_merges_partitioned(spark.createDataFrame(half, "word string, n long"), 10)) == plain(half, 10)


def test_symbols_nulls_and_empty_tables(spark):
    rows = [(["▁", "ab", "c"], 4), (["ab", "c"], 3), (None, 9), ([], 2), (["c", "ab"], 0), (["c"], 5)]
    frame = spark.createDataFrame(rows, "symbols array<string>, n long")
    assert got(merges.learn_merges_partitioned(frame, 9)) == plain([(s, n) for s, n in rows if s], 9)
    assert got(merges.learn_merges_partitioned(frame.where("false"), 9)) == []


def test_no_more_than_some_rounds(spark, sf_dir):
    from wordloom.plans import corpus_queries

    words = corpus_queries._all_words(spark, sf_dir)
    rounds = []
    one = got(learn_merges(words, 1000))
    assert got(merges.learn_merges_partitioned(words, 1000, rounds=rounds)) == one and len(one) == 1000
    assert len(rounds) <= 12 and sum(rounds) == 1000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=2, max_size=8), st.integers(1, 9)), min_size=1, max_size=8), st.sets(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=6))
def test_runs_are_the_longest_stretches_of_candidates(words, candidates):
    want = {}
    for s, n in words:
        run = [s[0]]
        for a, b in [*zip(s, s[1:]), (None, None)]:
            if (a, b) in candidates:
                run.append(b)
            else:
                if len(run) > 1:
                    want[tuple(run)] = want.get(tuple(run), 0) + n
                run = [b]
    flat, sizes = np.array([x for s, _ in words for x in s], np.int64), np.array([len(s) for s, _ in words])
    found = merges.runs_of(flat, sizes, np.array([n for _, n in words]), np.sort(np.array([a << 32 | b for a, b in candidates], np.int64)))
    assert {tuple(np.frombuffer(k, "<i4").tolist()): n for k, n in found.items()} == want


def test_merges_by_key_lie_in_all_tasks_and_are_those_of_one(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(key, "".join(rng.choices("abcé", k=rng.randint(1, 7))), rng.randint(1, 9)) for key in ("x", "y", None) for _ in range(60)]
    frame = spark.createDataFrame(rows, "lang string, word string, n long").groupBy("lang", "word").sum("n").withColumnRenamed("sum(n)", "n")
    want = sorted(map(tuple, learn_merges(frame, 12, config=("lang",), least=2).collect()), key=str)
    monkeypatch.setattr(corpus_queries, "_counts", lambda *_: frame)
    made = corpus_queries.bpe_merges_full(spark, "")
    assert "InArrow" not in made._jdf.queryExecution().optimizedPlan().toString()  # no language's vocabulary in one task
    assert made.columns == ["lang", "rank", "left", "right", "n"]
    got = merges.learn_merges_by(frame, 12, "lang", least=2)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 36
