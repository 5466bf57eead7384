import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, c) for i, text in docs if (c := Counter(terms(text)))]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def got(frame):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def made(n, seed=0, vocabulary=40, longest=30):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    return [(i, " ".join(names[min(int(rng.expovariate(0.15)), vocabulary - 1)] for _ in range(rng.randrange(longest)))) for i in range(n)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**60), max_size=60))
def test_numbers_as_bytes(values):
    data, ends = lexical.packed(np.array(values, np.int64))
    assert lexical.unpacked(data).tolist() == values and len(ends) == len(values)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_terms_of_bytes_are_those_of_the_pattern(text):
    found = [w.decode() for part in lexical.words(text.encode()) for w in part]
    assert found == terms(text)


def test_terms_go_on_over_stretches(monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 5)
    text = "a bb averyverylongterm, cc  ddddd eeeee    f"
    assert [w.decode() for part in lexical.words(text.encode()) for w in part] == terms(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 9), max_size=30), max_size=5), st.integers(1, 6), st.integers(1, 5))
def test_heap_merge_of_posting_lists(lists, k, run):
    total = Counter()
    for one in lists:
        total.update(one)
    want = sorted(((s, -d) for d, s in total.items() if s > 0), reverse=True)[:k]
    doc = np.array([d for one in lists for d in sorted(one)], np.int64)
    gain = np.array([one[d] for one in lists for d in sorted(one)], np.int64)
    stops = np.cumsum([len(one) for one in lists]).tolist()
    spans = [(b - len(one), b) for one, b in zip(lists, stops)]
    assert lexical.best(spans, doc, gain, k, run) == [(s, -d) for s, d in want]


@pytest.mark.parametrize("shard_words", [1, 60, 1 << 22])
def test_equals_brute_force_whatever_the_shards(spark, monkeypatch, shard_words):
    docs, items = made(300), made(25, seed=5) + [(100, "unknown words only"), (101, None), (102, "")]
    monkeypatch.setattr(lexical.index, "__defaults__", (shard_words,))
    assert got(lexical.lexical_search(*frames(spark, docs, items))) == plain(docs, items)


def test_ties_nulls_repeats_and_cases(spark):
    docs = [(i, "Same text, SAME text") for i in range(20, 0, -1)] + [(3, "same text"), (None, "same text same text"), (50, None), (51, "?!"), (52, "ärger Ärger ÄRGER text")]
    docs += [(53, "same text same text"), (53, "same text same text")]
    items = [(1, "same"), (1, "Ärger"), (2, "TEXT ärger"), (None, "text"), (2, "same"), (2, "same")]
    assert got(lexical.lexical_search(*frames(spark, docs, items))) == plain(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_WORDS", 20)
    docs, items = made(150, seed=2), made(20, seed=3, longest=15)
    assert got(lexical.lexical_search(*frames(spark, docs, items))) == plain(docs, items)


def test_very_long_texts_extra_columns_and_empty_tables(spark):
    docs = made(30) + [(99, "w1 filler " * 150_000 + "w39")]
    items = [(7, "w39 w1")]
    left, right = frames(spark, docs, items)
    left, right = left.selectExpr("*", "1 AS rank", "'x' AS term", "2 AS shard"), right.selectExpr("*", "3 AS query", "4 AS score")
    assert got(lexical.lexical_search(left, right)) == plain(docs, items)
    for a, b in ((left.where("false"), right), (left, right.where("false"))):
        empty = lexical.lexical_search(a, b)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_index_has_every_posting(spark):
    docs = made(80, seed=9) + [(None, "w1 w1"), (7, "w2")]
    rows = lexical.index(spark.createDataFrame(docs, "doc_id long, text string"), 200).collect()
    names = {(r["shard"], i): (d, n) for r in rows if r["term"] is None for i, (d, n) in enumerate(zip(r["ids"], r["lengths"]))}
    found = Counter()
    for r in rows:
        if r["term"] is not None:
            values = lexical.unpacked(np.frombuffer(r["postings"], np.uint8)).reshape(-1, 2)
            assert len(values) == r["n"] and (values[1:, 0] > 0).all()
            for at, tf in zip(np.cumsum(values[:, 0]).tolist(), values[:, 1].tolist()):
                found[(*names[r["shard"], at], r["term"], tf)] += 1
    want = Counter()
    for i, text in docs:
        c = Counter(terms(text))
        want.update((i, sum(c.values()), t, tf) for t, tf in c.items())
    assert found == want
