"""Counting: texts stay out of Python and of joins, and are worked out once; composed words are those of the composed text."""

import random
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wordloom import session
from wordloom.functions import text
from wordloom.operators import corpus, measure, merges
from wordloom.plans import corpus_queries, indic_queries, report_queries, text_queries

ODD = ["", " ", "▁", " ▁a", "a▁▁b", "a ▁b  c\t", "\x1c", "a\x1cb", " ́x é ́e", "각 ᆨ", "▁́ ạ̇　ạ̇", "Å Å", "क़ क़\n\n क", "̈́ ̈́", "a" * 50]


def odd_texts():
    picks, chance = list("ab ▁\t\n　 \x1c") + ["́", "̣", "̇", "̈́", "e", "é", "Ω", "ᄀ", "ᅡ", "ᆨ"], random.Random(5)
    return ODD + ["".join(chance.choices(picks, k=chance.randrange(1, 25))) for _ in range(300)]


def nodes(plan, name):
    """The nodes of a logical plan with a name."""
    children = plan.children()
    below = [x for i in range(children.size()) for x in nodes(children.apply(i), name)]
    return [plan, *below] if plan.nodeName() == name else below


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def pretokens(x):
    norm = " ".join(y for y in "".join(" " if ord(c) in {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000} else c for c in unicodedata.normalize("NFC", x)).split(" ") if y)
    marked = norm.replace(" ", "▁")
    return ["▁" + w for w in (marked if marked.startswith("▁") else "▁" + marked)[1:].split("▁")] if norm else []


def test_counts_without_lists_are_those_of_lists(spark):
    rows = spark.createDataFrame([(x,) for x in [*odd_texts(), None]], "t string").select("t", text.normalized(F.col("t")).alias("norm"), text.normalized(F.col("t"), None).alias("spaced"))
    words = text.pretokens(F.col("norm"))
    for r in rows.select("t", words.alias("w"), text.count_pretokens(F.col("norm")).alias("n"), text.count_pretokens(F.col("spaced")).alias("spaced"), text.pretoken_characters(F.col("norm")).alias("c"), text.count_words(F.col("t")).alias("words")).collect():
        if r.t is None:
            assert (r.n, r.c, r.words) == (None, None, None)
        else:
            assert r.w == pretokens(r.t) and r.n == r.spaced == len(r.w) and r.c == sum(map(len, r.w)) and r.words == len(r.t.split()), repr(r.t)


def test_words_are_composed_after_counting(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([("x", t) for t in texts] + [("x", None)], "lang string, text string")
    expected = Counter(w for t in texts for w in pretokens(t))
    assert {r.word: r.n for r in corpus.word_counts(rows, keys=("lang",)).collect()} == expected
    measured = {r.word: r.n for r in measure.counted_with_words(rows, ("lang",)).collect()}
    assert measured == expected | {None: sum(len(t.split()) for t in texts)}
    pieces = Counter()
    for r in spark.createDataFrame(list(expected.items()), "word string, n long").select(text.punctuation_pieces(F.col("word")).alias("p"), "n").collect():
        for p in r.p:
            pieces[p] += r.n
    assert {r.word: r.n for r in corpus.word_counts(rows, keys=("lang",), punctuation=True).collect()} == pieces


def test_python_gets_distinct_words_not_texts(spark, sf_dir):
    docs = text_queries.docs(spark, sf_dir)
    indic = measure.counted_with_words(docs, ("lang",), written=lambda w: indic_queries.written(F.col("lang"), w))
    for counted in (corpus.word_counts(docs), corpus.word_counts(docs, punctuation=True), measure.counted_with_words(docs, ("lang",)), indic):
        python = nodes(optimized(counted), "ArrowEvalPython")
        assert python and all(nodes(x, "Aggregate") for x in python)


def test_two_routes_work_each_text_out_once(spark, sf_dir):
    plan = optimized(report_queries.compared_reports(spark, sf_dir))
    assert not nodes(plan, "ArrowEvalPython") and plan.toString().count("regexp_replace(") == 2  # a route each


def test_texts_are_measured_before_they_meet_events(spark, sf_dir):
    (join,) = nodes(optimized(text_queries.arrivals_per_window(spark, sf_dir)), "Join")
    assert "text" not in [join.output().apply(i).name() for i in range(join.output().size())]


def test_pieces_are_cut_in_counted_words(spark, sf_dir):
    for query in (corpus_queries.pretoken_punct_counts, corpus_queries.punct_floor_per_lang):
        assert not any("documents" in name for name in query(spark, sf_dir).inputFiles())


def test_a_large_table_is_dealt_to_more_tasks(spark, sf_dir, monkeypatch):
    cores, size = spark.sparkContext.defaultParallelism, 290_257  # bytes of the one file
    assert session.table(spark, sf_dir, "documents").rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "TASK_BYTES", size // 20)
    assert session.table(spark, sf_dir, "documents").rdd.getNumPartitions() == 21


def test_words_are_merged_in_small_chunks():
    """A task over 2^20 symbols and more holds a fraction of them at a time."""
    chance = np.random.default_rng(3)

    def batches():
        for _ in range(16):
            sizes = np.full(10_000, 8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 8, pa.int32()), pa.array(chance.integers(0, 40, sizes.sum()), pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.ones(10_000, np.int64))], ["s", "n"])

    names = [chr(97 + i) for i in range(40)]
    tracemalloc.start()
    words = sum(int(b.column(1).null_count == 0) * b.num_rows for b in merges._merged(batches(), names, [("a", "b"), ("c", "d")]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words == 160_000 and peak < 64e6
