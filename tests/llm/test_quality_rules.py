import re

import pytest
from pyspark.sql import functions as F

from wordloom.llm import native, quality_rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams, seen = [tuple(words[i : i + 8]) for i in range(len(words) - 7)], {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h a b c d e f g h", "a " * 30, "é 𝒳 x#\nx#\n\nx#", "One! TWO! " * 40, "w%d " * 9, "\n".join(["a b c"] * 9), " ".join(f"w{i}" for i in range(40000)) + " w1 w2 w3 w4 w5 w6 w7 w8", "\x0b\x0cq r\x85s t"]


def test_measures_equal_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for r in quality_rules.quality_rules(docs).collect():
        want = plain(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(texts)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]) for r in got)


def test_clean_labelled_documents_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and r.n_words >= 20]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.98 * len(junk)


def test_ablations(spark):
    rows = [(1, 0), (2, 0b1), (3, 0b101), (4, 0b100), (5, 0b100)]
    made = quality_rules.ablations(spark.createDataFrame(rows, "doc_id long, failed long"), {"p": 0b101}).collect()
    assert {(r.rule, r.n_docs, r.n_kept, r.n_failed, r.n_only) for r in made} == {("few_words", 5, 1, 2, 1), ("symbols", 5, 1, 3, 2)}


def test_empty_table_and_repeats(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, text string")
    assert quality_rules.quality_rules(docs).count() == 3
    assert quality_rules.quality_rules(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_running(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(values,)], "a array<int>").select(native.running(F.col("a")).alias("r")).first().r
    assert got == [sum(values[:i]) for i in range(n)]
