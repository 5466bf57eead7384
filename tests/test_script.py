"""Syllables, clusters and words of published examples; the fold against the loop."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import script, text
from wordloom.operators import bpe, corpus, measure, train
from wordloom.plans import indic_queries

#: Syllables of words.
AKSHARA_CASES = (
    ("शक्ति", ("श", "क्ति")),
    ("स्वतंत्रता", ("स्व", "तं", "त्र", "ता")),
    ("క్ష", ("క్ష",)),
    ("స్వాతంత్ర్యం", ("స్వా", "తం", "త్ర్యం")),
    ("क्\u200dष", ("क्\u200dष",)),
    ("क्\u200cष", ("क्\u200c", "ष")),
    ("இந்தியா", ("இ", "ந்", "தி", "யா")),
)
SPLIT_CASES = (("शक्ति", ("शक", "्ति"), 1), ("शक्ति", ("श", "क्ति"), 0), ("स्वतंत्रता", ("स्", "व", "तंत्", "रता"), 2), ("abc", ("a", "b", "c"), 0))
GRAPHEME_CASES = (("é́a", 2), ("🇮🇳x", 2), ("कि", 1))



def test_syllables_of_words(spark):
    rows = spark.createDataFrame([(w,) for w, _ in AKSHARA_CASES], "word string")
    got = rows.select("word", script.aksharas(F.col("word")).alias("a"), script.aksharas_folded(F.col("word")).alias("b"), script.aksharas_any(F.col("word")).alias("c")).collect()
    assert {r.word: tuple(r.a) for r in got} == {r.word: tuple(r.b) for r in got} == {r.word: tuple(r.c) for r in got} == dict(AKSHARA_CASES)


def test_cuts_inside_syllables(spark):
    rows = spark.createDataFrame([(w, list(p), n) for w, p, n in SPLIT_CASES], "word string, pieces array<string>, n int")
    assert all(r.bad == r.n for r in rows.select("n", measure.violations(F.col("word"), F.col("pieces")).alias("bad")).collect())


def test_clusters(spark):
    rows = spark.createDataFrame(GRAPHEME_CASES, "word string, n int")
    assert all(r.k == r.n for r in rows.select("n", F.size(script.graphemes(F.col("word"))).alias("k")).collect())


def test_words_by_two_definitions_of_white_space(spark):
    cases = [("a\u00a0b\u2009c  d\n\ne", 5, 5), ("जवाहर\u200cलाल", 1, 1), ("", 0, 0), ("  ", 0, 0), ("x\x1cy", 2, 1)]
    rows = spark.createDataFrame(cases, "text string, python int, unicode int")
    assert all((r.a, r.b) == (r.python, r.unicode) for r in rows.select("*", text.count_words(F.col("text")).alias("a"), text.count_words(F.col("text"), text.WHITE_SPACE).alias("b")).collect())


LETTERS = st.text(st.sampled_from("▁aक\u094d\u093e\u0937\u200c\u200d\u0c15\u0c4d\u0c3eந\u0bcd\u0301A"), max_size=12)


def test_folds_equal_the_loop(spark):
    found = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(LETTERS)
    def collect(word):
        found.append((word,))

    collect()
    rows = spark.createDataFrame(found, "word string").select("word", script.aksharas(F.col("word")).alias("a"), script.aksharas_folded(F.col("word")).alias("b")).collect()
    for r in rows:
        assert r.a == r.b == script.akshara_list(r.word), r.word


def test_written_letters_hold_conjuncts_joiners_and_cuts(spark, sf_dir):
    rows = indic_queries.indic_aksharas(spark, sf_dir)
    sums = rows.agg(F.sum("bad"), F.count_if(F.col("units").rlike("\u094d\u200d[\u0915-\u0939]")), F.count_if(F.col("units").rlike("\u0c4d[\u0c15-\u0c39]"))).first()
    assert min(sums) > 10
    assert min(r.violations for r in indic_queries.indic_cuts(spark, sf_dir).collect()) > 0


def test_trainer_over_syllables_equals_its_parts(spark, sf_dir):
    """The trainer's tokens are those that counting, choosing, gluing and learning give one after the other."""
    glued = indic_queries._glued(spark, sf_dir)
    parts = indic_queries.indic_vocabulary(spark, sf_dir).orderBy("id").collect()
    rows = indic_queries._documents(spark, sf_dir).select("lang", F.lit("s").alias("source"), "text")
    weights = rows.select("lang", "source").distinct().withColumn("micro", F.lit(1_000_000).cast("long"))
    total = indic_queries._words(spark, sf_dir).agg(F.sum("mass")).first()[0]
    pages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 10 = 0").select(F.lit("de").alias("lang"), F.translate("text", indic_queries.LATIN, indic_queries.DEVANAGARI).alias("text"))
    config = train.Config(vocab_size=len(parts), akshara=True, akshara_min=int(total) // 1_000_000 // indic_queries.SHARE)
    made = train.train(rows, weights, config, pages)
    want = [(r.token, r.kind) for r in parts]
    assert list(zip(made.tokens, made.kinds)) == want and made.merges[: len(bpe.akshara_merges(glued))] == bpe.akshara_merges(glued)
    assert made.info["akshara"] > 50 and made.info["learned"] >= 20


def test_chosen_syllables_hold_those_of_every_page(spark, sf_dir):
    """Not only those of some pages: each syllable of the benchmark that the documents have is glued."""
    units = lambda words: words.select(F.explode(script.aksharas(F.col("word"))).alias("a")).where(F.length("a") > 1)
    pages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.translate("text", indic_queries.LATIN, indic_queries.DEVANAGARI).alias("text"))
    of_pages = {r.a for r in units(corpus.word_counts(pages, keys=())).collect()} & {r.a for r in units(indic_queries._words(spark, sf_dir)).collect()}
    chosen = {r.akshara for r in indic_queries.indic_chosen_aksharas(spark, sf_dir).collect()}
    assert of_pages <= chosen and len(of_pages - set(indic_queries._glued(spark, sf_dir))) > 0
