"""Merges, vocabularies, encoding and measures against second implementations."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from wordloom.functions import script
from wordloom.operators import bpe, corpus, measure, train


def plain_merges(words, n):
    """Recount everything each round."""
    state, made = [(list(w), k) for w, k in words], []
    for _ in range(n):
        count = Counter()
        for s, k in state:
            for p in zip(s, s[1:]):
                count[p] += k
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], p))
        made.append((*best, count[best]))
        state = [(bpe.replaced(s, *best), k) for s, k in state]
    return made


@pytest.mark.parametrize("seed", range(12))
def test_incremental_learning_equals_recounting(seed):
    rng = random.Random(seed)
    words = [("".join(rng.choices("aabc", k=rng.randint(1, 9))), rng.randint(1, 5)) for _ in range(rng.choice([1, 5, 60]))]
    assert bpe.learned([(list(w), n) for w, n in words], 30) == plain_merges(words, 30)


def test_odd_runs_are_joined_from_the_left(spark):
    for n in range(1, 8):
        want = ["aa"] * (n // 2) + ["a"] * (n % 2)
        assert bpe.replaced(["a"] * n, "a", "a") == want
        row = spark.range(1).select(bpe.joined(F.array(*[F.lit("a")] * n), F.lit("a"), F.lit("a")).alias("r")).first()
        assert row.r == want


def test_two_learners_agree(spark):
    words = spark.createDataFrame([("▁low", 5), ("▁lower", 2), ("▁newest", 6), ("▁widest", 3)], "word string, n long")
    a = [tuple(r) for r in bpe.learn_merges(words, 8).orderBy("rank").collect()]
    b = [tuple(r) for r in bpe.learn_merges_relational(words, 8).orderBy("rank").collect()]
    assert a == b and len(a) == 8


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rounds_of_several_merges_agree(spark, seed):
    rng = random.Random(seed)
    words = [("▁" + "".join(rng.choices("abcdefghij", k=rng.randint(2, 6))), rng.randint(1, 40)) for _ in range(300)]
    rows, jobs = spark.createDataFrame(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), []
    near = bpe._neighbourhoods
    bpe._neighbourhoods = lambda *x: jobs.append(1) or near(*x)
    try:
        got = [tuple(r) for r in bpe.learn_merges_relational(rows, 30).orderBy("rank").collect()]
    finally:
        bpe._neighbourhoods = near
    assert got == [tuple(r) for r in bpe.learn_merges(rows, 30).orderBy("rank").collect()] and len(jobs) < 30


def test_encoding_equals_the_public_library(spark):
    rng = random.Random(2)
    words = [("".join(rng.choices("abcd", k=rng.randint(1, 8))), rng.randint(1, 9)) for _ in range(200)]
    merges = [(a, b) for a, b, _ in bpe.learned([(list(w), n) for w, n in words], 40)]
    vocab = {t: i for i, t in enumerate(["<unk>", *"abcd", *dict.fromkeys(a + b for a, b in merges)])}
    library = Tokenizer(models.BPE(vocab=vocab, merges=merges, unk_token="<unk>"))
    rows = spark.createDataFrame([("".join(rng.choices("abcdé", k=rng.randint(1, 12))),) for _ in range(300)], "word string").distinct()
    for r in bpe.segment_words(rows, merges, set("abcd")).collect():
        assert r.tokens == [t if t != "<unk>" else "<unk>" for t in library.encode(r.word).tokens], r.word


def test_akshara_merges_equal_replaying_them():
    import random

    rng = random.Random(5)
    for _ in range(200):
        units = list(dict.fromkeys("".join(rng.choices("abc", k=rng.randint(2, 6))) for _ in range(12)))
        ranks = {}
        for u in units:
            while len(parts := bpe.segmented(list(u), ranks)) > 1:
                ranks[parts[0], parts[1]] = len(ranks)
        assert bpe.akshara_merges(units) == list(ranks)


def test_akshara_merges_build_each_unit():
    units = ["क्ष", "त्र", "त्रि", "स्त्र"]
    merges = bpe.akshara_merges(units)
    ranks = {p: i for i, p in enumerate(merges)}
    assert all(bpe.segmented(list(u), ranks) == [u] for u in units) and len(merges) == len(set(merges))


def test_bytes_survive_decoding(spark):
    tokens = bpe.encoded_word("▁a𝒳é", {}, {"▁", "a"}, byte_fallback=True)
    assert tokens == ["▁", "a", "<0xF0>", "<0x9D>", "<0x92>", "<0xB3>", "<0xC3>", "<0xA9>"]
    rows = spark.createDataFrame([(tokens,), (["▁", "▁x"],), ([],)], "t array<string>")
    assert [r.d for r in rows.select(bpe.decoded(F.col("t")).alias("d")).collect()] == ["a𝒳é", " x", ""]


CASES = ["plain text", "क्‍ष क्‌ष क्ष", "తెలుగు‌లో", "اُردُو میں", "ज़मीन", "é é", "a  b\n c", ""]


def test_round_trips_of_unicode_cases(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    assert all(r.ok for r in measure.round_trip(rows, [("▁", "क"), ("a", "b")], "id").collect())
    assert all(r.ok for r in measure.round_trip(rows, [], "id", alphabet=set("▁ab"), byte_fallback=True).collect())
    marked = spark.createDataFrame([(0, "▁x ▁▁y")], "id int, text string")  # marks in a text come back as spaces
    assert not measure.round_trip(marked, [], "id").first().ok


def test_spread_is_an_exact_fraction(spark):
    rows = [("en", 17292, 11672), ("hi", 12131, 8187), ("te", 3634, 2453), ("ur", 5166, 3486), ("none", 3, 0)]
    got = measure.spread(spark.createDataFrame(rows, "lang string, tokens long, words long")).first()
    exact = Fraction(5166, 3486) - Fraction(3634, 2453)
    assert (int(got.spread_num), int(got.spread_den)) == (exact.numerator, exact.denominator) == (97, 203599)
    assert (got.max_lang, got.min_lang) == ("ur", "te") and abs(got.score - 2098958.762886598) < 1e-6
    tie = measure.spread(spark.createDataFrame([("b", 2, 1), ("a", 4, 2)], "lang string, tokens long, words long")).first()
    assert (tie.max_lang, tie.min_lang, tie.spread, tie.score) == ("a", "a", 0.0, None)


def test_evaluate_counts_tokens_unknowns_and_cuts(spark):
    rows = spark.createDataFrame([("hi", "शक्ति शक्ति"), ("en", "ab q"), ("no", " ")], "lang string, text string")
    got = {r.lang: r for r in measure.evaluate(rows, [("a", "b")], ("lang",), alphabet=set("▁abशक्ति")).collect()}
    assert (got["hi"].tokens, got["hi"].words, got["hi"].violations) == (12, 2, 6)
    assert (got["en"].tokens, got["en"].unk) == (4, 1) and got["no"].fertility is None


def test_reports_that_disagree_fail(spark):
    a = spark.createDataFrame([("en", 1), ("hi", 2)], "lang string, tokens int")
    b = spark.createDataFrame([("en", 1), ("te", 2)], "lang string, tokens int")
    got = {r.check: r["pass"] for r in measure.compared(a, b, "lang", ("tokens",)).collect()}
    assert got == {"en: tokens": True, "hi: tokens": False, "te: tokens": False}


def test_budget_keeps_the_document_that_crosses_it(spark):
    docs = spark.createDataFrame([(i, "x", "train", "a b c") for i in range(10)] + [(1, None, "train", "w " * 50), (2, None, "train", "w")], "doc_id long, lang string, split string, text string")
    got = corpus.within_budget(docs, 7).collect()
    assert sorted((r.lang or "", r.doc_id) for r in got) == [("", 1), ("x", 0), ("x", 1), ("x", 2)]


def test_alphabet_filter_keeps_forced_characters(spark):
    words = spark.createDataFrame([("ab", 10), ("ax", 1), ("ay", 1)], "word string, mass long")
    forced = spark.createDataFrame([("y",)], "word string")
    kept = corpus.alphabet_filtered(words, corpus.kept_characters(words, 5, forced))
    assert {r.word for r in kept.collect()} == {"ab", "ay"}


TEXTS = [("hi", "s", "शक्ति शक्ति क्षमा क्षमा शक्ति स्वतंत्रता"), ("en", "s", "the cat the cats the dog a dog the end of the day and the night")]


def test_trainer_sections_and_invariants(spark):
    texts = spark.createDataFrame(TEXTS, "lang string, source string, text string")
    weights = spark.createDataFrame([("hi", "s", 2_000_000), ("en", "s", 1_000_000)], "lang string, source string, micro long")
    made = train.train(texts, weights, train.Config(vocab_size=50, akshara=True, akshara_min=2))
    assert len(made.tokens) == 50 == len(set(made.tokens)) == sum(made.info.values()) and made.info["akshara"] > 0
    for a, b in made.merges:
        assert {a, b, a + b} <= set(made.tokens)
    checked = measure.evaluate(texts, made.merges, ("lang",), alphabet=made.alphabet).collect()
    assert all(r.unk == 0 for r in checked)
    again = train.train(texts.repartition(3), weights, made.config)
    assert (again.tokens, again.merges) == (made.tokens, made.merges)
    with pytest.raises(ValueError, match="too small"):
        train.train(texts, weights, train.Config(vocab_size=5000))
    with pytest.raises(ValueError, match="use up"):
        train.train(texts, weights, train.Config(vocab_size=5))
    scaled = train.train(texts, weights, train.Config(vocab_size=50, byte_fallback=False, total_mass=6000))
    assert len(scaled.tokens) == 50


def test_vocabulary_skips_products_that_exist(spark):
    base = spark.createDataFrame([(0, "<unk>", "special"), (1, "a", "char"), (2, "b", "char"), (3, "ab", "char")], "id long, token string, kind string")
    merges = spark.createDataFrame([(0, "a", "b", 5), (1, "b", "b", 4), (2, "b", "a", 3)], bpe.MERGES)
    rows = bpe.vocabulary(base, merges, size=5).orderBy("id").collect()
    assert [(r.id, r.token, r.kind) for r in rows] == [(0, "<unk>", "special"), (1, "a", "char"), (2, "b", "char"), (3, "ab", "char"), (4, "bb", "learned")]


def test_least_bounds_pairs_and_keeps_rare_words(spark):
    words = [(f"ab{chr(99 + k)}", 1) for k in range(5)] + [("xy", 3), ("zw", 2)]
    rows = bpe.learn_merges(spark.createDataFrame(words, "word string, n long"), 10, least=3).orderBy("rank").collect()
    want = [m for m in plain_merges(words, 10) if m[2] >= 3]
    assert [(r.left, r.right, r.n) for r in rows] == want == [("a", "b", 5), ("x", "y", 3)]


def test_languages_learn_side_by_side(spark):
    rng = random.Random(8)
    words = {lang: [("▁" + "".join(rng.choices(letters, k=rng.randint(1, 7))), rng.randint(1, 9)) for _ in range(40)] for lang, letters in (("a", "xyz"), ("b", "xyyw"))}
    rows = spark.createDataFrame([(lang, w, n) for lang, ws in words.items() for w, n in ws], "lang string, word string, n long")
    got = {lang: [] for lang in words}
    for r in bpe.learn_merges(rows, 25, config=("lang",), least=4).orderBy("lang", "rank").collect():
        got[r.lang].append((r.left, r.right, r.n))
    for lang, ws in words.items():
        plain = plain_merges(ws, 25)
        assert got[lang] == plain[: next((i for i, m in enumerate(plain) if m[2] < 4), 25)]


def test_masses_are_rounded_once_per_word(spark):
    """Rare aksharas cut words into runs; the runs of a word share what its whole, mapped, spelling is rounded to."""
    import hashlib

    rng = random.Random(4)
    syllables = ["क्ष", "त्र", "ज्ञ", "क", "ता", "मि", "न्य", "स्व"]
    texts = [" ".join("".join(rng.choices(syllables, (8, 7, 6, 9, 5, 4, 1, 1), k=rng.randint(1, 4))) for _ in range(rng.randint(3, 9))) for _ in range(120)]
    docs = spark.createDataFrame([("hi", "eval", t) for t in texts], "lang string, source string, text string")
    weights = spark.createDataFrame([("hi", "eval", 1_500_000)], "lang string, source string, micro long")
    made = train.train(docs, weights, train.Config(vocab_size=60, akshara=True, akshara_min=100, total_mass=900))
    mass = Counter(f"▁{w}" for t in texts for w in t.split())
    mass = {w: n * 1_500_000 for w, n in mass.items()}
    units = {w: script.akshara_list(w) for w in mass}
    frequency = Counter()
    for w, n in mass.items():
        for u in units[w]:
            frequency[u] += n * (len(u) > 1)
    glued = sorted((u for u, n in frequency.items() if n >= 100 * 1_000_000), key=lambda u: (-frequency[u], u))
    assert 0 < len(glued) < len([u for u in frequency if len(u) > 1])
    total, runs = sum(mass.values()), Counter()
    for w, n in mass.items():
        mapped = "".join(u if len(u) == 1 else chr(0xF0000 + glued.index(u)) if u in glued else " " + " ".join(u) + " " for u in units[w])
        k = int(n * (900.0 / total) + int(hashlib.md5(mapped.encode()).hexdigest()[:8], 16) / 2**32)
        for run in mapped.split():
            runs[run] += k
    fixed = bpe.akshara_merges(glued)
    learned = [tuple("".join(glued[ord(c) - 0xF0000] if ord(c) >= 0xF0000 else c for c in x) for x in m[:2]) for m in bpe.learned([(list(r), n) for r, n in runs.items() if n], 100)]
    tail = made.merges[len(fixed) :]
    products, want = {t for t, k in zip(made.tokens, made.kinds) if k != "learned"}, []
    for a, b in learned:  # ties are told apart by other symbols here, so only counts can be compared
        if a + b not in products:
            products.add(a + b)
            want.append((a, b))
    assert made.merges[: len(fixed)] == fixed and sorted(tail[:5]) == sorted(want[:5])
