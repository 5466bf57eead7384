import zlib

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import langid


def test_counts_of_pieces_and_blanks(monkeypatch):
    assert langid.counts(None) is None and langid.counts("") is None and langid.counts("12 3.\n") is None
    assert np.array_equal(langid.counts("Ab  12 c"), langid.counts("ab c"))
    assert langid.counts("é" * 10).sum() > 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_unknown_nulls_and_empty(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", None), ("123", "de"), ("the dog", None)] * 4)]
    docs = spark.createDataFrame([*rows, (None, "the", "en", "x")], "doc_id long, text string, lang string, lang_pred string")
    got = langid.language_id(docs).collect()
    assert len(got) == 25
    text = {r[0]: r[1] for r in rows}
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, text.get(r.doc_id, "the") or ""))) for r in got)
    assert langid.language_id(docs.where("false")).collect() == []
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", docs.lang.substr(9, 1)).where("text is null")).collect()} == {"und"}


def test_short_clean_texts_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 40 or doc_id < 1500")
    rows = langid.language_id(docs).where("rejected").collect()
    assert len(rows) <= 2


def test_a_text_like_no_language_is_rejected():
    rng = np.random.default_rng(0)
    idf = np.ones(langid.BINS)
    centre = np.zeros(langid.BINS)
    known = langid.counts("the cat sat on the mat and the dog ran off with the hat")
    centre[known > 0] = 1
    centre /= np.linalg.norm(centre)
    floors = langid._floors(["the cat sat on the mat and the dog ran off with the hat"], [known], idf, centre[None, :])
    model = langid.Model(idf, centre[None, :].astype(np.float32), ["en"], floors[None, :])
    assert not model.predict("the cat")[2]
    assert model.predict("".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 200)))[2]


def test_null_ids_and_very_long_texts_do_not_swell_the_sample(spark):
    rows = [(None, "the cat sat on the mat " * 3, "en")] * 400 + [(None, f"the dog {i} ran off with a hat and came home", "en") for i in range(60)] + [(i, "le chat est sur la table avec un chien " * 2000, "fr") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=16)
    assert sorted(set(model.langs)) == ["en", "fr"] and model.langs.count("fr") <= langid.CENTROIDS
    assert model.predict("the cat and the dog")[0] == "en" and model.predict("le chat est la")[0] == "fr"


def plain_counts(text):
    """n-grams one by one, with the same hashes in whole numbers."""
    mask, out, run = (1 << 64) - 1, [0] * langid.BINS, []
    for ch in text:
        lower = ch.lower()
        run += lower
    c, some = [32], False
    for ch in run:
        if ch.isalpha():
            c.append(ord(ch))
            some = True
        elif c[-1] != 32 or len(c) == 1:
            c.append(32)
    c.append(32)
    grams = [x for x in c if x != 32]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & mask for a, b in zip(c, c[1:])]
    grams += two + [(t * 0xC2B2AE3D + d * 0x27D4EB2F) & mask for t, d in zip(two, c[2:])]
    word = 0
    for x in c[1:]:
        word = (word + ((x * 0x9E3779B97F4A7C15 & mask) ^ (x << 17))) & mask
        if x == 32:
            grams.append(word)
            word = 0
    blank = ((32 * 0x9E3779B97F4A7C15 & mask) ^ (32 << 17)) & mask
    words = [g * 0xD6E8FEB86659FD93 & mask for g in grams[len(grams) - sum(x == 32 for x in c[1:]) :] if g != blank]
    singles = grams[: len(grams) - sum(x == 32 for x in c[1:])]
    for g in singles + words:
        mixed = (g ^ (g >> 15)) * 0x2C1B3C6D297A2D39 & mask
        out[mixed >> 40 & (langid.BINS - 1)] += 1
    return np.array(out) if some else None


def test_counts_equal_plain_loops():
    for text in ("The cat, sat. On 12 mats!", "été à Noël\n\tça", "x", "a  b", "ÀÉ über straße", "one"):
        assert (langid.counts(text) == plain_counts(text)).all(), text
    assert langid.counts("12 . !") is None and plain_counts("12 . !") is None


def test_predictions_equal_plain_loops(spark):
    """Frequencies, TF-IDF, the sample by hash, spherical k-means and nearest centroids over collected rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()
    made = {r.doc_id: langid.counts(r.text) for r in rows}
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and made[r.doc_id] is not None]
    df = sum((made[r.doc_id] > 0).astype(int) for r in train)
    idf = np.log((1 + len(train)) / (1 + df)) + 1e-3
    unit = lambda c: (v := np.sqrt(c) * idf) / np.linalg.norm(v)
    centres = []
    for lang in sorted({r.lang for r in train}):
        x = [unit(made[r.doc_id]) for r in sorted((r for r in train if r.lang == lang), key=lambda r: r.h)[: langid.SAMPLE_PER_LANGUAGE]]
        mean = sum(x) / len(x)
        chosen = [max(range(len(x)), key=lambda i: x[i] @ mean)]
        while len(chosen) < min(langid.CENTROIDS, len(x)):
            chosen.append(min(range(len(x)), key=lambda i: max(x[i] @ x[j] for j in chosen)))
        own = [x[i] for i in chosen]
        for _ in range(12):
            groups = [[] for _ in own]
            for v in x:
                groups[max(range(len(own)), key=lambda j: v @ own[j])].append(v)
            own = [(t := sum(g)) / np.linalg.norm(t) if g else c / np.linalg.norm(c) for g, c in zip(groups, own)]
        centres += [(lang, c) for c in own]
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    for i, c in made.items():
        if c is None:
            assert (got[i].lang_pred, got[i].score) == (langid.UNKNOWN, 0.0)
            continue
        best = max(float(unit(c) @ m) for _, m in centres)
        assert abs(got[i].score - best) < 1e-4
        assert got[i].lang_pred in {lang for lang, m in centres if unit(c) @ m > best - 1e-4}


def test_very_long_texts_and_ties(spark):
    rows = [(1, "the cat sat on the mat " * 60000, "en"), (2, "le chat est sur la table " * 3, "fr"), (3, "the cat sat on the mat " * 3, "en"), (3, "the cat sat on the mat " * 3, "en"), (5, "le chat", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    got = langid.language_id(docs).collect()
    assert len(got) == 15 and {(r.doc_id, r.lang_pred) for r in got} >= {(1, "en"), (3, "en")}
