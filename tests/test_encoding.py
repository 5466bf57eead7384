"""Encoding where texts stand, and segmentation by heap, against the plain method; the cache of tables."""

import random

import pyarrow as pa

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from wordloom.functions import text
from wordloom.operators import bpe
from wordloom.plans import corpus_queries, training_queries


def plain(symbols, ranks):
    """The pair of lowest rank, leftmost first, by looking at all pairs for each merge."""
    symbols = list(symbols)
    while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


PIECES = st.sampled_from(["a", "b", "ab", "ba", "aa", "aab"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=30), st.lists(st.tuples(PIECES, PIECES), max_size=12))
def test_segmentation_equals_the_plain_method(symbols, pairs):
    ranks = {}
    for p in pairs:
        ranks.setdefault(p, len(ranks))
    assert bpe.segmented(symbols, ranks) == plain(symbols, ranks)


def test_long_words_equal_the_plain_method_and_the_library():
    rng = random.Random(3)
    words = [("".join(rng.choices("abcd", k=rng.randint(2, 9))), rng.randint(1, 9)) for _ in range(300)]
    merges = [(a, b) for a, b, _ in bpe.learned([(list(w), n) for w, n in words], 150)]
    ranks = {}
    for p in merges:
        ranks.setdefault(p, len(ranks))
    short, long = "".join(rng.choices("abcd", k=1500)), "".join(rng.choices("abcd", k=10_000))
    assert bpe.segmented(list(short), ranks) == plain(short, ranks)
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*"abcd", *(a + b for a, b in merges)]))}
    assert bpe.segmented(list(long), ranks) == Tokenizer(models.BPE(vocab=vocab, merges=merges)).encode(long).tokens


def test_texts_are_encoded_where_they_stand(spark, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)]
    merges = [(a, b) for a, b, _ in bpe.learned([(list(w), 1) for w in words], 30)]
    rows = [(i, [rng.choice([*words, "xa", "", None]) for _ in range(rng.randrange(6))]) for i in range(60)] + [(98, None), (99, ["same"] * 500)]
    frame = spark.createDataFrame(rows, "id int, pieces array<string>").repartition(3)
    ranks = {p: k for k, p in reversed(list(enumerate(merges)))}
    made = frame.select("id", bpe.encoded(F.col("pieces"), merges, set("abc")).alias("t"))
    assert "Exchange" not in made.where("t is not null")._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["t"] for r in made.collect()}
    for i, pieces in rows:
        assert got[i] == (pieces and [None if w is None else bpe.encoded_word(w, ranks, set("abc")) for w in pieces]) or (pieces == [] and got[i] == [])


def test_documents_by_the_full_tokenizer(spark, sf_dir):
    vocab, merges, alphabet = training_queries._full_parts(spark, sf_dir)
    ids = {r.token: r.id for r in vocab.collect()}
    assert len(ids) == 10_000
    library = Tokenizer(models.BPE(vocab=ids, merges=merges, unk_token="<unk>"))
    plan = training_queries.documents_10k(spark, sf_dir)
    assert "hashpartitioning(word" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in plan.collect()}
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.pretokens(text.normalized(F.col("text"))).alias("p")).collect()
    assert len(got) == len(some) and all(r.ok or r.unk for r in got.values())
    known: dict[str, list[int]] = {}
    for r in some:
        for w in r.p:
            if w not in known:
                known[w] = library.encode(w).ids
        assert got[r.doc_id].n_tokens == sum(len(known[w]) for w in r.p) and got[r.doc_id].unk == sum(known[w].count(0) for w in r.p)
    rows = training_queries.fertility_10k(spark, sf_dir).collect()
    assert sum(r.tokens for r in rows) == sum(r.n_tokens for r in got.values()) == sum(r.tokens for r in training_queries.heldout_fertility_10k(spark, sf_dir).collect())


def test_shared_tables_see_that_files_changed(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"

    def write(n):
        spark.createDataFrame([(i, "one two two", "en", "s", 11) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars int").write.mode("overwrite").parquet(path)

    def total():
        return corpus_queries.pretoken_counts_topk(spark, str(tmp_path)).agg(F.sum("n")).first()[0]

    write(10)
    assert total() == 30
    before = corpus_queries.pretoken_counts_topk(spark, str(tmp_path))
    write(200)
    assert total() == 600 and total() == 600
    assert before.agg(F.sum("n")).first()[0] == 30  # made from the table before
    write(7)
    assert total() == 21


def test_a_batch_of_many_different_words_is_cut_in_parts():
    lists = pa.array([[f"w{i}x{j}" for j in range(7)] for i in range(50)] + [None, [], ["same", None]], pa.list_(pa.string()))
    cut = lambda w: [w[:1], w[1:]]
    parts = list(bpe.encoded_lists(iter([lists]), cut, kept=20, at_once=15))
    assert max(len(x.flatten()) for x in parts) <= 15 and len(parts) > 20
    want = [None if row is None else [None if w is None else cut(w) for w in row] for row in lists.to_pylist()]
    assert [row for part in parts for row in part.to_pylist()] == want
    ids = {t: k for k, t in enumerate({t for row in want if row for w in row if w for t in w})}
    both = [row for part in bpe.encoded_lists(iter([lists[:9], lists[9:]]), cut, ids, kept=20, at_once=15) for row in part.to_pylist()]
    assert both == [None if row is None else [None if w is None else [{"token": t, "id": ids[t]} for t in w] for w in row] for row in want]
