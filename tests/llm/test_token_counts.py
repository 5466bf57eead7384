import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


ODD = ["", " ", "  \n x", "it's we'll 'S'", "a b  c", "漢字 𝒳 é́", "<|endoftext|> x", "1234,5 ½", "\n\n\n", "x" * 500]


def test_counts_equal_the_library(whole):
    for text in ODD:
        assert tc.Tree.of(text, tc.counter(PATH)).tokens == whole(text), text


def test_pieces_partition_the_text():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices("ab '\n\t1, é𝒳\x1c", k=rng.randint(0, 40)))
        assert "".join(tc.PRE_TOKEN.findall(text)) == text


@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_random_edits_equal_encoding_anew(monkeypatch, leaf):
    monkeypatch.setattr(tc, "LEAF", leaf)
    rng, count = random.Random(leaf), tc.counter(PATH)
    for _ in range(400):
        text = "".join(rng.choices("ab  '\nst1,é", k=rng.randint(0, 60)))
        tree = tc.Tree.of(text, count)
        for _ in range(6):
            start = rng.randint(0, len(text))
            end = min(len(text), start + rng.choice([0, 0, 1, 2, 9, 60]))
            new = "".join(rng.choices("ab  '\ns1,", k=rng.choice([0, 1, 2, 15])))
            text, _ = tree.edit(text, start, end, new, count)
            fresh = tc.Tree.of(text, count)
            assert [x for r in tree.lens for x in r] == [x for r in fresh.lens for x in r]
            assert (tree.tokens, tree.characters) == (fresh.tokens, len(text))
            assert all((a == b).all() for a, b in zip(tree.sums, tc.Tree(tree.lens, tree.counts).sums, strict=True))
        assert tc.Tree.from_bytes(tree.to_bytes()).lens == tree.lens


def test_an_edit_of_a_long_text_encodes_little():
    text, count = "some words here and " * 20000, tc.counter(PATH)
    tree = tc.Tree.of(text, count)
    _, again = tree.edit(text, 200001, 200004, "new", count)
    assert again < 8


def test_query_equals_brute_force(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in docs.withColumn("edits", tc.revision(F.col("text"), F.col("doc_id"))).collect()}
    got = tc.edited_token_counts(docs, PATH).collect()
    assert len(got) == len(rows)
    long = [(r.n_reencoded, len(tc.PRE_TOKEN.findall(rows[r.doc_id].text))) for r in got if len(rows[r.doc_id].text) > 2000]
    assert len(long) > 20 and sum(a for a, _ in long) < 0.1 * sum(b for _, b in long)  # the kept trees are reused
    for r in got:
        text = rows[r.doc_id].text
        assert r.n_tokens == whole(text)
        for e in rows[r.doc_id].edits:
            text = text[: e.start] + e.replacement + text[e.start + e.length :]
        assert r.n_tokens_edited == whole(text)


def test_trees_and_edits_as_tables(spark, whole):
    docs = spark.createDataFrame([(1, "hello there world", "x"), (2, None, "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, tokens string")
    trees = tc.build_trees(docs, PATH)
    assert trees.columns == ["tree", "n_tokens", "doc_id", "text", "tokens"]
    schema = "array<struct<start:int,length:int,replacement:string>>"
    edits = F.when(F.col("doc_id") == 1, F.expr("array(named_struct('start', 5, 'length', 6, 'replacement', ' dear'), null, named_struct('start', 99, 'length', null, 'replacement', null))")).otherwise(F.lit(None)).cast(schema)
    made = tc.apply_edits(trees.withColumn("edits", edits), PATH).collect()
    assert {(r.doc_id, r.new_text) for r in made} == {(1, "hello dear world"), (2, ""), (None, "")} and len(made) == 4
    assert all(r.new_n_tokens == whole(r.new_text) for r in made)
    assert tc.edited_token_counts(docs.where("false"), PATH).collect() == []
    assert len(tc.edited_token_counts(docs, PATH).collect()) == 4


def test_a_file_that_splits_otherwise_is_refused():
    with pytest.raises(ValueError, match="does not split"):
        tc.counter(public_tokenizers.path("word_bpe_49k.json"))
