"""Each stage on its own input, against a brute-force version of what it has to keep."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_packing import check as check_sequences
from tests.llm.test_simhash import plain_components, plain_fingerprint
from wordloom.llm import mixing


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language_keeps_clean_documents(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert set(after) == {i for i, r in before.items() if any(map(str.isalpha, r.text))}
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.97 * len(after)


def test_dedup_keeps_the_first_of_each_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    groups = plain_components({i: plain_fingerprint(t) for i, t in before.items()})
    assert set(after) == set(groups.values()) and all(after[i] == before[i] for i in after)


def test_secrets_are_redacted(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sure = re.compile(r'(?<=token = ")[0-9a-f]{40}(?=")|(?<=password=)[0-9a-f]{18}\b|\bAKIA[A-Z0-9]{16}\b')
    assert after == {i: sure.sub("[SECRET]", t) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_mix_takes_what_the_operator_says(stages):
    want = {r.doc_id: r.taken for r in mixing.mix(stages[3]).collect() if r.taken}
    got = Counter()
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.split())
    assert dict(got) == want


def test_packing_holds_every_token(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, min(2048, n - at)) for k, at in enumerate(range(0, n, 2048)))
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in rows) == want
    n = check_sequences([(r.length, r.sequence_id, r.offset) for r in rows], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_run_gives_the_last_stage(spark, stages):
    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(made.collect()) == key(stages[5].collect())


def test_odd_rows(spark, tmp_path):
    rows = [(None, "the cat", "en", None, 7), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, "the cat sat", "en", "b", 11), (4, "the cat sat", "en", "b", 11), (None, "the dog ran off", "en", None, 15)] * 2
    docs, made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), defaultdict(int)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for what, df in (("rows", docs), ("none", docs.where("false"))):
            df.write.mode("overwrite").parquet(str(tmp_path / f"in{k}"))
            out = stage(spark, spark.read.parquet(str(tmp_path / f"in{k}")), "")
            made[name, what] = out.count()
    assert all(n == 0 for (_, what), n in made.items() if what == "none")
    assert made["simhash near-dedup", "rows"] == len({plain_fingerprint(r[1]) for r in rows})
    assert np.all([made[name, "rows"] == len(rows) for name in ("secret scan", "best-fit packing")])


def test_clashing_columns_and_very_long_texts(spark, tmp_path):
    """Every stage on columns that bear the names it works with, on a text of 200,000 words, and on rows that repeat a doc_id."""
    long = "the cat sat on the mat with words " * 25000
    rows = [(1, long, "en", "a", len(long)), (1, "another text of the same number here", "en", "a", 36), (2, "password=b7db7aa4a5fcc78305 is what the cat said to the dog", "en", "b", 59), (2, "password=b7db7aa4a5fcc78305 is what the cat said to the dog", "en", "b", 59), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_key", "_uid", "uid", "row", "h", "late", "id", "findings", "between", "slot", "turn", "words", "_chunk", "lang_pred2", "piece2"):
        docs = docs.withColumn(name, docs.doc_id)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / f"in{k}"))
        out = stage(spark, spark.read.parquet(str(tmp_path / f"in{k}")), "").collect()
        if name == "language id":
            assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} and {r.doc_id for r in out} <= {1, 2}
        elif name == "simhash near-dedup":
            assert sorted((r.doc_id, r.n_chars or 0, r.uid) for r in out) == [(1, 36, 1), (1, len(long), 1), (2, 59, 2), (3, 0, 3)]
        elif name == "secret scan":
            assert len(out) == 5 and [r.text for r in out if r.doc_id == 2] == ["password=[SECRET] is what the cat said to the dog"] * 2 and all(r.h == r.doc_id for r in out)
        elif name == "source mixing":
            assert sum(len(r.text.split()) for r in out if r.n_chars and r.source == "b") > 0 and all(r.slot == r.doc_id for r in out)
        else:
            assert {r.doc_id for r in out} == {1, 2, 3}
