import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{id: smallest id reachable} by comparing all pairs."""
    up = {i: i for i in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "ONE two three", "É é É é", "a b c a b c a b c", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("members", [simhash.NODE_MEMBERS, 5])
def test_links_join_the_same_components_as_all_pairs(spark, members):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    codes = set(base)
    for code in base[:25]:
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    signed = {int(np.uint64(c).view(np.int64)): c for c in codes}
    prints = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.near_links(prints, node_members=members)).collect()}
    assert {s: got.get(s, s) for s in signed} == plain_components(signed)


def test_dense_cluster_in_one_node_is_walked_in_parts():
    rng = np.random.default_rng(1)
    codes = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 40, (3000, 3)).astype(np.uint64), axis=1))
    order = np.argsort(simhash.gray_rank(codes))
    label = simhash.GrayIndex(codes[order], np.zeros(len(codes))).forest(3, most=5000)
    assert set(label) == {0}


def test_chain_and_hub_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    got = simhash.simhash_components(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(got) == len(texts)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None, 1, 2), (3, "", 1, 2), (3, "", 1, 2), (9, "a b c d", 1, 2), (None, "a b c d", 1, 2), (None, "only null", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int")
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str)
    assert [(r[0], r[2]) for r in got if r[1] == "0" * 16] == [(3, 3), (3, 3), (5, 3)]
    assert {r[2] for r in got if r[0] in (9, None)} == {9, None}
    assert simhash.simhash_components(docs.where(F.lit(False))).collect() == []


def test_first_documents_keep_a_row_of_each_component(spark):
    rows = [(5, "alpha beta gamma", "x"), (5, "quite another text here", "x"), (3, "alpha beta gamma", "y"), (3, "alpha beta gamma", "x"), (None, "no id at all", "z"), (None, "no id at all", "z"), (None, "alpha beta gamma", "z"), (9, None, "n"), (8, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("h", F.lit(1)).withColumn("_hot", F.lit(2))
    made = simhash.first_documents(docs.repartition(5))
    assert made.columns == docs.columns
    got = {(r.doc_id, r.text, r.row) for r in made.collect()}
    assert got == {(3, "alpha beta gamma", "x"), (5, "quite another text here", "x"), (None, "no id at all", "z"), (8, "", "n")} and made.count() == 4
    assert simhash.first_documents(docs.where("false")).collect() == []


def test_hot_fingerprints_are_looked_up_alike(spark, monkeypatch):
    rows = [(i, "same words in every one" if i % 3 else f"text number {i} stands alone {i * i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, simhash.simhash_components(docs).collect()))
    monkeypatch.setattr(simhash, "HOT", 8)
    assert sorted(map(tuple, simhash.simhash_components(docs).collect())) == want and len(want) == 300
