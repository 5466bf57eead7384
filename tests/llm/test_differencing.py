import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wordloom.llm import differencing as packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_differencing(sizes, k):
    """Sums of the windows by the method on full tuples, without any shared parts."""
    parts = [sorted([s] + [0] * (k - 1), reverse=True) for s in sizes]
    age = list(range(len(parts)))
    turn = len(parts)
    while len(parts) > 1:
        def rank(i):
            return (-(parts[i][0] - parts[i][-1]), age[i])
        a, b = sorted(range(len(parts)), key=rank)[:2]
        merged = sorted((x + y for x, y in zip(parts[a], reversed(parts[b]))), reverse=True)
        keep = [i for i in range(len(parts)) if i not in (a, b)]
        parts, age = [parts[i] for i in keep] + [merged], [age[i] for i in keep] + [turn]
        turn += 1
    return sorted(parts[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 8))
def test_windows_are_those_of_the_plain_method(sizes, k):
    window = packing.differenced(np.array(sizes, np.int64), k)
    assert sorted(np.bincount(window, sizes, k).astype(int).tolist()) == plain_differencing(sizes, k)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_sequences_hold_each_place_once_and_need_no_padding(sizes):
    made = packing.filled(np.array(sizes, np.int64), 64)
    seen = defaultdict(list)
    for sequence in made:
        total = sum(b - a for _, a, b in sequence)
        assert total == 64 or total & (total - 1) == 0 and 0 < total < 64
        for item, a, b in sequence:
            assert a < b
            seen[item].append((a, b))
    for item, size in enumerate(sizes):
        ends = sorted(seen[item])
        assert ends[0][0] == 0 and ends[-1][1] == size and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
    assert sum(1 for s in made if sum(b - a for _, a, b in s) < 64) <= 6


@pytest.mark.parametrize("sizes", [[2100] * 300, [4095] * 40, [4096] * 3, [1] * 5000, [4000, 97] * 100])
def test_awkward_lengths(sizes):
    sizes = np.array(sizes, np.int64)
    window, k = packing.near_equal(sizes, 4096)
    assert np.bincount(window, sizes, k).max() <= 4096
    totals = [sum(b - a for _, a, b in s) for s in packing.filled(sizes, 4096)]
    assert sum(totals) == sizes.sum() and sum(t == 4096 for t in totals) == sizes.sum() // 4096


def test_few_documents_are_cut():
    sizes = np.random.default_rng(1).integers(1, 2000, 1500)
    whole = sum(b - a == sizes[i] for s in packing.filled(sizes, 4096) for i, a, b in s)
    assert whole > 0.96 * len(sizes)


def held(rows, texts, capacity=4096):
    """Every id of every document lies in one piece, sequences are gapless, and none needs padding."""
    library = Tokenizer.from_file(PATH)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for found, want in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for key, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == want[key] if want else at == capacity or at & (at - 1) == 0


def test_query_packs_every_id_once(spark, sf_dir):
    from wordloom.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    held(queries.queries()["op13_differencing_packing"](spark, sf_dir).collect(), texts)


def test_odd_rows(spark):
    long = "words of a very long text, again and again; " * 3000
    texts = {1: None, 2: "", 3: " \n ", 4: long, 5: "Ünïcödé  <|endoftext|> 中文 abc", 6: "x", 7: long[:-30]}
    docs = spark.createDataFrame([(i, t, 1, "s", 0) for i, t in texts.items()], "doc_id long, text string, offset int, sequence_id string, length int")
    held(packing.differencing_packing(docs, PATH).collect(), texts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 3 + [(1, "same text")] * 4 + [(1, None)], "doc_id long, text string").coalesce(1)
    rows = packing.differencing_packing(docs, PATH).collect()
    assert sum(r["length"] for r in rows) == 3 * 4 + 4 * 3 + 1 and sum(r["length"] for r in rows if r["doc_id"] is None) == 12
    assert packing.differencing_packing(docs.where("false"), PATH).collect() == []


def test_ids_of_pieces_are_those_of_their_document(spark):
    texts = {i: f"{'word ' * (i * 7)} end {i}" for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    library, found = Tokenizer.from_file(PATH), defaultdict(list)
    for r in packing.near_equal_windows(docs, PATH, capacity=64, end_id=7, group_windows=4).collect():
        found[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, t in texts.items():
        assert [x for _, part in sorted(found[i]) for x in part] == [*library.encode(t, add_special_tokens=False).ids, 7]


def test_partitions_number_their_sequences_apart(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id long, text string").repartition(7)
    rows = packing.differencing_packing(docs, PATH).collect()
    held(rows, {i: "some words here" for i in range(50)})
    assert len({r["sequence_id"] >> 40 for r in rows}) > 1
