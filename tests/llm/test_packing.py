import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wordloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "It's I'LL we've 'S x'tx", "ÀÉ ß÷×µªº", "İstanbul ΣΑΣ é é", "a b c\x85\x1c d", "<|endoftext|> <| x", "1234 ½²", "𝒳 漢字 ", "a" * 3000, "!?!''''s\t\r\n\x0b\x0c~\x7f", "don't DON'T 'Re"]


def test_encoder_equals_the_library():
    tok, own = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(5)
    alphabet = "abcXYZ 'stdlrevm0123.,;!\n\téÉßÖ÷-_<|"
    texts = [*ODD, *("".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000))]
    for text, ids in zip(texts, own.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED", 10)
    monkeypatch.setattr(packing, "_RUN", 1)
    own, tok = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"word{i} next{i} the end's {i}" for i in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, capacity):
    """Sequences are gapless from 0 and within the capacity."""
    made = defaultdict(list)
    for length, sequence, offset in rows:
        made[sequence].append((offset, length))
    for parts in made.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(made)


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [min(capacity, max(1, int(rng.expovariate(1 / rng.choice([3, 20, 60]))))) for _ in range(rng.choice([1, 50, 900]))]
    plan, rank, rows = packing.plan(Counter(lengths), capacity), Counter(), []
    for x in lengths:
        s, o = plan.place(np.array([x]), np.array([rank[x]]))
        rank[x] += 1
        rows.append((x, int(s[0]), int(o[0])))
    assert check(rows, capacity) == plan.sequences <= first_fit_decreasing(lengths, capacity) * 1.02 + 1


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, tok = {r.doc_id: r.text for r in docs.collect()}, Tokenizer.from_file(PATH)
    got = packing.best_fit_packing(docs, PATH).collect()
    want = []
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = check([(r.length, r.sequence_id, r.offset) for r in got], 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, 3), (1, None, 3), (None, "", 3), (2, "a b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.best_fit_packing(docs, PATH).collect()
    assert sorted(r.length for r in got) == [1, 1, 1, 3] and check([(r.length, r.sequence_id, r.offset) for r in got], 2048) == 1
    assert packing.best_fit_packing(docs.where("false"), PATH).collect() == []


def test_other_tokenizer_files_are_encoded_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), ["Some words, it's 12 of them", "", "  two  blanks "]
    encoder = packing.Encoder(path)
    assert not encoder.split and packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).split
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
