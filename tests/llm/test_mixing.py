import hashlib
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from wordloom.llm import mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / (sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def plain_mix(rows, slots=mixing.SLOTS, golden=mixing.GOLDEN):
    """Rows (doc_id, text, source) -> (doc_id, size, source_size, target, taken, first_slot, n_slots), by loops."""
    lines, sizes = defaultdict(list), defaultdict(int)
    for i, text, source in rows:
        n = len((text or "").split())
        lines[source].append((hashlib.md5(f"{'null' if i is None else i}:{text or ''}".encode()).hexdigest(), i, n))
        sizes[source] += n
    targets = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    quota = {s: min(2 * sizes[s], int(targets[s] + 1e-6)) for s in order}
    line = sum(quota.values())
    block = max(1, -(-line // max(slots, mixing.SLOTS_PER_SOURCE * len(order))))
    owner = [s for s in order for _ in range(quota[s])]
    slot_of = defaultdict(list)
    for i in range(-(-line // block)):
        slot_of[owner[i * golden % mixing.POINTS * line // mixing.POINTS]].append(i)
    out = []
    for s in order:
        played, begin = min(2 * sizes[s], block * len(slot_of[s])), 0
        for _, i, n in sorted(lines[s], key=lambda x: x[0]):
            spans = [(lo, min(lo + n, played)) for lo in (begin, begin + sizes[s]) if n and lo < played]
            places = [slot_of[s][lo // block] for lo, _ in spans]
            out.append((i, n, sizes[s], targets[s], sum(hi - lo for lo, hi in spans), min(places, default=None), sum((hi - 1) // block - lo // block + 1 for lo, hi in spans)))
            begin += n
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:3]), *map(str, r[4:]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-6 * max(1, b[3]) for a, b in zip(got, want, strict=True))


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("slots", [mixing.SLOTS, 1000])
def test_whole_table_equals_plain_loops_and_repeats(spark, slots):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixing.mix(docs, slots).collect()
    same(got, plain_mix(rows_of(docs), slots))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), slots).collect()))
    with pytest.raises(AssertionError):  # the schedule decides: another sequence, another mix
        same(got, plain_mix(rows_of(docs), slots, golden=3))


def test_taken_words_come_near_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, want = defaultdict(int), {}
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        taken[r.source] += r.taken
        want[r.source] = r.target
    assert all(abs(taken[s] - want[s]) <= 8 for s in want)  # blocks of one word at this size


def test_small_and_odd_sources(spark):
    rows = [(1, "a b c", "a"), (2, "x " * 9000, "b"), (3, None, None), (4, "q", None), (5, "", "c"), (5, "", "c"), (None, "m n", "a"), (None, "m n", "a"), (6, "z " * 500, ""), (7, "k l", "b"), (7, "o p", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1)).withColumn("uid", F.lit(2)).withColumn("row", F.lit(3))
    for slots in (mixing.SLOTS, 64):
        same(mixing.mix(docs, slots).collect(), plain_mix(rows, slots))
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns and all((r.target, r.uid, r.row) == (1, 2, 3) for r in made.collect())
    assert mixing.mix(docs.where("false")).collect() == [] and mixing.mixed_documents(docs.where("false")).collect() == []


@pytest.mark.parametrize("quota", [[3000, 1000, 96000, 0], [1, 7, 13, 10**6], [33333] * 30])
def test_every_prefix_of_the_schedule_holds_the_shares(spark, quota):
    targets = spark.createDataFrame(list(enumerate(quota)), "source_id long, quota long")
    made, block, n = mixing.schedule(targets, 50_000)
    got = sorted((r.slot, r.source_id, r["rank"]) for r in made.collect())
    assert [g[0] for g in got] == list(range(n)) and n == -(-sum(quota) // block)
    count = dict.fromkeys(range(len(quota)), 0)
    for slot, source, rank in got:
        assert rank == count[source]
        count[source] += 1
        if slot % 997 == 0 or slot == len(got) - 1:
            assert all(abs(count[s] - (slot + 1) * q / sum(quota)) < 8 for s, q in enumerate(quota))


def test_mixed_documents_hold_what_is_taken_in_slot_order(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert {r.doc_id for r in mixing.mixed_documents(docs.select("*")).collect()} == {r.doc_id for r in mixing.mixed_documents(docs).collect()}  # numbered, and by place
    first = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(docs).collect()}
    made = mixing.mixed_documents(docs)
    # Another cut of the files between the reads must not change which row is which.
    for key, value in (("spark.sql.files.minPartitionNum", "23"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(key, value)
    try:
        got = made.collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert made.columns == docs.columns
    words, whole, seen = defaultdict(int), {r.doc_id: r.text for r in docs.collect()}, {}
    for r in got:
        words[r.doc_id] += len(r.text.split())
        seen.setdefault(r.doc_id, first[r.doc_id][1])
        assert whole[r.doc_id].startswith(r.text.rstrip()) and r.n_chars == len(r.text)
    assert dict(words) == {i: n for i, (n, _) in first.items() if n}
    assert list(seen.values()) == sorted(seen.values())
