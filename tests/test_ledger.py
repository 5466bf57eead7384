"""Ledger analytics, searches, readers and writers."""

import json
import math
import random
import statistics
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from wordloom.operators import bpe, corpus, ledger, runs, search, train
from wordloom.plans import ledger_queries
from wordloom.sources import readers, run_log, sinks

def made_runs():
    """A ledger of eight stages: three languages or four, some runs with held-out results, weights that come again."""
    rng, runs = random.Random(6), []
    for stage, fourth in (("B-3lang", None), ("B-ur", "ur"), ("B-ml", "ml"), ("B-test", "ur"), ("C-few", "ur"), ("C-more", "ur"), ("D-sweep", "ur"), ("D-ft1", "ur")):
        langs = ["en", "hi", "te", *([fourth] if fourth else [])]
        for k in range(9):
            part = lambda scale: {x: {"tokens": 10, "words": 5, "fertility": scale * rng.uniform(1.3, 1.6), "akshara_violations": rng.randint(0, 3)} for x in langs}  # noqa: B023, E731
            ev, held = part(1), part(1.5) if k % 4 == 3 and stage != "B-ml" else {}
            f = [m["fertility"] for m in ev.values()]
            result = {"langs": langs, "eval": ev, "heldout": held, "max_fertility": max(f), "min_fertility": min(f), "spread": max(f) - min(f), "score": 1000 / (max(f) - min(f))}
            if held:
                result["heldout_max"] = max(m["fertility"] for m in held.values())
            weights = {f"{x}.eval": float(k // 2) + 1 for x in langs} if k % 2 else {f"{x}.eval": k // 2 + 1.0 for x in reversed(langs)}
            runs.append({"id": f"{stage}-{k + 1:03d}", "stage": stage, "time": f"2026-01-{k + 1:02d}T00:00:00", "langs": langs, "config": {"vocab_size": 1000, "akshara_min": 3000 if k % 2 else 1e15}, "weights": weights, "info": {"n_base_chars": 3, "n_stage1": 2, "n_learned": 1}, "result": result, "tokenizer_sha256": f"{k % 5}", "note": f"sweep x{k + 1}"})
    return runs


@pytest.fixture(scope="module")
def shipped(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ledger")
    for stage in {r["stage"] for r in made_runs()}:
        (folder / f"{stage}.jsonl").write_text("\n\n".join(json.dumps(r) for r in made_runs() if r["stage"] == stage) + "\n")
    return readers.ledger(spark, *(str(p) for p in sorted(folder.glob("*.jsonl")))).cache()


def plain_rows():
    stages = {}
    for r in made_runs():
        stages.setdefault(r["stage"], []).append(r)
    out = {}
    for stage, runs in stages.items():
        best = min(runs, key=lambda r: r["result"]["spread"])
        same = [r for r in runs if r["result"]["heldout"] and r["weights"] == best["weights"]] or [r for r in runs if r["result"]["heldout"]]
        held = same[-1]["result"] if same else None
        mean = lambda part: statistics.mean(part[x]["fertility"] for x in best["langs"])  # noqa: B023, E731
        out[stage] = (best["id"], len(runs), mean(best["result"]["eval"]), held and held["heldout_max"], held and mean(held["heldout"]))
    return out


def test_stage_rows_equal_plain_python(shipped):
    got, want = {r.stage: r for r in ledger.stage_rows(shipped).collect()}, plain_rows()
    assert set(got) == set(want) and shipped.count() == sum(w[1] for w in want.values())
    for stage, (run, n, level, held, mean) in want.items():
        r = got[stage]
        assert (r.best_id, r.runs) == (run, n) and math.isclose(r.level, level)
        assert (r.heldout is None and held is None) or (math.isclose(r.heldout, held) and math.isclose(r.heldout_mean, mean))


def test_report_tables(spark, shipped):
    pages = spark.createDataFrame([("ur", "Urdu", 3486), ("ml", "Malayalam", 1999)], "lang string, name string, words int")
    rows = ledger.fourth_language_rows(shipped, pages)
    got, want = {r.stage: r for r in rows.collect()}, plain_rows()
    assert set(got) == {"B-3lang", "B-ur", "B-ml"} and got["B-ml"].eligible is False and got["B-ur"].eligible and got["B-3lang"].name == "none"
    table = ledger.markdown(rows.where("stage in ('B-ur', 'B-3lang')"), [("name", "4th", None), ("words", "page words", "%,d"), ("level", "mean", "%.4f")])
    assert f"| none | — | {want['B-3lang'][2]:.4f} |" in table and f"| Urdu | 3,486 | {want['B-ur'][2]:.4f} |" in table
    names = spark.createDataFrame([("C-few", "few", ""), ("C-more", "more", "could not be balanced"), ("B-ur", "ref", "stage B")], "stage string, name string, note string")
    named = {r.stage: r for r in ledger.ablation_rows(shipped, names, final="C-few").collect()}
    assert set(named) == {"C-few", "C-more", "B-ur"} and [s for s, r in named.items() if r.chosen] == ["C-few"]
    assert named["C-more"].note == "could not be balanced" and named["B-ur"].note == f"stage B; best spread only {named['B-ur'].spread:.3f}"
    assert all(r.level == r.max for r in named.values())


def test_tradeoff_and_trace(shipped):
    points = ledger.tradeoff(shipped, "D-sweep").collect()
    runs = [r for r in made_runs() if r["stage"] == "D-sweep"]
    assert [(p.weight, p.own) for p in points] == [(k + 1.0, r["result"]["eval"]["en"]["fertility"]) for k, r in enumerate(runs)]
    assert all(p.worst_other == max(m["fertility"] for x, m in r["result"]["eval"].items() if x != "en") for p, r in zip(points, runs, strict=True))
    within = ledger.first_within(ledger.tradeoff(shipped, "D-sweep"), 1.4).collect()
    assert [p.id for p in within] == [p.id for p in points if p.own <= 1.4][:1]
    steps = ledger.trace(shipped.withColumn("spread", F.col("result.spread")), (F.col("stage") == "C-few") | F.startswith("stage", F.lit("D-ft"))).orderBy("step").collect()
    best = [r.best for r in steps]
    assert best == sorted(best, reverse=True) and len(steps) == 18 and [r.id for r in steps[:2]] == ["C-few-001", "D-ft1-001"]
    assert ledger.last_noted(shipped, "D-sweep", "sweep").first().id == "D-sweep-009"
    assert shipped.select(F.countDistinct("tokenizer_sha256")).first()[0] == 5


def test_held_out_falls_back_to_the_last_run(spark):
    runs = spark.createDataFrame([("s", 1, "k1", 0.5, 1.1), ("s", 2, "k2", 0.1, None), ("s", 3, "k3", 0.2, 2.2), ("t", 1, "k", 0.1, None), ("u", 1, "k", 0.3, 7.0), ("u", 2, "k", 0.3, 8.0)], "stage string, seq int, key string, spread double, h double")
    got = {r.stage: (r.seq, r.held) for r in ledger.with_heldout(ledger.best_runs(runs), runs, "key", F.col("h")).collect()}
    assert got == {"s": (2, 2.2), "t": (1, None), "u": (1, 8.0)}


def test_equal_maps_share_a_key(spark):
    rows = spark.sql("select map('a', 1.0d, 'b', 2.0d) as m union all select map('b', 2.0d, 'a', 1.0d)")
    assert rows.select(ledger.canonical(F.col("m")).alias("k")).distinct().count() == 1


def test_run_line_and_ids(spark):
    row = spark.sql("select map('en', 1.5d) as f").select(ledger.run_line(F.col("f"), F.lit(0.25), F.lit(4000.0)).alias("r")).first()
    assert row.r == "en 1.5000  spread 0.25000  score 4,000.0"
    ids = ledger.next_ids(spark.createDataFrame([(None, 1), ("B", 1), ("B", 2)], "stage string, seq int")).collect()
    assert {r.run_id for r in ids} == {"E0001", "B-001", "B-002"}


def answer(multipliers):
    """Fertility falls with a language's share of the weight."""
    total = sum(multipliers.values())
    return {x: (2.0 + 0.3 * i) * (multipliers[x] / total) ** -0.2 for i, x in enumerate(sorted(multipliers))}


def test_balancing_closes_the_spread():
    records = search.balance(answer, ["a", "b", "c"], rounds=30)
    best = min(records, key=lambda r: r["objective"])
    assert best["improved"] and best["objective"] < 1e-3 < records[0]["objective"]
    pinned = search.balance(answer, ["a", "b", "c"], rounds=40, fixed={"a": 2.9})
    assert abs(min(pinned, key=lambda r: r["objective"])["fertility"]["a"] - 2.9) < 0.02
    assert search.balance(answer, ["a"], rounds=3, fixed={"a": 2.0})[0]["objective"] == 0.0


def test_feedback_learns_the_response_and_adapts_the_gain():
    goal = search.Goal.of(["a", "b"])
    begin = search.Feedback(goal, np.full(2, -0.15))
    first = begin.observe(search.Point(np.zeros(2), np.log([2.0, 3.0]), 1.0))
    assert first.gain == 0.8 and np.allclose(first.response, -0.15)
    step = first.propose()
    assert step[1] > 0 > step[0] and np.isclose(step.sum(), 0) and np.isclose(step[1] - step[0], 2 * min(1.0, 0.8 * np.log(1.5) / 2 / 0.15))
    worse = first.observe(search.Point(step, np.log([2.0, 3.0]) - 0.4 * step, 1.5))
    assert np.allclose(worse.response, (-0.15 - 0.4) / 2) and worse.gain == 0.4 and worse.best is first.points[0]
    still = worse.observe(search.Point(step, np.log([2.0, 2.0]), 0.5))  # nothing moved, so nothing is learned
    assert np.allclose(still.response, worse.response) and still.gain == 0.5


def test_climbing_improves_and_repeats():
    a, b = (search.climb(answer, ["a", "b"], 25, seed=4) for _ in range(2))
    assert a == b and len(a) == 26 and min(r["objective"] for r in a) < a[0]["objective"]
    sigmas, fails = [0.01], 0
    for r in a[1:]:
        assert np.isclose(r["sigma"], sigmas[-1])
        fails = 0 if r["improved"] else fails + 1
        if fails == 3:
            sigmas, fails = [*sigmas, max(sigmas[-1] * 0.6, 2e-4)], 0
    assert search.make_weights({"en": 2.0}, 3.0, 0.0) == {"en.eval": 6.0}


def local_trial(words, n_merges):
    """A trial over (lang, word, n) by plain loops."""
    def measure(multipliers):
        mass, tokens, totals = Counter(), Counter(), Counter()
        for lang, w, n in words:
            mass[w] += n * round(multipliers[lang] * 1_000_000)
            totals[lang] += n
        ranks = {(a, b): k for k, (a, b, _) in enumerate(bpe.learned([(list(w), mass[w]) for w in sorted(mass)], n_merges))}
        for lang, w, n in words:
            tokens[lang] += n * len(bpe.segmented(list(w), ranks))
        return {lang: tokens[lang] / totals[lang] for lang in totals}

    return measure


def test_chains_equal_climbs_over_plain_trials(spark):
    words = [("en", w, 5) for w in ("▁the", "▁then", "▁there")] + [("de", w, 3) for w in ("▁der", "▁das", "▁dem", "▁the")]
    made = search.chains(spark.createDataFrame(words, "lang string, word string, n long"), [1, 2], 2, 5).collect()
    for seed in (1, 2):
        want = search.climb(local_trial(words, 5), ["de", "en"], 2, seed)
        own = sorted((r for r in made if r.seed == seed), key=lambda r: r.trial)
        assert [(r.trial, r.improved) for r in own] == [(r["trial"] - 1, r["improved"]) for r in want]
        assert np.allclose([r.spread for r in own], [r["objective"] for r in want])


def test_trials_agree_and_balance_counts(spark):
    words = [("en", w, 5) for w in ("▁the", "▁then", "▁there")] + [("de", w, 3) for w in ("▁der", "▁das", "▁dem", "▁the")]
    near, far = local_trial(words, 5), search.spark_trial(spark.createDataFrame(words, "lang string, word string, n long"), 5)
    for weights in ({"en": 1.0, "de": 1.0}, {"en": 0.2, "de": 5.0}):
        assert near(weights) == pytest.approx(far(weights))


def test_sweep_moves_the_weighted_language(spark):
    words = spark.createDataFrame([("en", w, 5) for w in ("▁the", "▁then", "▁there")] + [("de", w, 5) for w in ("▁der", "▁das", "▁dem")], "lang string, word string, n long")
    got = {(r.weight, r.lang): r.fertility for r in search.sweep(words, [0.1, 10.0], "en", 4).collect()}
    assert got[10.0, "en"] < got[0.1, "en"] and got[10.0, "de"] > got[0.1, "de"]


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("1", "t", "a  b\n", "en", "train"), ("2", "u", "क्ष", "hi", "heldout")], "id string, title string, text string, lang string, split string")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    back = {(r.id, r.lang, r.split): r.text for r in readers.documents(spark, str(tmp_path / "docs")).collect()}
    assert back == {("1", "en", "train"): "a b", ("2", "hi", "heldout"): "क्ष"}
    assert readers.documents(spark, str(tmp_path / "docs"), max_words=1).count() == 2
    vocab = spark.createDataFrame([(0, "<unk>", "special"), (1, "a", "char"), (2, "b", "char"), (3, "ab", "learned")], "id long, token string, kind string")
    merges = spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string")
    sinks.write_tokenizer(vocab, merges, str(tmp_path / "tok"))
    for spelled in ('["a", "b"]', '"a b"'):
        (tmp_path / "t.json").write_text('{"normalizer": null, "pre_tokenizer": {"type": "Metaspace"}, "post_processor": null, "decoder": null, "model": {"type": "BPE", "vocab": {"a": 1, "<unk>": 0, "b": 2, "ab": 3}, "merges": [%s], "unk_token": "<unk>", "byte_fallback": false}}' % spelled)
        v, m, head = readers.tokenizer_tables(spark, str(tmp_path / "t.json"))
        assert sinks.same_rows(v, vocab.select("id", "token")) and [tuple(r) for r in m.collect()] == [(0, "a", "b")]
    assert sinks.tokenizer_sha(vocab, merges).first().sha256 == sinks.tokenizer_sha(vocab.repartition(3), merges).first().sha256
    (tmp_path / "bad.json").write_text('{"normalizer": {"type": "Lowercase"}, "post_processor": {"type": "X"}, "model": {"type": "BPE", "vocab": {}, "merges": []}}')
    with pytest.raises(ValueError, match="post-processor; normalizer Lowercase"):
        readers.tokenizer_tables(spark, str(tmp_path / "bad.json"))


def test_more_files(spark, tmp_path):
    (tmp_path / "en.txt").write_text("a\nb\n\n", encoding="utf-8")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path / "en.txt")).collect()] == [("en", "a\nb")]
    (tmp_path / "c.json").write_text(json.dumps({"langs": ["en"], "weights": {"en.x.eval": 1.5, "hi.train": 2}}))
    assert {tuple(r) for r in readers.weights(spark, str(tmp_path / "c.json")).collect()} == {("en.x", "eval", 1500000), ("hi", "train", 2000000)}
    runs = spark.createDataFrame([("a", 1)], "id string, n int")
    for _ in range(2):
        sinks.append_runs(runs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 2
    tokens = sinks.token_list(spark.createDataFrame([(0, 'q"', None, None), (1, "ab", "a", "b")], "id long, token string, left string, right string")).orderBy("id").collect()
    assert [(r.token_json, r.built_from_json) for r in tokens] == [('"q\\""', ""), ('"ab"', '["a","b"]')]


def test_split_and_exclusion(spark):
    docs = spark.createDataFrame([("en", str(i), f"t{i}", "w " * 25 if i % 7 else "short") for i in range(60)], "lang string, id string, title string, text string")
    got = readers.heldout_and_train(docs, spark.createDataFrame([("t1",)], "title string"), {"train": 300, "heldout": 60}).collect()
    assert {r.split for r in got} == {"train", "heldout"} and all(r.title != "t1" and r.n_words >= 20 for r in got)
    assert 300 <= sum(r.n_words for r in got if r.split == "train") < 325


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    from wordloom.streaming.fertility import fertility, running_counts

    rows = spark.createDataFrame([(f"2026-01-01 00:0{i}:00", "en" if i % 2 else "de", "a bc " * i) for i in range(9)], "ts string, lang string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(spark.table("running")) == key(running_counts(rows))
    assert all(r.fertility > 2 for r in fertility(running_counts(rows)).collect())


def test_samples_and_links(spark):
    assert readers.sampled(spark.range(50), 7, 1).count() == 7
    pages = spark.createDataFrame([(1, '<a href="a"></a><a href="b"></a><a href="c"></a>')], "page_id long, html string")
    assert [(r.place, r.target) for r in readers.page_links(pages, 2).collect()] == [(0, "a"), (1, "b")]


def test_writers_at_once_share_no_id_and_failed_ones_leave_no_row(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert run_log.entries(spark, path).count() == 0
    parts = [spark.createDataFrame([(s, w * 100 + i) for i, s in enumerate(["B", None, "B", "C-x"] * 3)], "stage string, n int") for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda p: run_log.append(p, path), parts)) == [0, 1, 2, 3]
    broken = parts[0].withColumn("n", F.when(F.col("n") == 5, F.raise_error(F.lit("x")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="x"):
        run_log.append(broken, path)
    assert run_log.append(parts[0].where("false"), path) == 4
    got = run_log.read(spark, path).collect()
    assert sorted(r.run_id for r in got) == sorted([f"B-{i:03d}" for i in range(1, 25)] + [f"E{i:04d}" for i in range(1, 13)] + [f"C-x-{i:03d}" for i in range(1, 13)])
    own = [r for r in sorted(got, key=lambda r: r.run_id) if r.stage == "B"]  # in a writer's order, writer by writer
    assert all([r.n for r in own[k : k + 6]] == sorted(r.n for r in own[k : k + 6]) and len({r.n // 100 for r in own[k : k + 6]}) == 1 for k in range(0, 24, 6))


def test_grids_count_what_they_share_once(spark, monkeypatch):
    texts = spark.createDataFrame([("en", "s", "the cat and the hat sat; then the rat ran. " * 4), ("de", "s", "der Hund und der Hut und die Kuh " * 4)], "lang string, source string, text string")
    weights = spark.createDataFrame([("en", "s", 1_000_000), ("de", "s", 2_000_000), ("fr", "s", 0)], "lang string, source string, micro long")
    pages = texts.select("lang", "text")
    configs = {"a": train.Config(vocab_size=34), "b": train.Config(vocab_size=30), "c": train.Config(vocab_size=34, punctuation=True), "d": train.Config(vocab_size=30, alpha_min=3), "e": train.Config(vocab_size=290, byte_fallback=True)}
    calls, count = [], corpus.word_counts
    monkeypatch.setattr(corpus, "word_counts", lambda *a, **k: calls.append(k.get("punctuation")) or count(*a, **k))
    made = {r.stage: r for r in runs.grid(texts, weights, configs, pages).collect()}
    assert sorted(calls) == [False, False, True, True]  # texts and pages, for each way to cut words
    monkeypatch.undo()
    for name, config in configs.items():
        assert made[name].tokenizer_sha256 == runs.one_run(texts, weights, config, pages, name).first().tokenizer_sha256


def test_decimals_are_rounded_from_the_exact_value(spark):
    values = [6.5625, 0.0005, 1.0005, 2.5, 0.125, -0.0625, 1234567.8125, 0.0, 999.9996, 1e-9]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k")
    for digits in (0, 1, 3):
        lines = ledger.markdown(rows, [("v", "V", f"%,.{digits}f")]).splitlines()[2:]
        assert lines == [f"| {v:,.{digits}f} |" for v in values]
    odd = spark.createDataFrame([(1e20,), (float("nan"),), (None,)], "v double")
    assert ledger.markdown(odd, [("v", "V", "%.1f")]).splitlines()[2:] == ["| 100000000000000000000.0 |", "| NaN |", "| — |"]
    line = rows.where("k = 0").select(ledger.run_line(F.create_map(F.lit("a"), F.lit(0.00625)), F.lit(0.000125), F.lit(1.0)).alias("l")).first().l
    assert line == f"a {0.00625:.4f}  spread {0.000125:.5f}  score 1.0"


@pytest.mark.parametrize("name", ["ledger_run_lines", "ledger_languages_by_weight", "ledger_fourth_languages", "ledger_ablations"])
def test_a_run_counts_the_words_of_its_text_once(spark, sf_dir, name):
    """One split of a text per scan of the documents; the fourth languages and stage rows scan them more than once."""
    plan = ledger_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("split(text") <= plan.count("Relation [")


def test_a_trace_works_its_rows_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def spread(k):
        worked.add(1)
        return float(k % 7 + 1)

    rows = spark.range(100).select(F.col("id").cast("string").alias("time"), F.col("id").cast("string").alias("id"), spread("id").alias("spread"))
    assert ledger.trace(rows, F.lit(True)).count() == 100
    assert worked.value == 100


#: Texts without a word, without a text and without a language, as (doc_id, text, lang, source, n_chars).
ODD = [
    (1, "a bc", "en", "mix", 4), (2, None, "de", "mix", None), (3, "a bc", "en", "mix", 4), (6, "", "fr", "mix", 0), (9, "a bcd e", "en", "mix", 7), (12, "", None, "mix", 0),
    (15, "abc de", None, "mux", 6), (18, "abc d", "en", "mux", 5), (21, "  \n", "fr", "solo", 3), (24, None, "en", "void", None), (27, "", "en", "bare", 0),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["ledger_best_per_stage", "ledger_best_with_heldout", "ledger_by_language", "ledger_elasticity", "ledger_failure_streaks", "ledger_trace_best_so_far", "ledger_next_ids"])
def test_runs_of_texts_without_words_equal_their_sql(spark, odd_dir, name):
    assert differences(ledger_queries.QUERIES[name](spark, odd_dir), ledger_queries.ORACLES[name], odd_dir) == ""


def test_the_first_point_within_counts_no_text_twice(spark, sf_dir, monkeypatch):
    """All words are counted when the points are kept: the rest reads two numbers a point, and the limit's condition meets no text."""
    plans, kept = [], ledger_queries.checkpointed
    monkeypatch.setattr(ledger_queries, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    made = ledger_queries.ledger_first_within(spark, sf_dir)
    assert [p.count("array_remove(") for p in plans] == [1]
    assert "array_remove(" not in made._jdf.queryExecution().optimizedPlan().toString()
