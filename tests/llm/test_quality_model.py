import zlib

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import quality_model as qm


def test_isotonic_pools():
    assert np.allclose(qm.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1, 1, 3, 1])), [0.1, 0.35, 0.35, 0.9])


def test_partition_sums_equal_one_solve(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(qm.STATISTICS)))
    y = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "doc_id long, stats array<double>, label int")
    a, b = qm.fit(rows.repartition(7), features=32), qm.fit(rows.coalesce(1), features=32)
    assert np.allclose(a.beta, b.beta, atol=1e-8) and np.allclose(a.values, b.values)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = qm.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "", 7), (None, "a b", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = qm.quality_scores(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in qm.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert qm.quality_scores(docs.where("false"), labels).collect() == []


def plain_isotonic(values, weight):
    """The max-min formula, over all stretches."""
    n = len(values)
    mean = lambda a, b: np.average(values[a : b + 1], weights=weight[a : b + 1])
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_scores_equal_one_dense_solve(spark):
    """All rows in one matrix, the kernel's features, one ridge solve, isotonic by its formula: the same scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))
    rows = docs.select("doc_id", "text", fold.alias("fold")).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    stats = {r.doc_id: np.array(qm.statistics(r.text)) for r in rows}
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in known]
    x, y = np.array([stats[r.doc_id] for r in train]), np.array([known[r.doc_id] for r in train], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    rng = np.random.default_rng(qm.SEED)
    w, phase = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], qm.FEATURES)), rng.uniform(0, 2 * np.pi, qm.FEATURES)
    lift = lambda m: np.c_[np.sqrt(2 / qm.FEATURES) * np.cos(np.clip((m - mean) / scale, -4, 4) @ w + phase), np.ones(len(m))]
    learn = np.array([r.fold != 0 for r in train])
    z = lift(x[learn])
    penalty = qm.RIDGE * max(1.0, learn.sum()) / (qm.FEATURES + 1) * np.eye(qm.FEATURES + 1)
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ y[learn])
    at = np.clip(((lift(x[~learn]) @ beta + 0.5) / 2 * qm.CALIBRATION_BINS).astype(int), 0, qm.CALIBRATION_BINS - 1)
    bins = np.unique(at)
    count = np.array([(at == b).sum() for b in bins])
    curve = plain_isotonic(np.array([(y[~learn][at == b].sum() + 0.5) / ((at == b).sum() + 1) for b in bins]), count)
    want = {i: float(np.clip(np.interp(lift(m[None, :]) @ beta, (bins + 0.5) / qm.CALIBRATION_BINS * 2 - 0.5, curve), 0, 1)[0]) for i, m in stats.items()}
    got = {r.doc_id: r.score for r in qm.quality_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_kernel_approximates_a_gaussian():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(qm.STATISTICS)))
    w, phase = qm._projection(x.shape[1], 20000, 3)
    z = qm._lift(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), w, phase)[:, :-1]
    far = ((np.clip(x, -4, 4)[:, None] - np.clip(x, -4, 4)[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * x.shape[1]))).max() < 0.05


def test_repeated_labels_ties_and_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "good words are here. " * (i % 7 + 1) if i % 2 else "bad!!! $$$ bad " * (i % 5 + 1)) for i in range(200)] + [(500, "word and word. " * 60000), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2 + [(3, 0), (500, 1), (None, 1)], "doc_id long, quality int").withColumn("score", F.lit(1))
    got = qm.quality_scores(docs, labels).collect()
    assert len(got) == 202 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 200) >= 190
