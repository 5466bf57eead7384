"""Quality classifier: random Fourier features, ridge regression by partition-summed normal equations, isotonic scores.

Document statistics are worked out once per text. A Gaussian kernel over the standardised statistics is approximated by
FEATURES random cosines; each partition sums its part of the normal equations, the parts are summed in Spark, and the
driver solves a system whose size does not depend on the data. Ridge outputs of rows that the regression did not learn
from are pooled by isotonic regression into probabilities.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import checkpointed, slices

FEATURES = 256
RIDGE = 1e-2
CALIBRATION_BINS = 1024
THRESHOLD = 0.7
SEED = 20240229
STATISTICS = ("words", "word_length", "distinct", "top_word", "repeats", "symbols", "upper", "digits", "exclaims", "other", "dup_lines", "line_words", "stops", "stop_gap")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_ODD = re.compile(r"[^\w\s.,;:'\"!?()#*$%&|<>-]")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text, each squeezed into a small range; null and empty texts: all zero."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    enders = text.count(".") + text.count("?")
    return [
        np.log1p(n) / 5,
        min(chars / n, 40) / 5,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        min(len(_SYMBOLS.findall(text)) / n, 2),
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        min(text.count("!") / n, 2),
        len(_ODD.findall(text)) / chars,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 3,
        min(enders / n, 1),
        np.log1p(n / (1 + enders)) / 4,
    ]


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = np.array([statistics(x.as_py()) for x in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(made), pa.list_(pa.float64()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics_batches, "doc_id long, stats array<double>")


def _projection(n: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1 / np.sqrt(n), (n, features)), rng.uniform(0, 2 * np.pi, features)


def _lift(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised, clipped statistics, with a constant."""
    z = np.clip((stats - mean) / scale, -4, 4)
    return np.c_[np.sqrt(2 / len(phase)) * np.cos(z @ weights + phase), np.ones(len(z))]


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def _sums(make):
    """mapInArrow function: one row per partition, the sum of make(batch) over its batches as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = make(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def _summed(rows: DataFrame, make, ways: int = 16) -> np.ndarray | None:
    """Sum of the partitions' parts. At most 64 * ways parts arise, whatever the input's partitions; they are pooled in `ways`
    tasks, so that the driver gets at most that many."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_py())
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.coalesce(64 * ways).mapInArrow(_sums(make), "part binary")
    got = sorted(bytes(r.part) for r in parts.repartition(ways).mapInArrow(pool, "part binary").collect())
    return sum(np.frombuffer(x) for x in got) if got else None


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps: np.ndarray  # ridge outputs where the isotonic curve has its points, and
    values: np.ndarray  # the curve there

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return _lift(stats, self.mean, self.scale, self.weights, self.phase) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.steps, self.values), 0, 1)


def isotonic(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing fit by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.array([])


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """Learn from (doc_id, stats, label 0 or 1). Four fifths, by hash of doc_id, give the regression and the rest the
    calibration. None if there is no row."""
    n = len(STATISTICS)
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("fold")), F.lit(5))
    rows = train.where("label is not null").select("stats", F.col("label").cast("double").alias("label"), (part == 0).alias("calibrate"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    got = _summed(rows, moments)
    if got is None or not got[0]:
        return None
    mean = got[1 : n + 1] / got[0]
    scale = np.maximum(np.sqrt(np.maximum(got[n + 1 :] / got[0] - mean**2, 0)), 1e-3)
    weights, phase = _projection(n, features, seed)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = _lift(_matrix(batch.column(0)), mean, scale, weights, phase), batch.column(1).to_numpy()
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    learn = rows.where(~F.col("calibrate"))
    sums = _summed(learn, normal)
    if sums is None:
        learn, sums = rows, _summed(rows, normal)
    size = features + 1
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    penalty = np.eye(size) * ridge * max(1.0, gram[-1, -1]) / size
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(gram + penalty, right)
    model = Model(mean, scale, weights, phase, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * CALIBRATION_BINS).astype(int), 0, CALIBRATION_BINS - 1)
        y = batch.column(1).to_numpy()
        return np.r_[np.bincount(at, minlength=CALIBRATION_BINS), np.bincount(at, y, minlength=CALIBRATION_BINS)].astype(np.float64)

    made = _summed(rows.where("calibrate"), binned)
    if made is None:
        made = _summed(learn, binned)
    count, good = made[:CALIBRATION_BINS], made[CALIBRATION_BINS:]
    full = np.flatnonzero(count)
    curve = isotonic((good[full] + 0.5) / (count[full] + 1), count[full])
    model.steps, model.values = (full + 0.5) / CALIBRATION_BINS * 2 - 0.5, curve
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels has doc_id and quality (0 or 1).

    Learns from labels of rows whose crc32(doc_id as text) mod 4 is not 2 (a null doc_id counts as the text "null").
    Null texts count as empty ones and get a score too; without any usable label every score is 0.5. A doc_id with several
    labels counts once per distinct label; repeated rows of docs stay; an empty table gives no rows; other columns are not read.
    """
    stats = checkpointed(document_statistics(docs))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).distinct()
    train = checkpointed(stats.where(~held).join(known, "doc_id").select("doc_id", "stats", "label"))
    model = fit(train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
