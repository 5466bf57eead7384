"""Searches over language weights: a feedback controller, seeded hill climbs, sweeps and grids of configurations.

Points live in log space, as vectors over the languages in their given order: `Point` holds the log weights that were tried
and the log fertilities that they gave. A search is a pair of pure functions, one from the history to the next log weights
and one from the history and a new point to the next history; `run` feeds it trials. A trial maps weights per language to
fertilities, and `spark_trial` measures one; no task holds a vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import bpe, corpus
from wordloom.operators.corpus import MICRO
from wordloom.operators.merges import learn_merges_partitioned
from wordloom.session import checkpointed

Trial = Callable[[dict[str, float]], dict[str, float]]


@dataclass(frozen=True)
class Tuning:
    """The settings of both searches."""

    response: float = -0.15  # first guess of d log fertility / d log weight
    believable: tuple[float, float] = (-2.0, -0.005)  # responses that are taken over
    least_move: float = 1e-3  # of a log weight, to tell a response from
    gain: float = 0.8
    gain_growth: float = 1.25
    gain_cut: float = 0.5
    largest_step: float = 1.0  # of a log weight
    close: float = 1e-4  # objective at which the controller is done
    climb_response: float = -0.2
    lean: tuple[float, float] = (0.2, 1.0)  # share of the gap that a leaning proposal closes
    patience: int = 3  # failures in a row after which a climb takes smaller steps
    shrink: float = 0.6
    least_sigma: float = 2e-4


@dataclass(frozen=True)
class Point:
    weight: np.ndarray
    fertility: np.ndarray
    objective: float


@dataclass(frozen=True)
class Goal:
    """What a search is after: free languages alike, the others (where target is not nan) at their log target."""

    langs: tuple[str, ...]
    target: np.ndarray

    @classmethod
    def of(cls, langs: list[str], fixed: dict[str, float] | None = None) -> Goal:
        return cls(tuple(langs), np.log([(fixed or {}).get(x, np.nan) for x in langs]))

    @property
    def free(self) -> np.ndarray:
        return np.isnan(self.target)

    def objective(self, fertility: np.ndarray) -> float:
        """Spread of the free languages plus the largest distance of a fixed one from its target; no languages of a kind add 0."""
        value, free = np.exp(fertility), self.free
        spread = np.ptp(value[free]) if free.any() else 0.0
        away = np.abs(value - np.exp(self.target))[~free]
        return float(spread + away.max(initial=0.0))

    def gap(self, point: Point) -> np.ndarray:
        """How far each language's log fertility is above where it should be."""
        middle = point.fertility[self.free].mean() if self.free.any() else 0.0
        return point.fertility - np.where(self.free, middle, self.target)


def centred(weight: np.ndarray) -> np.ndarray:
    """The same proportions with a geometric mean of one: only proportions matter to a tokenizer."""
    return weight - weight.mean()


@dataclass(frozen=True)
class Feedback:
    """The controller's state: points so far, each language's believed response and the gain."""

    goal: Goal
    response: np.ndarray
    points: tuple[Point, ...] = ()
    gain: float = Tuning.gain
    tuning: Tuning = field(default_factory=Tuning)

    @property
    def best(self) -> Point:
        return min(self.points, key=lambda p: p.objective)

    @property
    def done(self) -> bool:
        return bool(self.points) and self.points[-1].objective < self.tuning.close

    def observe(self, point: Point) -> Feedback:
        """A response is believed half of what was believed and half of what the last move shows, where it shows any."""
        t, response, better = self.tuning, self.response, not self.points or point.objective < self.best.objective
        if self.points:
            moved = point.weight - self.points[-1].weight
            seen = np.divide(point.fertility - self.points[-1].fertility, moved, out=np.full(len(moved), np.nan), where=np.abs(moved) > t.least_move)
            with np.errstate(invalid="ignore"):
                response = np.where((seen > t.believable[0]) & (seen < t.believable[1]), (response + seen) / 2, response)
        gain = min(t.gain, self.gain * t.gain_growth) if better else self.gain * t.gain_cut
        return replace(self, response=response, gain=gain, points=(*self.points, point))

    def propose(self) -> np.ndarray:
        """From the best point, each language by the weight that closes its gap if it answers as believed, times the gain."""
        step = np.clip(-self.gain * self.goal.gap(self.best) / self.response, -self.tuning.largest_step, self.tuning.largest_step)
        return centred(self.best.weight + step)


@dataclass(frozen=True)
class Climb:
    """A hill climb's state: the best point, failures since it or since the last smaller step, and the step's size. Noise is
    drawn per trial from the seed and the trial's number, so that a state alone fixes what follows."""

    goal: Goal
    seed: int
    sigma: float
    best: Point | None = None
    trials: int = 0
    fails: int = 0
    tuning: Tuning = field(default_factory=Tuning)
    done: bool = False

    def observe(self, point: Point) -> Climb:
        if self.best is None:
            return replace(self, best=point)
        if point.objective < self.best.objective:
            return replace(self, best=point, trials=self.trials + 1, fails=0)
        small = self.fails + 1 == self.tuning.patience
        sigma = max(self.sigma * self.tuning.shrink, self.tuning.least_sigma) if small else self.sigma
        return replace(self, trials=self.trials + 1, fails=0 if small else self.fails + 1, sigma=sigma)

    def propose(self) -> np.ndarray:
        """Noise around the best point; every other proposal also leans towards closing the gaps."""
        rng = np.random.default_rng((self.seed, self.trials))
        step = rng.normal(0, self.sigma, len(self.goal.langs))
        if self.trials % 2 == 0:
            step -= self.goal.gap(self.best) / self.tuning.climb_response * rng.uniform(*self.tuning.lean, len(step))
        return centred(self.best.weight + step)


def run(state: Feedback | Climb, trial: Trial, trials: int, start: dict[str, float] | None = None) -> tuple[Feedback | Climb, list[dict]]:
    """At most `trials` trials from the start (all weights one); the last state and a record per trial: trial, multipliers,
    fertility, objective, improved, and of a climb sigma. The point of lowest objective, the first of equals, is the last one
    that improved."""
    langs = state.goal.langs
    weight, records = np.log([(start or {}).get(x, 1.0) for x in langs]), []
    for k in range(trials):
        multipliers = dict(zip(langs, np.exp(weight).tolist(), strict=True))
        got = trial(multipliers)
        fertility = np.log([got[x] for x in langs])
        point = Point(weight, fertility, state.goal.objective(fertility))
        best = min((r["objective"] for r in records), default=np.inf)
        records.append({"trial": k, "multipliers": multipliers, "fertility": got, "objective": point.objective, "improved": point.objective < best} | ({"sigma": state.sigma} if isinstance(state, Climb) else {}))
        state = state.observe(point)
        if state.done:
            break
        weight = state.propose()
    return state, records


def balance(trial: Trial, langs: list[str], rounds: int = 12, start: dict[str, float] | None = None, fixed: dict[str, float] | None = None) -> list[dict]:
    """Feedback on the weights until the fertilities agree. Sequential by nature: each round needs the last one's trial."""
    goal = Goal.of(langs, fixed)
    return run(Feedback(goal, np.full(len(langs), Tuning.response)), trial, rounds, start)[1]


def climb(trial: Trial, langs: list[str], trials: int, seed: int, sigma: float = 0.01, start: dict[str, float] | None = None) -> list[dict]:
    """The start and `trials` proposals of a seeded hill climb."""
    return run(Climb(Goal.of(langs), seed, sigma), trial, trials + 1, start)[1]


def make_weights(multipliers: dict[str, float], eval_weight: float, train_weight: float) -> dict[str, float]:
    """Weights by "lang.source"; sources without a positive weight are left out."""
    sources = {s: w for s, w in {"eval": eval_weight, "train": train_weight}.items() if w > 0}
    return {f"{lang}.{s}": w * m for lang, m in multipliers.items() for s, w in sources.items()}


def spark_trial(counts: DataFrame, n_merges: int) -> Trial:
    """A trial over counts (lang, word, n), which stay where they are: merges are learned by all tasks together, words are cut
    and summed by all."""
    counts = checkpointed(counts)
    spark = counts.sparkSession

    def measure(multipliers: dict[str, float]) -> dict[str, float]:
        weights = spark.createDataFrame([(x, round(w * MICRO)) for x, w in multipliers.items()], "lang string, micro long")
        mass = checkpointed(corpus.weighted_counts(counts, weights, on=("lang",)).select("word", F.col("mass").cast("long").alias("n")))
        merges = [(r["left"], r["right"]) for r in learn_merges_partitioned(mass, n_merges).orderBy("rank").collect()]  # a vocabulary
        cut = bpe.segment_words(counts.select("word").distinct(), merges).select("word", F.size("tokens").alias("t"))
        sums = counts.join(cut, "word").groupBy("lang").agg((F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("f")).collect()
        return {r["lang"]: r["f"] for r in sums}

    return measure


def _side_by_side(work: Callable, points: list, at_once: int) -> list:
    """work of each point, a few at once; trials of different points do not wait for each other."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(work, points))


def sweep(words: DataFrame, points: list[float], lang: str, n_merges: int, at_once: int = 4) -> DataFrame:
    """(weight, lang, fertility): one language's weight changed, the others at one, a trial per point over (lang, word, n)."""
    counts = checkpointed(words)
    langs, trial = sorted(r[0] for r in counts.select("lang").distinct().collect()), spark_trial(counts, n_merges)
    got = _side_by_side(lambda p: trial({x: p if x == lang else 1.0 for x in langs}), points, at_once)
    rows = [(float(p), x, found[x]) for p, found in zip(points, got, strict=True) for x in langs]
    return words.sparkSession.createDataFrame(rows, "weight double, lang string, fertility double")


def chains(words: DataFrame, seeds: list[int], trials: int, n_merges: int, at_once: int = 4) -> DataFrame:
    """(seed, trial, spread, sigma, improved): independent hill climbs, side by side; the start is trial -1."""
    counts = checkpointed(words)
    langs, trial = sorted(r[0] for r in counts.select("lang").distinct().collect()), spark_trial(counts, n_merges)
    made = _side_by_side(lambda s: climb(trial, langs, trials, s), seeds, at_once)
    rows = [(s, r["trial"] - 1, r["objective"], r["sigma"], r["improved"]) for s, records in zip(seeds, made, strict=True) for r in records]
    return words.sparkSession.createDataFrame(rows, "seed int, trial int, spread double, sigma double, improved boolean")
