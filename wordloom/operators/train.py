"""The whole trainer: weighted counts, alphabet, aksharas first, merge learning, vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from threading import RLock

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.script import MARKED, aksharas
from wordloom.operators import bpe, corpus
from wordloom.operators.merges import learn_merges_partitioned
from wordloom.session import checkpointed


#: Fixed value: the first of the private-use characters that stand for glued aksharas.
PRIVATE = 0xF0000


@dataclass(frozen=True)
class Config:
    vocab_size: int = 10_000
    norm: str = "NFC"
    punctuation: bool = False
    akshara: bool = False
    akshara_min: int = 0
    byte_fallback: bool = False
    alpha_min: int = 0
    min_frequency: int = 1
    total_mass: int | None = None  # scale masses to this total and round without bias; None keeps exact masses


@dataclass
class Tokenizer:
    """A trained tokenizer: its tables are as large as the vocabulary, so they are held on the driver."""

    config: Config
    tokens: list[str]
    kinds: list[str]
    merges: list[tuple[str, str]]
    info: dict[str, int] = field(default_factory=dict)

    @property
    def alphabet(self) -> set[str]:
        return {t for t, k in zip(self.tokens, self.kinds, strict=True) if k == "char"}

    def vocabulary(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(self.tokens, self.kinds, strict=True))], "id long, token string, kind string")

    def merge_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(self.merges)], "rank int, left string, right string")


class Counted:
    """Texts (lang, source, text) with weights (lang, source, micro), and the word counts that trainings over them share: one
    scan per normal form and way to cut words, one filter per least occurrence of a character."""

    def __init__(self, texts: DataFrame, weights: DataFrame, eval_texts: DataFrame | None = None):
        self.texts, self.weights, self.eval_texts = texts, weights, eval_texts
        self._made: dict[tuple, DataFrame] = {}
        self._turn = RLock()  # trainings may run side by side

    def _once(self, *key, build: Callable[[], DataFrame]) -> DataFrame:
        with self._turn:
            if key not in self._made:
                self._made[key] = checkpointed(build())
            return self._made[key]

    def forced(self, config: Config) -> DataFrame | None:
        """(word) of eval_texts."""
        if self.eval_texts is None:
            return None
        return self._once("forced", config.norm, config.punctuation, build=lambda: corpus.word_counts(self.eval_texts, keys=("lang",), form=config.norm, punctuation=config.punctuation).select("word").distinct())

    def words(self, config: Config) -> DataFrame:
        """(word, mass) without words that hold a character that is too rare."""
        kind = (config.norm, config.punctuation)
        every = self._once("words", *kind, 0, build=lambda: corpus.weighted_counts(corpus.word_counts(self.texts, form=config.norm, punctuation=config.punctuation), self.weights))
        if config.alpha_min <= 0:
            return every
        return self._once("words", *kind, config.alpha_min, build=lambda: corpus.alphabet_filtered(every, corpus.kept_characters(every, config.alpha_min * corpus.MICRO, self.forced(config))))


def train(texts: DataFrame, weights: DataFrame, config: Config, eval_texts: DataFrame | None = None, counted: Counted | None = None) -> Tokenizer:
    """texts (lang, source, text) with weights (lang, source, micro); characters and aksharas of eval_texts are kept
    whatever their mass. counted, over the same tables, saves the counting that it has done before.

    Raises ValueError if base symbols use up the vocabulary, or if the corpus gives too few merges for it.
    """
    shared = counted or Counted(texts, weights, eval_texts)
    forced, words = shared.forced(config), shared.words(config)
    fixed: list[tuple[str, str]] = []
    glued: list[str] = []
    if config.akshara:
        chosen = corpus.chosen_aksharas(words, config.akshara_min * corpus.MICRO, forced).orderBy(F.desc("mass"), "akshara")
        glued = [r["akshara"] for r in chosen.collect()]  # a part of the vocabulary
        fixed = bpe.akshara_merges(glued)
        mapped = mapped_words(words, glued)
    else:
        mapped = words.select("word", F.array(F.filter(F.split("word", ""), lambda c: c != "")).alias("runs"), "mass")
    base = [(r["token"], r["kind"]) for r in corpus.base_vocabulary(words, byte_fallback=config.byte_fallback).orderBy("id").collect()]
    tokens, kinds = [t for t, _ in base], [k for _, k in base]
    existing = set(tokens)
    for product in (a + b for a, b in fixed):
        if product not in existing:
            existing.add(product)
            tokens.append(product)
            kinds.append("akshara")
    room = config.vocab_size - len(tokens)
    if room <= 0:
        raise ValueError("base symbols use up the vocabulary")
    # A word's mass is rounded once, by its own hash, before it falls into runs; equal runs of many words are summed after.
    counted = corpus.rounded_counts(mapped, config.total_mass).withColumnRenamed("k", "n") if config.total_mass else mapped.withColumn("n", F.col("mass").cast("long"))
    grouped = counted.where("n > 0").select(F.explode("runs").alias("symbols"), "n").groupBy("symbols").agg(F.sum("n").alias("n"))
    merges = list(fixed)
    for r in learn_merges_partitioned(grouped, room + 64, least=config.min_frequency).orderBy("rank").collect():
        product = r["left"] + r["right"]
        if len(tokens) >= config.vocab_size:
            break
        if product in existing:
            continue
        existing.add(product)
        tokens.append(product)
        kinds.append("learned")
        merges.append((r["left"], r["right"]))
    if len(tokens) != config.vocab_size:
        raise ValueError(f"{len(tokens)} tokens instead of {config.vocab_size}: the corpus is too small")
    info = {k: kinds.count(k) for k in ("special", "byte", "char", "akshara", "learned")}
    return Tokenizer(config, tokens, kinds, merges, info)


def mapped_words(words: DataFrame, glued: list[str]) -> DataFrame:
    """(word, runs, mass): each word with glued aksharas as one private-use character each and rare ones apart between blanks,
    and its runs of symbols, which no merge reaches across. Words without marks have none of either."""
    shared = words.sparkSession.sparkContext.broadcast({a: chr(PRIVATE + i) for i, a in enumerate(glued)})

    @F.pandas_udf("struct<word:string,runs:array<array<string>>>")
    def cut(units: pd.Series) -> pd.DataFrame:
        place, out = shared.value, []
        for row in units:
            name, runs, open_ = "", [], []
            for u in row:
                if len(u) == 1 or u in place:
                    name += place.get(u, u) if len(u) > 1 else u
                    open_.append(u)
                else:
                    name += f" {' '.join(u)} "
                    runs += [open_, *([c] for c in u)]
                    open_ = []
            out.append((name, [r for r in [*runs, open_] if r]))
        return pd.DataFrame(out, columns=["word", "runs"])

    marked = F.col("word").rlike(MARKED)
    mapped = words.where(marked).select(cut(aksharas(F.col("word"))).alias("m"), "mass").select("m.word", "m.runs", "mass")
    plain = F.array(F.filter(F.split("word", ""), lambda c: c != ""))
    return mapped.unionByName(words.where(~marked).select("word", F.when(F.col("word") == "", F.array().cast("array<array<string>>")).otherwise(plain).alias("runs"), "mass"))
