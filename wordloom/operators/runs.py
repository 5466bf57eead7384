"""Training runs: train, measure, check, and one row of the ledger; grids of them."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators import measure
from wordloom.operators.ledger import SCHEMA
from wordloom.operators.train import Config, Counted, Tokenizer, train
from wordloom.sources.sinks import tokenizer_sha


def measured(pages: DataFrame, tokenizer: Tokenizer) -> dict[str, dict]:
    """Tokens, words, fertility, unknown tokens and cut aksharas of pages (lang, text), by language."""
    rows = measure.evaluate(pages, tokenizer.merges, ("lang",), tokenizer.alphabet, tokenizer.config.byte_fallback).collect()  # a row per language
    return {r.lang: {"tokens": r.tokens, "words": r.words, "fertility": r.fertility, "unk": r.unk, "akshara_violations": r.violations} for r in rows}


def summary(spark, by_lang: dict[str, dict]) -> dict:
    """Extremes, spread and score of measures by language; empty without any."""
    rows = [(x, m["tokens"], m["words"]) for x, m in by_lang.items()]
    found = measure.spread(spark.createDataFrame(rows, "lang string, tokens long, words long")).collect() if rows else []
    return {k: found[0][k] for k in ("max_lang", "min_lang", "max_fertility", "min_fertility", "spread", "score")} if found else {}


def one_run(texts: DataFrame, weights: DataFrame, config: Config, pages: DataFrame, stage: str, number: int = 1, note: str = "", heldout: DataFrame | None = None, counted: Counted | None = None) -> DataFrame:
    """One row of the ledger (SCHEMA) for a tokenizer trained on texts with weights, see train, and measured on pages (lang,
    text) and, if given, on heldout texts. Append it with sinks.append_runs."""
    began, spark = time.monotonic(), texts.sparkSession
    tokenizer = train(texts, weights, config, pages, counted)
    trained = time.monotonic() - began
    on_pages, held = measured(pages, tokenizer), measured(heldout, tokenizer) if heldout is not None else {}
    langs, own, away = sorted(on_pages), summary(spark, on_pages), summary(spark, held)
    kept = measure.round_trip(pages, tokenizer.merges, "lang", tokenizer.alphabet, config.byte_fallback).agg(F.bool_and("ok")).first()[0]
    given = {f"{r.lang}.{r.source}": r.micro / 1_000_000 for r in weights.collect()}  # a small dimension table
    settings = asdict(config)
    row = {
        "id": f"{stage}-{number:03d}",
        "stage": stage,
        "time": datetime.now().isoformat(timespec="seconds"),
        "langs": langs,
        "config": {**{k: settings[k] for k in ("vocab_size", "norm", "akshara", "byte_fallback", "min_frequency")}, "alpha_min": float(config.alpha_min), "pretok": "punct" if config.punctuation else "meta", "akshara_min": float(config.akshara_min), "ext_words": None},
        "weights": given,
        "info": {"n_base_chars": tokenizer.info["char"], "n_stage1": tokenizer.info["akshara"], "n_learned": tokenizer.info["learned"], "n_specials": tokenizer.info["special"] + tokenizer.info["byte"], "train_seconds": round(trained, 1), "weighted_mass": given},
        "result": {"langs": langs, "eval": on_pages, "heldout": held, **own, "vocab_size": len(tokenizer.tokens), "heldout_spread": away.get("spread"), "heldout_max": away.get("max_fertility")},
        "checks": {"vocab_is_10000": len(tokenizer.tokens) == 10_000, "no_unk_on_eval": all(m["unk"] == 0 for m in on_pages.values()), "roundtrip_eval": bool(kept)},
        "tokenizer_sha256": tokenizer_sha(tokenizer.vocabulary(spark), tokenizer.merge_table(spark)).first().sha256,
        "seconds": round(time.monotonic() - began, 1),
        "note": note,
    }
    return spark.createDataFrame([row], SCHEMA)


def grid(texts: DataFrame, weights: DataFrame, configs: dict[str, Config], pages: DataFrame, at_once: int = 4) -> DataFrame:
    """A ledger row per named configuration; a few run at once. What their configurations have in common is counted once."""
    counted = Counted(texts, weights, pages)
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(lambda item: one_run(texts, weights, item[1], pages, item[0], counted=counted), configs.items()))
    made = rows[0]
    for row in rows[1:]:
        made = made.unionByName(row)
    return made
