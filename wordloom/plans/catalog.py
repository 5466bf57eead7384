"""All queries of the library by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import measure
from wordloom.plans import corpus_queries, file_queries, indic_queries, ledger_queries, report_queries, text_queries, training_queries
from wordloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (text_queries, corpus_queries, indic_queries, file_queries, indic_queries, ledger_queries, report_queries, training_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility per language at the level of characters, with the spread and score over all of them."""
    measured = measure.character_level(table(spark, sf_dir, "documents"), ("lang",))
    whole = measure.spread(measured).select("max_lang", "min_lang", "spread", "score")
    each = measured.withColumn("fertility", F.try_divide(F.col("tokens").cast("double"), F.col("words").cast("double")))
    return each.crossJoin(F.broadcast(whole))  # one row


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
