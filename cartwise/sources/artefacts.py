"""Fitted artefacts as Parquet tables: vocabularies, index tables, model tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

from cartwise.operators.index import SearchIndex

_INDEX_TABLES = ("vocab", "members", "postings", "heads", "blocks")


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; if there is none it is fitted and written first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    fit().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_index(index: SearchIndex, path: str) -> None:
    index.vocab.sparkSession.createDataFrame([(index.k,)], "k int").write.mode("overwrite").parquet(f"{path}/settings")
    for name in _INDEX_TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, k: int | None = None) -> SearchIndex:
    """The index at ``path``, for result lists up to ``k``: at most what it was built for, by default all of it."""
    built_for = spark.read.parquet(f"{path}/settings").first()["k"]
    if k is not None and k > built_for:
        raise ValueError(f"the index answers lists up to {built_for}, not {k}")
    return SearchIndex(*[spark.read.parquet(f"{path}/{name}") for name in _INDEX_TABLES], built_for)
