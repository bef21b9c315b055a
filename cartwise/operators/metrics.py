"""Counters of a running job: numbers that a run collects while it does its work, without a second scan.

Batch runs hand on observed frames and give their numbers after the first action. Streams report numbers with
every micro-batch. Tasks that are run again count once; stages that Spark computes twice would count twice, so observe what is
written, not what is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cartwise.operators.cleaning import OUTLIER_PROB, _has_fields, _is_sale, first_lines
from cartwise.operators.quantiles import exact_quantile
from cartwise.session import stage


class CleaningRun:
    """One cleaning run with the funnel of its rows: ``write`` once, then ``funnel``."""

    def __init__(self, tx: DataFrame):
        self._spark = tx.sparkSession
        self._scan, self._unique, self._final = Observation("scan"), Observation("unique"), Observation("final")
        counted = tx.observe(self._scan, F.count(F.lit(1)).alias("initial"), F.count_if(_has_fields()).alias("complete"),
                             F.count_if(_has_fields() & _is_sale()).alias("positive"))
        lines = first_lines(counted.filter(_has_fields()).filter(_is_sale()))
        self._lines = lines.observe(self._unique, F.count(F.lit(1)).alias("unique"))

    def write(self) -> DataFrame:
        """The cleaned transactions, as a table."""
        lines = stage(self._lines, "first-lines")
        ceiling = exact_quantile(lines, "price", OUTLIER_PROB)
        kept = lines.filter(F.col("price") <= ceiling).withColumn("amount", F.col("quantity") * F.col("price"))
        return stage(kept.observe(self._final, F.count(F.lit(1)).alias("final")), "cleaned")

    def funnel(self) -> DataFrame:
        """step, stage, n_rows, removed; after ``write``."""
        counts = {**self._scan.get, **self._unique.get, **self._final.get}
        names = ("initial", "complete", "positive", "unique", "final")
        before = [counts["initial"], *(counts[n] for n in names)]
        rows = [(i, n, counts[n], before[i - 1] - counts[n]) for i, n in enumerate(names, 1)]
        return self._spark.createDataFrame(rows, "step int, stage string, n_rows long, removed long")


def labelled_counters(labels: dict[str, Column]) -> list[Column]:
    """For ``observe``: how many rows meet each condition."""
    return [F.count_if(condition).alias(name) for name, condition in labels.items()]


class StreamCounters:
    """Totals of the counters that a stream observes under ``name``; ``update`` may be called at any time, batches count once."""

    def __init__(self, name: str):
        self._name = name
        self._batches: dict[int, dict[str, int]] = {}

    def update(self, query) -> dict[str, int]:
        for progress in query.recentProgress:
            if row := progress.observedMetrics.get(self._name):
                self._batches[progress.batchId] = row.asDict()
        return self.totals()

    def totals(self) -> dict[str, int]:
        names = {n for counts in self._batches.values() for n in counts}
        return {n: sum(counts.get(n) or 0 for counts in self._batches.values()) for n in sorted(names)}
