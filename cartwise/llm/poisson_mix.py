"""Mixing sources to target weights by Poisson replication.

A source with ``n`` documents and target weight ``w`` of a mixture of ``total`` documents repeats each of
its documents ``total * w / n`` times on average. A document's count is drawn by inverting the Poisson
distribution of that mean at a number in (0, 1) hashed from a seed and the document, so it does not
depend on partitioning, retries or other documents. Each copy gets a hashed key, by which the copies
of all sources are dealt out and ordered: a global shuffle.

Cases: a null source is a source of its own, matched by a null source among the targets. A source
without a target, or whose target is null or not positive, gets no copies; a target whose source has
no documents takes no effect, and weights are shares of those that do. A document without an id is
named by its text. Rows that repeat an id get equal counts. Columns of the input stay, apart from
``copy`` and ``shuffle_key``, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.columns import hash48, pack, row_key, uniform, unpack
from cartwise.session import stage

SEED = 42
_NONE = "\x00none"


def _named(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(_NONE))


def tempered_targets(docs: DataFrame, power: float = 0.5, source: str = "source") -> DataFrame:
    """(source, weight): counts to a power below 1 lift small sources."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def repetition_rates(docs: DataFrame, targets: DataFrame, total: float | None = None, source: str = "source") -> DataFrame:
    """(source, n, rate, cdf): mean repetitions, and the Poisson distribution function as far as it is below 1.

    One row per source. ``total`` is the number of documents wanted, by default as many as there are.
    """
    counts = docs.groupBy(_named(source).alias("source")).agg(F.count("*").alias("n"))
    wanted = targets.filter("weight > 0").groupBy(_named("source").alias("source")).agg(F.sum("weight").alias("weight"))
    sources = stage(counts.join(wanted, "source"), "sources")
    sums = sources.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights"))
    total_rows = F.col("rows").cast("double") if total is None else F.lit(float(total))
    rated = sources.join(F.broadcast(sums)).select("source", "n", (total_rows * F.col("weight") / F.col("weights") / F.col("n")).alias("rate"))  # one row
    # P(X <= k) for k = 0, 1, ... with P(X = k) from logarithms, up to where the rest is below 1e-16
    cdf = F.expr("""
        aggregate(sequence(1, cast(ceil(rate + 10 * sqrt(rate) + 24) as int)),
            named_struct('p', -rate, 'c', array(exp(-rate))),
            (s, k) -> named_struct('p', s.p + ln(rate) - ln(k), 'c',
                concat(s.c, array(least(1D, s.c[size(s.c) - 1] + exp(s.p + ln(rate) - ln(k)))))),
            s -> s.c)""")
    return rated.withColumn("cdf", cdf)


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, source: str = "source",
        key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Copies of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, dealt out and ordered by that key.

    The rates are a table of one row per source, written first so that Spark knows its size and
    broadcasts it only if small; else its split of skewed partitions carries a hot source.
    """
    rates = stage(repetition_rates(docs, targets, total, source).select(F.col("source").alias("_source"), "cdf"), "rates")
    name = row_key(F.col(key), F.col(text)) if text in docs.columns else F.coalesce(F.col(key).cast("string"), F.lit("none"))
    drawn = (
        docs.select(pack(docs, "copy", "shuffle_key"), _named(source).alias("_source"), name.alias("_name"))
        .join(rates, "_source")
        .withColumn("_u", uniform(F.lit(str(seed)), F.col("_name")))
        .withColumn("_n", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))))
        .filter("_n > 0")
        .select("_row", "_name", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    )
    order = hash48(F.lit(f"{seed}-order"), F.col("_name"), F.col("copy").cast("string"))
    return unpack(drawn, "copy", order.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
