"""Exact hybrid retrieval of many queries over an indexed catalogue.

The score of a pair is a sum over shared terms, so pairs without a shared term score 0 and are never
formed. Lists are cut into blocks by weight, each with its own largest weights, and are read only as far as
they can matter, whatever their length:

1. ``floor`` of a query: the ``k``-th best weight of any one term, times its query weight, is
   reached by ``k`` products, so nothing below it can be in the result.
2. The floor is raised before any list is read: the ``k`` best postings of the query's shortest lists,
   which are stored beside the lists, are scored in full, and the ``k``-th best score is reached by ``k`` products too.
3. Terms are ordered by the length of their list over their largest possible contribution (of both spaces
   together), short lists of much weight first. A product in the result is found through the first of its terms in this
   order, so a block is read only if its largest weights and all later terms together still reach the
   floor. Long lists of frequent words come last, where the later terms are few, and are mostly never read.
4. Lists no longer than those read together are read beside them, but only for the pairs found there: that costs
   less than looking their terms up pair by pair.
5. What was read gives a lower and an upper bound per pair. The ``k``-th best lower bound raises
   the floor; pairs whose upper bound stays below it are dropped. For the others the terms not read
   in full are looked up.

All bounds hold exactly (up to a slack far above rounding error and far below any reported digit),
so the result equals scoring every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.operators import tfidf as TF
from cartwise.operators.index import SearchIndex
from cartwise.operators.joins import PLACE, block_join, fan_out
from cartwise.session import stage

SLACK = 1e-8
SEEDS = 1  # times k postings of a query are scored before lists are read
SCORE_DIGITS = 9  # scores closer than this count as equal and keep catalogue order


def query_vectors(texts: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Sparse query vectors of both spaces."""
    return TF.hybrid_tfidf(texts, key, text, vocab).withColumnsRenamed({"dense": "q_dense", "sparse": "q_sparse"})


def _adds(dense: str, sparse: str) -> Column:
    """Share of the hybrid score from a query term with the given product weights."""
    return K.W_DENSE * F.col("q_dense") * F.col(dense) + K.W_SPARSE * F.col("q_sparse") * F.col(sparse)


def _query_terms(qv: DataFrame, bounds: DataFrame) -> DataFrame:
    """Query terms with the most a posting of theirs can add, and the floor by single terms."""
    # one row per vocabulary term
    terms = qv.join(F.broadcast(bounds), "tid").withColumn("most", _adds("top_dense", "top_sparse"))
    kth = F.greatest(K.W_DENSE * F.col("q_dense") * F.col("kth_dense"), K.W_SPARSE * F.col("q_sparse") * F.col("kth_sparse"))
    return terms.withColumn("floor", F.max(kth).over(Window.partitionBy("qkey")) - SLACK)


def _scored_seeds(terms: DataFrame, index: SearchIndex) -> DataFrame:
    """Per query the ``k``-th best score among the best postings of its shortest lists: (qkey, reached)."""
    shortest = Window.partitionBy("qkey").orderBy("list_length", "tid").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.least("list_length", F.lit(index.k))).over(shortest), F.lit(0))
    chosen = terms.withColumn("before", before).filter(F.col("before") < SEEDS * index.k).select("qkey", "tid")
    seeds = block_join(chosen, index.heads.select("tid", "gid"), ["tid"], "qkey", "gid").select("qkey", "gid").distinct()
    scored = (
        seeds.join(terms.select("qkey", "tid", "q_dense", "q_sparse"), "qkey")
        .join(index.postings.select("gid", "tid", "dense", "sparse"), ["gid", "tid"])
        .groupBy("qkey", "gid").agg(F.sum(_adds("dense", "sparse")).alias("score"))
    )
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "gid")
    ranked = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= index.k)
    return ranked.filter(F.col("rn") == index.k).select("qkey", (F.col("score") - SLACK).alias("reached"))


def reading_plan(qv: DataFrame, index: SearchIndex) -> DataFrame:
    """Per query term: how far its list is read, and the most an unread posting can add."""
    terms = stage(_query_terms(qv, index.bounds), "query-terms")
    raised = terms.join(_scored_seeds(terms, index), "qkey", "left").withColumn(
        "floor", F.greatest("floor", F.coalesce("reached", F.lit(0.0)))).drop("reached")
    per_query = Window.partitionBy("qkey")
    later = per_query.orderBy(F.col("list_length") / F.greatest("most", F.lit(SLACK)), "tid").rowsBetween(1, Window.unboundedFollowing)
    placed = raised.withColumn("rest", F.coalesce(F.sum("most").over(later), F.lit(0.0)))
    gap = F.greatest(F.col("floor") - F.col("rest"), F.lit(0.0))
    reads = F.sum(F.when(F.col("most") >= F.col("gap"), F.col("list_length")).otherwise(0)).over(per_query)
    unread = F.when(F.col("in_full"), 0.0).otherwise(F.least("most", "gap"))
    planned = placed.withColumn("gap", gap).withColumn("in_full", (F.col("gap") == 0) | (F.col("list_length") <= reads))
    return planned.withColumns({"unread": unread, "unread_sum": F.sum(unread).over(per_query)})


def blocks_to_read(plan: DataFrame, index: SearchIndex) -> DataFrame:
    """Rows of the plan, one for each block that is read: those whose largest weights reach the gap, and all of terms read in full."""
    blocks = F.broadcast(index.blocks)  # BUCKETS rows a vocabulary term at most
    return plan.filter((F.col("most") >= F.col("gap")) | F.col("in_full")).drop("top_dense", "top_sparse").join(blocks, "tid").filter(
        (_adds("top_dense", "top_sparse") >= F.col("gap")) | F.col("in_full")).select(
        "qkey", "tid", "bucket", "n", "q_dense", "q_sparse", "gap", "in_full", "unread", "unread_sum", "floor")


def _read_lists(plan: DataFrame, index: SearchIndex) -> DataFrame:
    """Pairs (qkey, gid) met while reading that may reach the floor, with their bounds and the sums
    over terms read in full."""
    stored = index.postings.select("tid", "bucket", "gid", "dense", "sparse")
    adds, none = _adds("dense", "sparse"), F.lit(0.0)
    read = block_join(blocks_to_read(plan, index).drop("n"), stored, ["tid", "bucket"], "qkey", "gid")
    read = read.filter((adds >= F.col("gap")) | F.col("in_full"))
    whole = F.col("in_full")
    pairs = read.groupBy("qkey", "gid").agg(
        F.sum(F.when(whole, F.col("q_dense") * F.col("dense")).otherwise(none)).alias("dense_sim"),
        F.sum(F.when(whole, F.col("q_sparse") * F.col("sparse")).otherwise(none)).alias("sparse_score"),
        F.sum(F.when(whole, none).otherwise(adds)).alias("partly"),
        (F.first("unread_sum") - F.sum("unread")).alias("open"),
        F.first("floor").alias("floor"),
        F.bool_or(adds >= F.col("gap")).alias("found"),
    ).filter("found")
    at_least = K.W_DENSE * F.col("dense_sim") + K.W_SPARSE * F.col("sparse_score") + F.col("partly")
    bounded = pairs.select("qkey", "gid", "dense_sim", "sparse_score", "floor", at_least.alias("at_least"),
                           (at_least + F.col("open")).alias("at_most"))
    return bounded.filter(F.col("at_most") >= F.col("floor") - SLACK).drop("floor")


def candidate_pairs(plan: DataFrame, index: SearchIndex) -> DataFrame:
    """Pairs that can be among the best ``k`` groups of their query."""
    pairs = stage(_read_lists(plan, index), "read-pairs")
    order = Window.partitionBy("qkey").orderBy(F.desc("at_least"), "gid")
    kth = (
        pairs.select("qkey", "gid", "at_least").withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= index.k).filter(F.col("rn") == index.k).select("qkey", F.col("at_least").alias("kth"))
    )
    reach = F.col("at_most") >= F.coalesce("kth", F.lit(0.0)) - SLACK
    return pairs.join(kth, "qkey", "left").filter(reach).select("qkey", "gid", "dense_sim", "sparse_score")


def score_pairs(pairs: DataFrame, plan: DataFrame, postings: DataFrame) -> DataFrame:
    """Complete similarities: the sums so far and the terms that were not read in full."""
    open_terms = plan.filter(~F.col("in_full")).select("qkey", "tid", "q_dense", "q_sparse")
    looked_up = (
        pairs.select("qkey", "gid").join(open_terms, "qkey")
        .join(postings.select("gid", "tid", "dense", "sparse"), ["gid", "tid"])
        .select("qkey", "gid", (F.col("q_dense") * F.col("dense")).alias("dense_sim"),
                (F.col("q_sparse") * F.col("sparse")).alias("sparse_score"))
    )
    return pairs.unionByName(looked_up).groupBy("qkey", "gid").agg(
        F.sum("dense_sim").alias("dense_sim"), F.sum("sparse_score").alias("sparse_score")
    )


def hybrid_score(dense: Column, sparse: Column) -> Column:
    return F.round(K.W_DENSE * dense + K.W_SPARSE * sparse, SCORE_DIGITS)


def _best_groups(scored: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best groups, less those behind groups that already fill the result."""
    per_query = Window.partitionBy("qkey")
    order = per_query.orderBy(F.desc("hybrid"), "gid")
    top = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).join(sizes, "gid")
    upto = F.sum("copies").over(per_query.orderBy(F.desc("hybrid")).rangeBetween(Window.unboundedPreceding, 0))
    ties = F.sum("copies").over(Window.partitionBy("qkey", "hybrid"))
    return top.withColumn("better", upto - ties).filter(F.col("better") < k).drop("rn", "better")


def _padding(qkeys: DataFrame, found: DataFrame, index: SearchIndex) -> DataFrame:
    """For queries with too few matches the first products of the catalogue, which score 0."""
    have = found.groupBy("qkey").agg(F.count("*").alias("have"))
    short = qkeys.join(have, "qkey", "left").filter(F.coalesce("have", F.lit(0)) < index.k).select("qkey")
    slots = short.select("qkey", F.explode(F.sequence(F.lit(1), F.lit(index.k))).alias("slot"))
    first = index.members.orderBy("ordinal").limit(index.k).select(
        "product_id", "ordinal", F.row_number().over(Window.orderBy("ordinal")).alias("slot")
    )
    zero = F.lit(0.0)
    return (
        slots.join(F.broadcast(first), "slot")  # k rows
        .join(found.select("qkey", "ordinal"), ["qkey", "ordinal"], "left_anti")
        .select("qkey", "product_id", "ordinal", zero.alias("dense_sim"), zero.alias("sparse_score"), zero.alias("hybrid"))
    )


def distinct_vectors(queries: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with the ``qkey`` of their vector, and the vectors (qkey, tid, q_dense, q_sparse).

    A vector depends on the known terms and their counts only, so texts that agree in these share one; all
    texts without a known term share a ``qkey`` that has no vector.
    """
    texts = stage(queries.filter(F.col("query").isNotNull()).groupBy("query").agg(F.min("query_id").alias("_text")), "query-texts")
    counts = stage(TF.hybrid_counts(texts, "_text", "query", vocab), "query-counts")
    held = counts.groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("tid", "tf"))).alias("_terms"))  # as long as the vocabulary at most
    none = F.array().cast(held.schema["_terms"].dataType)
    known = stage(texts.join(held, "_text", "left").withColumn("_terms", F.coalesce("_terms", none)), "query-terms-held")
    first = known.groupBy("_terms").agg(F.min("_text").alias("qkey"))
    asked = stage(queries.join(known.join(first, "_terms").select("query", "qkey"), "query"), "asked")
    own = counts.join(first.select(F.col("qkey").alias("_text")), "_text", "left_semi").withColumnRenamed("_text", "qkey")
    return asked, TF.hybrid_weights(own, "qkey").withColumnsRenamed({"dense": "q_dense", "sparse": "q_sparse"})


def retrieve_vectors(queries: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame]:
    """Queries with their ``qkey``, and the best ``index.k`` products per ``qkey``: (qkey, product_id, retrieval_rank, dense_sim, sparse_score).

    Equal vectors are answered once. Ties keep catalogue order.
    """
    asked, qv = distinct_vectors(queries, index.vocab)
    plan = stage(reading_plan(qv, index), "reading-plan")
    pairs = stage(candidate_pairs(plan, index), "pairs")
    scored = score_pairs(pairs, plan, index.postings).withColumn("hybrid", hybrid_score(F.col("dense_sim"), F.col("sparse_score")))
    sizes = index.members.filter("ordinal = gid").select("gid", "copies")
    best = _best_groups(scored, sizes, index.k).drop("copies")
    found = stage(
        best.join(index.members.select("gid", "ordinal", "product_id"), "gid").drop("gid"), "matches"
    )
    every = found.unionByName(_padding(asked.select("qkey").distinct(), found, index))
    order = Window.partitionBy("qkey").orderBy(F.desc("hybrid"), "ordinal")
    ranked = every.withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= index.k)
    return asked, stage(ranked.select("qkey", "product_id", "retrieval_rank", "dense_sim", "sparse_score"), "retrieved")


def hybrid_retrieve(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Best ``index.k`` products per query: (query_id, product_id, retrieval_rank, dense_sim, sparse_score)."""
    asked, ranked = retrieve_vectors(queries.select("query_id", "query"), index)
    return fan_out(asked.select("query_id", "qkey"), ranked, "qkey", "query_id").drop(PLACE)


def external_candidates(scores: DataFrame, k: int = K.TOP_CANDIDATES) -> DataFrame:
    """Candidates scored elsewhere, as (query_id, product_id, score): the score stands in for the
    dense similarity and there is no sparse part."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "product_id")
    return scores.withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= k).select(
        "query_id", "product_id", "retrieval_rank",
        F.col("score").cast("double").alias("dense_sim"), F.lit(0.0).alias("sparse_score"),
    )
