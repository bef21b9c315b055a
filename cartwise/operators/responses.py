"""Answers as nested documents: one JSON text per request, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNALS = "struct<vector_score:double,dense_sim:double,sparse_score:double,intent_score:double,pricing_score:double>"
RESULT = ("struct<rank:int,product_id:bigint,name:string,category:string,brand:string,price:double,discount:double,rating:double,"
          f"final_score:double,rank_explanation:string,signals:{SIGNALS}>")
RESPONSE = f"query_id bigint, intent struct<label:string,confidence:double>, total_candidates bigint, returned int, results array<{RESULT}>"


def search_responses(ranked: DataFrame) -> DataFrame:
    """(query_id, response): the results of a search in their order, with explanations, signals and totals. A request has at most top_k rows."""
    signals = F.struct("vector_score", "dense_sim", "sparse_score", "intent_score", "pricing_score").alias("signals")
    result = F.struct("rank", "product_id", "name", "category", "brand", "price", "discount", "rating", "final_score", "rank_explanation", signals)
    grouped = ranked.groupBy("query_id").agg(
        F.struct(F.first("intent_label").alias("label"), F.first("intent_confidence").alias("confidence")).alias("intent"),
        F.first("total_candidates").alias("total_candidates"), F.count("*").cast("int").alias("returned"),
        F.array_sort(F.collect_list(result)).alias("results"))
    return grouped.select("query_id", F.to_json(F.struct("query_id", "intent", "total_candidates", "returned", "results")).alias("response"))


def read_responses(responses: DataFrame) -> DataFrame:
    """One row per result of JSON texts in ``response``."""
    read = responses.select(F.from_json("response", RESPONSE).alias("r")).select("r.*")
    rows = read.select("query_id", F.col("intent.label").alias("intent_label"), F.col("intent.confidence").alias("intent_confidence"),
                       "total_candidates", "returned", F.inline("results"))
    return rows.select("*", "signals.*").drop("signals")
