"""Views of the TPC-H-like test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed mapping of part types to catalogue categories
CATEGORY_OF_TYPE = {
    "ECONOMY": "running_shoes",
    "STANDARD": "casual_shoes",
    "MEDIUM": "sandals",
    "PROMO": "sports_shirt",
    "LARGE": "sports_pants",
    "SMALL": "kids_shoes",
}
# fixed mapping of market segments to opening words of a search request
OPENING_OF_SEGMENT = {
    "AUTOMOBILE": "urgent",
    "BUILDING": "cheap",
    "FURNITURE": "premium",
    "HOUSEHOLD": "gift for her",
    "MACHINERY": "compare",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mapped(col, mapping: dict[str, str], default: str):
    out = F
    for k, v in mapping.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail lines: order lines with the customer and date of their order."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice"), F.col("l_partkey").alias("stock_code"),
        F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
    )
    order = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("invoice"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("invoice_ts"),
    )
    return line.join(order, "invoice")


def _exact_mean(name: str):
    """Mean that does not depend on the order of additions; of values that are no decimals (NaN, infinite) as doubles."""
    exact = F.col(name).try_cast("decimal(20,10)")
    return F.coalesce(F.when(F.count(exact) == F.count(name), F.avg(exact).cast("double")), F.avg(name))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue columns that parts have of themselves."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_partkey").alias("ordinal"),
        F.col("p_name").alias("name"), F.lower("p_type").alias("desc"),
        _mapped(F.col("p_type"), CATEGORY_OF_TYPE, "other").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"),
        F.round(3 + F.col("p_size") / 25.0, 2).alias("rating"),
        (F.col("p_size") % 10 != 0).alias("stock"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: parts with sales-based popularity and discount."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.sum("l_quantity").alias("qty"), _exact_mean("l_discount").alias("avg_discount")
    )
    top = sold.agg(F.max("qty")).scalar()
    part = parts(spark, sf_dir)
    return part.join(sold, "product_id", "left").select(
        *part.columns,
        F.coalesce(F.try_divide("qty", top), F.lit(0.5)).alias("popularity"),
        F.round(F.coalesce("avg_discount", F.lit(0.0)), 4).alias("discount"),
    )


def search_requests(spark: SparkSession, sf_dir: str, churn: DataFrame | None = None) -> DataFrame:
    """One search request per customer, worded from its segment and the part of the same key."""
    cust = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part")
    opening = _mapped(F.col("c_mktsegment"), OPENING_OF_SEGMENT, "show")
    closing = (
        F.when(F.col("c_nationkey") % 3 == 0, F.lit(" sneaker"))
        .when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit(" under $"), F.floor("p_retailprice").cast("string")))
        .otherwise(F.lit(""))
    )
    parts = max(1, part.count())  # keys run from 0
    requests = cust.join(part, F.pmod(cust.c_custkey, parts) == part.p_partkey).select(
        F.col("c_custkey").alias("query_id"),
        # some requests hold no word of the catalogue, some only words that few products have
        F.when(F.col("c_custkey") % 40 == 7, F.concat(F.lit("qqzz"), F.col("c_custkey").cast("string")))
        .when(F.col("c_custkey") % 40 == 11, F.concat(F.lit("zzqq "), F.col("p_name")))
        .otherwise(F.concat(opening, F.lit(" "), "p_name", F.lit(" "), "p_brand", closing)).alias("query"),
        F.when(F.col("c_custkey") % 10 == 3, 5).otherwise(20).alias("top_k"),
        F.when(F.col("c_custkey") % 12 == 5, F.create_map(F.lit("vector"), F.lit(0.6), F.lit("pricing"), F.lit(0.1))).alias("weights"),
    )
    if churn is None:
        return requests.withColumn("churn_score", F.lit(0.5))
    scored = churn.select(F.col("customer_id").alias("query_id"), "churn_probability")
    return requests.join(scored, "query_id", "left").withColumn(
        "churn_score", F.coalesce("churn_probability", F.lit(0.5))
    ).drop("churn_probability")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products recently dealt with by each customer, weighted by quantity."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("weight")
    )
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", "product_id", "weight")


# what the values of events stand for. Round scales (1 and 500) would put many results of these two-digit
# values exactly halfway between two roundings, where DuckDB's round and Spark's differ.
EVENT_SCALES = {"view_seconds": 0.997, "value_scale": 487.0}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: the type is the path, errors are 5xx, the value is milliseconds.

    Every seventh client key of a signup stands for a rejected request (422).
    """
    key = F.get_json_object("props", "$.k").try_cast("bigint")
    status = (
        F.when(F.col("event_type") == "error", 500)
        .when((F.col("event_type") == "signup") & (key % 7 == 0), 422)
        .otherwise(200)
    )
    return events(spark, sf_dir).select(
        "event_id", "ts", F.lit("POST").alias("method"), F.concat(F.lit("/ml/"), "event_type").alias("path"),
        status.alias("status"), (F.col("value") / 1000).alias("duration_s"),
        F.col("event_type").alias("endpoint"), F.concat(F.lit("step_"), (key % 3).cast("string")).alias("step"),
    )


def rerank_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rerank requests, one per customer, and the lines it ordered as candidates.

    Segments stand for intents; the keyword score is the discount, the semantic score the tax, and
    neither price nor semantic score are known for returned lines.
    """
    label = F
    for segment, name in (("BUILDING", "price_sensitive"), ("FURNITURE", "premium"), ("HOUSEHOLD", "gift")):
        label = label.when(F.col("c_mktsegment") == segment, F.lit(name))
    own = F.create_map(F.lit("vector"), F.lit(0.6), F.lit("pricing"), F.lit(0.1))
    requests = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), label.otherwise(F.lit(None)).alias("label"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.lit(0.75)).alias("confidence"),
        F.when(F.col("c_nationkey") % 5 == 0, own).alias("weights"),
    )
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    returned = F.col("l_returnflag") == "R"
    candidates = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("request_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), F.col("l_partkey").alias("product_id"),
        F.col("l_discount").alias("keyword_score"), F.when(~returned, F.col("l_tax")).alias("semantic_score"),
        F.when(~returned, F.col("l_extendedprice")).alias("price"),
    )
    return requests, candidates


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts a person may have typed: conversation turns, documents and search requests."""
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("origin"), (F.col("conv_id") * 10000 + F.col("turn")).alias("key"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("key"), F.col("text").alias("query"))
    asked = search_requests(spark, sf_dir).select(F.lit("request").alias("origin"), F.col("query_id").alias("key"), "query")
    return turns.unionByName(docs).unionByName(asked)
