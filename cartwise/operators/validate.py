"""Row contracts: valid rows, and the others with the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.scores import SIGNALS

Rule = tuple[str, Column]


def _typed(name: str, kind: str) -> Column:
    """The field as its type; null if it is not of it. A fraction is no whole number."""
    value = F.col(name).try_cast(kind)
    if kind in ("int", "bigint"):
        value = F.when(F.col(name).try_cast("double") == value, value)
    return value


def required(name: str, kind: str) -> Rule:
    """A typed field that has to be there."""
    return f"{name}:{kind}", _typed(name, kind).isNotNull()


def present(name: str) -> Rule:
    """A field of a nested type that has to be there."""
    return f"{name}:required", F.col(name).isNotNull()


def optional(name: str, kind: str) -> Rule:
    return f"{name}:{kind}?", F.col(name).isNull() | _typed(name, kind).isNotNull()


def each(name: str, *fields: str) -> Rule:
    """An array of structs, each with all the fields given."""
    whole = F.forall(name, lambda x: reduce(lambda a, b: a & b, [x[f].isNotNull() for f in fields]))
    return f"{name}:{','.join(fields)}", F.coalesce(whole, F.lit(False))


def optional_between(name: str, kind: str, low, high) -> Rule:
    """A field that, where given, is of the type and in the closed range."""
    value = _typed(name, kind)
    return f"{name}:{low}..{high}", F.col(name).isNull() | F.coalesce(value.between(low, high), F.lit(False))


def churn_request_rules() -> list[Rule]:
    return [
        required("days_since_last_purchase", "bigint"),
        required("total_order_count", "bigint"),
        required("avg_order_value", "double"),
    ]


def search_request_rules() -> list[Rule]:
    return [
        required("query", "string"),
        optional_between("churn_score", "double", 0.0, 1.0),
        optional_between("top_k", "bigint", 1, 100),
    ]


def intent_request_rules() -> list[Rule]:
    return [optional(n, "double") for n in SIGNALS]


def product_embed_rules() -> list[Rule]:
    return [required("product_id", "string"), required("name", "string")]


def user_vector_rules() -> list[Rule]:
    return [present("recent_product_ids"),
            ("weights:double?", F.coalesce(F.forall("weights", lambda w: w.isNotNull()), F.lit(True)))]


def rerank_request_rules() -> list[Rule]:
    intent = F.col("search_intent")
    return [present("user_vector"), each("candidates", "product_id", "keyword_score"),
            ("search_intent:label,confidence", intent.isNull() | (intent["label"].isNotNull() & intent["confidence"].isNotNull()))]


def check(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``reason``: the first rule a row breaks, null for valid rows."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules]
    return rows.withColumn("reason", F.coalesce(*broken))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NULL").drop("reason")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NOT NULL")


def reason_counts(checked: DataFrame) -> DataFrame:
    return quarantine(checked).groupBy("reason").agg(F.count("*").alias("n_rows"))


def parse_json(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """Fields of a JSON text as columns; text that is no such object gives nulls."""
    return rows.withColumn("_fields", F.from_json(json, schema, {"mode": "PERMISSIVE"})).select("*", "_fields.*").drop("_fields")
