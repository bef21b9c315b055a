"""Reader for retail transaction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("InvoiceDate", T.TimestampNTZType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.StringType()),
    T.StructField("Country", T.StringType()),
])
_NAMES = {
    "Invoice": "invoice", "StockCode": "stock_code", "Description": "description", "Quantity": "quantity",
    "InvoiceDate": "invoice_ts", "Price": "price", "Customer ID": "customer_id", "Country": "country",
}


def _named(df: DataFrame, *more: Column) -> DataFrame:
    """Column names of the operators, and the line's place in the input.

    The place is file, block start and row within the task, so it does not depend on scheduling.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in _NAMES.items()], place.alias("line_no"), *more)


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Lines of CSV files with header. Quoted fields may hold quotes (doubled), commas and line breaks.

    Line breaks in fields mean that a file is read by one task; large inputs should be many files, or
    Parquet. A record that does not fit the schema has its text in ``malformed`` (else null), so it can
    be counted and set aside instead of vanishing in the test for nulls.
    """
    schema = T.StructType([*SCHEMA.fields, T.StructField("_malformed", T.StringType())])
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed")
    return _named(raw.schema(schema).csv(path), F.col("_malformed").alias("malformed"))


def read_transactions_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.schema(SCHEMA).parquet(path))
