"""Stream readers and a finite run of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.session import shared_path


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a file stream; timestamps without zone become timestamps."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # as a pattern, since a stream's path may name one file only through a pattern
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    return stream.withColumns({
        f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"
    })


def finite(spark: SparkSession, sf_dir: str, name: str, time: str) -> DataFrame:
    """A test table as a stream that ends with a closing row long after all others.

    The closing row holds only its time. It moves the watermark past every window and session, so all of
    them are emitted; its own window stays open and is not.
    """
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    last = table.agg(F.max(time).alias(time)).select((F.col(time) + F.expr("INTERVAL 1000 DAYS")).alias(time))
    path = shared_path(spark, "closing-row")
    last.select(*[F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]).coalesce(1).write.parquet(path)
    rows = stream_table(spark, sf_dir, name)
    closing = spark.readStream.schema(table.schema).parquet(path)
    return rows.unionByName(closing.withColumn(time, F.col(time).cast("timestamp")).select(*rows.columns))


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there now, append mode, and read the result back."""
    spark = stream.sparkSession
    out = shared_path(spark, label)
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
