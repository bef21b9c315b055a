"""Product catalogue files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.operators.upsert import with_catalog_defaults

LEGACY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("desc", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.DoubleType()),
])
CATALOG_SCHEMA = T.StructType(LEGACY_SCHEMA.fields + [
    T.StructField("brand", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("popularity", T.DoubleType()),
    T.StructField("stock", T.BooleanType()),
    T.StructField("discount", T.DoubleType()),
    T.StructField("image", T.StringType()),
])

# fixed seed catalogue, used where no file exists and the caller asks for it:
# id, name, desc, category, brand, price, rating, popularity, stock, discount
SEED = [
    ("rs-001", "Skechers Go Run Pulse", "Budget running shoe memory foam", "running_shoes", "Skechers", 49.99, 4.1, 0.72, True, 0.0),
    ("rs-002", "New Balance Fresh Foam 520", "Affordable everyday running shoe plush cushioning", "running_shoes", "New Balance", 59.99, 4.3, 0.78, True, 0.10),
    ("rs-003", "Nike Air Zoom Pegasus 41", "Versatile running shoe Zoom Air cushioning all distances", "running_shoes", "Nike", 130.00, 4.5, 0.91, True, 0.0),
    ("rs-004", "Nike Vaporfly 3", "Elite marathon carbon plate racing shoe", "running_shoes", "Nike", 249.99, 4.9, 0.82, True, 0.0),
    ("rs-005", "Adidas Adizero Adios Pro 3", "Professional marathon racing shoe carbon energy rods", "running_shoes", "Adidas", 229.99, 4.8, 0.78, True, 0.0),
    ("cs-001", "Nike Air Force 1 Low", "Classic casual sneaker versatile everyday street wear", "casual_shoes", "Nike", 109.99, 4.6, 0.96, True, 0.0),
    ("cs-002", "Converse Chuck Taylor All Star", "Iconic canvas high-top casual sneaker timeless style", "casual_shoes", "Converse", 59.99, 4.4, 0.89, True, 0.0),
    ("ap-001", "Nike Dri-FIT Running T-Shirt", "Moisture-wicking running shirt lightweight breathable", "sports_shirt", "Nike", 29.99, 4.4, 0.82, True, 0.0),
    ("ap-002", "Lululemon Surge Jogger", "Premium athletic jogger pants for running casual wear", "sports_pants", "Lululemon", 118.00, 4.8, 0.68, True, 0.0),
    ("ac-001", "Garmin Forerunner 965", "Premium flagship GPS running watch advanced metrics AMOLED", "running_accessories", "Garmin", 599.99, 4.8, 0.65, True, 0.0),
]
_SEED_SCHEMA = ("id string, name string, desc string, category string, brand string, price double, "
                "rating double, popularity double, stock boolean, discount double")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _in_order(df: DataFrame) -> DataFrame:
    """Number the products as they stand in the files: files by name, blocks of a file, then rows.

    A block is read by one task, whose counter gives the order of its rows. Only the list of files and
    blocks is ordered in one place.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = df.withColumn("_block", block).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    blocks = placed.select("_block").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("_block")).cast("long") - 1)
    numbered = placed.join(blocks, "_block").withColumn("ordinal", F.shiftleft("_nth", 33) + F.col("_row"))
    return numbered.drop("_block", "_row", "_nth").withColumnRenamed("id", "product_id")


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """``fmt``: json (one array a file, which one task reads), jsonl (a product a line) or parquet."""
    if fmt == "parquet":
        return _in_order(spark.read.schema(schema).parquet(path))
    return _in_order(spark.read.option("multiLine", fmt == "json").schema(schema).json(path))


def read_legacy_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """id, name, desc, category and price."""
    return _read(spark, path, LEGACY_SCHEMA, fmt)


def load_catalog(spark: SparkSession, *paths: str, seed: bool = False, fmt: str = "json") -> DataFrame:
    """The first of ``paths`` that exists; missing fields get defaults. The seed catalogue only where asked for."""
    for path in paths:
        if _exists(spark, path):
            return with_catalog_defaults(_read(spark, path, CATALOG_SCHEMA, fmt))
    if not seed:
        raise FileNotFoundError(f"no catalogue at {', '.join(paths)}")
    raw = spark.createDataFrame([(i, *row) for i, row in enumerate(SEED)], f"ordinal long, {_SEED_SCHEMA}")
    return with_catalog_defaults(raw.withColumnRenamed("id", "product_id"))


def save_catalog(products: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Products with the names of the catalogue schema, as jsonl or parquet."""
    named = products.withColumnRenamed("product_id", "id")
    kept = named.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG_SCHEMA if f.name in named.columns])
    kept.write.mode("overwrite").format("json" if fmt == "jsonl" else fmt).save(path)


def next_ordinals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Number new products after the existing ones. Numbers rise, but need not be consecutive."""
    base = existing.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).scalar()
    ordered = new.repartitionByRange("product_id").sortWithinPartitions("product_id")
    return ordered.withColumn("ordinal", F.monotonically_increasing_id() + base)
