"""Training of the calibrated churn model and its use as column arithmetic.

The model is a bounded table of numbers: quantile references per feature and, per fold, four
coefficients, an intercept and the two numbers of the calibration sigmoid. Only these reach the
driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import scores
from cartwise.operators.churn import churn_response
from cartwise.operators.quantiles import quantile_refs
from cartwise.operators.rfm import FEATURES, label_churn
from cartwise.session import stage

MODEL_FEATURES = ["f_days", "f_orders", "f_value", "f_days_orders"]
FOLDS = 5
C_TRAINED = 0.1
C_FALLBACK = 1.0
SHUFFLE_BINS = 1024
BIN_ROWS = 100_000


@dataclass(frozen=True)
class ChurnModel:
    refs: list          # per feature the quantile references
    folds: list         # per fold: coefficients, intercept, slope, offset
    train_accuracy: float

    def save(self, spark: SparkSession, path: str) -> None:
        schema = "refs array<array<double>>, folds array<array<double>>, train_accuracy double"
        spark.createDataFrame([asdict(self)], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ChurnModel":
        row = spark.read.parquet(path).first()
        return ChurnModel([list(r) for r in row.refs], [list(f) for f in row.folds], row.train_accuracy)


def model_features(df: DataFrame) -> DataFrame:
    """Log of recency, orders, value, and log recency times orders."""
    days, orders, value = (scores.number(F.col(c)) for c in FEATURES)
    log_days = F.log1p(days)
    return df.withColumns(dict(zip(MODEL_FEATURES, [log_days, orders, value, log_days * orders])))


def _scaled(df: DataFrame, refs: list) -> DataFrame:
    """Features as quantile positions; the references are literals."""
    arrays = [F.array(*[F.lit(float(x)) for x in r]) for r in refs]
    return df.withColumns({
        f: scores.quantile_score(F.col(f), a, len(r)) for f, a, r in zip(MODEL_FEATURES, arrays, refs)
    })


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = FOLDS) -> DataFrame:
    """Add ``fold`` 0..folds-1, equally filled within each class.

    Rows of a class are numbered in the order of a hash of their key: per hash bin in parallel,
    after the number of rows in earlier bins. A bin holds about ``BIN_ROWS`` rows at most.
    """
    bins = max(SHUFFLE_BINS, -(-df.count() // BIN_ROWS))
    binned = df.withColumn("_h", F.xxhash64(key)).withColumn("_bin", F.pmod("_h", F.lit(bins)))
    before = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(label, "_bin").agg(F.count("*").alias("n")).select(
        label, "_bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", key))
    return (
        binned.join(F.broadcast(starts), [label, "_bin"])
        .withColumn("fold", F.pmod(F.col("_start") + inside, F.lit(folds)).cast("int"))
        .drop("_h", "_bin", "_start")
    )


def _fit(df: DataFrame, columns: list[str], label: str, c: float, weight: str | None = None, max_iter: int = 2000):
    """L2 logistic regression with inverse strength ``c`` against the summed loss."""
    total = df.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    lr = LogisticRegression(
        featuresCol="_x", labelCol=label, regParam=1.0 / (c * float(total)) if c else 0.0, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-8,
    )
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(VectorAssembler(inputCols=columns, outputCol="_x").transform(df))


def _balanced(df: DataFrame, label: str) -> DataFrame:
    """Add ``_w``: n / (2 n_class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("c")).collect()  # two rows
    n = sum(r["c"] for r in sizes)
    out = F
    for r in sizes:
        out = out.when(F.col(label) == r[label], F.lit(n / (2.0 * r["c"])))
    return df.withColumn("_w", out)


def _margin(coefficients: list[float]) -> Column:
    *w, b = coefficients
    return sum((F.col(f) * F.lit(float(x)) for f, x in zip(MODEL_FEATURES, w)), F.lit(float(b)))


def _platt(held_out: DataFrame, label: str) -> tuple[float, float]:
    """Slope and offset of the sigmoid from margin to label, with smoothed targets.

    A smoothed target t is a row of class 1 with weight t and one of class 0 with weight 1 - t.
    """
    n1, n0 = held_out.agg(F.sum(label), F.sum(1 - F.col(label))).first()
    high, low = (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    both = held_out.withColumn("_t", target).select("margin", F.inline(F.array(
        F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")),
        F.struct(F.lit(0.0).alias("y"), (1 - F.col("_t")).alias("w")),
    )))
    fitted = _fit(both, ["margin"], "y", 0.0, "w", 200)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def fold_probabilities(df: DataFrame, folds: list) -> Column:
    """Mean of the calibrated probabilities of all folds."""
    ps = [scores.sigmoid(F.lit(a) * _margin(coefs) + F.lit(b)) for *coefs, a, b in folds]
    return sum(ps[1:], ps[0]) / len(ps)


def train_churn_model(labelled: DataFrame, key: str = "customer_id", label: str = "churn") -> ChurnModel:
    """Quantile scaling, then a class-balanced regression per fold calibrated on its held-out rows."""
    features = stage(model_features(labelled).select(key, label, *MODEL_FEATURES), "churn-features")
    by_name = {r["feature"]: list(r["refs"]) for r in quantile_refs(features, MODEL_FEATURES).collect()}  # four rows
    refs = [by_name[f] for f in MODEL_FEATURES]
    rows = stage(stratified_folds(_scaled(features, refs), key, label), "churn-folds")

    def fit_fold(i: int) -> list[float]:
        fitted = _fit(_balanced(rows.filter(F.col("fold") != i), label), MODEL_FEATURES, label, C_TRAINED, "_w")
        coefs = [*map(float, fitted.coefficients), float(fitted.intercept)]
        held_out = rows.filter(F.col("fold") == i).select(label, _margin(coefs).alias("margin"))
        return [*coefs, *_platt(held_out, label)]

    with ThreadPool(FOLDS) as pool:  # folds are independent jobs
        folds = pool.map(inheritable_thread_target(rows.sparkSession)(fit_fold), range(FOLDS))
    hit = (fold_probabilities(rows, folds) >= 0.5).cast("int") == F.col(label)
    accuracy = rows.agg(F.avg(hit.cast("double"))).first()[0]
    return ChurnModel(refs, folds, float(accuracy))


def predict(rfm: DataFrame, model: ChurnModel) -> DataFrame:
    """Response columns from the trained model."""
    scaled = _scaled(model_features(rfm), model.refs)
    p = scaled.withColumn("ml_probability", fold_probabilities(scaled, model.folds)).drop(*MODEL_FEATURES)
    return churn_response(p, F.col("ml_probability"), "real_trained")


def train_fallback(rfm: DataFrame) -> list[float]:
    """Three coefficients and an intercept, fitted to pressure labels of a real RFM table."""
    r, f, m = scores.rfm_scores(*[F.col(c) for c in FEATURES])
    label = scores.pressure_label(*[F.col(c) for c in FEATURES])
    rows = stage(rfm.select(r.alias("r"), f.alias("f"), m.alias("m"), label.alias("y")), "fallback-rows")
    fitted = _fit(rows, ["r", "f", "m"], "y", C_FALLBACK, max_iter=300)
    return [*map(float, fitted.coefficients), float(fitted.intercept)]


def predict_fallback(rfm: DataFrame, coefficients: list[float]) -> DataFrame:
    *w, b = coefficients
    parts = scores.rfm_scores(*[F.col(c) for c in FEATURES])
    margin = sum((s * F.lit(x) for s, x in zip(parts, w)), F.lit(b))
    return churn_response(rfm.withColumn("ml_probability", scores.sigmoid(margin)), F.col("ml_probability"), "fallback_synthetic")


def training_rows(rfm: DataFrame) -> DataFrame:
    return label_churn(rfm, K.CHURN_TRAINING_DAYS)
