"""Training job: transactions to a saved churn model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartwise.operators.churn_model import ChurnModel, train_churn_model, training_rows
from cartwise.operators.cleaning import clean_transactions
from cartwise.operators.rfm import rfm_features


def train(transactions: DataFrame, model_path: str | None = None) -> ChurnModel:
    return train_on(rfm_features(clean_transactions(transactions)), model_path)


def train_on(rfm: DataFrame, model_path: str | None = None) -> ChurnModel:
    """For jobs that need the features for more than the training."""
    model = train_churn_model(training_rows(rfm))
    if model_path:
        model.save(rfm.sparkSession, model_path)
    return model
