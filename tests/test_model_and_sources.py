import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.operators import churn_model as M, index, tfidf
from cartwise.operators.rfm import FEATURES, label_churn
from cartwise.session import shared_path, stage
from cartwise.sources import artefacts, catalog, transactions


@pytest.fixture(scope="module")
def rfm(spark):
    rng = np.random.default_rng(11)
    rows = [(f"c{i}", int(rng.integers(0, 365)), int(rng.integers(1, 50)), float(rng.uniform(1, 500))) for i in range(400)]
    return stage(spark.createDataFrame(rows, ["customer_id", *FEATURES]), "rfm-test")


def test_folds_are_stratified(rfm):
    rows = M.stratified_folds(label_churn(rfm, K.CHURN_TRAINING_DAYS), "customer_id", "churn")
    sizes = rows.groupBy("churn").pivot("fold", list(range(5))).count().collect()
    for r in sizes:
        assert max(r[1:]) - min(r[1:]) <= 1


def test_regression_equals_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    fitted = M._fit(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), ["a", "b"], "y", 0.1)
    z, w = np.column_stack([x, np.ones(200)]), np.zeros(3)
    penal = np.diag([1.0, 1.0, 0.0]) / 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penal, z.T @ (p - y) + penal @ w)
    assert [*fitted.coefficients, fitted.intercept] == pytest.approx(list(w), abs=1e-4)


def test_train_save_load_predict(spark, rfm):
    model = M.train_churn_model(label_churn(rfm, K.CHURN_TRAINING_DAYS))
    assert len(model.refs) == 4 and all(len(r) == 100 for r in model.refs) and len(model.folds) == 5
    assert model.train_accuracy > .9
    path = shared_path(spark, "model")
    model.save(spark, path)
    again = M.ChurnModel.load(spark, path)
    assert again == model
    out = M.predict(rfm, again).collect()
    assert {r.model_type for r in out} == {"real_trained"} and all(0 <= r.churn_probability <= 1 for r in out)
    old = [r.ml_probability for r in out if r.days_since_last_purchase > 150]
    new = [r.ml_probability for r in out if r.days_since_last_purchase < 20]
    assert min(old) > max(new)


def test_fallback_model(rfm):
    out = M.predict_fallback(rfm, M.train_fallback(rfm)).collect()
    assert {r.model_type for r in out} == {"fallback_synthetic"} and all(0 <= r.churn_probability <= 1 for r in out)


def test_transactions_csv_keeps_file_order(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
                 "1,a,x,2,2024-01-02 03:04:05,1.5,17,UK\n1,a,x,9,2024-01-02 03:04:05,1.5,17,UK\nC2,b,,-1,2024-01-03 00:00:00,2,,UK\n")
    rows = transactions.read_transactions_csv(spark, str(f)).orderBy("line_no").collect()
    assert [r.quantity for r in rows] == [2, 9, -1] and rows[0].invoice_ts.hour == 3 and rows[2].customer_id is None


def test_transactions_csv_with_quotes_breaks_and_bad_lines(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text('Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n'
                 '1,A,"a ""big"", red box",2,2024-01-02 03:04:05,1.5,17,UK\n'
                 '2,B,"two\nlines",3,2024-01-02 03:04:05,2.5,18,UK\n3,C,x,many,2024-01-02 03:04:05,2.5,18,UK\n')
    rows = transactions.read_transactions_csv(spark, str(f)).orderBy("line_no").collect()
    assert [(r.description, r.quantity, r.price, r.customer_id) for r in rows] == [
        ('a "big", red box', 2, 1.5, "17"), ("two\nlines", 3, 2.5, "18"), ("x", None, 2.5, "18")]
    assert [r.malformed is None for r in rows] == [True, True, False]


def test_catalog_first_existing_then_seed(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('[\n {"id": "p1", "name": "A", "desc": "d", "category": "c", "price": 3, "discount": 0},\n'
                 ' {"id": "p2", "name": "B", "price": 4.5, "stock": false, "discount": 0.1, "rating": 4}\n]')
    rows = catalog.load_catalog(spark, str(tmp_path / "none.json"), str(f)).orderBy("ordinal").collect()
    assert [(r.product_id, r.brand, r.rating, r.popularity, r.stock, r.discount) for r in rows] == [
        ("p1", "Generic", 3.5, 0.5, True, 0.0), ("p2", "Generic", 4.0, 0.5, False, 0.1)]
    assert catalog.load_catalog(spark, str(tmp_path / "none.json"), seed=True).count() == 10
    with pytest.raises(FileNotFoundError):
        catalog.load_catalog(spark, str(tmp_path / "none.json"))
    assert catalog.read_legacy_catalog(spark, str(f)).columns == ["product_id", "name", "desc", "category", "price", "ordinal"]
    out = str(tmp_path / "out")
    catalog.save_catalog(catalog.load_catalog(spark, str(f)), out, "parquet")
    more = catalog.next_ordinals(catalog.load_catalog(spark, out, fmt="parquet"), spark.createDataFrame([("p4",), ("p3",)], "product_id string"))
    first, second = [r.ordinal for r in more.orderBy("product_id").collect()]
    assert 1 < first < second


def test_catalog_of_several_files_keeps_their_order(spark, tmp_path):
    for name, ids in (("b", "xyz"), ("a", "qr"), ("c", "k")):
        (tmp_path / f"{name}.json").write_text("[" + ", ".join(f'{{"id": "{i}", "name": "{"n" * (50 if name == "a" else 1)}"}}' for i in ids) + "]")
    rows = catalog.load_catalog(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert "".join(r.product_id for r in rows) == "qrxyzk"


def test_artefacts_are_reused(spark, tmp_path):
    calls = []
    docs = spark.createDataFrame([("red shoe",), ("blue shoe",)], "text string")

    def fit():
        calls.append(1)
        return tfidf.fit_vocab(docs, "text", tfidf.LEGACY)

    for _ in range(2):
        assert artefacts.load_or_fit(spark, str(tmp_path / "vocab"), fit).count() == 3
    assert len(calls) == 1


def test_index_saved_and_loaded(spark, tmp_path):
    cat = catalog.load_catalog(spark, seed=True)
    ix = index.build_index(cat, stage, 5)
    artefacts.save_index(ix, str(tmp_path / "ix"))
    again = artefacts.load_index(spark, str(tmp_path / "ix"))
    assert again.k == artefacts.load_index(spark, str(tmp_path / "ix"), 3).k == 5
    with pytest.raises(ValueError):
        artefacts.load_index(spark, str(tmp_path / "ix"), 6)
    assert again.postings.count() == ix.postings.count() and again.members.count() == 10
