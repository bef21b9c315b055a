import __spark_entry__ as entry_module
from checks.compare import connect, difference

CHEAP = ["churn_calibrated", "query_slots", "tfidf_vocab_sparse", "mean_pool", "success_error_ratio", "validate_rows"]
ROWS_ONLY = {"churn_train_predict", "churn_fallback_predict"}


def test_every_query_has_sql_or_is_known_to_have_none():
    from checks.oracle import ORACLE as sql
    from checks.queries import REGISTRY as queries

    assert set(queries) <= set(entry_module.queries()) and set(sql) <= set(entry_module.oracle_sql())
    assert set(queries) - set(sql) == ROWS_ONLY and set(sql) <= set(queries)


def test_entry(spark, sf):
    assert entry_module.entry(spark).count() > 0


def test_some_queries_equal_their_sql(spark, sf):
    con = connect(sf)
    for name in CHEAP:
        got = entry_module.queries()[name](spark, sf).toPandas()
        assert not difference(got, con.execute(entry_module.oracle_sql()[name]).df()), name
