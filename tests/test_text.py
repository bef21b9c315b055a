import pytest
from pyspark.sql import functions as F

from cartwise.functions import text as X
from cartwise.operators import query_intent as Q

# query -> label, confidence, price, brand, category
CASES = [
    ("cheap running shoes", "price_sensitive", .5, None, None, "running_shoes"),
    ("cheapest running shoes", "price_sensitive", .75, None, None, "running_shoes"),
    ("gift for her under $60", "gift", .75, "60", None, None),
    ("nike vs adidas sneaker", "comparison", .5, None, "adidas", "casual_shoes"),
    ("waterproof", "premium", .5, None, None, None),
    ("zzz qqq", "exploratory", .3, None, None, None),
    ("steel bottle deal", "price_sensitive", .5, None, None, "sports_shirt"),
    ("Shoes maximum 60.555", "exploratory", .3, "60.55", None, None),
    ("trail shoes less than 80 from new balance", "exploratory", .3, "80", "new balance", "trail_shoes"),
    ("  URGENT gift  ", "gift", .5, None, None, None),
]


def test_intent_and_slots(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, query string")
    for r in Q.query_slots(Q.query_intent(df)).collect():
        got = (r.intent_label, r.intent_confidence, r.slot_max_price, r.slot_brand, r.slot_category)
        assert got == CASES[r.i][1:], CASES[r.i][0]


def test_slots_map_has_no_nulls(spark):
    df = spark.createDataFrame([("nike shirt",), ("nothing",)], "query string")
    full, empty = [r.slots for r in Q.slots_map(Q.query_slots(df)).collect()]
    assert full == {"brand": "nike", "category": "sports_shirt"} and empty == {}


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("Étion a Über-schön x1_y 7",), ("a b",), ("One",)], "t string")
    toks = X.tokens(F.col("t"))
    rows = df.select(toks.alias("t"), X.bigrams(toks).alias("b")).collect()
    assert rows[0].t == ["étion", "über", "schön", "x1_y"] and rows[0].b == ["étion über", "über schön", "schön x1_y"]
    assert (rows[1].t, rows[1].b) == ([], []) and (rows[2].t, rows[2].b) == (["one"], [])


def test_product_text(spark):
    df = spark.createDataFrame([("N", "", "D", None, "B"), (None, "X", "D", "C", None)], "n string, d string, e string, c string, b string")
    c = [F.col(x) for x in "ndcb"]
    assert [r[0] for r in df.select(X.product_text(*c, F.col("e"))).collect()] == ["N D  B", "X C"]


@pytest.mark.parametrize("label,want", [
    ("price_sensitive", "budget pick at $44.99, 20% off, score 0.875"), ("premium", "premium quality — rated 4.9/5, score 0.875"),
    ("gift", "highly-rated gift option (4.9/5), score 0.875"), ("urgent_buy", "popular & available now, score 0.875"),
    ("comparison", "strong semantic match for comparison, score 0.875"), ("exploratory", "relevant match, score 0.875")])
def test_explanation(spark, label, want):
    out = X.explanation(F.lit(label), F.lit(44.99), F.lit(0.2), F.lit(4.9), F.lit(0.875))
    assert spark.range(1).select(out).first()[0] == want
