"""Fixed values. Results depend on every one of them; none is tuned here."""

# --- session intent: weight per signal, in tie-break order -------------------
INTENT_WEIGHTS = {
    "time_on_product_page": 0.20,
    "product_visit_count": 0.15,
    "cart_add_events": 0.25,
    "scroll_depth": 0.10,
    "avg_spend_score": 0.15,
    "session_recency": 0.15,
}
INTENT_BUCKETS = [(80, "hot_buyer"), (55, "interested_hesitant"), (30, "cold_browser")]
INTENT_BUCKET_FLOOR = "churn_risk"

# --- churn -------------------------------------------------------------------
RISK_TIERS = [
    (0.8, "critical", "win_back_pricing"),
    (0.6, "high", "win_back_pricing"),
    (0.3, "medium", "retention_offer"),
]
RISK_FLOOR = ("low", "none")
RFM_WEIGHTS = {"recency": 0.40, "frequency": 0.35, "monetary": 0.25}
CHURN_LABEL_DAYS = 90
CHURN_TRAINING_DAYS = 45

# --- search ------------------------------------------------------------------
DENSE_DIM = 384
SPARSE_DIM = 8000
LEGACY_DIM = 100
W_DENSE = 0.70
W_SPARSE = 0.30
TOP_CANDIDATES = 100
DEFAULT_TOP_K = 20
DEFAULT_CHURN = 0.5
RELEVANCE_FLOOR = 0.05
RELEVANCE_PENALTY = 0.30
DISCOUNT_LIFT = 0.30
CHURN_LIFT = 0.40
MISSING_PRICE = 9999.0

BASE_WEIGHTS = {"vector": 0.45, "intent": 0.30, "pricing": 0.25}
LABEL_WEIGHTS = {
    "price_sensitive": {"vector": 0.35, "intent": 0.25, "pricing": 0.40},
    "premium": {"vector": 0.40, "intent": 0.25, "pricing": 0.35},
    "urgent_buy": {"vector": 0.45, "intent": 0.40, "pricing": 0.15},
    "gift": {"vector": 0.50, "intent": 0.35, "pricing": 0.15},
    "comparison": {"vector": 0.55, "intent": 0.30, "pricing": 0.15},
    "exploratory": {"vector": 0.50, "intent": 0.25, "pricing": 0.25},
}

# --- query intent keywords, labels in tie-break order -------------------------
INTENT_KEYWORDS = {
    "price_sensitive": [
        "cheap", "cheapest", "affordable", "budget", "low price", "low-price",
        "inexpensive", "discount", "sale", "bargain", "value", "economical",
        "cost-effective", "on sale", "deal", "least expensive", "low cost",
    ],
    "premium": [
        "premium", "luxury", "high-end", "best quality", "top rated", "elite",
        "professional", "pro", "high quality", "finest", "top tier", "best",
    ],
    "comparison": [
        "compare", "vs", "versus", "difference between", "better than",
        "alternative", "which is better", "best option",
    ],
    "gift": [
        "gift", "present", "birthday", "anniversary", "for him", "for her",
        "surprise", "gifting",
    ],
    "urgent_buy": [
        "urgent", "fast shipping", "quick", "same day", "overnight",
        "asap", "right now", "immediately", "today",
    ],
}
NO_INTENT = ("exploratory", 0.30)

# --- slots --------------------------------------------------------------------
PRICE_CEILING_PATTERN = (
    r"(?:under|below|less than|max|maximum|\$)\s*\$?(\d+(?:\.\d{1,2})?)"
)
CATEGORY_PHRASES = {
    "running shoe": "running_shoes",
    "running shoes": "running_shoes",
    "trail shoe": "trail_shoes",
    "trail shoes": "trail_shoes",
    "casual shoe": "casual_shoes",
    "sneaker": "casual_shoes",
    "sandal": "sandals",
    "shirt": "sports_shirt",
    "tee": "sports_shirt",
    "shorts": "sports_shorts",
    "tights": "sports_pants",
    "legging": "sports_pants",
    "kids": "kids_shoes",
}
BRANDS = [
    "nike", "adidas", "brooks", "asics", "new balance", "hoka",
    "saucony", "reebok", "puma", "vans", "converse", "salomon",
    "merrell", "lululemon", "gymshark", "under armour", "mizuno",
    "birkenstock", "teva", "crocs", "havaianas", "garmin", "balega",
]

# --- catalogue defaults -------------------------------------------------------
CATALOG_DEFAULTS = {
    "brand": "Generic",
    "rating": 3.5,
    "popularity": 0.5,
    "stock": True,
    "discount": 0.0,
}

# --- request log --------------------------------------------------------------
HTTP_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
STEP_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]

# --- tokeniser: runs of two or more letters, digits or underscores -------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
