"""SQL that states the expected result of each registered query, for DuckDB."""

from __future__ import annotations

from cartwise import constants as K
from cartwise.sources.tables import CATEGORY_OF_TYPE, OPENING_OF_SEGMENT

ORACLE: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(expr: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {_quote(default)} END"


# --- transactions, RFM, churn -----------------------------------------------------------

TX = """
tx AS (SELECT l_orderkey AS invoice, l_partkey AS stock_code, o_custkey AS customer_id, l_linenumber AS line_no,
  l_quantity AS quantity, l_extendedprice / l_quantity AS price, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CLEAN = """
sales AS (SELECT * FROM tx WHERE customer_id IS NOT NULL AND ts IS NOT NULL AND quantity IS NOT NULL
  AND price IS NOT NULL AND quantity > 0 AND price > 0),
firsts AS (SELECT * FROM sales QUALIFY row_number() OVER (
  PARTITION BY invoice, stock_code, customer_id ORDER BY line_no, quantity, price, ts) = 1),
clean AS (SELECT *, quantity * price AS amount FROM firsts
  WHERE price <= (SELECT quantile_cont(price, 0.99) FROM firsts))"""
RFM = """
totals AS (SELECT customer_id, max(ts) AS last_ts, count(DISTINCT invoice) AS orders, sum(amount) AS spend
  FROM clean GROUP BY customer_id),
rfm AS (SELECT customer_id, CAST(floor((epoch((SELECT max(last_ts) FROM totals)) - epoch(last_ts)) / 86400) AS BIGINT) AS d,
  orders AS o, spend / orders AS v FROM totals)"""
_RFM = (TX, CLEAN, RFM)


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _risk(d: str, o: str, v: str, days: float, orders: float, value: float) -> str:
    return _clamp(
        f"1 - (greatest(1.0::DOUBLE, 5 * (1 - least({d}, {days}) / {days}::DOUBLE)) * 0.4::DOUBLE"
        f" + greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1 + {o} / {orders}::DOUBLE * 4)) * 0.35::DOUBLE"
        f" + greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1 + {v} / {value}::DOUBLE * 4)) * 0.25::DOUBLE) / 5"
    )


def _tier(p: str, pick: int, floor: str) -> str:
    whens = " ".join(f"WHEN {p} >= {t[0]} THEN '{t[pick]}'" for t in K.RISK_TIERS)
    return f"CASE {whens} ELSE '{floor}' END"


R01 = _clamp("1 - d / 365.0::DOUBLE")
F01 = _clamp("o / 50.0::DOUBLE")
M01 = _clamp("v / 500.0::DOUBLE")
CHURN = f"""
churn AS (SELECT *, {_risk('d', 'o', 'v', 90, 20, 200)} AS p, {R01} AS r01, {F01} AS f01, {M01} AS m01 FROM rfm)"""

ORACLE["rfm_clean_funnel"] = _with(TX, CLEAN, """
stages AS (
  SELECT 1 AS step, 'initial' AS stage, count(*) AS n_rows FROM tx UNION ALL
  SELECT 2, 'complete', count(*) FROM tx WHERE customer_id IS NOT NULL AND ts IS NOT NULL AND quantity IS NOT NULL AND price IS NOT NULL UNION ALL
  SELECT 3, 'positive', count(*) FROM sales UNION ALL
  SELECT 4, 'unique', count(*) FROM firsts UNION ALL
  SELECT 5, 'final', count(*) FROM clean)""") + """
SELECT CAST(step AS BIGINT) AS step, stage, n_rows, coalesce(lag(n_rows) OVER (ORDER BY step) - n_rows, 0) AS removed FROM stages"""

ORACLE["transaction_summary"] = _with(TX, CLEAN) + """
SELECT count(*) AS transactions, count(DISTINCT customer_id) AS customers,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM clean"""

ORACLE["transactions_csv"] = _with(TX) + """
SELECT customer_id, count(*) AS n_rows, sum(quantity)::BIGINT AS quantity, round(sum(price), 2) AS price_sum,
  max(length('part "' || stock_code || '", boxed in two lines')) AS longest, 0 AS malformed,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM tx GROUP BY customer_id"""
ORACLE["rfm_features"] = _with(*_RFM) + """
SELECT customer_id, d AS days_since_last_purchase, o AS total_order_count, round(v, 6) AS avg_order_value FROM rfm"""

ORACLE["rfm_profile"] = _with(*_RFM) + " UNION ALL ".join(
    f"""
SELECT '{name}' AS feature, round(min({c})::DOUBLE, 2) AS min_value, round(max({c})::DOUBLE, 2) AS max_value,
  round(median({c})::DOUBLE, 2) AS median_value FROM rfm"""
    for name, c in (("days_since_last_purchase", "d"), ("total_order_count", "o"), ("avg_order_value", "v")))

ORACLE["churn_label_rate"] = _with(*_RFM) + """
SELECT t AS threshold_days, CAST(sum((d > t)::INT) AS BIGINT) AS churned, CAST(sum((d <= t)::INT) AS BIGINT) AS retained,
  round(avg((d > t)::INT) * 100, 4) AS churn_pct
FROM rfm, (VALUES (45::BIGINT), (90::BIGINT)) AS th(t) GROUP BY t"""

_BREAKDOWN = "round(r01, 4) AS recency_score, round(f01, 4) AS frequency_score, round(m01, 4) AS monetary_score"
ORACLE["churn_calibrated"] = _with(*_RFM, CHURN) + f"""
SELECT customer_id, round(p, 4) AS churn_probability, {_tier('p', 1, 'low')} AS churn_risk_level, {_BREAKDOWN},
  {_tier('p', 2, 'none')} AS recommended_action FROM churn"""

ORACLE["churn_legacy"] = _with(*_RFM) + f"""
SELECT customer_id, round({_risk('d', 'o', 'v', 365, 50, 500)}, 4) AS legacy_probability FROM rfm"""

ORACLE["churn_pressure_label"] = _with(*_RFM, CHURN) + """
SELECT customer_id, CAST(1.8::DOUBLE * (1 - r01) + 1.5::DOUBLE * (1 - f01) + (1 - m01) > 1.9 AS BIGINT) AS pressure_churn FROM churn"""

_FOLDS = ", ".join(f"(n + {5 - f}) // 5" if f else "n // 5" for f in range(5))
ORACLE["churn_model_checks"] = _with(*_RFM, f"""
sizes AS (SELECT CASE WHEN d > {K.CHURN_TRAINING_DAYS} THEN 1 ELSE 0 END AS churn, count(*) AS n FROM rfm GROUP BY 1),
folds AS (SELECT churn, unnest([0, 1, 2, 3, 4]) AS fold, unnest([{_FOLDS}]) AS n FROM sizes)""") + """
SELECT model || '_' || what AS check_name, n FROM (VALUES ('trained'), ('fallback')) m(model),
  (SELECT 'rows' AS what, count(*) AS n FROM rfm UNION ALL SELECT 'below_formula', 0 UNION ALL SELECT 'wrong_tier', 0 UNION ALL SELECT 'outside_0_1', 0)
UNION ALL SELECT concat('fold_', churn, '_', fold), n FROM folds WHERE n > 0
UNION ALL SELECT 'accuracy_recomputed', 1"""
ORACLE["risk_distribution"] = _with(*_RFM, CHURN) + f"""
SELECT c_mktsegment, {_tier('p', 1, 'low')} AS churn_risk_level, count(*) AS customers, min(round(p, 4)) AS min_probability,
  max(round(p, 4)) AS max_probability, round(avg(round(p, 4)), 6) AS mean_probability
FROM churn JOIN customer ON c_custkey = customer_id GROUP BY 1, 2"""


def _quantile_score(c: str) -> str:
    """Mean of forward and backward interpolation among 100 references."""
    lo, hi = f"len(list_filter(q_{c}, lambda r: r < {c}))", f"len(list_filter(q_{c}, lambda r: r <= {c}))"
    return f"""
CASE WHEN {c} <= q_{c}[1] THEN 0.0 WHEN {c} >= q_{c}[100] THEN 1.0
  WHEN {hi} > {lo} THEN ({lo} + {hi} - 1) / 198.0::DOUBLE
  ELSE ({hi} - 1 + ({c} - q_{c}[{hi}]) / (q_{c}[{hi} + 1] - q_{c}[{hi}])) / 99.0::DOUBLE END"""


_GRID = "[" + ", ".join(f"{i / 99!r}" for i in range(100)) + "]"
ORACLE["rfm_quantile_transform"] = _with(*_RFM, f"""
refs AS (SELECT quantile_cont(d::DOUBLE, {_GRID}) AS q_d, quantile_cont(o::DOUBLE, {_GRID}) AS q_o, quantile_cont(v, {_GRID}) AS q_v FROM rfm)""") + f"""
SELECT customer_id, round({_quantile_score('d')}, 6) AS q_days_since_last_purchase,
  round({_quantile_score('o')}, 6) AS q_total_order_count, round({_quantile_score('v')}, 6) AS q_avg_order_value FROM rfm, refs"""

ORACLE["churn_error_rows"] = _with(f"""
raw AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS d,
  TRY_CAST(CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT)::VARCHAR ELSE 'n/a' END AS DOUBLE) AS o, sqrt(value) * 10 AS v FROM events),
scored AS (SELECT *, d IS NOT NULL AND o IS NOT NULL AND v IS NOT NULL AS ok, {_risk('d', 'o', 'v', 90, 20, 200)} AS p,
  {R01} AS r01, {F01} AS f01, {M01} AS m01 FROM raw)""") + f"""
SELECT event_id, CASE WHEN ok THEN round(p, 4) ELSE 0.0 END AS churn_probability,
  CASE WHEN ok THEN {_tier('p', 1, 'low')} ELSE 'error' END AS churn_risk_level,
  CASE WHEN ok THEN round(r01, 4) ELSE 0.0 END AS recency_score, CASE WHEN ok THEN round(f01, 4) ELSE 0.0 END AS frequency_score,
  CASE WHEN ok THEN round(m01, 4) ELSE 0.0 END AS monetary_score,
  CASE WHEN ok THEN {_tier('p', 2, 'none')} ELSE 'none' END AS recommended_action FROM scored"""

# --- sessions ------------------------------------------------------------------------------

SESSIONS = """
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM gaps),
sess AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end,
  count(*) FILTER (event_type = 'view')::DOUBLE AS visits, coalesce(sum(value * 0.997::DOUBLE) FILTER (event_type = 'view'), 0.0) AS secs,
  count(*) FILTER (event_type = 'click')::DOUBLE AS carts, avg(value) / 487.0::DOUBLE AS scroll,
  coalesce(avg(value) FILTER (event_type = 'purchase') / 487.0::DOUBLE, 0.0) AS spend,
  epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) AS idle_us
  FROM numbered GROUP BY user_id, session_no),
feat AS (SELECT *, idle_us / 3.6e9::DOUBLE AS hours FROM sess)"""
SIGNALS = """
sig AS (SELECT *,
  CASE WHEN secs <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, secs / 120.0::DOUBLE)) END AS s_time,
  CASE WHEN visits <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ln(1 + visits) / ln(21.0::DOUBLE))) END AS s_visit,
  greatest(0.0, least(1.0, carts / 5.0::DOUBLE)) AS s_cart, greatest(0.0, least(1.0, scroll)) AS s_scroll,
  greatest(0.0, least(1.0, CASE WHEN spend > 1 THEN spend / 100 ELSE spend END)) AS s_spend,
  CASE WHEN hours BETWEEN 0 AND 1 THEN hours ELSE least(1.0, exp(-(hours / 24) / 7)) END AS s_recency FROM feat)"""
SCORED = """
contrib AS (SELECT *, s_time * 0.20::DOUBLE AS c1, s_visit * 0.15::DOUBLE AS c2, s_cart * 0.25::DOUBLE AS c3,
  s_scroll * 0.10::DOUBLE AS c4, s_spend * 0.15::DOUBLE AS c5, s_recency * 0.15::DOUBLE AS c6 FROM sig),
scored AS (SELECT *, greatest(0.0, least(100.0, (c1 + c2 + c3 + c4 + c5 + c6) * 100)) AS raw,
  [round(c1, 4), round(c2, 4), round(c3, 4), round(c4, 4), round(c5, 4), round(c6, 4)] AS cs FROM contrib),
intent AS (SELECT *, round(raw, 2) AS intent_score,
  CASE WHEN raw >= 80 THEN 'hot_buyer' WHEN raw >= 55 THEN 'interested_hesitant' WHEN raw >= 30 THEN 'cold_browser' ELSE 'churn_risk' END AS score_bucket,
  ['time_on_product_page', 'product_visit_count', 'cart_add_events', 'scroll_depth', 'avg_spend_score', 'session_recency'][list_position(cs, list_max(cs))] AS dominant_signal
  FROM scored)"""
_START = "strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start"

ORACLE["session_features"] = _with(SESSIONS) + f"""
SELECT user_id, {_START}, strftime(session_end, '%Y-%m-%d %H:%M:%S') AS session_end, round(secs, 6) AS time_on_product_page,
  round(visits, 6) AS product_visit_count, round(carts, 6) AS cart_add_events, round(scroll, 6) AS scroll_depth,
  round(spend, 6) AS avg_spend_score, round(hours, 6) AS session_recency FROM feat"""
ORACLE["normalized_signals"] = _with(SESSIONS, SIGNALS) + f"""
SELECT user_id, {_START}, round(s_time, 9) AS time_on_product_page, round(s_visit, 9) AS product_visit_count,
  round(s_cart, 9) AS cart_add_events, round(s_scroll, 9) AS scroll_depth, round(s_spend, 9) AS avg_spend_score,
  round(s_recency, 9) AS session_recency FROM sig"""
ORACLE["intent_score"] = _with(SESSIONS, SIGNALS, SCORED) + f"""
SELECT user_id, {_START}, intent_score, score_bucket, dominant_signal, cs[1] AS c_time_on_product_page, cs[2] AS c_product_visit_count,
  cs[3] AS c_cart_add_events, cs[4] AS c_scroll_depth, cs[5] AS c_avg_spend_score, cs[6] AS c_session_recency FROM intent"""
ORACLE["live_session_scores"] = ORACLE["intent_score"]
# as a stream: recency is measured at the end of the session window, half an hour after the last event
ORACLE["session_intent_stream"] = _with(SESSIONS.replace("idle_us / 3.6e9::DOUBLE AS hours", "0.5::DOUBLE AS hours"), SIGNALS, SCORED) + f"""
SELECT user_id, {_START}, intent_score, score_bucket, dominant_signal FROM intent"""
ORACLE["intent_bucket_counts"] = _with(SESSIONS, SIGNALS, SCORED) + """
SELECT score_bucket, count(*) AS sessions, round(avg(intent_score), 2) AS mean_score FROM intent GROUP BY 1"""

# --- query understanding -------------------------------------------------------------------

REQUESTS = f"""
asked AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 40 = 7 THEN 'qqzz' || c_custkey WHEN c_custkey % 40 = 11 THEN 'zzqq ' || p_name ELSE concat({_case('c_mktsegment', OPENING_OF_SEGMENT, 'show')}, ' ', p_name, ' ', p_brand,
  CASE c_nationkey % 3 WHEN 0 THEN ' sneaker' WHEN 1 THEN ' under $' || CAST(floor(p_retailprice) AS BIGINT)::VARCHAR ELSE '' END) END AS query
  FROM customer JOIN part ON c_custkey % (SELECT count(*) FROM part) = p_partkey)"""
TEXTS = """
texts AS (SELECT 'turn' AS origin, conv_id * 10000 + turn AS key, text AS query FROM conversations UNION ALL
  SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'request', query_id, query FROM asked)"""


def _hits(keywords: list[str]) -> str:
    return " + ".join(f"contains(q, {_quote(k)})::INT" for k in keywords)


def _understood(source: str, keep: str) -> str:
    hits = ", ".join(f"{_hits(kws)} AS h_{label}" for label, kws in K.INTENT_KEYWORDS.items())
    conf = "[" + ", ".join(
        f"CASE WHEN h_{label} > 0 THEN least(0.95, 0.5 + 0.25 * (h_{label} - 1)) ELSE 0.0 END::DOUBLE" for label in K.INTENT_KEYWORDS) + "]"
    labels = "[" + ", ".join(_quote(k) for k in K.INTENT_KEYWORDS) + "]"
    brands = " ".join(f"WHEN contains(q, {_quote(b)}) THEN {_quote(b)}" for b in sorted(K.BRANDS, key=len, reverse=True))
    cats = " ".join(f"WHEN contains(q, {_quote(p)}) THEN {_quote(K.CATEGORY_PHRASES[p])}"
                    for p in sorted(K.CATEGORY_PHRASES, key=len, reverse=True))
    return f"""
lowered AS (SELECT {keep}, trim(lower(query)) AS q FROM {source}),
counted AS (SELECT *, {hits} FROM lowered),
confs AS (SELECT *, {conf} AS conf FROM counted),
understood AS (SELECT {keep},
  CASE WHEN list_max(conf) > 0 THEN {labels}[list_position(conf, list_max(conf))] ELSE 'exploratory' END AS intent_label,
  CASE WHEN list_max(conf) > 0 THEN list_max(conf) ELSE 0.3 END::DOUBLE AS intent_confidence,
  nullif(regexp_extract(q, {_quote(K.PRICE_CEILING_PATTERN)}, 1), '') AS slot_max_price,
  CASE {brands} END AS slot_brand, CASE {cats} END AS slot_category FROM confs)"""


ORACLE["query_intents"] = _with(REQUESTS, TEXTS, _understood("texts", "origin, key")) + """
SELECT origin, key, intent_label, intent_confidence FROM understood"""
ORACLE["query_slots"] = _with(REQUESTS, TEXTS, _understood("texts", "origin, key")) + """
SELECT origin, key, slot_max_price, slot_brand, slot_category FROM understood"""

# --- text and vectors ------------------------------------------------------------------------

PRODUCTS = f"""
sold AS (SELECT l_partkey AS pid, sum(l_quantity) AS qty, avg(l_discount) AS ad FROM lineitem GROUP BY 1),
products AS (SELECT p_partkey AS product_id, p_name AS name, lower(p_type) AS descr,
  {_case('p_type', CATEGORY_OF_TYPE, 'other')} AS category, p_brand AS brand, p_retailprice AS price,
  round(3 + p_size / 25.0::DOUBLE, 2) AS rating, p_size % 10 <> 0 AS stock,
  coalesce(qty / (SELECT max(qty) FROM sold), 0.5) AS popularity, round(coalesce(ad, 0.0), 4) AS discount,
  concat_ws(' ', p_name, lower(p_type), {_case('p_type', CATEGORY_OF_TYPE, 'other')}, p_brand) AS text
  FROM part LEFT JOIN sold ON pid = p_partkey)"""


def _tokens(name: str, source: str, key: str, text: str = "text") -> str:
    return f"{name}_tok AS (SELECT {key}, regexp_extract_all(lower({text}), '{K.TOKEN_PATTERN}') AS t FROM {source})"


def _terms(name: str, key: str, ngrams: int) -> str:
    """One row per occurrence of a term."""
    pairs = f"""
  UNION ALL SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM {name}_tok"""
    return f"{name}_terms AS (SELECT {key}, unnest(t) AS term FROM {name}_tok{pairs if ngrams == 2 else ''})"


def _vocab(out: str, terms: str, source: str, key: str, size: int, first: int = 0, space: str = "", only_words: bool = False) -> str:
    where = "WHERE NOT contains(term, ' ')" if only_words else ""
    return f"""
{out}_top AS (SELECT term, count(*) AS tf, count(DISTINCT {key}) AS df FROM {terms} {where} GROUP BY term ORDER BY tf DESC, term LIMIT {size}),
{out} AS (SELECT term, row_number() OVER (ORDER BY term) - 1 + {first} AS fid, '{space}' AS space, tf, df,
  ln((1 + (SELECT count(*) FROM {source}))::DOUBLE / (1 + df)) + 1 AS idf FROM {out}_top)"""


def _weights(out: str, terms: str, vocab: str, key: str, sublinear: bool = True) -> str:
    tf = "1 + ln(count(*))" if sublinear else "count(*)"
    return f"""
{out}_raw AS (SELECT {key}, space, fid, ({tf}) * any_value(idf) AS raw FROM {terms} JOIN {vocab} USING (term) GROUP BY {key}, space, fid),
{out} AS (SELECT {key}, space, fid, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key}, space)) AS weight FROM {out}_raw)"""


ORACLE["product_texts"] = _with(PRODUCTS) + """
SELECT product_id, trim(text) AS text, md5(trim(text)) AS text_hash FROM products"""

_VOCAB_OUT = "\nSELECT term, CAST(fid AS BIGINT) AS fid, tf, df, round(idf, 6) AS idf FROM v"
ORACLE["tfidf_vocab_legacy"] = _with(PRODUCTS, _tokens("p", "products", "product_id"), _terms("p", "product_id", 1),
                                     _vocab("v", "p_terms", "products", "product_id", K.LEGACY_DIM)) + _VOCAB_OUT
ORACLE["tfidf_vocab_dense"] = _with(_tokens("d", "documents", "doc_id"), _terms("d", "doc_id", 1),
                                    _vocab("v", "d_terms", "documents", "doc_id", K.DENSE_DIM)) + _VOCAB_OUT
ORACLE["tfidf_vocab_sparse"] = _with(_tokens("d", "documents", "doc_id"), _terms("d", "doc_id", 2),
                                     _vocab("v", "d_terms", "documents", "doc_id", K.SPARSE_DIM, K.DENSE_DIM)) + _VOCAB_OUT
ORACLE["tfidf_vectors"] = _with(_tokens("d", "documents", "doc_id"), _terms("d", "doc_id", 1),
                                _vocab("v", "d_terms", "documents", "doc_id", K.DENSE_DIM), _weights("w", "d_terms", "v", "doc_id")) + """
SELECT doc_id, CAST(fid AS BIGINT) AS fid, round(weight, 6) AS weight FROM w"""
ORACLE["embed_once_store"] = _with(_tokens("d", "documents", "doc_id"), _terms("d", "doc_id", 1),
                                   _vocab("v", "d_terms", "documents", "doc_id", K.DENSE_DIM), _weights("w", "d_terms", "v", "doc_id"), """
sums AS (SELECT doc_id, count(*) AS terms, sum(weight) AS weight FROM w GROUP BY 1),
early AS (SELECT DISTINCT md5(text) AS h FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
runs AS (SELECT (SELECT count(*) FROM early) AS reused, count(DISTINCT md5(text)) AS texts FROM documents)""") + """
SELECT doc_id, md5(text) AS text_hash, CASE WHEN md5(text) IN (SELECT h FROM early) THEN 0 ELSE 1 END::BIGINT AS run,
  coalesce(terms, 0) AS terms, round(coalesce(sums.weight, 0.0), 6) AS weight, texts - reused AS embedded, reused
FROM documents LEFT JOIN sums USING (doc_id), runs WHERE text IS NOT NULL"""
ORACLE["product_vectors_legacy"] = _with(
    PRODUCTS, _tokens("p", "products", "product_id"), _terms("p", "product_id", 1),
    _vocab("v", "p_terms", "products", "product_id", K.LEGACY_DIM), _weights("w", "p_terms", "v", "product_id", False)) + """
SELECT product_id, CAST(fid AS BIGINT) AS pos, round(weight, 6) AS x FROM w"""

# streamed products have no category; the vocabulary is the catalogue's
ORACLE["embed_upsert_stream"] = _with(
    PRODUCTS, _tokens("p", "products", "product_id"), _terms("p", "product_id", 1), _vocab("v", "p_terms", "products", "product_id", K.LEGACY_DIM),
    "streamed AS (SELECT p_partkey AS product_id, concat_ws(' ', p_name, lower(p_type), p_brand) AS text FROM part)",
    _tokens("s", "streamed", "product_id"), _terms("s", "product_id", 1), _weights("w", "s_terms", "v", "product_id", False)) + """
SELECT product_id, CAST(fid AS BIGINT) AS fid, round(weight, 6) AS weight FROM w"""
ORACLE["embed_dedupe_md5"] = """
WITH groups AS (SELECT md5(text) AS text_hash, min(doc_id) AS first_key, count(*) AS copies FROM documents GROUP BY 1),
todo AS (SELECT * FROM groups WHERE text_hash NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))
SELECT doc_id, text_hash, first_key, copies FROM documents JOIN todo ON md5(text) = text_hash"""

POOLED = """
cells AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
pooled AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY 1, 2)"""
ORACLE["mean_pool"] = _with(POOLED) + """
SELECT label::BIGINT AS label, pos, round(x, 6) AS x FROM pooled"""
ORACLE["dense_cosine_topk"] = _with(POOLED, """
means AS (SELECT label, list(x ORDER BY pos) AS m FROM pooled GROUP BY label),
sims AS (SELECT means.label AS query_id, vec_id AS ordinal,
  greatest(0.0, round(list_cosine_similarity(m, embedding::DOUBLE[]), 9)) AS sim FROM means, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ordinal) AS rn FROM sims)""") + """
SELECT query_id::BIGINT AS query_id, ordinal, round(sim, 6) AS dense_sim, rn AS retrieval_rank FROM ranked WHERE rn <= 100"""

LEGACY = (
    PRODUCTS, "stocked AS (SELECT * FROM products WHERE stock)", _tokens("p", "stocked", "product_id"), _terms("p", "product_id", 1),
    _vocab("v", "p_terms", "stocked", "product_id", K.LEGACY_DIM), _weights("w", "p_terms", "v", "product_id", False))
USERS = """
items AS (SELECT o_custkey AS user_id, l_partkey AS product_id, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
user_total AS (SELECT user_id, sum(weight) AS total FROM items GROUP BY 1),
user_vec AS (SELECT user_id, fid, sum(items.weight * w.weight) / any_value(total) AS x
  FROM items JOIN w USING (product_id) JOIN user_total USING (user_id) GROUP BY user_id, fid)"""
ORACLE["user_vectors_recent"] = _with(*LEGACY, USERS) + """
SELECT user_id, CAST(fid AS BIGINT) AS pos, round(x, 6) AS x FROM user_vec WHERE x <> 0"""
ORACLE["missing_vector_ids"] = _with(*LEGACY, USERS) + """
SELECT '/ml/user-vector' AS endpoint, user_id, CAST(count(*) FILTER (stocked.product_id IS NOT NULL) AS BIGINT) AS hits,
  CAST(count(*) FILTER (stocked.product_id IS NULL) AS BIGINT) AS misses
FROM items LEFT JOIN stocked USING (product_id) GROUP BY user_id"""
ORACLE["rerank_candidates_v1"] = _with(*LEGACY, USERS, """
req AS (SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'price_sensitive' WHEN 'FURNITURE' THEN 'premium' WHEN 'HOUSEHOLD' THEN 'gift' END AS label,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN 0.75 END::DOUBLE AS confidence,
  CASE WHEN c_nationkey % 5 = 0 THEN 0.6 ELSE 0.45 END::DOUBLE AS wv, 0.30::DOUBLE AS wi, CASE WHEN c_nationkey % 5 = 0 THEN 0.1 ELSE 0.25 END::DOUBLE AS wp
  FROM customer WHERE c_custkey IN (SELECT user_id FROM items)),
cand AS (SELECT o_custkey AS request_id, l_orderkey * 8 + l_linenumber AS position, l_partkey AS product_id, l_discount AS keyword_score,
  CASE WHEN l_returnflag <> 'R' THEN l_tax END AS semantic_score, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
span AS (SELECT request_id, min(price) AS lo, max(price) AS hi FROM cand GROUP BY 1),
pairs AS (SELECT DISTINCT request_id, product_id FROM cand),
dots AS (SELECT request_id, product_id, sum(x * weight) AS dot, sum(weight * weight) AS pp
  FROM pairs JOIN w USING (product_id) JOIN user_vec ON user_id = request_id AND user_vec.fid = w.fid GROUP BY 1, 2),
ulen AS (SELECT user_id, sqrt(sum(x * x)) AS un FROM user_vec GROUP BY 1),
plen AS (SELECT product_id, sqrt(sum(weight * weight)) AS pn FROM w GROUP BY 1),
cos AS (SELECT request_id, product_id, dot / (un * pn) AS cosine FROM dots JOIN ulen ON user_id = request_id JOIN plen USING (product_id)),
base AS (SELECT cand.*, label, confidence, wv, wi, wp, coalesce(cosine, 0.0) AS cosine_score,
  CASE WHEN price IS NULL OR hi = lo THEN 0.5 WHEN label = 'price_sensitive' THEN 1 - (price - lo) / (hi - lo)
    WHEN label = 'premium' THEN (price - lo) / (hi - lo) ELSE 0.5 END AS pricing_score
  FROM cand JOIN req USING (request_id) JOIN span USING (request_id) LEFT JOIN cos USING (request_id, product_id)),
parts AS (SELECT *, wv * vector_score + wi * intent_score + wp * pricing_score AS final FROM (SELECT *, 0.7::DOUBLE * cosine_score + 0.3::DOUBLE * keyword_score AS vector_score,
  coalesce(confidence, 0.0) * CASE WHEN label IN ('price_sensitive', 'premium') THEN pricing_score ELSE coalesce(semantic_score, keyword_score) END AS intent_score FROM base))""") + """
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY round(final, 9) DESC, position, product_id) AS rank, position, product_id, round(final, 6) AS final_score,
  round(vector_score, 6) AS vector_score, round(cosine_score, 6) AS cosine_score, round(keyword_score, 6) AS keyword_score,
  round(intent_score, 6) AS intent_score, round(pricing_score, 6) AS pricing_score, label AS intent_label,
  coalesce(confidence, 0.0) AS intent_confidence FROM parts"""

# --- search -------------------------------------------------------------------------------------

VOCABS = (
    PRODUCTS, _tokens("c", "products", "product_id"), _terms("c", "product_id", 2),
    _vocab("vd", "c_terms", "products", "product_id", K.DENSE_DIM, 0, "dense", True),
    _vocab("vs", "c_terms", "products", "product_id", K.SPARSE_DIM, K.DENSE_DIM, "sparse"),
    "vocab AS (SELECT * FROM vd UNION ALL SELECT * FROM vs)")
ORACLE["postings_build"] = _with(*VOCABS, """
copies AS (SELECT text, min(product_id) AS gid, least(count(*), 100) AS copies FROM products WHERE stock GROUP BY text)""",
    _tokens("g", "copies", "gid"), _terms("g", "gid", 2), _weights("gw", "g_terms", "vocab", "gid")) + """
SELECT gid, copies, CAST(fid AS BIGINT) AS fid, round(weight, 6) AS weight FROM gw JOIN copies USING (gid)"""

RETRIEVED = (
    *VOCABS, _weights("pw", "c_terms", "vocab", "product_id"), REQUESTS,
    _tokens("q", "asked", "query_id", "query"), _terms("q", "query_id", 2), _weights("qw", "q_terms", "vocab", "query_id"), """
stocked AS (SELECT product_id FROM products WHERE stock),
sims AS (SELECT query_id, product_id, sum(CASE WHEN qw.space = 'dense' THEN qw.weight * pw.weight ELSE 0 END) AS dense_sim,
  sum(CASE WHEN qw.space = 'sparse' THEN qw.weight * pw.weight ELSE 0 END) AS sparse_score
  FROM qw JOIN pw USING (fid) JOIN stocked USING (product_id) GROUP BY 1, 2),
every AS (SELECT query_id, product_id, coalesce(dense_sim, 0.0) AS dense_sim, coalesce(sparse_score, 0.0) AS sparse_score
  FROM asked CROSS JOIN stocked LEFT JOIN sims USING (query_id, product_id)),
retrieved AS (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY round(0.7::DOUBLE * dense_sim + 0.3::DOUBLE * sparse_score, 9) DESC, product_id) AS retrieval_rank
  FROM every QUALIFY retrieval_rank <= 100)""")
ORACLE["hybrid_retrieve_topk"] = _with(*RETRIEVED) + """
SELECT query_id, product_id, retrieval_rank, round(dense_sim, 6) AS dense_sim, round(sparse_score, 6) AS sparse_score FROM retrieved"""

# vocabulary of an earlier catalogue: without each fifth product, each seventh under a reversed name
_EARLIER = (PRODUCTS, """
earlier AS (SELECT product_id, CASE WHEN product_id % 7 = 0 THEN concat_ws(' ', reverse(name), descr, category, brand) ELSE text END AS text
  FROM products WHERE product_id % 5 <> 0)""", _tokens("e", "earlier", "product_id"), _terms("e", "product_id", 2),
    _vocab("vd", "e_terms", "earlier", "product_id", K.DENSE_DIM, 0, "dense", True),
    _vocab("vs", "e_terms", "earlier", "product_id", K.SPARSE_DIM, K.DENSE_DIM, "sparse"),
    "vocab AS (SELECT * FROM vd UNION ALL SELECT * FROM vs)", _tokens("c", "products", "product_id"), _terms("c", "product_id", 2))
ORACLE["index_update_search"] = _with(*_EARLIER, *RETRIEVED[len(VOCABS):]) + """
SELECT query_id, product_id, retrieval_rank, round(dense_sim, 6) AS dense_sim, round(sparse_score, 6) AS sparse_score FROM retrieved"""
ORACLE["segment_update_search"] = ORACLE["index_stream_search"] = ORACLE["index_update_search"]
ORACLE["catalog_files"] = _with(PRODUCTS) + """
SELECT fmt, product_id, name, category, CASE WHEN product_id % 9 <> 0 THEN brand ELSE 'Generic' END AS brand, price, rating, stock,
  round(discount, 4) AS discount FROM products, (VALUES ('jsonl'), ('parquet')) f(fmt)"""
ORACLE["index_file_search"] = _with(*RETRIEVED) + """
SELECT query_id, product_id, retrieval_rank, round(dense_sim, 6) AS dense_sim FROM retrieved WHERE retrieval_rank <= 20"""
ORACLE["external_candidates_topk"] = """
SELECT l_suppkey AS query_id, l_orderkey * 8 + l_linenumber AS product_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS retrieval_rank,
  l_extendedprice AS dense_sim, 0.0::DOUBLE AS sparse_score FROM lineitem QUALIFY retrieval_rank <= 100"""

NARROWED = (_understood("asked", "query_id"), """
cand AS (SELECT * FROM retrieved JOIN products USING (product_id) JOIN understood USING (query_id)),
by_cat AS (SELECT * FROM cand QUALIFY slot_category IS NULL OR category = slot_category
  OR NOT bool_or(category = slot_category) OVER (PARTITION BY query_id)),
narrowed AS (SELECT * FROM by_cat QUALIFY slot_max_price IS NULL OR price <= slot_max_price::DOUBLE
  OR NOT bool_or(price <= slot_max_price::DOUBLE) OVER (PARTITION BY query_id))""")
ORACLE["slot_filter_fallback"] = _with(*RETRIEVED, *NARROWED) + """
SELECT query_id, product_id, slot_category, slot_max_price FROM narrowed"""


def _label_weight(name: str) -> str:
    whens = " ".join(f"WHEN '{label}' THEN {w[name]}" for label, w in K.LABEL_WEIGHTS.items())
    own = {"vector": 0.6, "pricing": 0.1}.get(name, K.BASE_WEIGHTS[name])  # a request's own weights fall back to the base ones
    given = f"CASE WHEN query_id % 12 = 5 THEN {own}::DOUBLE ELSE "
    return f"{given}CASE intent_label {whens} ELSE {K.BASE_WEIGHTS[name]} END::DOUBLE END"


RANKED = f"""
normed AS (SELECT *, count(*) OVER w AS total_candidates,
  dense_sim / CASE WHEN max(dense_sim) OVER w = 0 THEN 1 ELSE max(dense_sim) OVER w END AS nd,
  sparse_score / CASE WHEN max(sparse_score) OVER w = 0 THEN 1 ELSE max(sparse_score) OVER w END AS ns,
  (price - min(price) OVER w) / CASE WHEN max(price) OVER w = min(price) OVER w THEN 1 ELSE max(price) OVER w - min(price) OVER w END AS np,
  coalesce(p, 0.5) AS churn_score
  FROM narrowed LEFT JOIN (SELECT customer_id, round(p, 4) AS p FROM churn) ON customer_id = query_id WINDOW w AS (PARTITION BY query_id)),
vec AS (SELECT *, 0.7::DOUBLE * nd + 0.3::DOUBLE * ns AS vs, rating / 5 AS stars FROM normed),
fits AS (SELECT *,
  intent_confidence * {_clamp('''CASE intent_label WHEN 'price_sensitive' THEN 1 - np + discount * 0.30::DOUBLE
    WHEN 'premium' THEN 0.60::DOUBLE * stars + 0.40::DOUBLE * np WHEN 'gift' THEN 0.50::DOUBLE * stars + 0.50::DOUBLE * popularity
    WHEN 'urgent_buy' THEN popularity ELSE vs END''')} AS fi,
  {_clamp('''CASE intent_label WHEN 'price_sensitive' THEN (1 - np + discount * 0.30::DOUBLE) * (1 + 0.40::DOUBLE * churn_score)
    WHEN 'premium' THEN 0.50::DOUBLE * np + 0.50::DOUBLE * stars
    WHEN 'urgent_buy' THEN 0.60::DOUBLE * popularity + 0.40::DOUBLE * (1 - np * 0.40::DOUBLE)
    WHEN 'gift' THEN 0.40::DOUBLE * stars + 0.30::DOUBLE * (1 - abs(np - 0.50::DOUBLE)) + 0.30::DOUBLE * popularity
    ELSE 0.50::DOUBLE + 0.20::DOUBLE * (popularity - 0.50::DOUBLE) END''')} AS fp FROM vec),
pen AS (SELECT *, CASE WHEN vs < 0.05 THEN fi * 0.30::DOUBLE ELSE fi END AS isc, CASE WHEN vs < 0.05 THEN fp * 0.30::DOUBLE ELSE fp END AS psc FROM fits),
final AS (SELECT *, {_label_weight('vector')} * vs + {_label_weight('intent')} * isc + {_label_weight('pricing')} * psc AS fs FROM pen),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 4) DESC, retrieval_rank) AS rank FROM final QUALIFY rank <= CASE WHEN query_id % 10 = 3 THEN 5 ELSE 20 END)"""
_SEARCH = (*_RFM, CHURN, *RETRIEVED, *NARROWED, RANKED)
ORACLE["search_rerank"] = _with(*_SEARCH) + """
SELECT query_id, rank, product_id, name, category, brand, price, discount, rating, round(fs, 4) AS final_score, round(vs, 4) AS vector_score,
  round(nd, 4) AS dense_sim, round(ns, 4) AS sparse_score, round(isc, 4) AS intent_score, round(psc, 4) AS pricing_score,
  intent_label, round(intent_confidence, 4) AS intent_confidence, total_candidates FROM ranked"""
ORACLE["rank_explain"] = _with(*_SEARCH) + """
SELECT query_id, rank, product_id, CASE intent_label
  WHEN 'price_sensitive' THEN printf('budget pick at $%.2f', price) || CASE WHEN discount > 0 THEN printf(', %d%% off', CAST(trunc(discount * 100) AS BIGINT)) ELSE '' END
  WHEN 'premium' THEN printf('premium quality — rated %.1f/5', round(rating, 1)) WHEN 'gift' THEN printf('highly-rated gift option (%.1f/5)', round(rating, 1))
  WHEN 'urgent_buy' THEN 'popular & available now' WHEN 'comparison' THEN 'strong semantic match for comparison' ELSE 'relevant match' END
  || printf(', score %.3f', round(fs, 3)) AS rank_explanation FROM ranked"""

# --- upsert, status, validation -----------------------------------------------------------------

VERSIONS = """
versions AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_retailprice AS price, 0::BIGINT AS version FROM part UNION ALL
  SELECT l_partkey, NULL, NULL, l_extendedprice, l_orderkey * 8 + l_linenumber FROM lineitem),
latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY version DESC, price DESC) = 1)"""
ORACLE["catalog_upsert"] = _with(VERSIONS) + """
SELECT product_id, coalesce(name, '') AS name, coalesce(brand, '') AS brand, price, 3.5::DOUBLE AS rating, 0.5::DOUBLE AS popularity,
  true AS stock, 0.0::DOUBLE AS discount, version FROM latest"""
ORACLE["index_status"] = _with(VERSIONS) + """
SELECT count(product_id) AS indexed_products, max(version) AS max_version FROM latest"""

CHECKED = """
requests AS (SELECT event_id, CASE WHEN event_type <> 'signup' THEN event_type END AS query, value / 100 AS churn_score,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS top_k FROM events),
checked AS (SELECT event_id, CASE WHEN query IS NULL THEN 'query:string' WHEN NOT (churn_score BETWEEN 0 AND 1) THEN 'churn_score:0.0..1.0'
  WHEN NOT (top_k BETWEEN 1 AND 100) THEN 'top_k:1..100' END AS reason FROM requests)"""
ORACLE["validate_rows"] = _with(CHECKED) + "\nSELECT event_id, reason FROM checked"
ORACLE["malformed_by_reason"] = _with(CHECKED) + "\nSELECT reason, count(*) AS n_rows FROM checked WHERE reason IS NOT NULL GROUP BY 1"

# --- request logs ---------------------------------------------------------------------------------

LOG = """
log AS (SELECT *, date_trunc('hour', ts) AS w, '/ml/' || event_type AS path, value / 1000 AS dur,
  TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 = 0 THEN 422 ELSE 200 END AS status FROM events)"""
_W = "strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start"
_RATE = "count(*) AS requests, round(count(*) / 3600.0::DOUBLE, 6) AS per_second"
ORACLE["traffic_rate"] = _with(LOG) + f"\nSELECT {_W}, path, {_RATE} FROM log GROUP BY w, path"
ORACLE["traffic_rate_stream"] = ORACLE["traffic_rate"]
ORACLE["traffic_rate_total"] = _with(LOG) + f"\nSELECT {_W}, {_RATE} FROM log GROUP BY w"
ORACLE["traffic_rate_by_status"] = _with(LOG) + f"\nSELECT {_W}, (status // 100)::VARCHAR || 'xx' AS status_family, {_RATE} FROM log GROUP BY w, 2"
ORACLE["latency_mean"] = _with(LOG) + f"\nSELECT {_W}, round(avg(dur), 9) AS mean_duration_s FROM log GROUP BY w"
ORACLE["success_error_ratio"] = _with(LOG) + f"""
SELECT {_W}, round(avg((status < 300)::INT), 6) AS success_ratio, round(avg((status >= 400)::INT), 6) AS error_ratio FROM log GROUP BY w"""


def _p95(bounds: list[float], by: str) -> str:
    """Bucket counts as rows, then the first bucket whose cumulative count reaches the rank."""
    edges = ", ".join(f"({i}, {([0.0] + bounds)[i]}::DOUBLE, {b}::DOUBLE)" for i, b in enumerate(bounds))
    extra = f", {by}" if by else ""
    return _with(LOG.replace("log AS (SELECT *,", "log AS (SELECT *, event_type AS endpoint, 'step_' || (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 3)::VARCHAR AS step,"), f"""
edges(i, lo, hi) AS (VALUES {edges}),
total AS (SELECT w{extra}, count(*) AS n FROM log GROUP BY w{extra}),
cum AS (SELECT w{extra}, i, lo, hi, count(*) FILTER (dur <= hi) AS c FROM log CROSS JOIN edges GROUP BY w{extra}, i, lo, hi),
steps AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY w{extra} ORDER BY i), 0) AS b FROM cum),
hit AS (SELECT * FROM steps JOIN total USING (w{extra}) WHERE c >= 0.95 * n QUALIFY row_number() OVER (PARTITION BY w{extra} ORDER BY i) = 1)""") + f"""
SELECT {_W}{extra}, n, round(lo + (hi - lo) * (0.95::DOUBLE * n - b) / (c - b), 6) AS quantile_s FROM hit"""


ORACLE["latency_p95_histogram"] = _p95(K.HTTP_BUCKETS, "")
ORACLE["latency_p95_by_path"] = _p95(K.HTTP_BUCKETS, "path")
ORACLE["step_p95_histogram"] = _p95(K.STEP_BUCKETS, "endpoint, step")
ORACLE["label_counter_rates"] = _with(LOG) + f"""
SELECT {_W}, CASE WHEN status = 422 THEN 'malformed:validation' ELSE 'business_error' END AS label, event_type AS endpoint,
  count(*) AS increments, round(count(*) / 3600.0::DOUBLE, 6) AS per_second FROM log WHERE status >= 422 GROUP BY w, 2, 3"""
ORACLE["log_filter"] = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARNING' END || ' HTTP POST ' || event_type AS line
FROM events WHERE user_id % 4 <> 0 AND (event_type = 'error' OR value > 150)"""

ORACLE["cache_lookup_rates"] = """
SELECT strftime(date_trunc('hour', o_orderdate), '%Y-%m-%d %H:%M:%S') AS window_start,
  CASE WHEN p_size % 10 <> 0 THEN 'cache_hit' ELSE 'cache_miss' END AS label, count(*) AS increments,
  round(count(*) / 3600.0::DOUBLE, 6) AS per_second
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""

ORACLE["success_ratio_stream"] = ORACLE["success_error_ratio"]
ORACLE["recent_product_arrays"] = """
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
used AS (SELECT *, CASE WHEN l_orderkey % 3 = 2 THEN 1.0 ELSE l_quantity END::DOUBLE AS w FROM placed WHERE l_orderkey % 3 <> 0 OR i < n)
SELECT l_orderkey AS user_id, count(*) AS n_products, sum(w) AS weight_sum, sum(l_partkey * w) AS weighed_ids FROM used GROUP BY 1"""
ORACLE["malformed_by_endpoint"] = """
WITH e AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
broken AS (
  SELECT 'churn' AS endpoint, CASE WHEN value IS NULL OR value <> trunc(value) THEN 'days_since_last_purchase:bigint' WHEN k IS NULL THEN 'total_order_count:bigint'
    WHEN event_type = 'error' THEN 'avg_order_value:double' END AS reason FROM e UNION ALL
  SELECT 'intent', CASE WHEN event_type = 'error' THEN 'scroll_depth:double?' END FROM e UNION ALL
  SELECT 'product_embed', CASE WHEN event_type = 'signup' THEN 'name:string' END FROM e UNION ALL
  SELECT 'user_vector', CASE WHEN event_type = 'view' THEN 'recent_product_ids:required' WHEN event_type = 'error' THEN 'weights:double?' END FROM e UNION ALL
  SELECT 'rerank', CASE WHEN event_type = 'view' THEN 'user_vector:required' WHEN event_type = 'error' THEN 'candidates:product_id,keyword_score'
    WHEN event_type = 'signup' THEN 'search_intent:label,confidence' END FROM e)
SELECT endpoint, reason, count(*) AS n_rows FROM broken WHERE reason IS NOT NULL GROUP BY ALL"""

# --- round trips, counters of running jobs, running sums ---------------------------------------

ORACLE["funnel_of_one_run"] = ORACLE["rfm_clean_funnel"]
ORACLE["vocab_load_or_fit"] = ORACLE["tfidf_vocab_legacy"]
ORACLE["user_vectors_running"] = ORACLE["user_vectors_recent"]
ORACLE["search_responses_json"] = ORACLE["search_rerank"]
ORACLE["legacy_catalog_file"] = _with(PRODUCTS) + """
SELECT product_id, name, descr AS "desc", category, price FROM products"""
ORACLE["churn_model_files"] = _with(*_RFM) + """
SELECT count(*) AS answers, count(*) AS same FROM rfm"""
ORACLE["vectors_of_384"] = """
WITH v AS (SELECT vec_id, unnest(range(0, 384)) AS i, embedding FROM embeddings),
x AS (SELECT vec_id, i, embedding[i % 64 + 1]::DOUBLE AS x FROM v)
SELECT vec_id, 384 AS padded_size, 384 AS cut_size, round(sum(CASE WHEN i < 64 THEN x * (i + 1) ELSE 0 END), 4) AS padded_sum, round(sum(x * (i + 1)), 4) AS cut_sum
FROM x GROUP BY vec_id"""
ORACLE["stream_counters"] = _with(LOG) + """
SELECT unnest(['requests', 'malformed', 'business_error', 'slow']) AS label,
  unnest([count(*), count(*) FILTER (status = 422), count(*) FILTER (status >= 500), count(*) FILTER (dur > 0.1)]) AS n FROM log"""
