"""Text expressions: product text, tokens, query intent and slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwise import constants as K

# fixed values: every character that counts as white space around a text
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def product_text(name: Column, desc: Column, category: Column, brand: Column,
                 description: Column | None = None) -> Column:
    """Text of a product; a null or empty ``desc`` gives way to ``description``."""
    body = F.nullif(desc, F.lit(""))
    if description is not None:
        body = F.coalesce(body, description)
    parts = [F.coalesce(c, F.lit("")) for c in (name, body, category, brand)]
    return F.btrim(F.concat_ws(" ", *parts), F.lit(WHITE_SPACE))


def corpus_text(name: Column, desc: Column, category: Column, brand: Column) -> Column:
    """Search corpus text: same order, not trimmed; a missing name stays missing."""
    rest = [F.coalesce(c, F.lit("")) for c in (desc, category, brand)]
    return F.when(name.isNotNull(), F.concat_ws(" ", name, *rest))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN), F.lit(0))


def bigrams(toks: Column) -> Column:
    """Neighbouring pairs; an array of fewer than two tokens has none."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(
        F.slice(toks, F.lit(1), n), F.slice(toks, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)
    )


def content_hash(text: Column) -> Column:
    return F.md5(text)


def normalized_query(q: Column) -> Column:
    return F.btrim(F.lower(q), F.lit(WHITE_SPACE))


# --- query intent ---------------------------------------------------------------

def keyword_hits(q: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in ``q`` as plain substrings."""
    return reduce(lambda a, b: a + b, [F.contains(q, F.lit(k)).cast("int") for k in keywords])


def hit_counts(q: Column) -> Column:
    """One count per label. Kept as a column of its own so that the text is scanned once."""
    return F.array(*[keyword_hits(q, kws) for kws in K.INTENT_KEYWORDS.values()])


def label_and_confidence(hits: Column) -> tuple[Column, Column]:
    conf = F.transform(
        hits,
        lambda h: F.when(h > 0, F.least(F.lit(0.95), 0.50 + 0.25 * (h - 1))).otherwise(F.lit(0.0)),
    )
    best = F.array_max(conf)
    labels = F.array(*[F.lit(k) for k in K.INTENT_KEYWORDS])
    label = F.element_at(labels, F.array_position(conf, best).cast("int"))
    return (
        F.when(best > 0, label).otherwise(F.lit(K.NO_INTENT[0])),
        F.when(best > 0, best).otherwise(F.lit(K.NO_INTENT[1])),
    )


def price_ceiling(q: Column) -> Column:
    """First price limit named in the query, as written; null without one."""
    return F.nullif(F.regexp_extract(q, K.PRICE_CEILING_PATTERN, 1), F.lit(""))


def _longest_match(q: Column, phrases: dict[str, str]) -> Column:
    ordered = sorted(phrases, key=len, reverse=True)
    return F.coalesce(*[F.when(F.contains(q, F.lit(p)), F.lit(phrases[p])) for p in ordered])


def brand_slot(q: Column) -> Column:
    return _longest_match(q, {b: b for b in K.BRANDS})


def category_slot(q: Column) -> Column:
    return _longest_match(q, K.CATEGORY_PHRASES)


# --- explanation ------------------------------------------------------------------

def explanation(label: Column, price: Column, discount: Column, rating: Column,
                score: Column) -> Column:
    budget = F.concat_ws(
        ", ",
        F.format_string("budget pick at $%.2f", price),
        F.when(discount > 0, F.concat((discount * 100).cast("int"), F.lit("% off"))),
    )
    reason = (
        F.when(label == "price_sensitive", budget)
        .when(label == "premium", F.format_string("premium quality — rated %.1f/5", rating))
        .when(label == "gift", F.format_string("highly-rated gift option (%.1f/5)", rating))
        .when(label == "urgent_buy", F.lit("popular & available now"))
        .when(label == "comparison", F.lit("strong semantic match for comparison"))
        .otherwise(F.lit("relevant match"))
    )
    return F.concat(reason, F.format_string(", score %.3f", score))
