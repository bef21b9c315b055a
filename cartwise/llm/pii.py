"""Personal data: patterns propose spans, checks confirm them, words nearby adjust a score.

Kinds with a fixed definition (``BASE``) are reported whenever their check passes; their score informs.
The other kinds are too easily matched by chance, so they need a score of ``THRESHOLD``: a confirmed
checksum counts towards it, and so do context words of the kind close before or after the span;
words that speak of orders, parts or versions count against it.

Patterns are written so that a long run of equal characters costs linear time and no deep recursion:
repeated parts are possessive where nothing after them could need a character back, and a match
starts at the beginning of a run or where the previous match ended.

A span is counted in code points, end exclusive; matches of one kind are leftmost and do not overlap,
and a match that fails its check is dropped without another try at its place.

Cases: a null or empty text has no spans. Repeated rows are searched alike, each. Columns of the input
stay, apart from one named ``pii``, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.columns import let, running_sums, with_new

#: Kind -> (pattern, a character that every match holds, weight of a passed check).
_START = r"(?:\G|(?<![%s]))"
BASE = {
    "email": (_START % "A-Za-z0-9._%+-" + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7),
    "ip": (_START % "0-9" + r"[0-9]++(?:\.[0-9]++){3}", ".", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.6),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6),
}
ADDED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", 0.8),
    "short_card": (r"(?<![0-9.-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9.]|[\x20-][0-9])", "", 0.3),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3),
}
KINDS = tuple(BASE) + tuple(ADDED)
CONTEXT = {
    "email": "mail|contact|write to|courriel|correo",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|credit|visa|mastercard|karte|carte|tarjeta|pay",
    "phone": "phone|call|tel|mobile|fax|telefon|llame",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "short_card": "card|credit|amex|american express|diners|karte|carte|tarjeta",
    "ssn": "ssn|social security|taxpayer|national id",
}
AGAINST = "order|invoice|isbn|serial|part no|version|ticket"
BEFORE, AFTER = 40, 24
FOR_CONTEXT, AGAINST_CONTEXT = 0.3, -0.2
THRESHOLD = 0.6


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        value = (F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48) * (1 + i % 2)
        return total + value - F.when(value > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    """ISO 7064: the first four characters go to the end, letters count 10 to 35, remainder 1."""
    compact = F.regexp_replace(match, r"\x20", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return let(_digits(match), lambda d: F.length(d).between(low, high) & F.when(F.length(d).between(low, high), _luhn(d)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by start.

    A text split at the matches gives the gaps between them; the lengths of gaps and matches, summed
    up, give the places, and the ends of the gaps are the context.
    """
    pattern, holds, weight = (BASE | ADDED)[kind]
    none = F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>")
    pattern = F.lit(pattern)

    def located(matches: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(
            running_sums(F.transform(matches, lambda m, i: (F.length(gaps[i]) + F.length(m)).cast("long"))),
            lambda before: F.filter(F.transform(matches, lambda m, i: scored(m, gaps[i], gaps[i + 1], before[i])),
                                    lambda s: s.isNotNull())))

    def scored(match: Column, gap: Column, following: Column, before: Column) -> Column:
        near = F.lower(F.concat(F.right(gap, F.lit(BEFORE)), F.lit(" ~ "), F.left(following, F.lit(AFTER))))
        score = (F.lit(weight) + F.when(near.rlike(rf"\b({CONTEXT[kind]})"), FOR_CONTEXT).otherwise(0.0)
                 + F.when(near.rlike(rf"\b({AGAINST})"), AGAINST_CONTEXT).otherwise(0.0))
        start = before + F.length(gap)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"),
                        F.round(F.least(score, F.lit(1.0)), 2).alias("score"))
        ok = _valid(kind, match)
        return F.when(ok if kind in BASE else ok & (score >= THRESHOLD), span)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    spans = let(found, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))
    return F.when(F.contains(text, F.lit(holds)), spans).otherwise(none) if holds else spans


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<kind, start, end, score>>, by kind in the order of KINDS, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    return with_new(docs, {"pii": F.concat(*[_spans(body, kind) for kind in KINDS])})


def mask(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with each span of its text replaced by ``[kind]``; of overlapping spans the first stays.

    Needs ``pii``. A null text stays null.
    """
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.concat(F.substr(F.col(text), state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh, -s["to"]).otherwise(state["at"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return found.withColumn(text, F.when(F.size("pii") == 0, F.col(text)).otherwise(F.aggregate(
        ordered, start, step, lambda s: F.concat(s["out"], F.substr(F.col(text), s["at"] + 1)))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
