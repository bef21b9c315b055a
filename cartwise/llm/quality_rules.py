"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a document if one of its measures, a whole number of thousandths, is above a cutoff.
For every stratum (here: language) and rule, the cutoff is as low as the labelled good documents of
the stratum allow: with ``n`` good documents, at most ``k`` of them may lie above it, where ``k`` is
the largest count with P(Binomial(n, risk) <= k) <= error. Then, with confidence ``1 - error``, the rule
rejects at most the share ``risk`` of the stratum's good documents (exact one-sided binomial bound on
an order statistic). ``error`` is the allowed overall error divided by the number of rules and strata
(Bonferroni), so all bounds hold at once. A stratum with too few good documents for a bound gets no
cutoff, and only the base test rejects there. A cutoff is never below the rule's floor; raising a
cutoff only rejects fewer documents, so the guarantee stays.

Cases: a null text counts as empty and fails the base test. A null stratum is a stratum of its own.
Null ids take part like all others but have no label. Of repeated labels the lowest quality counts,
null qualities are ignored. Repeated rows are judged alike, each. Columns of the input stay, apart
from those named like a result column, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.llm.columns import BLANKS, pack, unpack, words
from cartwise.session import stage

#: Rule -> (measure in thousandths, lowest cutoff). Measures are capped at 1000.
RULES = {
    "symbols": ("1000 * n_symbols / n_words", 100),
    "capitals": ("1000 * n_capitals / word_chars", 300),
    "repeated_lines": ("1000 * n_dup_lines / n_lines", 500),
    "repeated_words": ("1000 * n_repeat_words / n_words", 300),
    "word_length": ("10 * word_chars / n_words", 120),
}
RISK = 0.02
ERROR = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS (long), all over the whole text and within the row, without a shuffle.

    Windows of three words that recur: each window is hashed, the hash shares a 64-bit number with
    the window's position, the numbers are sorted, and neighbours of equal hash part are candidates;
    only candidates are compared by their full 64-bit hashes.
    """
    window = "xxhash64(_w[i], _w[i + 1], _w[i + 2])"
    df = docs.select(pack(docs, *COUNTS), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words(F.col("_t")))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("n_words", F.expr("cast(size(_w) as long)")).withColumn("_b", F.expr("length(bin(size(_w)))"))
    df = df.withColumn("_p", F.expr(f"""
        case when n_words < 4 then cast(array() as array<bigint>) else sort_array(transform(
            sequence(0, cast(n_words as int) - 3), i -> shiftleft({window}, _b) | cast(i as bigint))) end"""))
    df = df.withColumn("_c", F.expr("""
        transform(filter(transform(_p, (x, j) -> j), j ->
            shiftright(get(_p, j - 1), _b) = shiftright(_p[j], _b) or shiftright(get(_p, j + 1), _b) = shiftright(_p[j], _b)),
            j -> cast(_p[j] & (shiftleft(1L, _b) - 1) as int))"""))
    df = df.withColumn("_s", F.expr(f"sort_array(transform(_c, i -> named_struct('h', {window}, 'i', i)))"))
    df = df.withColumn("_r", F.expr("""
        transform(filter(transform(_s, (x, j) -> j), j -> get(_s, j - 1).h = _s[j].h or get(_s, j + 1).h = _s[j].h),
            j -> _s[j].i)"""))
    counts = {
        "n_words": "n_words",
        "word_chars": "length(array_join(_w, ''))",
        "n_symbols": "length(_t) - length(regexp_replace(_t, '[#*$%&|<>]+', ''))",
        "n_capitals": "length(_t) - length(regexp_replace(_t, '[A-Z]+', ''))",
        "n_lines": "size(_l)",
        "n_dup_lines": "size(_l) - size(array_distinct(_l))",
        "n_repeat_words": "size(array_distinct(flatten(transform(_r, i -> array(i, i + 1, i + 2)))))",
    }
    return unpack(df, *[F.expr(f"cast({e} as long)").alias(name) for name, e in counts.items()])


def _measures(measured: DataFrame):
    """array<struct<rule, value>>; a measure without a divisor is 0."""
    return F.array(*[F.struct(
        F.lit(rule).alias("rule"),
        F.expr(f"cast(least(1000, coalesce(try_divide({e.rsplit(' / ', 1)[0]}, {e.rsplit(' / ', 1)[1]}), 0)) as int)")
        .alias("value")) for rule, (e, _) in RULES.items()])


def _stratum(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00none"))


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
              risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, n_good, allowed, cutoff): the certified cutoffs; one row per stratum and rule.

    The documents of one stratum are counted per measured value, at most 1001 of them, before
    anything is ordered, so a stratum with most of the rows is no burden on one task.
    """
    good = labels.groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_q")).filter("_q = 1 and _key is not null")
    slim = stage(measured.select(F.col(key).alias("_key"), _stratum(stratum).alias("stratum"), _measures(measured).alias("_m")), "rule-measures")
    per_value = (
        slim.join(good.select("_key"), "_key")
        .select("stratum", F.explode("_m").alias("_m"))
        .groupBy("stratum", "_m.rule", "_m.value").agg(F.count("*").alias("n"))
    )
    per_value = stage(per_value, "rule-values")
    tests = per_value.select("stratum", "rule").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    sizes = per_value.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good")).join(F.broadcast(tests))  # one row
    allowed = F.expr(f"""
        aggregate(sequence(0L, cast(ceil(n_good * {risk}D) as bigint)),
            named_struct('p', n_good * ln(1 - {risk}D), 'below', 0D, 'k', -1L),
            (s, i) -> named_struct(
                'p', if(i < n_good, s.p + ln((n_good - i) / (i + 1D)) + ln({risk}D / (1 - {risk}D)), -1e9D),
                'below', s.below + exp(s.p),
                'k', if(s.below + exp(s.p) <= {error}D / tests, i, s.k)),
            s -> s.k)""")
    sizes = sizes.withColumn("allowed", allowed).drop("tests")
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    floors = F.create_map(*[F.lit(x) for rule, (_, low) in RULES.items() for x in (rule, low)])
    # the largest value of which more than ``allowed`` good documents reach it: those above it are few enough
    cut = (
        per_value.withColumn("reach", F.sum("n").over(above)).join(sizes.select("stratum", "rule", "allowed"), ["stratum", "rule"])
        .filter("allowed >= 0 and reach > allowed").groupBy("stratum", "rule").agg(F.max("value").alias("cutoff"))
        .withColumn("cutoff", F.greatest("cutoff", floors[F.col("rule")]))
    )
    return sizes.join(cut, ["stratum", "rule"], "left")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed, failed_rules (array of rule names) and kept.

    The cutoffs are written as a table first, so Spark knows their size when it chooses the join.
    """
    rules = stage(
        cutoffs.filter("cutoff is not null").groupBy(F.col("stratum").alias("_stratum"))
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs")), "rule-cutoffs")
    base = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    df = (
        measured.select(pack(measured, "base_failed", "failed_rules", "kept"), F.expr(base).alias("base_failed"),
                        _stratum(stratum).alias("_stratum"), _measures(measured).alias("_m"))
        .join(rules, "_stratum", "left")
        .withColumn("failed_rules", F.expr(
            "coalesce(transform(filter(_m, m -> m.value > _cutoffs[m.rule]), m -> m.rule), cast(array() as array<string>))"))
    )
    return unpack(df, "base_failed", "failed_rules", F.expr("not base_failed and size(failed_rules) = 0").alias("kept"))
