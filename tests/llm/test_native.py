"""Quality rules, personal data, shards, mixing: against brute force."""

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartwise.llm import hilbert, pii, poisson_mix, quality_rules
from cartwise.llm.columns import running_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(docs, clashing):
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    for df in (docs, clashing):
        got = quality_rules.measure(df).select("text", *names).collect()
        assert len(got) == df.count()
        for r in got:
            assert tuple(r[1:]) == base_counts(r.text), r.text


def test_cutoffs_follow_the_binomial_bound(spark):
    n, bad = 3000, 20
    rows = [(i, "en", 5 * (i < 100)) for i in range(n)] + [(n + i, "en", 90) for i in range(bad)] + [(9000, "fr", 0)]
    measured = spark.createDataFrame(rows, "doc_id long, lang string, n_symbols long").selectExpr(
        "*", "100L as n_words", "500L as word_chars", "0L as n_capitals", "5L as n_lines", "0L as n_dup_lines", "0L as n_repeat_words")
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(n + bad)] + [(9000, 1, 0), (5, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    cut = {(r.stratum, r.rule): r for r in quality_rules.calibrate(measured, labels).collect()}
    row = cut["en", "symbols"]
    error = quality_rules.ERROR / 10
    below = lambda k: sum(math.comb(n, i) * quality_rules.RISK**i * (1 - quality_rules.RISK) ** (n - i) for i in range(k + 1))
    assert row.n_good == n and below(row.allowed) <= error < below(row.allowed + 1)
    assert row.cutoff == 100  # 100 good documents have 50, more than allowed; the floor is higher
    assert cut["fr", "symbols"].cutoff is None and cut["fr", "symbols"].allowed == -1
    kept = {r.doc_id: r for r in quality_rules.judge(measured, quality_rules.calibrate(measured, labels)).collect()}
    assert all(kept[i].kept for i in range(n)) and kept[9000].kept
    assert all(kept[n + i].failed_rules == ["symbols"] and not kept[n + i].kept for i in range(bad))


def test_rules_on_odd_tables(docs, clashing, empty, spark):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for df in (docs, clashing, empty):
        measured = quality_rules.measure(df)
        for some in (labels, labels.limit(0)):
            got = quality_rules.judge(measured, quality_rules.calibrate(measured, some))
            assert got.count() == df.count() and len(set(map(str.lower, got.columns))) == len(got.columns)
    assert got.filter("kept is null").count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    checks = [
        ("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
        ("phone", PHONE, lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in p.finditer(text or "") if ok(m.group())]


TRICKY = [
    "a@b.c@d.e x@y.z_w@q.com @@ a@b .x@y-z.co.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (017) 555-7713 +12 +1234567 8 +1+22222222222", "\U0001d54fé mail x@y.zz and +49 30 1234567", "9807915762804490 9", "a" * 3000 + "@", "1" * 20000,
    ("u@v.ww 10.0.0.1 " * 700), "1.1.1.1" * 5, "x@y.a@b.c@d.e", "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432, not GB83WEST12345698765432",
]


def found(spark, texts):
    df = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))
    rows = df.select("doc_id", pii.joined(pii.of_kinds(F.col("pii"), *pii.BASE)), pii.joined(F.col("pii"))).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def test_spans_against_brute_force(spark, docs, sf):
    texts = TRICKY + [r[0] for r in docs.select("text").collect()] + [
        r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == ",".join(base_spans(t)), t


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("0123456789.@+-_ ()ab\né", max_size=60), min_size=30, max_size=60))
def test_random_spans(spark, texts):
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == ",".join(base_spans(t)), t


def test_added_kinds_and_masking(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "GB83WEST12345698765432", "ssn 078-05-1120", "part no 078-05-1120",
             "my card 378282246310005 here", "order 378282246310005"]
    got = found(spark, texts)
    assert [got[i][1].split(":")[0] for i in range(6)] == ["iban", "", "ssn", "", "short_card", ""]
    df = pii.mask(pii.find_pii(spark.createDataFrame([("to a@b.cc now +1 (017) 555-7713",), (None,), ("",)], "text string")))
    assert [r.text for r in df.collect()] == ["to [email] now [phone]", None, ""]


def test_pii_odd_tables(clashing, empty):
    assert pii.find_pii(clashing).filter("pii is null").count() == 0
    assert pii.find_pii(empty).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=700))
def test_running_sums(spark, xs):
    df = spark.createDataFrame([(xs,)], "x array<long>").select(running_sums(F.col("x")))
    assert df.first()[0] == [sum(xs[:i]) for i in range(len(xs))]


def test_curve_steps_to_neighbours(spark):
    n, bits = 3, 3
    cells = spark.range(1 << (bits * n)).selectExpr(*[f"(id >> {bits * i}) & {(1 << bits) - 1} as x{i}" for i in range(n)])
    rows = hilbert.curve_index(cells, [f"x{i}" for i in range(n)], bits, "h").orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (bits * n)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("shards", [1, 8, 100])
def test_shards_are_even(docs, clashing, empty, shards):
    for df in (docs, clashing, empty):
        n = df.count()
        out = hilbert.hilbert_shards(df, ["lang", "source", "n_chars"], ["doc_id", "text"], shards).collect()
        per = Counter(r.shard for r in out)
        assert len(out) == n and (not n or max(per.values()) - min([per.get(s, 0) for s in range(shards)]) <= 1)
        for s in per:
            assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
        order = sorted(out, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in order] == sorted(r.curve for r in out)


def bins_of(values, bits=4):
    """How many of the bounds that cut the sorted values into equal parts each value is above."""
    known = sorted(v for v in values if v is not None)
    cuts = [known[max(0, math.ceil(i / 2**bits * len(known)) - 1)] for i in range(1, 2**bits)] if known else []
    return [0 if v is None else sum(v > c for c in cuts) for v in values]


def test_bins_and_curve_against_brute_force(spark):
    rows = [(i, f"https://site{i % 40:02d}.example/page", ["en", "fr", None, "de"][i * 7 % 4], (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").repartition(4)
    binned, names = hilbert.quantise(df, ["source", "lang", "n_chars"], 4)
    got = {r.doc_id: tuple(r[n] for n in names) for r in binned.collect()}
    want = list(zip(*[bins_of([r[c] for r in rows]) for c in (1, 2, 3)]))
    assert [got[i] for i in range(400)] == want and len({w[0] for w in want}) == 16
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = [[(n >> (bits * d)) % side for d in range(dims)] for n in range(side**dims)]
        frame = spark.createDataFrame([tuple(c) for c in cells], ", ".join(f"a{d} int" for d in range(dims)))
        path = sorted((r["at"], tuple(r)[:dims]) for r in hilbert.curve_index(frame, [f"a{d}" for d in range(dims)], bits, "at").collect())
        assert [at for at, _ in path] == list(range(side**dims))
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(path, path[1:]))  # neighbours, as on no row order
    out = hilbert.hilbert_shards(df, ["source", "lang", "n_chars"], ["doc_id"], 8).orderBy("shard", "slot").collect()
    assert [r.curve for r in out] == sorted(r.curve for r in out)
    assert {r.doc_id: r.curve for r in out} == {r.doc_id: r["at"] for r in hilbert.curve_index(binned, names, 4, "at").collect()}


def test_manifest_and_files(docs, spark, tmp_path):
    out = hilbert.hilbert_shards(docs, ["lang", "n_chars"], ["doc_id", "text"], 4)
    assert sum(r["rows"] for r in hilbert.manifest(out, ["lang", "n_chars"]).collect()) == docs.count()
    hilbert.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def poisson_inverse(rate, u):
    k, p, c = 0, math.exp(-rate), 0.0
    while True:
        c += p
        if c > u:
            return k
        k += 1
        p *= rate / k


def test_mixing_counts(docs, clashing, empty, spark):
    targets = spark.createDataFrame([("s0", 1.0), ("s1", 2.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    for df in (docs, clashing, empty):
        rows = df.collect()
        n = Counter(r.source for r in rows)
        weight = {"s0": 1.0, "s1": 2.0, None: 1.0}
        expect = Counter()
        for r in rows:
            key = str(r.doc_id) if r.doc_id is not None else "text-" + hashlib.md5((r.text or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"42:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            expect[r.doc_id, r.text] += poisson_inverse(1000.0 * weight[r.source] / 4 / n[r.source], u)
        got = poisson_mix.mix(df, targets, 1000.0)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == +expect
        assert len(set(got.columns)) == len(got.columns)


def test_mixing_reaches_the_targets(spark):
    docs = spark.range(30000).selectExpr("id as doc_id", "if(id < 20000, 'a', 'b') as source", "'' as text")
    targets = spark.createDataFrame([("a", 0.25), ("b", 0.75), ("c", None)], "source string, weight double")
    got = {r.source: r["count"] for r in poisson_mix.mix(docs, targets).groupBy("source").count().collect()}
    assert abs(got["a"] - 7500) < 350 and abs(got["b"] - 22500) < 600
