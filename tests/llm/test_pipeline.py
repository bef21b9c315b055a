"""The pipeline as a whole: runs beside each other, columns with clashing names, near copies, odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from cartwise.llm import near_copies, simhash
from cartwise.llm.line_dedup import similar
from cartwise.session import stage
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def changed(text, n, seed):
    rng = random.Random(seed)
    words = text.split(" ")
    for at in rng.sample(range(len(words)), n):
        words[at] = f"zz{rng.randrange(10**6)}"
    return " ".join(words)


def shingle_set(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    out = []
    for i in range(60):
        base = prose(150 + 3 * i, 700 + i)
        out += [(10 * i, base), (10 * i + 1, changed(base, 3 + i % 4, i)), (10 * i + 2, prose(160, 5000 + i))]
        if i % 7 == 0:
            out += [(10 * i + 3, base), (10 * i + 4, changed(base, 40, i))]
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in out]


def classes(rows):
    """Groups of row numbers that three bits or four fifths of the five-word shingles connect."""
    prints, sets = [simhash.fingerprint_of(r[1]) for r in rows], [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or (sets[i] and sets[j] and similar(sets[i], sets[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark, sf):
    rows = corpus() + [(9000, "", "en", None, 0), (9001, None, None, None, None), (None, prose(90, 1), "en", "s0", 1), (9002, "a b", "en", "s1", 3), (9003, "A  b", "en", "s1", 4)]
    kept = defaultdict(list)
    for r, c in zip(rows, classes(rows)):
        kept[c].append(r[0])
    want = Counter(min(ids, key=lambda i: (i is None, i or 0)) for ids in kept.values())
    step = dict(P.STAGES)["near_duplicates"]
    got = Counter(r.doc_id for r in step(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), sf).collect())
    assert got == want
    pairs = [(a, b) for a, b in zip(rows, rows[1:]) if similar(shingle_set(a[1]), shingle_set(b[1])) and a[1] != b[1]]
    missed = sum((simhash.fingerprint_of(a[1]) ^ simhash.fingerprint_of(b[1])).bit_count() > 3 for a, b in pairs)
    assert len(pairs) > 30 and missed > 10  # which fingerprints alone would keep


def test_shingles_of_words():
    for text in ("", None, "one", "A b\tc\x0bD", "a b c d e", "a b c d e f a b c d e f", "é \U0001d54f x y z é \U0001d54f x y z"):
        assert len(near_copies.word_shingles(text)) == len(shingle_set(text))
    a, b = near_copies.WordShingles(prose(80, 1)), near_copies.WordShingles(changed(prose(80, 1), 5, 2))
    assert len(a & b) == len(shingle_set(prose(80, 1)) & shingle_set(changed(prose(80, 1), 5, 2)))


def test_own_columns_are_kept(spark, sf):
    docs = stage(spark.read.parquet(f"{sf}/documents.parquet"), "documents")
    names = "n_words kept n_dropped copy shuffle_key fingerprint fp _row _hash component_id n_lines line Text2 a.b".split()
    more = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for name, step in P.STAGES[:-1]:
        plain, docs = docs, stage(step(spark, docs, sf), name)
        quoted = [f"`{c}`" for c in more.columns]
        wide = more.join(plain.select("doc_id").distinct(), "doc_id", "left_semi").select(*quoted)
        wide = wide.drop("text", "n_chars").join(plain.select("doc_id", "text", "n_chars").dropDuplicates(["doc_id"]), "doc_id").select(*quoted) if name != "mixing" else wide
        out = step(spark, wide, sf)
        assert out.columns == more.columns
        for n in names:
            assert out.filter(F.col(f"`{n}`") != F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string"))).count() == 0
        if name != "mixing":
            assert out.count() == docs.count()


def test_runs_beside_each_other(spark, sf):
    first = P.run(spark, sf)
    second = P.run(spark, sf)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    a, b = (Counter(map(tuple, df.select(*columns).collect())) for df in (first, second))
    assert a == b and sum(a.values()) > 0
    filled = first.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert filled <= 2048
    ids = first.select("ids", "length").limit(20).collect()
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in ids)


def test_stages_called_one_by_one_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    name, step = P.STAGES[0]
    a, b = step(spark, docs, sf), step(spark, docs, sf)
    after = P.STAGES[1][1](spark, stage(a, "a"), sf)   # b may still be waiting for its tables
    assert b.count() == a.count() and after.count() <= b.count()
