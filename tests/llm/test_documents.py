"""Near-duplicates, line dedup, packing, quality scores: against brute force, and odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartwise.llm import components as cc
from cartwise.llm import crf, line_dedup, packing, simhash
from cartwise.llm.columns import BLANKS

from .conftest import prose


def roots_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in BLANKS}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(docs):
    for r in docs.select("text").collect():
        assert simhash.fingerprint_of(r.text) == slow_print(r.text)
    text = prose(2 * simhash._BITS_AT_ONCE + 5, 9)
    assert simhash.fingerprint_of(text) == slow_print(text)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5]))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in cc.components(simhash.near_links(df)).collect()}
    want = roots_of(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    groups = defaultdict(set)
    for i, r in enumerate(want):
        groups[r].add(signed[i])
    for g in groups.values():
        assert {got.get(p, p) for p in g} == {min(g)}


def test_classes(docs, clashing, empty):
    rows = docs.collect()
    prints = [slow_print(r.text) for r in rows]
    want = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = defaultdict(list)
    for i, r in enumerate(want):
        least[r].append(rows[i].doc_id)
    expect = Counter((rows[i].doc_id, f"{prints[i]:016x}", min((d for d in least[r] if d is not None), default=None)) for i, r in enumerate(want))
    for df in (docs, clashing):
        got = simhash.near_duplicates(df)
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == expect
        kept = simhash.drop_near_duplicates(df)
        assert kept.columns == df.columns
        first = {r: min((rows[i].doc_id is None, rows[i].doc_id or 0, prints[i] - (prints[i] >> 63 << 64)) for i, w in enumerate(want) if w == r) for r in want}
        assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(f[:2] for f in first.values())
        assert Counter(tuple(r) for r in simhash.fingerprint_table(df).select("doc_id", "fingerprint", "component_id").collect()) == expect
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(500, 500)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(70)]
    rng.shuffle(edges)
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = roots_of(len(nodes), [(at[a], at[b]) for a, b in edges])
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: nodes[want[i]] for i, x in enumerate(nodes)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_lines():
    rng = random.Random(5)
    docs = []
    for i in range(40):
        lines = [prose(rng.randint(1, 40), 1000 + 40 * i + j) for j in range(rng.randint(0, 6))]
        docs.append(lines)
    for i in range(60):
        line = rng.choice(docs[rng.randrange(40)] or ["short"])
        words = line.split(" ")
        words[rng.randrange(len(words))] = rng.choice(["changed", "other", ""])
        docs[rng.randrange(40)].append(rng.choice([line, "  " + line + "\t", " ".join(words)]))
    out = [(i, "\n".join(x), "s") for i, x in enumerate(docs)]
    return out + [(900, None, "s"), (901, "", "s"), (902, " \n\n ", "s"), (None, out[0][1], "s"), out[5], (903, out[6][1] + "\n" + out[7][1], "s")]


@pytest.mark.parametrize("block", [3, 1024])
def test_line_dedup_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 1_000_000 if block > 3 else 0)
    rows = near_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    texts = sorted({x.strip(BLANKS) for _, t, _ in rows for x in (t or "").split("\n")} - {""})
    sets = [line_dedup.shingles(t) for t in texts]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and
               len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = dict(zip(texts, roots_of(len(texts), similar)))
    assert similar
    seen, want = set(), Counter()
    for doc_id, text, _ in sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        kept = []
        for x in lines:
            name = x.strip(BLANKS)
            if not name or root[name] not in seen:
                kept.append(x)
            seen.add(root.get(name))
        want[doc_id, None if text is None else "\n".join(kept)] += rows.count((doc_id, text, "s"))
    assert Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()) == want


def test_shared_holds_one_row():
    import pandas as pd

    rng = random.Random(2)
    rows = sorted((rng.randrange(40) if i % 3 else 7, rng.randrange(60), 9) for i in range(900)) + [(50, 1, 9), (51, 1, 9), (51, 1, 9), (52, 1, 9), (52, 2, 9)]
    per = defaultdict(set)
    for key, line, _ in rows:
        per[key].add(line)
    want = [(k, x, 9) for k in sorted(per) for x in sorted(per[k]) if len(per[k]) > 1]
    frame = pd.DataFrame(rows, columns=["key", "line", "size"])
    for step in (1, 2, 7, 1000):
        parts = [frame[i:i + step] for i in range(0, len(frame), step)]
        got = list(line_dedup._shared(iter(parts)))
        assert [tuple(r) for g in got for r in g.itertuples(index=False)] == want
        assert max(map(len, got)) <= step + 1  # a bucket is never gathered


@pytest.mark.parametrize("long", [0, 100])
def test_long_lines_by_characters(spark, monkeypatch, long):
    monkeypatch.setattr(line_dedup, "LONG", long)
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", 2000)
    base = [prose(n, n).replace("s", "é\U0001d54f") for n in (18, 25, 200, 1000)]
    lines = [" ".join(w if rng.random() > 0.03 else "zz" for w in b.split(" ")) for b in base for rng in map(random.Random, range(12))]
    sets = [line_dedup.shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.similar(sets[i], sets[j])]
    held = line_dedup._Links()
    held.add_unit(list(range(len(lines))), lines, [0] * len(lines), False)
    want = roots_of(len(lines), links)
    assert [[held.find(i) == held.find(j) for j in range(len(lines))] for i in range(len(lines))] == [[a == b for b in want] for a in want]
    assert all(held._alike(i, j) == line_dedup.similar(sets[i], sets[j]) for i in range(len(lines)) for j in range(i))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    first = {r: want.index(r) for r in want}
    kept = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.n_dropped == 0}
    assert kept == set(first.values())


def test_bands_recall(spark):
    rng = random.Random(8)
    hit = total = 0
    for i in range(150):
        words = prose(60, 5000 + i).split(" ")
        other = list(words)
        for at in rng.sample(range(60), 2):
            other[at] = "xyz"
        a, b = " ".join(words), " ".join(other)
        if line_dedup.similar(line_dedup.shingles(a), line_dedup.shingles(b)):
            total += 1
            keys = line_dedup.band_keys([a, b])
            hit += bool((keys[:, 0] == keys[:, 1]).any())
    assert total > 50 and hit >= 0.97 * total


def test_line_dedup_odd_tables(docs, clashing, empty):
    for df in (docs, clashing, empty):
        out = line_dedup.dedup_lines(df)
        assert out.count() == df.count() and len(set(out.columns)) == len(out.columns)
    cleaned = line_dedup.dedup_lines(docs).filter("doc_id is not null and doc_id < 2").collect()
    assert {r.text for r in cleaned} == {None, ""}


def test_pieces_round_trip(docs, clashing, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for df in (docs, clashing):
        pieces = packing.pack(df).collect()
        rows = df.collect()
        want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in rows)
        whole = Counter()
        parts = defaultdict(lambda: defaultdict(list))
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u4")
            assert len(ids) == p.length
            parts[p.doc_id, p.doc_tokens][p.start].append(tuple(ids.tolist()))
        for (doc_id, _), by_start in parts.items():
            copies = [sorted(by_start[s]) for s in sorted(by_start)]
            for chain in zip(*copies):
                whole[doc_id, tuple(x for c in chain for x in c)] += 1
        assert sum(whole.values()) == len(rows)
        assert {k: v for k, v in whole.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
        per = defaultdict(list)
        for p in pieces:
            per[p.sequence_id].append((p.offset, p.length))
        for spans in per.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= packing.LENGTH
        used = sum(p.length for p in pieces)
        assert len(per) - 1 <= used / packing.LENGTH * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_added_tokens_have_their_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<<|endoftext|>>\n <|endoftext", "x " * 3000 + "<|endoftext|>\ty", "plain"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = defaultdict(list)
    for p in sorted(rows, key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
        assert p.length == len(p.ids) // 4
    assert got[0] == [64, 220, 50256, 275, 1]
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert {(p.doc_id, p.doc_tokens) for p in rows} == {(i, len(ids)) for i, ids in got.items()}


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(n)]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    per_doc = np.array([1, 4, 2])
    emit, moves = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    marginals, moved, logz = crf.forward_backward(emit, moves, per_doc)
    want_moved, at = np.zeros((2, 2)), 0
    for d, n in enumerate(per_doc):
        paths = np.array([[p >> i & 1 for i in range(n)] for p in range(1 << n)])
        weights = np.array([sum(emit[at + i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        z = np.log(np.exp(weights).sum())
        prob = np.exp(weights - z)
        assert np.isclose(z, logz[d])
        assert np.allclose(marginals[at:at + n, 1], prob @ paths)
        for p, w in zip(paths, prob):
            for a, b in zip(p, p[1:]):
                want_moved[a, b] += w
        at += n
    assert np.allclose(moved, want_moved)


def test_held_out_quality(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = crf.score(docs, crf.train(docs, labels.filter(~held))).join(labels.filter(held), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([g >= 0.3 for g in good]) > 0.97


def test_quality_odd_tables(docs, clashing, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        model = crf.train(docs, labels)
        for df in (docs, clashing, empty):
            got = crf.score(df, model)
            assert got.filter("score is null or score < 0 or score > 1").count() == 0 and got.count() == df.count()
    assert abs(crf.train(docs, none).scores(["any text"])[0] - 0.5) < 1e-9


def test_packed_shingles_are_the_shingles():
    rng = random.Random(12)
    lines = ["".join(rng.choice("abcé ÿ\x00") for _ in range(rng.randrange(8, 60))) for _ in range(60)]
    lines += ["aaaaaaaaaaaaaaaa", "abcdefgh", "abc—defgh ijk", "\U0001d54f" * 12, lines[0] + "—"]
    links = line_dedup._Links()
    links.add_unit(list(range(len(lines))), lines, [0] * len(lines), False)
    for i, a in enumerate(lines):
        assert len(line_dedup.shingled(a)) == len(line_dedup.shingles(a))
        for j, b in enumerate(lines):
            x, y = line_dedup.shingles(a), line_dedup.shingles(b)
            assert links._alike(i, j) == line_dedup.similar(x, y)
            if type(line_dedup.shingled(a)) is type(line_dedup.shingled(b)):
                assert len(line_dedup.shingled(a) & line_dedup.shingled(b)) == len(x & y)
