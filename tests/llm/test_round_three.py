"""Conversation repair, Merkle manifest, minimum bin slack: against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.llm import bin_slack, conversation_repair, merkle

BLANK = "[\x20\x09-\x0d]"


# conversations

def cheapest(initials, faults):
    """(cost, audit) over all ways to edit, by states and whole audit strings."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def rest(i, state, inserted):
        found = []
        if i == len(initials):
            found += [(0, "")] if state in (0, 3) else []
        else:
            ways = [("D", 2, state)]
            if faults[i] not in "bd":
                more = 5 if faults[i] == "t" else 0
                ways += [("R", 1 + more, after[state])]
                ways += [("K", more, kept[state, initials[i]])] if (state, initials[i]) in kept else []
            for letter, cost, to in ways:
                c, a = rest(i + 1, to, 0)
                found.append((cost + c, letter + a))
        if inserted < 3:
            c, a = rest(i, after[state], inserted + 1)
            found.append((5 + c, "I" + a))
        return min(found, default=(1 << 40, ""))

    return rest(0, 0, 0)


def test_crossings_against_all_ways():
    rng = random.Random(11)
    for _ in range(1500):
        n = rng.randrange(1, 13)
        initials, faults = "".join(rng.choices("suax", (2, 4, 4, 1), k=n)), "".join(rng.choices(".bdt", (6, 1, 1, 3), k=n))
        size = rng.randrange(1, n + 1)
        cut = [(initials[i:i + size], faults[i:i + size]) for i in range(0, n, size)]
        states = conversation_repair.crossings([conversation_repair.segment_summary(*s) for s in cut], 0, None)
        cost, audit = 0, ""
        for s, a, b in zip(cut, states, states[1:]):
            edits, c = conversation_repair.segment_edits(*s, a, b)
            cost, audit = cost + c, audit + "".join(edits)[::2]
        more, closing = conversation_repair._END[states[-1]]
        assert (cost + more, audit + closing[::2]) == cheapest(initials, faults)


def expected(rows):
    """Per conversation what the query has to return, from (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        turns = held[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        turns += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, faults = set(), ""
        for _, role, text in turns:
            bare = re.sub(f"^{BLANK}+|{BLANK}+$", "", text)
            faults += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join(role[:1] if role[:1] in ("s", "u", "a") else "x" for _, role, _ in turns)
        cost, audit = cheapest(initials, faults)
        repaired, i, state = [], 0, 0
        for letter in audit:
            told = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            if letter == "D":
                i += 1
                continue
            if letter == "I":
                repaired.append(f"{told}:")
            else:
                repaired.append(f"{turns[i][1] if letter == 'K' else told}:{turns[i][2]}")
                i += 1
            state = {"s": 1, "u": 2, "a": 3}[repaired[-1][0]]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                     hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def odd_turns():
    rng = random.Random(5)
    says = ["Yes.", "No!", "Why?", "well", "", " \t\n", "a.b", "é\U0001d54f.", None, "end. \x0c", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys"]
    rows = [(c, t, rng.choice(roles if c % 3 == 0 else ["user", "assistant"]), rng.choice(says)) for c in range(40) for t in range(rng.randrange(1, 8))]
    rows += [(50, None, "user", "Hi."), (50, None, "assistant", "Ho."), (None, 1, "user", "lost."), (None, None, None, None), rows[0], rows[0], rows[5]]
    rows += [(60, 3 * t, ["user", "assistant"][t % 2], f"turn {t // 7}.") for t in range(150)]  # over several segments
    rows += [(70, t, "user", "x" * 60_000 + ".") for t in range(3)]
    return rows


def run_op11(spark, tmp_path, rows):
    from cartwise.llm import queries

    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, at string").repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return queries.REGISTRY["op11_conversation_repair"](spark, str(tmp_path))


@pytest.mark.parametrize("bits", [10, 3])
def test_repair_against_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)
    rows = odd_turns()
    got = {r[0]: tuple(r)[1:] for r in run_op11(spark, tmp_path, rows).collect()}
    assert got == expected(rows)


def test_repair_of_nothing(spark, tmp_path):
    assert run_op11(spark, tmp_path, []).count() == 0


# manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        fields = [r[0], r[3], r[2], r[4], text]
        return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def ascend(tree, at, h, proof):
        for level in tree[:-1]:
            run = level[at - at % 3:at - at % 3 + 3]
            proof += "".join(run[:at % 3] + run[at % 3 + 1:])
            h, at = digest(*run[:at % 3], h, *run[at % 3 + 1:]), at // 3
        return h, proof

    held = defaultdict(list)
    for r in rows:
        cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        held[r[3]].append((r[0], leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if cut else r[1])))
    sources = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        held[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in held[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for rank, s in enumerate(sources):
        for at, (doc_id, own, claimed) in enumerate(held[s]):
            h, proof = ascend(trees[s], at, claimed, "")
            h, proof = ascend(top, rank, h, proof)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], digest(proof), h, h == top[-1][0]))
    return out


def run_op12(spark, path, df):
    from cartwise.llm import queries

    df.write.parquet(f"{path}/documents.parquet")
    return queries.REGISTRY["op12_merkle_manifest"](spark, str(path))


def test_manifest_against_brute_force(spark, tmp_path, docs, clashing):
    many = [(1000 + i, f"text\n{i}", "en", "hot", i) for i in range(800)] + [(5000 + i, "a\nb" * (i % 3), None, f"é{i}", i) for i in range(31)]
    more = spark.createDataFrame(many, docs.schema).repartition(5)
    for name, df in (("plain", docs), ("clashing", clashing.withColumn("leaf", F.lit("own")).withColumn("key", F.lit(1))), ("deep", docs.union(more))):
        got = [tuple(r) for r in run_op12(spark, tmp_path / name, df).collect()]
        want = manifest_by_hand([tuple(r)[:5] for r in df.collect()])
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_of_little(spark, tmp_path, docs, empty):
    assert run_op12(spark, tmp_path / "none", empty).count() == 0
    one = docs.filter("doc_id = 3")
    [row] = run_op12(spark, tmp_path / "one", one).collect()
    assert (row.leaf, row.verified, row.proof_sha256) == (row.root, True, hashlib.sha256(b"").hexdigest())


def test_row_limit_is_put_back(spark, tmp_path, docs):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "77")
    try:
        assert run_op12(spark, tmp_path, docs).count() == docs.count()
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "77"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


# packing

def best_sum(sizes, room):
    reach = {0}
    for s in sizes:
        reach |= {t + s for t in reach if t + s <= room}
    return max(reach)


def test_fullest_combination_against_all_subsets():
    rng = random.Random(3)
    for _ in range(400):
        room = rng.randrange(5, 60)
        sizes = sorted((rng.randrange(1, room + 1) for _ in range(rng.randrange(1, 12))), reverse=True)
        parts = bin_slack.fullest(dict(Counter(sizes)), room)
        assert parts[0][0] == sizes[0] and not Counter(dict(parts)) - Counter(sizes)
        assert sum(s * n for s, n in parts) == sizes[0] + best_sum(sizes[1:], room - sizes[0])
        loose = bin_slack.fullest(dict(Counter(sizes)), room, 4)
        assert sum(s * n for s, n in loose) >= sum(s * n for s, n in parts) - 4


def fewest_bins(sizes, room):
    """Least number of bins, by trying all."""
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= room and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1:]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best[0]


def test_few_sequences():
    rng = random.Random(4)
    extra = 0
    for _ in range(150):
        sizes = sorted((rng.randrange(1, 41) for _ in range(rng.randrange(1, 10))), reverse=True)
        got = bin_slack.fewest(Counter(sizes), 40)
        assert sum((Counter({s: n * c.times}) for c in got for s, n in c.parts), Counter()) == Counter(sizes)
        assert all(sum(s * n for s, n in c.parts) <= 40 for c in got)
        extra += sum(c.times for c in got) - fewest_bins(sizes, 40)
    assert extra <= 2
    for seed in range(3):
        sizes = np.random.default_rng(seed).integers(300, 1500, 4000)
        bins = sum(c.times for c in bin_slack.fewest(Counter(sizes.tolist()), 2048))
        assert bins <= 1.005 * sizes.sum() / 2048 + 1


def test_cut():
    assert bin_slack.cut(2048, 2048) == [(0, 2048)] and bin_slack.cut(1, 2048) == [(0, 1)]
    assert bin_slack.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and bin_slack.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_bin_slack_round_trip(spark, docs, clashing, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    added = spark.createDataFrame([(900, "a <|endoftext|> b", "en", "s0", 1)], docs.schema)
    for df in (docs.union(added), clashing, empty):
        pieces = bin_slack.pack(df).collect()
        want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in df.collect())
        sequences, starts = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for p in pieces:
            ids = tuple(np.frombuffer(p.ids, "<u4").tolist())
            assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
            sequences[p.sequence_id].append((p.offset, p.length))
            starts[p.doc_id][p.piece].append((p.start, ids))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert sum(p.piece == 0 for p in pieces) == sum(want.values())
        for (doc_id, ids), n in want.items():
            for i, (start, length) in enumerate(bin_slack.cut(len(ids), 2048)):
                assert starts[doc_id][i].count((start, ids[start:start + length])) >= n
        assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_queries_of_bin_slack(spark, sf):
    from cartwise.llm import queries

    got = queries.REGISTRY["op13_bin_slack"](spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 2048 and len(filled) <= 1.02 * got["length"].sum() / 2048 + 1
