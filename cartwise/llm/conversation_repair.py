"""Repair of conversations to system?, (user, assistant)+ at least cost, by Hirschberg's divide and conquer.

Every turn is kept, given the other role (1) or deleted (2), and turns without text are inserted where
roles would not alternate (5); blank turns and repeats have to go, and keeping a truncated one costs 5 more.
Of the cheapest ways the one whose audit, the initials of its edits, comes first in ASCII is taken.

A conversation so far is in one of four states: nothing yet, after a system turn, after a user's, after an
assistant's. A run of turns is summed up by sixteen costs, one for each state before and after it, and by
the order of its audits: all audits of a run have one letter for each turn and end with it, so no audit
is the start of another, and those from one state to different states differ. Such summaries compose. Costs
forward from the start and backward from the end meet in the middle of a conversation: the state there is
the one of least total cost, of equal ones that with the least audit up to it, and both halves follow
in the same way. No table over all turns is held, only a vector of four on each side.

The turns of a conversation need not meet in one task either. A global sort numbers them; blocks of
``BLOCK`` numbers cut conversations into segments, which are summed up wherever they lie. Summaries, a hundredth of
the turns' size, meet per conversation and are divided first, which gives each segment the states at its ends; then
every segment is divided by itself. Repeats are found by an aggregate per conversation, role and text,
whose least numbers are joined back by number, so neither a hot conversation nor a hot text is a group.

Cases: a null role or text is one space. Turns come by number, nulls first, then by role and text; rows
that repeat a turn are turns of their own. A null key is a conversation. A text is handled whole, in its
row. Other columns, whatever their names, are not kept. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.columns import BLANKS
from cartwise.llm.ranks import placed
from cartwise.session import stage

BLOCK_BITS = 10
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NONE = "\x00none"
_STATES = range(4)  # nothing yet, after system, after user, after assistant
_FAR = 1 << 60
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # by an inserted turn, or one given another role
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_ROLE = {2: "u", 3: "a"}
#: What it costs to end in a state, and the turns inserted for it.
_END = {0: (0, ""), 1: (2 * INSERT, "IuIa"), 2: (INSERT, "Ia"), 3: (0, "")}
_LEGAL = {"su", "ua", "au"}

Vector = tuple[list[int], list[int]]  # costs of the four states, ranks of their audits


class Summary(NamedTuple):
    """Least costs from state to state over some turns, and the ranks of their audits among those from the same state."""

    cost: tuple[tuple[int, ...], ...]
    rank: tuple[tuple[int, ...], ...]


def _edits(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, after) -> (cost, edits) of one turn; edits are pairs of an initial and a role."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED if fault == "t" else 0
    for start in _STATES:
        at, inserted = start, ""
        for _ in range(3):  # two inserted turns lead back to the same state
            cost = INSERT * (len(inserted) // 2)
            ways = [(at, cost + DELETE, inserted + "D-")]
            if fault not in ("b", "d"):
                ways.append((_NEXT[at], cost + REROLE + extra, inserted + "R" + _ROLE[_NEXT[at]]))
                if (at, initial) in _KEPT:
                    ways.append((_KEPT[at, initial], cost + extra, inserted + "K" + initial))
            for end, c, edits in ways:
                found[start, end] = min(found.get((start, end), (_FAR, "")), (c, edits), key=lambda x: (x[0], x[1][::2]))
            inserted += "I" + _ROLE[_NEXT[at]]
            at = _NEXT[at]
    return found


#: Of a turn by the initial of its role (x: any other) and its fault (b blank, d duplicate, t truncated, or none).
_TURN = {i + f: _edits(i, f) for i in "suax" for f in ".bdt"}


def _ranks(keys: list) -> tuple[int, ...]:
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    return tuple(order.index(i) for i in range(len(keys)))


def _turn_summary(edits: dict[tuple[int, int], tuple[int, str]]) -> Summary:
    cost = tuple(tuple(edits.get((p, s), (_FAR, ""))[0] for s in _STATES) for p in _STATES)
    return Summary(cost, tuple(_ranks([edits[p, s][1][::2] if (p, s) in edits else "~" for s in _STATES]) for p in _STATES))


_SUMMARY = {name: _turn_summary(edits) for name, edits in _TURN.items()}


def forward(vector: Vector, step: Summary) -> Vector:
    """Costs and ranks after one more step."""
    cost, rank = vector
    costs, keys = [], []
    for s in _STATES:
        total, _, via = min((cost[q] + step.cost[q][s], rank[q], q) for q in _STATES)
        costs.append(min(total, _FAR))
        keys.append((rank[via], step.rank[via][s]) if total < _FAR else (len(cost), s))
    return costs, list(_ranks(keys))


def backward(costs: list[int], step: Summary) -> list[int]:
    return [min(_FAR, *(step.cost[q][s] + costs[s] for s in _STATES)) for q in _STATES]


def _from(state: int) -> Vector:
    return [0 if s == state else _FAR for s in _STATES], list(_STATES)


def summed(steps: list[Summary]) -> Summary:
    rows = []
    for start in _STATES:
        vector = _from(start)
        for step in steps:
            vector = forward(vector, step)
        rows.append(vector)
    return Summary(tuple(tuple(c) for c, _ in rows), tuple(tuple(r) for _, r in rows))


def crossings(steps: list[Summary], start: int, end: int | None) -> list[int]:
    """States before, between and after ``steps`` on the cheapest way of least audit; ``end`` None: in any state that may be last."""
    states = [start, *[-1] * len(steps)]
    if end is None:
        vector = _from(start)
        for step in steps:
            vector = forward(vector, step)
        end = min(_STATES, key=lambda s: (vector[0][s] + _END[s][0], vector[1][s]))
    states[len(steps)] = end
    parts = [(0, len(steps))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        vector = _from(states[lo])
        for step in steps[lo:mid]:
            vector = forward(vector, step)
        costs = _from(states[hi])[0]
        for step in reversed(steps[mid:hi]):
            costs = backward(costs, step)
        states[mid] = min(_STATES, key=lambda q: (vector[0][q] + costs[q], vector[1][q]))
        parts += [(lo, mid), (mid, hi)]
    return states


def _turns(initials: str, faults: str) -> list[str]:
    return [i + f for i, f in zip(initials, faults)]


@lru_cache(1 << 14)
def segment_summary(initials: str, faults: str) -> Summary:
    return summed([_SUMMARY[t] for t in _turns(initials, faults)])


@lru_cache(1 << 14)
def segment_edits(initials: str, faults: str, start: int, end: int) -> tuple[list[str], int]:
    """Edits of each turn, and their cost."""
    turns = _turns(initials, faults)
    states = crossings([_SUMMARY[t] for t in turns], start, end)
    found = [_TURN[t][p, s] for t, p, s in zip(turns, states, states[1:])]
    return [edits for _, edits in found], sum(cost for cost, _ in found)


def _pack(summary: Summary) -> str:
    return " ".join(str(x) for part in summary for row in part for x in row)


def _unpack(text: str) -> Summary:
    x = [int(n) for n in text.split(" ")]
    rows = [tuple(x[i:i + 4]) for i in range(0, 32, 4)]
    return Summary(tuple(rows[:4]), tuple(rows[4:]))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        packed = [_pack(segment_summary(i, f)) for i, f in zip(batch["initials"], batch["faults"])]
        illegal = [sum(a + b not in _LEGAL for a, b in zip(i, i[1:])) for i in batch["initials"]]
        ends = [i[0] + i[-1] for i in batch["initials"]]
        yield pd.DataFrame({"conv": batch["conv"], "segment": batch["segment"], "summary": packed, "illegal": illegal, "ends": ends})


def _routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States at the ends of segments, from summaries sorted by conversation and segment. One conversation's summaries are held."""
    conv, held = None, []

    def route() -> list[tuple]:
        states = crossings([_unpack(s) for _, s, _, _ in held], 0, None)
        before = [None, *(ends[1] for _, _, _, ends in held)]
        return [(segment, states[i], states[i + 1], i == len(held) - 1, illegal + (i > 0 and before[i] + ends[0] not in _LEGAL))
                for i, (segment, _, illegal, ends) in enumerate(held)]

    for batch in batches:
        out = []
        for name, *rest in zip(*(batch[c].tolist() for c in ("conv", "segment", "summary", "illegal", "ends"))):
            if name != conv and held:
                out += route()
                held = []
            conv = name
            held.append(rest)
        yield pd.DataFrame(out, columns=["segment", "start", "end", "last", "illegal"])
    if held:
        yield pd.DataFrame(route(), columns=["segment", "start", "end", "last", "illegal"])


def _divided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        edits, costs = [], []
        for initials, faults, start, end, last in zip(*(batch[c] for c in ("initials", "faults", "start", "end", "last"))):
            found, cost = segment_edits(initials, faults, start, end)
            more, closing = _END[end] if last else (0, "")
            edits.append([*found[:-1], found[-1] + closing])
            costs.append(cost + more)
        yield pd.DataFrame({"conv": batch["conv"], "segment": batch["segment"], "illegal": batch["illegal"], "cost": costs, "edits": edits})


class Repair(NamedTuple):
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: conv, at, part, edit, role, text.

    ``conv`` is the key as a string, ``NONE`` for a null one. ``turns`` are those of the repaired conversations, by ``at`` and ``part``.
    """

    conversations: DataFrame
    turns: DataFrame


def name(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NONE))


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Repairs each conversation of ``rows``."""
    blank = F.lit(BLANKS)
    spoken, said = F.coalesce(F.col(role).cast("string"), F.lit(" ")), F.coalesce(F.col(text).cast("string"), F.lit(" "))
    rows = rows.select(name(F.col(key)).alias("conv"), F.col(turn).alias("turn"), spoken.alias("role"), said.alias("text"),
                       F.monotonically_increasing_id().alias("any"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    ranged = placed(rows, [*order, F.col("any")], order, "turns").drop("any")  # equal rows may lie in several ranges
    first = F.substring("role", 1, 1)
    end = F.right(F.rtrim(F.col("text"), blank), F.lit(1))
    looked = ranged.select(
        "conv", "turn", F.col("_at").alias("at"), F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
        F.when(F.rtrim(F.col("text"), blank) == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise(".").alias("look"),
        F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("words"))
    looked = stage(looked, "looks")
    firsts = looked.filter("look <> 'b'").groupBy("conv", "words").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    marked = looked.join(firsts, "at", "left").select(
        "conv", "at", "initial", F.when((F.col("look") != "b") & F.col("new").isNull(), "d").otherwise(F.col("look")).alias("fault"))
    counts = [F.count_if(F.col("fault") == f).alias(what) for f, what in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    together = marked.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(  # 2**BLOCK_BITS rows a group at most
        F.min("at").alias("segment"), F.sort_array(F.collect_list(F.struct("at", "initial", "fault"))).alias("t"), *counts)
    segments = stage(together.select("conv", "segment", F.array_join("t.initial", "").alias("initials"), F.array_join("t.fault", "").alias("faults"),
                                     "blank", "duplicate", "truncated"), "segments")
    summaries = segments.mapInPandas(_summaries, "conv string, segment long, summary string, illegal long, ends string")
    routes = summaries.repartition("conv").sortWithinPartitions("conv", "segment").mapInPandas(
        _routes, "segment long, start int, end int, last boolean, illegal long")
    divided = stage(segments.join(routes, "segment").mapInPandas(
        _divided, "conv string, segment long, illegal long, cost long, edits array<string>"), "edits")

    audit = F.array_join(F.transform("edits", lambda e: F.regexp_replace(e, "(.).", "$1")), "")
    costs = divided.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
                                        F.sort_array(F.collect_list(F.struct("segment", audit.alias("audit")))).alias("audits"))
    faults = segments.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    gaps = looked.groupBy("conv").agg(gaps.alias("gaps"))
    conversations = gaps.join(faults, "conv").join(costs, "conv").select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.array_join("audits.audit", "").alias("audit"))

    edits = divided.select("segment", F.posexplode("edits").alias("i", "edits")).select((F.col("segment") + F.col("i")).alias("_at"), "edits")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("edits") / 2).cast("int") - 1), lambda i: F.struct(
        i.alias("part"), F.substring(F.col("edits"), 2 * i + 1, F.lit(1)).alias("edit"), F.substring(F.col("edits"), 2 * i + 2, F.lit(1)).alias("r")))
    turns = ranged.join(edits.withColumn("part", F.explode(parts)).select("_at", "part.*").filter("edit <> 'D'"), "_at")
    given = F.when(F.col("edit") == "K", F.col("role")).when(F.col("r") == "u", "user").otherwise("assistant")
    return Repair(conversations, turns.select("conv", F.col("_at").alias("at"), "part", "edit", given.alias("role"),
                                              F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 (hex) of the repaired turns as ``role:text``, joined by line feeds; a conversation streams through a task."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        conv, state = None, None
        for batch in batches:
            out = []
            for one, role, text in zip(*(batch[c].tolist() for c in ("conv", "role", "text"))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if one == conv:
                    state.update(b"\n" + line)
                    continue
                if state:
                    out.append((conv, state.hexdigest()))
                conv, state = one, hashlib.sha256(line)
            yield pd.DataFrame(out, columns=["conv", "sha256"])
        if state:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "sha256"])

    sorted_turns = turns.repartition("conv").sortWithinPartitions("conv", "at", "part")
    return sorted_turns.select("conv", "role", "text").mapInPandas(hashed, "conv string, sha256 string")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` (key, turn, role, text) with faults dealt by a hash of key and turn: dropped, emptied, unpunctuated, repeated, said by the user."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (key, turn, role, text)]
    fault = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    return (
        rows.select(F.col(key), F.col(turn), said[2].alias("_role"), said[3].alias("_text"), fault.alias("_fault")).filter("_fault <> 0")
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))))
        .select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.when(F.col("_fault") == 4, "user").otherwise(F.col("_role")).alias("role"),
                F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text")).alias("text"))
    )
