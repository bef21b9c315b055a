"""Best-fit packing by minimum bin slack: every sequence takes the fullest combination of lengths that is left.

Documents are tokenised and an end id is added; only documents beyond the sequence length are cut, into
pieces of that length, the first of which may be shorter. A sequence is made by taking the longest piece
left and the set of other pieces that fills the rest best. That set is a subset sum over the lengths
available, in a bitset: bit ``t`` is on if some pieces add up to ``t`` tokens. Lengths go in from the
longest, so short pieces, which fill gaps, are spent last, and the search ends once the rest is full.

Only lengths matter for this, and there are at most ``length`` of them, so the whole corpus is packed at
once from its histogram: a combination is taken as many times as the counts allow, after which one of its
lengths is short of copies. There are fewer than ``length * (1 + ln(length))`` combinations at any size of
the corpus. The histogram (a count per length) and the combinations are all that the driver holds.

Pieces of a length are interchangeable, so they are numbered, and a combination takes the next numbers of
its lengths: a piece finds its sequence and offset by a join with the combinations on its length and number.
Numbers are counted where pieces are cut, and continued from task to task by sums, so no piece is shuffled
to number it, and a length that a third of all pieces share is no group. The pieces are a table in the
shared folder first; a lost executor never changes a number.

Cases: a null text is empty, one end id. Repeated rows are documents of their own. Null ids stay null.
Other columns of the input are not kept, whatever their names. A text is tokenised whole, in its task.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.llm.packing import encoder
from cartwise.session import stage

LENGTH = 2048
END_ID = 0
SLACKS = (0, 1, 2, 4, 8, 16, 32, 64)
_PART_BYTES = 8 << 20


class Combination(NamedTuple):
    """``parts``: (length, copies), the longest first. ``times``: sequences made of them."""

    parts: list[tuple[int, int]]
    times: int


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """(length, copies) of a sequence with the longest length of ``counts`` and the least slack.

    A set that leaves at most ``slack`` ends the search. ``counts`` has positive counts, the longest first.
    """
    longest = next(iter(counts))
    rest = room - longest
    enough = max(0, rest - slack)
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for size, count in counts.items():
        left = min(count - (size == longest), rest // size)
        copies = 1
        while left > 0 and not reach >> enough:  # 1, 2, 4, .. copies and what remains give every number up to ``left``
            copies = min(copies, left)
            steps.append((size, copies, reach))
            reach |= (reach << size * copies) & mask
            left -= copies
            copies *= 2
        if reach >> enough:
            break
    total, taken = reach.bit_length() - 1, Counter({longest: 1})
    for size, copies, before in reversed(steps):
        if not before >> total & 1:
            taken[size] += copies
            total -= size * copies
    return sorted(taken.items(), reverse=True)


def combinations(counts: dict[int, int], room: int, slack: int = 0) -> list[Combination]:
    """Sequences for all pieces counted by length."""
    left = {size: counts[size] for size in sorted(counts, reverse=True) if counts[size] > 0}
    out = []
    while left:
        parts = fullest(left, room, slack)
        times = min(left[size] // copies for size, copies in parts)
        for size, copies in parts:
            left[size] -= copies * times
            if not left[size]:
                del left[size]
        out.append(Combination(parts, times))
    return out


def fewest(counts: dict[int, int], room: int) -> list[Combination]:
    """The shortest packing over all allowances."""
    return min((combinations(counts, room, slack) for slack in SLACKS), key=lambda found: sum(c.times for c in found))


def places(combined: list[Combination]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, sequence, copies, offset): pieces ``first`` to ``end`` of a length lie from ``sequence`` on, ``copies`` in each."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for parts, times in combined:
        offset = 0
        for size, copies in parts:
            rows.append((size, used[size], used[size] + copies * times, sequence, copies, offset))
            used[size] += copies * times
            offset += size * copies
        sequence += times
    return rows


def cut(tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first have the full length."""
    first = tokens if tokens <= length else tokens % length or length
    return [(0, first), *((start, length) for start in range(first, tokens, length))]


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
             vocabulary: str | None = None) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids (binary, little-endian 32 bits), ids_crc32, task, nth (of its length in the task, from 0)."""
    key_type = docs.schema[key].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        rows, held = [], 0
        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"]):
                ids = encode.encode_to_numpy(body, allowed_special="all") if body else np.zeros(0)
                ids = np.append(ids, end_id).astype("<u4")
                for i, (start, size) in enumerate(cut(len(ids), length)):
                    part = ids[start:start + size].tobytes()
                    rows.append((doc, i, start, size, part, zlib.crc32(part), task, seen[size]))
                    seen[size] += 1
                    held += len(part)
                    if held > _PART_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        pieces, f"doc_id {key_type}, piece int, start long, length int, ids binary, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
         vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    cut_up = stage(tokenise(docs, key, text, length, end_id, vocabulary), "pieces")
    counts = stage(cut_up.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    schema = "length int, first long, end long, sequence long, copies long, at long"
    found = cut_up.sparkSession.createDataFrame(places(fewest(histogram, length)), schema)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    earlier = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    number: Column = F.col("earlier") + F.col("nth")
    placed = cut_up.join(earlier, ["task", "length"]).withColumn("number", number).join(
        F.broadcast(found), ["length"]).filter("number >= first AND number < end")
    within = F.col("number") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32",
        (F.col("sequence") + F.floor(within / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + within % F.col("copies") * F.col("length")).alias("offset"))
