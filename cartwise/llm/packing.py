"""Packing documents into sequences of a fixed length, by first-fit decreasing.

Documents are tokenised, an end id is added, and the ids are cut into pieces of the sequence length and
a remainder. Pieces are dealt into random groups of about ``GROUP_PIECES``; within a group, pieces go
from the longest to the shortest, each into the first sequence that has room. A tournament tree over
the sequences' free room finds that sequence in logarithmic time: each inner node holds the most room
below it. A group wastes about one sequence more than packing everything at once would.

Ids come from the rank file of the vocabulary, which gives the ids of the same vocabulary's ``tokenizers``
file. Added tokens of that file, which lies beside the rank file, have their own ids wherever a text holds
their strings, as there. The pieces are a table in the shared folder before they are dealt, so a lost
executor never changes which piece went where, and each task holds one group.

Cases: a null text is empty, one end id. Repeated rows are documents of their own. Null ids stay null.
Other columns of the input are not kept. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import stage

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
_PART_BYTES = 8 << 20


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the ``tokenizers`` file beside a rank file; none where there is no such file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in tokens if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
        raise ValueError(f"added tokens that depend on what is around them: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str | None):
    """Text -> ids by a rank file; by default the installed one of 50,256 tokens. Added tokens count as such where allowed."""
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go by size, the largest first, ties in the given order."""
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    most = [room] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:  # the left child wins if it has room
            node *= 2
            if most[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, room - most[node]
        most[node] -= size
        node //= 2
        while node:
            most[node] = max(most[2 * node], most[2 * node + 1])
            node //= 2
    return bins, offsets


def tokenise(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
             vocabulary: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (binary, little-endian 16 or 32 bits), place.

    ``place`` is a number that spreads pieces evenly over groups, copies of a document included.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, n = encoder(vocabulary), 0
        kind = np.dtype("<u2" if encode.n_vocab <= 1 << 16 else "<u4")
        rng = np.random.default_rng([42, TaskContext.get().partitionId()])
        rows, held = [], 0

        def part() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
            out["place"] = rng.integers(0, 1 << 62, len(out))
            return out

        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode.encode_to_numpy(body, allowed_special="all").astype(kind), kind.type(end_id)) if body else np.array([end_id], kind)
                for start in range(0, len(ids), length):
                    cut = ids[start:start + length]
                    rows.append((doc, start, len(cut), len(ids), cut.tobytes()))
                    held += cut.nbytes
                if held > _PART_BYTES:
                    yield part()
                    rows, held = [], 0
        if rows:
            yield part()

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        pieces, f"doc_id {key_type}, start long, length long, doc_tokens long, ids binary, place long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
         vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` is binary, little-endian 32 bits. A sequence is the pieces of one ``sequence_id`` by ``offset``.
    """
    cut = stage(tokenise(docs, key, text, length, end_id, vocabulary), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    key_type = cut.schema["doc_id"].dataType.simpleString()

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, length)
        ids = [np.frombuffer(b, f"<u{len(b) // n}").astype("<u4").tobytes() for b, n in zip(group["ids"], sizes)]
        return pd.DataFrame({
            "doc_id": group["doc_id"], "start": group["start"], "length": sizes, "doc_tokens": group["doc_tokens"],
            "sequence_id": (int(group["grp"].iloc[0]) << 32) + bins, "offset": offsets, "ids": ids})

    dealt = cut.withColumn("grp", F.pmod("place", F.lit(groups))).drop("place")
    return dealt.groupBy("grp").applyInPandas(
        packed, f"doc_id {key_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
