"""Near copies among documents: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A-Z is lowered and words are split at blanks; a shorter text is one shingle, one without words has none and no
links. Shingles are compared as hashes of 64 bits. Candidates share one of the bands of MinHash values that line deduplication
uses, which finds a pair at the least similarity with probability 0.996 and more similar ones more surely; pairs within
buckets are verified by the whole sets, as for lines: blocks of bounded size, and an edge from each text to a root.

Texts are named by a hash of 64 bits, so equal ones are one. A text is handled whole; its shingles take eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.line_dedup import chosen_buckets, least_keys, verified_links
from cartwise.session import stage

WORDS = 5
_WORDS_KNOWN = 1 << 16
_HASHES_AT_ONCE = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, computed once while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


_hashes = _Hashes()


def word_shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * _FACTOR + h[i:len(h) - n + 1 + i]
    return np.unique(out ^ (out >> np.uint64(32)))


class WordShingles:
    """Set of a text's shingles."""

    def __init__(self, text: str):
        self.hashes = word_shingles(text)

    def __len__(self) -> int:
        return len(self.hashes)

    def __and__(self, other: WordShingles) -> np.ndarray:
        return np.intersect1d(self.hashes, other.hashes, assume_unique=True)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(names: list[int], sets: list[np.ndarray], sizes: list[int]) -> pd.DataFrame:
        counts = np.fromiter(map(len, sets), np.int64, len(sets))
        x = np.concatenate(sets)
        keys = least_keys((x ^ (x >> np.uint64(32))).astype(np.uint32), np.cumsum(counts) - counts)
        n = len(keys)
        return pd.DataFrame({"key": keys.ravel(), "line": np.tile(np.array(names, np.int64), n), "size": np.tile(np.array(sizes, np.int32), n)})

    for batch in batches:
        names, sets, sizes, held, seen = [], [], [], 0, set()
        for name, text in zip(batch["line"].tolist(), batch["text"]):
            if name in seen:
                continue
            seen.add(name)
            found = word_shingles(text)
            if not len(found):
                continue
            names.append(name)
            sets.append(found)
            sizes.append(len(text))
            held += len(found)
            if held > _HASHES_AT_ONCE:
                yield rows(names, sets, sizes)
                names, sets, sizes, held = [], [], [], 0
        if names:
            yield rows(names, sets, sizes)


def similar_texts(texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what similar pairs of ``texts`` (line: name, text) connect."""
    chosen = chosen_buckets(texts.mapInPandas(_signatures, "key long, line long, size int"))
    wanted = chosen.select("line").distinct()
    held = texts.join(wanted, "line", "left_semi").dropDuplicates(["line"])
    return verified_links(chosen, stage(held, "candidate-texts"), WordShingles)
