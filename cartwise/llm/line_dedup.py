"""Fuzzy deduplication of lines: of each component of similar lines one line of the corpus stays.

Lines are compared without blanks around them. Two lines are linked if they are equal, or if the Jaccard
similarity of their sets of ``SHINGLE`` characters is at least ``SIMILARITY``.

1. Signatures: per distinct line of a batch, the least of its shingles' hashes under ``BANDS * ROWS``
   permutations; bands of ``ROWS`` values are bucket keys. A pair at the least similarity shares a bucket
   with probability 1 - (1 - 0.8**5)**14 = 0.996, more similar pairs more surely.
2. Buckets with at least two distinct lines are kept; buckets of equal members are taken once. Rows of a
   bucket pass a task sorted and are handed on as they come, so that a bucket of any size takes no memory.
3. Within a bucket lines are verified by exact Jaccard similarity, unless already linked through others.
   A bucket beyond ``BLOCK`` lines or ``BLOCK_CHARS`` characters is cut into blocks, and each pair of blocks is a unit of its own. Units
   of buckets with the same least line are dealt to one task, which verifies no pair twice. Shingles of eight
   characters below 256 are compared as whole numbers of 64 bits, which hold them exactly, others as strings. Pairs are never
   written out, only an edge from each line to the root of its local component. Shingles of lines beyond
   ``LONG`` characters are sorted arrays of hashes, checked against the text, of twenty bytes a character.
4. Union-find over the edges, in rounds of joins (``components``).
5. Of each component, and of each group of equal lines, the first occurrence stays, by document id (null
   ids last), then line number. Other occurrences are dropped from their texts.

Texts are shuffled once, to drop lines from them. A line is named by 64 bits of its hash in the search
for candidates, which are verified by text, and by 96 bits where equal lines are grouped.

Cases: blank lines are never dropped; null and empty texts stay as they are. Lines shorter than a shingle
are only dropped as equals. Rows that agree in id and text are one document and get the same text.
Columns of the input stay, apart from ``n_lines`` and ``n_dropped``, which are replaced. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Set

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.columns import BLANKS, pack, unpack
from cartwise.llm.components import components
from cartwise.session import stage

SHINGLE = 8
SIMILARITY = 0.8
ROWS, BANDS = 5, 14
BLOCK = 1024
BLOCK_CHARS = 1 << 20
LONG = 4096
SEED = 42
#: A list of candidate lines up to this many rows of 8 bytes is broadcast; a longer one is joined by a shuffle.
BROADCAST_LINES = 1_000_000
_CHARS_AT_ONCE = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ROW_FACTORS = _RNG.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def line_id(line: str) -> int:
    """As Spark's xxhash64 of the line."""
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), SEED)
    return value - (1 << 64) if value >> 63 else value


def band_keys(lines: list[str]) -> np.ndarray:
    """Bucket keys (BANDS x lines) of lines of at least SHINGLE characters."""
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    base, width = 0x01000193, 1
    while width < SHINGLE:  # a hash of 2, 4, 8 characters from two of half the length
        h = h[:-width] * np.uint32(base) + h[width:]
        base, width = base * base % (1 << 32), width * 2
    h ^= h >> np.uint32(16)  # mixed, so that an odd factor permutes it well enough
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    inside = np.ones(len(h), bool)  # not the places where a shingle would run into the next line
    over = np.cumsum(sizes)[:-1, None] - np.arange(1, SHINGLE)
    inside[over.ravel()] = False
    x = h[inside]
    counts = sizes - SHINGLE + 1
    return least_keys(x, np.cumsum(counts) - counts)


def least_keys(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket keys (BANDS x sets) of sets of 32-bit hashes that lie one after another in ``x``, from ``starts`` on."""
    keys = np.empty((BANDS, len(starts)), np.uint64)
    v = np.empty_like(x)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64) * _ODD
        for r in range(ROWS):
            i = band * ROWS + r
            np.multiply(x, _FACTORS[i], out=v)
            key = (key ^ (key >> np.uint64(31))) * _ROW_FACTORS[r] + np.minimum.reduceat(v, starts).astype(np.uint64)
        keys[band] = (key ^ (key >> np.uint64(29))) * _ODD
    return keys.view(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(lines: list[str], ids: list[int]) -> pd.DataFrame:
        keys = band_keys(lines)
        sizes = np.fromiter(map(len, lines), np.int32, len(lines))
        return pd.DataFrame({"key": keys.ravel(), "line": np.tile(np.array(ids, np.int64), BANDS), "size": np.tile(sizes, BANDS)})

    for batch in batches:
        seen: set[int] = set()
        lines, ids, chars = [], [], 0
        for text in batch["text"]:
            for raw in (text or "").split("\n"):
                line = raw.strip(BLANKS)
                if len(line) >= SHINGLE and (name := line_id(line)) not in seen:
                    seen.add(name)
                    lines.append(line)
                    ids.append(name)
                    chars += len(line)
                    if chars > _CHARS_AT_ONCE:
                        yield rows(lines, ids)
                        lines, ids, chars = [], [], 0
        if lines:
            yield rows(lines, ids)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key and line, the distinct lines of keys with several. Of earlier batches only the last row is held."""
    held, follows = None, False  # the last distinct row, and whether one of its key came before it
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key, line = batch["key"].to_numpy(), batch["line"].to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        batch, key = batch[new], key[new]
        as_before = np.append(follows, key[1:] == key[:-1])
        keep = as_before | np.append(key[1:] == key[:-1], False)
        held, follows = batch.iloc[-1:], bool(as_before[-1])
        yield batch[:-1][keep[:-1]]
    if follows:
        yield held


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def similar(a: set[str], b: set[str]) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < SIMILARITY * large:
        return False
    common = len(a & b)
    return common >= SIMILARITY * (small + large - common)


class Packed:
    """Set of a line's shingles, all of characters below 256: the eight of a shingle are the bytes of a whole number, sorted."""

    def __init__(self, raw: bytes):
        v = np.frombuffer(raw, np.uint8).astype(np.uint64)
        for width in (1, 2, 4):
            v = v[:-width] << np.uint64(8 * width) | v[width:]
        v.sort()
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        self.packed = v[new]

    def __len__(self) -> int:
        return len(self.packed)

    def __and__(self, other: Packed) -> np.ndarray:
        few, many = sorted((self.packed, other.packed), key=len)
        at = np.searchsorted(many, few)
        at[at == len(many)] = 0
        return few[many[at] == few]


def shingled(line: str) -> Set:
    """Shingles of a line as ``similar`` takes them, with sets of its kind."""
    if len(line) > LONG:
        return Shingles(line)
    try:
        return Packed(line.encode("latin-1")) if len(line) >= SHINGLE else set()
    except UnicodeEncodeError:
        return shingles(line)


class Shingles:
    """Shingles of a long line: sorted distinct hashes, the place of each, and the line's characters."""

    def __init__(self, line: str):
        self.codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        h, base, width = self.codes.astype(np.uint64) + np.uint64(1), 0x100000001B3, 1
        while width < SHINGLE:
            h = h[:-width] * np.uint64(base) + h[width:]
            h ^= h >> np.uint64(29)
            base, width = base * base % (1 << 64), width * 2
        at = np.argsort(h, kind="stable")
        h = h[at]
        new = np.append(True, h[1:] != h[:-1])
        again = np.flatnonzero(~new)
        #: Whether no two shingles of the line share a hash.
        self.told_apart = bool(_same(self.codes, at[again], self.codes, at[again - 1]).all())
        self.hashes, self.at = h[new], at[new]

    def __len__(self) -> int:
        return len(self.hashes)

    def common(self, other: Shingles) -> int:
        _, i, j = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        return int(_same(self.codes, self.at[i], other.codes, other.at[j]).sum())


def _same(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    same = np.ones(len(at_a), bool)
    for k in range(SHINGLE):
        same &= a[at_a + k] == b[at_b + k]
    return same


class _Links:
    """Union-find over the lines of units that are dealt together; no pair is verified twice, or once linked.

    ``shingled`` gives a line's set of shingles.
    """

    def __init__(self, shingled: Callable[[str], Set] = shingled):
        self.shingled = shingled
        self.parent: dict[int, int] = {}
        self.sets: dict[int, set[str] | Shingles] = {}
        self.texts: dict[int, str] = {}
        self.differ: set[tuple[int, int]] = set()

    def find(self, line: int) -> int:
        while (up := self.parent.setdefault(line, line)) != line:
            self.parent[line] = self.parent[up]
            line = up
        return line

    def _similar(self, a: int, b: int) -> bool:
        pair = (a, b) if a < b else (b, a)
        if pair in self.differ:
            return False
        if self._alike(a, b):
            return True
        self.differ.add(pair)
        return False

    def _alike(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if not isinstance(x, Shingles) and not isinstance(y, Shingles):
            if type(x) is not type(y) and min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)):
                x, y = shingles(self.texts[a]), shingles(self.texts[b])
            return similar(x, y)
        small, large = sorted((len(x), len(y)))
        if small < SIMILARITY * large:
            if all(s.told_apart for s in (x, y) if isinstance(s, Shingles)):
                return False
        x, y = (s if isinstance(s, Shingles) else Shingles(self.texts[i]) for s, i in ((x, a), (y, b)))
        if not (x.told_apart and y.told_apart):
            return similar(shingles(self.texts[a]), shingles(self.texts[b]))
        common = x.common(y)
        return common >= SIMILARITY * (small + large - common)

    def add_unit(self, lines: list[int], texts: list[str], blocks: list[int], cross: bool) -> None:
        for line, text in zip(lines, texts):
            if line not in self.sets:
                self.texts[line] = text
                self.sets[line] = self.shingled(text)
        groups: dict[int, list[tuple[int, int]]] = {}
        for line, block in zip(lines, blocks):
            own = groups.pop(self.find(line), []) + [(line, block)]
            for root in list(groups):
                if any(self._similar(line, other) for other, at in groups[root] if not cross or at != block):
                    self.parent[self.find(line)] = self.find(root)
                    own += groups.pop(root)
            groups[self.find(line)] = own


def _verified(batches: Iterator[pd.DataFrame], shingled: Callable[[str], Set] = shingled) -> Iterator[pd.DataFrame]:
    """Edges (a, b) between lines, from rows sorted by deal and unit."""
    rest: list[pd.DataFrame] = []  # of the last deal

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        deals, units = part["deal"].to_numpy(), part["unit"].to_numpy()
        at = np.flatnonzero(np.append(True, (units[1:] != units[:-1]) | (deals[1:] != deals[:-1])))
        lines, texts, blocks, cross = (part[c].tolist() for c in ("line", "text", "block", "cross"))
        found: list[tuple[int, int]] = []
        links, deal = _Links(shingled), None
        for lo, hi in zip(at, np.append(at[1:], len(units))):
            if deals[lo] != deal:
                found += [(x, r) for x in links.parent if (r := links.find(x)) != x]
                links, deal = _Links(shingled), deals[lo]
            links.add_unit(lines[lo:hi], texts[lo:hi], blocks[lo:hi], bool(cross[lo]))
        found += [(x, r) for x in links.parent if (r := links.find(x)) != x]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        whole = (batch["deal"] != batch["deal"].iloc[-1]).to_numpy()
        if rest and (whole.any() or batch["deal"].iloc[0] != rest[-1]["deal"].iloc[-1]):
            yield edges(pd.concat([*rest, batch[whole]], ignore_index=True))
            rest = []
        elif whole.any():
            yield edges(batch[whole])
        rest.append(batch[~whole])
    if rest:
        yield edges(pd.concat(rest, ignore_index=True))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def chosen_buckets(signed: DataFrame) -> DataFrame:
    """Staged (key, line, least, blocks) of buckets with several lines, each set of lines once; ``signed``: key, line, size."""
    shared = stage(signed.repartition("key").sortWithinPartitions("key", "line").mapInPandas(_shared, "key long, line long, size int"), "buckets")
    buckets = shared.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("line")).alias("members"), F.min("line").alias("least"), F.sum("size").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("int")
    once = buckets.groupBy("members", "n").agg(F.min_by(F.struct("key", "least", "chars"), "key").alias("b")).select("n", "b.*")
    return stage(shared.join(once, "key").select("key", "line", "least", F.least("n", blocks).cast("int").alias("blocks")), "chosen-buckets")


def verified_links(chosen: DataFrame, texts: DataFrame, shingled: Callable[[str], Set] = shingled) -> DataFrame:
    """Edges (a, b) that connect what pairs of similar lines within buckets connect. ``texts``: line, text."""
    units = (
        chosen.withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
        .select("line", "key", "least", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("line", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
                F.xxhash64("least", F.least("block", "other"), F.greatest("block", "other")).alias("deal"), "block",
                (F.col("block") != F.col("other")).cast("int").alias("cross"))
    )
    return units.join(texts, "line").repartition("deal").sortWithinPartitions("deal", "unit", "line").mapInPandas(
        lambda batches: _verified(batches, shingled), "a long, b long")


def similar_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root): for each line with a similar, not equal one, its hash and the least hash of its component."""
    chosen = chosen_buckets(docs.select(F.col(text).alias("text")).mapInPandas(_signatures, "key long, line long, size int"))
    wanted = stage(chosen.select("line").distinct(), "candidate-lines")
    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    exploded = docs.select(F.explode(_lines(F.col(text))).alias("raw")).select(_bare(F.col("raw")).alias("text"))
    texts = exploded.withColumn("line", F.xxhash64("text")).join(wanted, "line").groupBy("line").agg(F.min("text").alias("text"))
    return components(stage(verified_links(chosen, stage(texts, "candidate-texts")), "line-links"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with dropped lines taken from ``text``, and ``n_lines`` (not blank ones) and ``n_dropped``."""
    linked = stage(similar_lines(docs, text), "line-components")
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    occurrences = docs.select(row.alias("row"), F.posexplode(_lines(F.col(text))).alias("at", "raw")).withColumn("bare", _bare(F.col("raw")))
    occurrences = occurrences.filter("bare <> ''").select("row", "at", F.xxhash64("bare").alias("line"), F.hash("bare").alias("more"))
    named = occurrences.join(linked.select(F.col("node").alias("line"), "root"), "line", "left").select(
        "row", "at", F.coalesce("root", "line").alias("g1"), F.when(F.col("root").isNull(), F.col("more")).otherwise(0).alias("g2"))
    named = stage(named, "occurrences")
    firsts = named.groupBy("g1", "g2").agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    dropped = named.join(firsts, ["g1", "g2"]).filter(F.struct("row", "at") != F.col("first"))
    dropped = dropped.groupBy("row").agg(F.collect_set("at").alias("dropped"))
    dropped = stage(dropped.select(F.col("row.id").cast("string").alias("_id"), F.col("row.h").alias("_h"), "dropped"), "dropped-lines")
    dropped = dropped.select(F.coalesce("_id", F.lit("\x00none")).alias("_id"), "_h", "dropped")
    df = docs.select(
        pack(docs, text, "n_lines", "n_dropped"), F.col(text).alias("_text"),
        F.coalesce(F.col(key).cast("string"), F.lit("\x00none")).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h")).join(dropped, ["_id", "_h"], "left")
    df = df.withColumn("_lines", _lines(F.col("_text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dropped"))
    out = unpack(df, F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(
                     F.array_join(F.transform(kept, lambda i: F.col("_lines")[i]), "\n")).alias(text),
                 F.size(F.filter("_lines", lambda x: _bare(x) != "")).cast("long").alias("n_lines"),
                 F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_dropped")
