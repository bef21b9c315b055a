"""Near-duplicate documents by SimHash.

Fingerprints: A-Z is lowered, words are split at blanks, and each shingle of three words votes with the
bits of its XXH64; a bit is 1 if more than half of the shingles have it. Two documents are linked if
their fingerprints differ in at most three bits; components of links are classes.

Candidates come from an inverted index on bytes at their positions. Three differing bits touch at most
three of the eight bytes, so linked fingerprints share at least five positional bytes. Postings of a
single byte would hold 1/256 of all fingerprints each; instead an entry joins three positions, chosen
so that any five shared bytes hold at least one whole entry: the triples within either half of the
fingerprint (five bytes put three into one half). That is eight entries of 24 bits a fingerprint. For
each pair that meets in an entry the shared positional bytes are tallied, pairs with fewer than five
are dropped, and the rest are verified by their differing bits.

Equal fingerprints are counted once. Within an entry's postings no pairs are written out: a task links
them and hands on one edge to the least of each local component. Postings longer than ``BLOCK`` are cut
into blocks, and each pair of blocks is a unit of work of its own, so all links of a hot entry are found
without a task that holds them all.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like others.
Repeated rows are linked with each other. The class id is the least document id; null ids count last,
and a class of null ids only has a null id (``class_print`` names it). Columns of the input
stay, apart from those added, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwise.llm.columns import pack, unpack
from cartwise.llm.components import components, local_roots
from cartwise.llm.near_copies import similar_texts
from cartwise.session import stage

SHINGLE = 3
DISTANCE = 3
SEED = 42
SHARED_BYTES = 8 - DISTANCE
ENTRIES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
BLOCK = 2048
ADDED = ("fingerprint", "component_id", "class_print")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BITS_AT_ONCE = 1 << 14


def fingerprint_of(text: str | None) -> int:
    """64-bit SimHash of one text, unsigned."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    line = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) if not line.isascii() else np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = max(1, len(words) - SHINGLE + 1)
    stops = (ends[min(SHINGLE, len(words)) - 1:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts = starts[:last].tolist()
    for at in range(0, last, _BITS_AT_ONCE):
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[at:at + _BITS_AT_ONCE], stops[at:at + _BITS_AT_ONCE])), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint_of(t) for t in batch], np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """Fingerprint as a long, two's complement."""
    return F.pandas_udf(_fingerprints, "long")(text)


def _entry_keys() -> Column:
    """The eight index entries of a fingerprint ``fp``: entry number and three positional bytes in one long."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * (7 - p)).bitwiseAND(255)
    return F.array(*[
        F.lit(n).cast("long") * (1 << 24) + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c)
        for n, (a, b, c) in enumerate(ENTRIES)])


def _links(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Links among postings sorted by unit of work: row i against row i + d of the same unit, for d = 1, 2, ..."""
    unit, fp = group["unit"].to_numpy(), group["fp"].to_numpy().view(np.uint64)
    block = group["block"].to_numpy()
    bytes_of = fp.view(np.uint8).reshape(-1, 8)
    left, right = [], []
    rows, d = np.arange(len(fp)), 1
    while True:
        rows = rows[rows + d < len(fp)]
        rows = rows[unit[rows] == unit[rows + d]]
        if not len(rows):
            break
        tried = rows[group["cross"].to_numpy()[rows] <= (block[rows] != block[rows + d])]
        shared = (bytes_of[tried] == bytes_of[tried + d]).sum(axis=1)
        tried = tried[shared >= SHARED_BYTES]
        near = np.bitwise_count(fp[tried] ^ fp[tried + d]) <= DISTANCE
        left.append(tried[near])
        right.append(tried[near] + d)
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) from postings sorted by unit; a unit that a batch cuts is carried to the next."""
    rest = None

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        fp = part["fp"].to_numpy()
        left, right = _links(part)
        roots = local_roots(len(fp), left, right)
        at = np.flatnonzero(roots != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[at], "b": fp[roots[at]]}).drop_duplicates()

    for batch in batches:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        whole = (batch["unit"] != batch["unit"].iloc[-1]).to_numpy()
        rest = batch[~whole]
        if whole.any():
            yield edges(batch[whole])
    if rest is not None:
        yield edges(rest)


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most DISTANCE bits connect; ``prints`` are distinct ``fp``.

    Counts of postings come first; entries with a single posting go no further. Postings of entry
    ``key`` with ``n`` rows lie in ``ceil(n / BLOCK)`` blocks; a unit is a block or a pair of blocks.
    """
    postings = stage(prints.select("fp", F.explode(_entry_keys()).alias("key")), "postings")
    hot = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = postings.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # a row works in the unit of its own block, and in one with each other block
    units = placed.select("fp", "key", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    units = units.select("fp", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "block",
                         (F.col("block") != F.col("other")).cast("int").alias("cross"))
    dealt = units.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``class_print``, which names the class."""
    return _classes(docs.select(pack(docs, *ADDED), F.col(key).alias("_key"), fingerprint(F.col(text)).alias("fp")))


def fingerprint_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``near_duplicates``, but of the input only the key is kept, so texts are not written."""
    return _classes(docs.select(F.struct(F.col(key)).alias("_row"), F.col(key).alias("_key"), fingerprint(F.col(text)).alias("fp")))


def _print_classes(printed: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``printed`` (fp, _key)."""
    least = stage(printed.groupBy("fp").agg(F.min("_key").alias("least")), "distinct-fingerprints")
    roots = components(stage(near_links(least.select("fp")), "links")).withColumnRenamed("node", "fp")
    rooted = stage(least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return stage(rooted.join(ids, "root").select("fp", "root", "component_id"), "classes")


def _classes(printed: DataFrame) -> DataFrame:
    printed = stage(printed, "fingerprints")
    classes = _print_classes(printed.select("fp", "_key"))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return unpack(printed.join(classes, "fp"), digits("fp").alias("fingerprint"), "component_id", digits("root").alias("class_print"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", near_copies: bool = False) -> DataFrame:
    """``docs`` with one row of each class: of its least id (nulls last), then of the least fingerprint and text hash.

    Which row stays is decided on ids and fingerprints alone; rows are shuffled once, to pick it. With ``near_copies``
    links are also those of ``near_copies.similar_texts``, since texts that share four fifths of their shingles differ
    by seven bits in the mean.
    """
    printed = stage(docs.select(pack(docs), F.col(key).alias("_key"), fingerprint(F.col(text)).alias("fp"),
                                F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash")), "fingerprints")
    slim = printed.select("fp", "_key", "_hash")
    classes = _print_classes(slim)
    if near_copies:
        rooted = stage(slim.join(classes.select("fp", "root"), "fp").select("_hash", "root").distinct(), "texts-by-class")
        pivots = rooted.groupBy("root").agg(F.min("_hash").alias("pivot"))
        own = rooted.join(pivots, "root").select(F.col("_hash").alias("a"), F.col("pivot").alias("b"))
        near = similar_texts(printed.select(F.col("_hash").alias("line"), F.col("_row").getField(text).alias("text")))
        classes = components(stage(own.unionByName(near), "text-links")).select(F.col("node").alias("_hash"), "root")
        rooted = slim.join(classes, "_hash")
    else:
        rooted = slim.join(classes, "fp")
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("id"), "fp", "_hash")
    first = rooted.groupBy("root").agg(F.min(order).alias("o")).select(
        F.col("o.fp").alias("_fp"), F.col("o.id").alias("_id"), F.col("o._hash").alias("_first"))
    same = (F.col("fp") == F.col("_fp")) & F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_first"))
    # rows that repeat id and text: a rank limit leaves one a task before the shuffle, and one after it
    one = Window.partitionBy("fp", "_key", "_hash").orderBy(F.xxhash64("_row"))
    return unpack(printed.join(first, same, "left_semi").withColumn("_n", F.row_number().over(one)).filter("_n = 1"))
