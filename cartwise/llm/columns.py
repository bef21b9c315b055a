"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what separates words.
BLANKS = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text, split at BLANKS; none for an empty, blank or null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def _scan(lengths: Column) -> Column:
    def longer(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    sums = F.aggregate(lengths, F.array(F.lit(0).cast("long")), longer)
    return F.slice(sums, 1, F.size(lengths))


def running_sums(lengths: Column) -> Column:
    """For each element of an array<long> the sum of those before it.

    Appending to an array copies it, so the array is cut into blocks of BLOCK elements: sums within
    blocks, and sums of whole blocks.
    """
    def cut(a: Column) -> Column:
        last = F.floor(F.size(a) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda s, x: s + x)

    def joined(blocks: Column) -> Column:
        return let(_scan(F.transform(blocks, total)), lambda before: F.flatten(F.transform(
            blocks, lambda block, i: F.transform(_scan(block), lambda x: x + before[i]))))

    return let(lengths, lambda a: let(cut(a), joined))


def uniform(*parts: Column) -> Column:
    """Number in (0, 1) from a hash of the parts, 48 bits, the same in every engine that has md5."""
    return (hash48(*parts) + F.lit(0.5)) / F.lit(float(2**48))


def hash48(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """String that names a row: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce(text, F.lit("")))))


def pack(docs: DataFrame, *replaced: str) -> Column:
    """One struct ``_row`` of the columns of ``docs`` without those named; keeps their names out of the way."""
    taken = {name.lower() for name in replaced}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]).alias("_row")


def unpack(df: DataFrame, *new) -> DataFrame:
    """The columns of ``_row`` and the new ones."""
    return df.select(*[F.col("_row").getField(f.name).alias(f.name) for f in df.schema["_row"].dataType.fields], *new)


def with_new(docs: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns of ``docs`` and the new ones, which replace any of the same name."""
    taken = {name.lower() for name in new}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken],
                       *[c.alias(name) for name, c in new.items()])
