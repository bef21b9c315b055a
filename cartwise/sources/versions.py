"""Versions of a set of files that are written once: lists of folders, each published by one step.

A version is a Parquet file of one row per folder, written as ``versions/version=<number>``. Spark's commit protocol moves
the one file into place when it is whole, so readers find a version entirely or not at all, and what it
names was written before. A number that is there is not written again, which keeps a second writer out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8  # so many folders of like size become one
_SCHEMA = "version long, seq long, name string, size long, batch long"


@dataclass(frozen=True)
class Folder:
    seq: int    # later folders replace or hide rows of earlier ones
    name: str
    size: int   # in rows


@dataclass(frozen=True)
class Version:
    """``batch``: the newest batch of a stream that is in it."""

    number: int
    folders: tuple[Folder, ...]
    batch: int | None

    def holds(self, batch: int | None) -> bool:
        return batch is not None and self.batch is not None and batch <= self.batch


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or an earlier one."""
    rows = spark.read.schema(_SCHEMA).parquet(f"{path}/versions")
    if number is None:
        number = rows.agg(F.max("version")).first()[0]
    found = rows.filter(F.col("version") == number).collect()  # a row per folder
    if not found:
        raise ValueError(f"no version {number} at {path}")
    folders = sorted((Folder(r["seq"], r["name"], r["size"]) for r in found if r["name"] is not None), key=lambda f: f.seq)
    return Version(number, tuple(folders), found[0]["batch"])


def publish(spark: SparkSession, path: str, version: Version) -> Version:
    rows = [(f.seq, f.name, f.size, version.batch) for f in version.folders] or [(None, None, None, version.batch)]
    named = spark.createDataFrame(rows, "seq long, name string, size long, batch long").coalesce(1)
    named.write.mode("errorifexists").parquet(f"{path}/versions/version={version.number}")
    return version


def unused(spark: SparkSession, path: str, keep: int) -> set[str]:
    """Folders that older versions name and none of the newest ``keep`` does."""
    rows: DataFrame = spark.read.schema(_SCHEMA).parquet(f"{path}/versions")
    newest = rows.agg(F.max("version")).first()[0]
    names = rows.filter("name is not null").groupBy("name").agg(F.max("version").alias("last")).collect()
    return {r["name"] for r in names if r["last"] <= newest - keep}


def like_sized(folders: tuple[Folder, ...], fan: int | None = FAN) -> int:
    """How many of the last folders should become one: those of like size, if they are ``fan`` or more; with None, all.

    A folder is like those after it unless it has ``fan`` times the rows of their average, so that a row is written
    again once each time the whole has grown by about ``fan``.
    """
    run: list[Folder] = []
    for f in reversed(folders):
        if run and fan and f.size >= fan * max(1, sum(x.size for x in run) / len(run)):
            break
        run.append(f)
    return len(run) if len(run) >= max(2, fan or 0) else 0
