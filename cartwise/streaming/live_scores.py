"""Scores of sessions that are still open, after every micro-batch.

The state is a table of sessions with sums that add up. A batch is first summed to sessions of its own. These
are merged with the stored sessions of the same users they overlap or come within the gap of; two
chains of events belong together exactly if their spans do, so no event is looked at again, and events that
come late, or join two sessions, are counted like any other. A batch writes the sessions it made or changed,
and takes back those that became part of an earlier one. A version (``sources.versions``) names the folders of all
batches so far: readers see a batch whole or not at all, and a batch that runs again changes nothing.

A user has at most one session per gap in any time, so even the busiest user is few rows. Stored
sessions that ended more than a gap before the first event of a batch are skipped by the file statistics. Recency
moves with the clock, so scores are taken when the table is read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.operators.sessions import GAP_MINUTES, _event_sums, features_of_sums, intent_score, session_sums
from cartwise.session import remove, stage
from cartwise.sources.versions import FAN, Folder, Version, like_sized, publish, read_version, unused


@dataclass(frozen=True)
class SessionTable:
    """Sessions at ``path``."""

    spark: SparkSession
    path: str
    gap_minutes: int = GAP_MINUTES
    view_seconds: float = 1.0
    value_scale: float = 1.0

    def version(self, number: int | None = None) -> Version:
        return read_version(self.spark, self.path, number)

    def _rows(self, folders: tuple[Folder, ...]) -> DataFrame:
        """Rows of all folders: user_id, first_ts, last_ts, sums, removed, seq."""
        return self.spark.read.parquet(*[f"{self.path}/sessions/{f.name}" for f in folders])

    def sessions(self, version: Version | None = None) -> DataFrame:
        """Sums of all sessions of a version, by default the newest."""
        return _newest(self._rows((version or self.version()).folders)).filter(~F.col("removed")).drop("removed", "seq")

    def scores(self, version: Version | None = None, as_of: Column | None = None) -> DataFrame:
        """Every session with its score. Recency is measured at ``as_of``, by default the last event of all."""
        sums = self.sessions(version)
        now = sums.agg(F.max("last_ts")).scalar() if as_of is None else as_of
        return intent_score(features_of_sums(sums, now, self.value_scale))

    def changes(self, version: Version, as_of: Column | None = None) -> DataFrame:
        """Scores of the sessions that the last batch of ``version`` made or changed; those it took back have no score but ``removed``."""
        rows = self._rows(version.folders[-1:])
        now = rows.agg(F.max("last_ts")).scalar() if as_of is None else as_of
        scored = intent_score(features_of_sums(rows.filter(~F.col("removed")), now, self.value_scale)).withColumn("removed", F.lit(False))
        taken_back = rows.filter("removed").select("user_id", F.col("first_ts").alias("session_start"), "removed")
        return scored.unionByName(taken_back, allowMissingColumns=True)

    def apply(self, events: DataFrame, batch: int | None = None) -> Version:
        """Publish the version after ``events`` (user_id, ts, event_type, value)."""
        now = self.version()
        if now.holds(batch):
            return now
        own = stage(session_sums(events, self.gap_minutes, self.view_seconds).drop("session_no"), "batch-sessions")
        gap = F.expr(f"INTERVAL {self.gap_minutes} MINUTES")
        span = own.agg((F.min("first_ts") - gap).cast("string").alias("lo"), (F.max("last_ts") + gap).cast("string").alias("hi")).first()
        lo, hi = (F.lit(span[c]).cast("timestamp_ntz") for c in ("lo", "hi"))
        sums = ["first_ts", "last_ts", *_event_sums()]
        both = own.select("user_id", *sums, F.lit(True).alias("new"))
        if now.folders and span["lo"] is not None:
            stored = self._rows(now.folders).filter((F.col("last_ts") >= lo) & (F.col("first_ts") <= hi))
            users = own.select(F.col("user_id").alias("_user")).distinct()  # events without a user count as one user's
            stored = _newest(stored.join(users, F.col("user_id").eqNullSafe(F.col("_user")), "left_semi")).filter(~F.col("removed"))
            both = both.unionByName(stored.select("user_id", *sums, F.lit(False).alias("new")))
        by_user = Window.partitionBy("user_id").orderBy("first_ts", "last_ts")
        until = F.max("last_ts").over(by_user.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(F.col("first_ts") <= until + gap, 0).otherwise(1)
        placed = both.withColumn("opens", opens).withColumn("session_no", F.sum("opens").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
        merged = placed.groupBy("user_id", "session_no").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *[F.sum(n).alias(n) for n in _event_sums()],
            F.bool_or("new").alias("touched"), F.collect_list(F.when(~F.col("new"), F.col("first_ts"))).alias("parts")).filter("touched")
        joined = merged.select("user_id", F.col("first_ts").alias("kept"), "last_ts", F.explode("parts").alias("first_ts")).filter("first_ts <> kept")
        changed = merged.select("user_id", *sums, F.lit(False).alias("removed")).unionByName(
            joined.select("user_id", "first_ts", "last_ts", F.lit(True).alias("removed")), allowMissingColumns=True)
        folder = self._write(changed, now.folders[-1].seq + 1 if now.folders else 0)
        return publish(self.spark, self.path, Version(now.number + 1, (*now.folders, folder), now.batch if batch is None else batch))

    def _write(self, rows: DataFrame, seq: int) -> Folder:
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/sessions/{name}"
        written = rows.withColumn("seq", F.lit(seq).cast("long"))
        written.write.parquet(path)
        return Folder(seq, name, self.spark.read.schema(written.schema).parquet(path).count())

    def fold(self, fan: int | None = FAN) -> Version:
        """Publish a version in which the newest folders are one where ``fan`` or more are of like size; with None, all."""
        now = self.version()
        folders = now.folders
        while n := like_sized(folders, fan):
            rows = _newest(self._rows(folders[-n:])).drop("seq")
            rows = rows if n < len(folders) else rows.filter(~F.col("removed"))  # nothing is left to take back
            folders = (*folders[:-n], self._write(rows, folders[-1].seq))
        return now if folders == now.folders else publish(self.spark, self.path, Version(now.number + 1, folders, now.batch))

    def vacuum(self, keep: int = 1) -> None:
        """Delete folders that none of the newest ``keep`` versions names."""
        for name in unused(self.spark, self.path, keep):
            remove(self.spark, f"{self.path}/sessions/{name}")


def _newest(rows: DataFrame) -> DataFrame:
    """The last row of each session; a session is named by its user and start."""
    order = Window.partitionBy("user_id", "first_ts").orderBy(F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def create(spark: SparkSession, path: str, **settings) -> SessionTable:
    """An empty table."""
    publish(spark, path, Version(0, (), None))
    return SessionTable(spark, path, **settings)


def score_stream(events: DataFrame, table: SessionTable, checkpoint: str, fan: int = FAN):
    """Start keeping ``table`` up to date with a stream of events."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own = replace(table, spark=batch.sparkSession)
        own.apply(batch, batch_id)
        own.fold(fan)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
