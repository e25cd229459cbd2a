"""Continuous detection: windows over a stream, idempotent upserts, run records, and a loop of ticks over stored rows."""

from __future__ import annotations

import signal
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from aerolith.operators import observations
from aerolith.plans.detectors import Detector
from aerolith.sinks.tables import Runs, VersionedTable, latest_of_key, to_rows
from aerolith.sources import readers


def tumbling(stream: DataFrame, window_s: int, *, lateness_s: int, time: str = "observed_at") -> DataFrame:
    """Reports by aircraft and window; a window is given out when the watermark has passed its end."""
    w = F.window(time, f"{window_s} seconds")
    return stream.withWatermark(time, f"{lateness_s} seconds").groupBy(w.alias("w"), "icao24").agg(F.count("*").alias("reports"), F.max("ground_speed_kt").alias("top_kt")).select(F.col("w.start").alias("window_start"), "icao24", "reports", "top_kt")


def new_only(stream: DataFrame, *key: str, lateness_s: int, time: str = "observed_at") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, f"{lateness_s} seconds").dropDuplicatesWithinWatermark(list(key))


def upserting(stream: DataFrame, table: VersionedTable, key: str, *order: str, kept: tuple[str, ...] = (), runs: Runs | None = None, detector: tuple[str, str] = ("", ""), prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer whose batches are upserted: a batch that is run again leaves the table as it was.

    With ``runs`` each batch has a record: RUNNING, then SUCCESS with counts or FAILED."""

    def batch(df: DataFrame, number: int) -> None:
        run = f"{number}-{uuid.uuid4().hex[:8]}"
        if runs:
            runs.start(run, *detector, ("1970-01-01", "1970-01-01"))
        try:
            rows = prepare(df) if prepare else df
            counts = table.upsert(latest_of_key(rows, key, *order), key, kept)
        except Exception:
            if runs:
                runs.finish(run, "FAILED", {})
            raise
        if runs:
            runs.finish(run, "SUCCESS", counts)

    return stream.writeStream.outputMode("update").foreachBatch(batch)


MOST_BACKOFF_S = 300.0


class Ticks:
    """One detector over stored rows: each tick reads the next window, detects, upserts and then moves the cursor.

    The cursor moves last, and upserts are idempotent: a tick that fails anywhere is the next tick again, and nothing is lost
    or stored twice.  Detectors that carry state from window to window run as a stream instead (``streaming.episodes``)."""

    def __init__(self, spark: SparkSession, detector: Detector, rows_path: str, table: VersionedTable, cursors: VersionedTable, runs: Runs, *, domain: str = "air"):
        if detector.stateful:
            raise ValueError(f"{detector.name} carries state between windows")
        self.spark, self.detector, self.rows_path, self.table, self.cursors, self.runs, self.domain = spark, detector, rows_path, table, cursors, runs, domain

    def cursor(self) -> datetime | None:
        row = self.cursors.read().where(F.col("detector_id") == self.detector.name).select(F.unix_micros("cursor_at")).first()
        return datetime.fromtimestamp(row[0] / 1e6, timezone.utc) if row else None

    def bounds(self, now: datetime) -> tuple[datetime, datetime]:
        """Of the next window: a step beyond the cursor, not beyond now; the first one ends now."""
        window_s, step_s = self.detector.cadence
        at = self.cursor()
        end = now if at is None else min(now, at + timedelta(seconds=step_s))
        return end - timedelta(seconds=window_s), end

    def tick(self, now: datetime) -> float:
        """Seconds by which the cursor is behind now, after one window."""
        start, end = self.bounds(now)
        run = uuid.uuid4().hex
        shown = [t.strftime("%Y-%m-%d %H:%M:%S.%f+00:00") for t in (start, end)]
        self.runs.start(run, self.detector.name, "1", (shown[0], shown[1]))
        try:
            rows = readers.stored_window(self.spark, self.rows_path, *shown, domain=self.domain)
            obs = observations.from_storage(rows).withColumn("seq", F.xxhash64("source_row_id"))
            found = observations.first_of_key(self.detector.detect(obs).withColumn("dedup_key", observations.dedup_key(F.col("scope"), F.col("start_at"))), "dedup_key", "start_at", "severity", "score")
            counts = self.table.upsert(to_rows(found, run, F.lit(shown[1]).cast("timestamp")))
        except Exception:
            self.runs.finish(run, "FAILED", {})
            raise
        self.runs.finish(run, "SUCCESS", counts)
        moved = self.spark.range(1).select(F.lit(self.detector.name).alias("detector_id"), F.lit(shown[1]).cast("timestamp").alias("cursor_at"))
        self.cursors.upsert(moved, "detector_id", ("detector_id",))
        return (now - end).total_seconds()


class Loop:
    """Ticks until stopped.  After a good tick it sleeps what is left of the interval once the lag is taken off, so a loop that
    is behind catches up without a pause; after a bad one, twice as long each time up to a limit.  SIGTERM and SIGINT end it after the
    tick under way, and ``drain`` runs last."""

    def __init__(self, tick: Callable[[], float], poll_s: float, *, drain: Callable[[], None] | None = None, sleep: Callable[[float], None] | None = None):
        if poll_s <= 0:
            raise ValueError("the interval must be positive")
        self.tick, self.poll_s, self.drain, self.stopped = tick, poll_s, drain, threading.Event()
        self.sleep = sleep or self.stopped.wait
        self.failures = 0

    def stop(self, *_) -> None:
        self.stopped.set()

    def pause(self, lag: float | None) -> float:
        """Seconds until the next tick; ``lag`` is None after a failure."""
        if lag is None:
            self.failures += 1
            return min(self.poll_s * 2 ** (self.failures - 1), max(MOST_BACKOFF_S, self.poll_s))
        self.failures = 0
        return max(0.0, self.poll_s - lag)

    def run(self, *, once: bool = False) -> None:
        main = threading.current_thread() is threading.main_thread()
        before = {s: signal.signal(s, self.stop) for s in (signal.SIGTERM, signal.SIGINT)} if main else {}
        try:
            while not self.stopped.is_set():
                try:
                    lag: float | None = self.tick()
                except Exception:
                    if once:
                        raise
                    lag = None
                if once:
                    break
                self.sleep(self.pause(lag))
        finally:
            for s, handler in before.items():
                signal.signal(s, handler)
            if self.drain:
                self.drain()
