"""Incursion episodes as a stream: one state per aircraft, late reports judged by its own clock."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerolith.config import Airspace

OUTPUT = "icao24 string, zone_id string, start_us long, end_us long, hits long, confidence double, status string"
_STATE = "state string"


class Tracker:
    """Episodes of one aircraft; ``feed`` takes its reports in time order."""

    def __init__(self, cfg: Airspace, state: dict | None = None):
        self.cfg = cfg
        self.last: int | None = state["last"] if state else None
        self.open: dict[str, dict] = state["open"] if state else {}

    def state(self) -> dict:
        return {"last": self.last, "open": self.open}

    def feed(self, at: int, zones: dict[str, float]) -> Iterator[tuple[str, dict]]:
        """A report at a time in microseconds with the zones that it hits and their confidences; yields episodes that it closes."""
        gap = self.last is not None and at - self.last > self.cfg.max_gap_s * 1e6
        self.last = at
        for zone in list(self.open):
            e = self.open[zone]
            if zone not in zones and not gap:
                e["clear"] += 1
                e["run_at"] = None
            if gap or e["clear"] >= self.cfg.clear_observations_to_close:
                yield zone, self.open.pop(zone)
        for zone, confidence in zones.items():
            e = self.open.setdefault(zone, {"start": at, "end": at, "hits": 0, "best": 0.0, "clear": 0, "run_at": None, "run_best": 0.0})
            if e["run_at"] is None:
                e["run_at"], e["run_best"] = at, 0.0
            e["run_best"] = max(e["run_best"], confidence)
            low = self.cfg.persistence_min_factor
            ramp = min((at - e["run_at"]) / 1e6 / self.cfg.persistence_saturation_s, 1.0) * (1 - low) + low
            e |= {"end": at, "hits": e["hits"] + 1, "clear": 0, "best": max(e["best"], e["run_best"] * ramp)}


def episodes(reports: DataFrame, cfg: Airspace, *, silence: bool = True) -> DataFrame:
    """reports (stream): icao24, us, seq, hits (array of zone_id, confidence; empty: clear).

    Update mode: rows of episodes that closed, and of all that are open, so that the last row of a key (icao24, zone_id,
    start_us) is its present state.  A report no later than one of an earlier batch is dropped for its aircraft only.

    The feed's clock is its newest report.  An aircraft that is silent for ``max_gap_s`` at the clock less ``feed_lateness_s``
    has its episodes closed by a timer on event time, whether or not it ever reports again, and is forgotten after
    ``seen_retention_s``, behind which reports are too late.  Without ``silence`` there are no timers: what is open at the end
    of the input stays so."""
    retention = max(cfg.seen_retention_s, cfg.max_gap_s + cfg.feed_lateness_s)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []

        def add(zone, e, status):
            rows.append((key[0], zone, e["start"], e["end"], e["hits"], e["best"], status))

        def wake(tracker: Tracker) -> None:
            """The watermark is the clock less the retention: the timer's time is set back by as much."""
            if not silence:
                return
            quiet = cfg.max_gap_s + cfg.feed_lateness_s - retention if tracker.open else 0
            state.setTimeoutTimestamp(max(int(tracker.last / 1000 + quiet * 1000) + 1, state.getCurrentWatermarkMs() + 1))

        tracker = Tracker(cfg, json.loads(state.get[0]) if state.exists else None)
        if state.hasTimedOut:
            if not tracker.open:
                state.remove()
                return
            for zone, e in tracker.open.items():
                add(zone, e, "CLOSED")
            tracker.open = {}
        else:
            before = tracker.last
            pdf = pd.concat(list(frames)).sort_values(["us", "seq"], kind="stable")
            for at, hits in zip(pdf["us"], pdf["hits"], strict=True):
                if before is not None and at <= before:
                    continue
                for zone, e in tracker.feed(int(at), {h["zone_id"]: h["confidence"] for h in hits}):
                    add(zone, e, "CLOSED")
            for zone, e in tracker.open.items():
                add(zone, e, "OPEN")
        state.update((json.dumps(tracker.state()),))
        wake(tracker)
        yield pd.DataFrame(rows, columns=["icao24", "zone_id", "start_us", "end_us", "hits", "confidence", "status"])

    if silence:
        reports = reports.withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{int(retention)} seconds")
    return reports.groupBy("icao24").applyInPandasWithState(run, OUTPUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout if silence else GroupStateTimeout.NoTimeout)


def report_lists(evaluated: DataFrame, hits: DataFrame) -> DataFrame:
    """Every report with the list of its hits; a clear report has an empty one.  Two batch tables of one report key ``seq``."""
    listed = hits.groupBy("seq").agg(F.collect_list(F.struct("zone_id", "confidence")).alias("hits"))
    reports = evaluated.select("icao24", F.unix_micros("timestamp").alias("us"), "seq").dropDuplicates(["seq"])
    none = F.array().cast("array<struct<zone_id:string,confidence:double>>")
    return reports.join(listed, "seq", "left").withColumn("hits", F.coalesce("hits", none))
