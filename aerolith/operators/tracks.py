"""Tracks: segments, features of consecutive reports, altitude steps and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.config import Spoofing
from aerolith.functions import geo

#: reports of one track in time order; equal times in order of arrival
ORDER = ("observed_at", "seq")


def track(*by: str) -> Window:
    return Window.partitionBy(*by, "icao24").orderBy(*ORDER)


def with_segments(obs: DataFrame, max_gap_s: float, *by: str) -> DataFrame:
    """``segment_id`` from 0: a gap of more than ``max_gap_s`` begins a new one."""
    w = track(*by)
    gap = geo.elapsed(F.lag("observed_at").over(w), F.col("observed_at"))
    broken = F.when(gap > max_gap_s, 1).otherwise(0)
    return obs.withColumn("gap_s", gap).withColumn("_new", broken).withColumn("segment_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


_CARRIED = ("observed_at", "latitude", "longitude", "altitude_ft", "track_deg", "nic", "nacp", "seq")


def pair_features(segmented: DataFrame, *by: str) -> DataFrame:
    """One row per two consecutive reports of a segment; pairs without a time between them are left out.

    The window is that of the segments, so the sort and shuffle are shared."""
    w = track(*by)
    # a segment begins at a row of its own, so the row before is of the same segment if its id is
    before = F.lag(F.struct("segment_id", *_CARRIED)).over(w)
    df = segmented.withColumn("p", before).where("p is not null and p.segment_id = segment_id")
    dt = geo.elapsed(F.col("p.observed_at"), F.col("observed_at"))
    df = df.withColumn("dt_s", dt).where("dt_s > 0")
    distance = geo.haversine_m(F.col("p.latitude"), F.col("p.longitude"), F.col("latitude"), F.col("longitude"))
    speed, climb = F.col("distance_m") / F.col("dt_s") * geo.KT_PER_MPS, (F.col("altitude_ft") - F.col("p.altitude_ft")) / F.col("dt_s") * 60
    return (
        df.withColumn("distance_m", distance)
        .withColumns({"implied_speed_kt": speed, "implied_climb_fpm": climb, "turn_rate_dps": geo.heading_delta(F.col("p.track_deg"), F.col("track_deg")) / F.col("dt_s")})
        .withColumns({"speed_delta_kt": F.col("implied_speed_kt") - F.col("ground_speed_kt"), "climb_delta_fpm": F.col("implied_climb_fpm") - F.col("vertical_rate_fpm")})
    )


def altitude_quantum(segmented: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Per track and segment the greatest common divisor of the altitude's steps, in whole feet.

    Null with too few steps, for a step of 1 and for steps beyond the limit.  Steps count from the last known altitude."""
    w = Window.partitionBy(*by, "icao24", "segment_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    step = F.abs(F.round(F.col("altitude_ft") - F.last("altitude_ft", ignorenulls=True).over(w))).cast("long")
    steps = segmented.withColumn("step", step).where("step > 0")
    # distinct steps have the same divisor, and how many there are is bounded by the band of altitudes
    grouped = steps.groupBy(*by, "icao24", "segment_id").agg(F.count("*").alias("n"), F.collect_set("step").alias("steps"))

    def gcd(a: Column, b: Column) -> Column:
        start = F.struct(a.alias("a"), b.alias("b"))
        out = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b")))
        return out["a"]

    divisor = F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: F.when(s == 0, x).otherwise(gcd(s, x)))
    return grouped.withColumn("divisor", divisor).select(*by, "icao24", "segment_id", "n", F.when((F.col("n") >= cfg.altitude_quantum_min_samples) & (F.col("divisor") > 1) & (F.col("divisor") <= cfg.altitude_quantum_max_ft), F.col("divisor")).cast("double").alias("quantum_ft"))


#: reports for each share of spans, so that few reports are not dealt into many shares
_SHARE_REPORTS = 500


def _shares(obs: DataFrame, step: int, slot: Callable[[Column], Column]) -> int:
    """Into how many shares spans are dealt: twice as many as there are slots, so that few of a share's slots meet in one task,
    which holds all their positions.  Counted in one job."""
    at = F.unix_micros("observed_at")
    r = obs.agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).select("n", (slot(F.floor(F.col("hi") / step)) - slot(F.floor(F.col("lo") / step)) + 1).cast("long").alias("slots")).first()
    return max(1, min(2 * (r.slots or 1), r.n // _SHARE_REPORTS))


def resample(obs: DataFrame, step_s: float, max_gap_s: float, *by: str, slot: Callable[[Column], Column] | None = None) -> DataFrame:
    """Positions on the grid of whole steps since the epoch, blended between the reports around each tick.

    Reports further apart than ``max_gap_s``, or at one time, are not blended; a report on a tick stands for itself.
    If two spans reach a tick, the earlier one counts: spans follow each other, so each has the tick at its end, and that at its
    beginning only if it is the track's first.  Times are whole microseconds, so ticks do not drift.

    ``slot`` makes a column of that name, of a tick's number; it must not fall as ticks rise.  Rows are then dealt by it, as spans,
    of which there are far fewer than positions, and into so many shares that a task has the positions of few slots at once."""
    w = track(*by)
    step = int(step_s * 1_000_000)
    fields = ("latitude", "longitude", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "nic", "nacp", "on_ground")
    at = F.unix_micros("observed_at")
    a, b, first = F.col("_a"), F.col("_n.b"), F.col("_first")
    df = obs.select(*by, "icao24", at.alias("_a"), *fields, (F.row_number().over(w) == 1).alias("_first"), F.lead(F.struct(at.alias("b"), *fields)).over(w).alias("_n")).where("_n is not null")
    # ticks from the first in [a, b] to the last; only exact ones if the span is not blended
    blended = (b > a) & (b - a <= int(max_gap_s * 1_000_000))
    on_a, on_b = a % step == 0, b % step == 0
    run = F.struct((F.ceil(a / step).cast("long") + F.when(on_a & ~first, 1).otherwise(0)).alias("lo"), F.floor(b / step).cast("long").alias("hi"))
    one = lambda t: F.struct((t / step).cast("long").alias("lo"), (t / step).cast("long").alias("hi"))
    ends = F.array(F.when(on_a & first, one(a)), F.when(on_b & (a.isNull() | (b > a)), one(b)))
    df = df.withColumn("_r", F.explode(F.when(blended, F.array(run)).otherwise(ends))).where("_r.lo <= _r.hi")
    if slot:
        df = df.withColumn("slot", F.explode(F.sequence(slot(F.col("_r.lo")), slot(F.col("_r.hi"))))).repartition(_shares(obs, step, slot), *by, "slot")
    df = df.withColumn("tick", F.explode(F.sequence("_r.lo", "_r.hi")))
    if slot:
        df = df.where(slot(F.col("tick")) == F.col("slot"))
    df = df.withColumn("_f", F.when(b > a, (F.col("tick") * step - a) / (b - a)).otherwise(0.0))
    f = F.col("_f")
    out = {c: F.when(f == 0, F.col(c)).when(f == 1, F.col(f"_n.{c}")).otherwise((geo.lerp_angle if c == "track_deg" else geo.lerp)(F.col(c), F.col(f"_n.{c}"), f)) for c in fields[:6]}
    for c in fields[6:]:  # not blended: of the report before
        out[c] = F.when(f == 1, F.col(f"_n.{c}")).otherwise(F.col(c))
    return df.select(*by, *(["slot"] if slot else []), "icao24", "tick", F.timestamp_micros(F.col("tick") * step).alias("at"), *(e.alias(c) for c, e in out.items()))
