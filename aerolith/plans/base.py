"""How plans meet tables: readers of the driver's tables and thresholds scaled to the event stream's cadence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.config import Airspace, Altitude, Proximity, Spoofing, Tier
from aerolith.operators import observations

DAY = 86_400

#: reports of one user are hours apart, so limits in seconds are hours here and speeds are lower
SPOOFING = Spoofing(
    teleport_kt=50.0, turn_rate_dps=0.004, turn_rate_min_speed_kt=20.0, speed_delta_kt=20.0, position_error_m=30.0, timing_error_s=0.25, vrate_delta_fpm=500.0, nic_min_duration_s=20_000.0,
    altitude_quantum_max_ft=100.0, max_gap_s=43_200.0, episode_gap_s=43_200.0, pingpong_speed_mps=3.0, reappear_speed_mps=1.0, coexistence_window_s=3600.0,
)
ALTITUDE = Altitude(floor_ft=500.0, ceiling_ft=6000.0)
PROXIMITY = Proximity(grid_step_s=900.0, max_gap_s=43_200.0, ground_altitude_ft=300.0, ground_speed_kt=5.0, max_tcpa_s=7200.0, max_current_separation_nm=40.0, min_altitude_ft=500.0, alert_cooldown_s=7200.0, tiers=(Tier("HIGH", 2.0, 400.0), Tier("MEDIUM", 6.0, 900.0), Tier("LOW", 12.0, 2000.0)))
AIRSPACE = replace(Airspace(), max_gap_s=43_200.0, persistence_saturation_s=7200.0)


def r3(c: str | Column, by: int = 1000) -> Column:
    """To three decimals, halves up, in double arithmetic, which every engine does alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(by) + 0.5) / float(by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.from_events(table(spark, sf_dir, "events"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier table read as a registry: one type per address."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lpad(F.lower(F.hex(F.col("s_suppkey") + 10485760)), 6, "0").alias("icao24"), (F.col("s_suppkey") % 7 * 20).cast("double").alias("max_speed_kt"), (F.col("s_suppkey") % 5 * 1000 + 1500).cast("double").alias("ceiling_ft"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation table read as disjoint address blocks."""
    n = table(spark, sf_dir, "nation")
    lo = F.col("n_nationkey").cast("long") * 8 + 10485760
    return n.select(lo.alias("lo"), (lo + 6).alias("hi"), F.col("n_name").alias("country"))


_RECT = "array(array(array({w}D, {s}D), array({e}D, {s}D), array({e}D, {n}D), array({w}D, {n}D)))"
_T = "array<struct<start:timestamp,end:timestamp>>"
_R = "array<struct<start_time:string,end_time:string,weekdays:array<int>,start_month_day:string,end_month_day:string,start_sunrise:boolean,end_sunset:boolean,all_day:boolean>>"


def zones(spark: SparkSession) -> DataFrame:
    """A fixed set of zones over the projection's area: one of each kind of limit and schedule."""
    rows = [
        ("P-1", "PROHIBITED", "ALWAYS", 0.0, "SFC", 5000.0, "MSL", _RECT.format(w=-78.9, e=-78.7, s=37.2, n=37.4), f"cast(array() as {_T})", f"cast(array() as {_R})", False, False),
        ("R-2", "RESTRICTED", "ALWAYS", 1000.0, "MSL", 8000.0, "MSL", "array(array(array(-78.6D, 37.1D), array(-78.3D, 37.1D), array(-78.3D, 37.5D), array(-78.45D, 37.25D), array(-78.6D, 37.5D)))", f"cast(array() as {_T})", f"cast(array() as {_R})", False, False),
        ("T-3", "TFR", "WINDOW", 0.0, "SFC", 7000.0, "MSL", _RECT.format(w=-78.9, e=-78.6, s=37.5, n=37.8), f"array(named_struct('start', timestamp'2024-01-05 00:00:00', 'end', timestamp'2024-01-20 12:00:00'))", f"cast(array() as {_R})", False, False),
        ("M-4", "MOA", "SCHEDULED", 2000.0, "MSL", 6000.0, "FL", _RECT.format(w=-78.5, e=-78.1, s=37.5, n=37.9), f"cast(array() as {_T})", f"cast(array(named_struct('start_time', '09:00', 'end_time', '17:30', 'weekdays', array(0, 1, 2, 3, 4), 'start_month_day', cast(null as string), 'end_month_day', cast(null as string), 'start_sunrise', false, 'end_sunset', false, 'all_day', false)) as {_R})", True, False),
        ("W-5", "WARNING", "NOTAM", 500.0, "AGL", 4000.0, "MSL", _RECT.format(w=-78.3, e=-78.05, s=37.1, n=37.4), f"cast(array() as {_T})", f"cast(array() as {_R})", False, False),
    ]
    sql = " union all ".join(
        f"select '{i}' as zone_id, '{i}' as name, '{k}' as zone_type, '{a}' as activation, {fl}D as floor_ft, '{fd}' as floor_datum, {ce}D as ceiling_ft, '{cd}' as ceiling_datum, {rings} as rings, {fixed} as active_windows, {recurring} as recurring_windows, 'UTC' as schedule_timezone, {str(out).lower()} as unknown_outside_schedule, {str(within).lower()} as unknown_within_schedule"
        for i, k, a, fl, fd, ce, cd, rings, fixed, recurring, out, within in rows
    )
    return spark.sql(sql)
