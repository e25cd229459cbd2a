"""Synthetic tracks for tests and the evaluation: a clean flight, ways to spoil it, and tracks that are odd but honest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geo


def clean_track(spark: SparkSession, icao24: str, *, lat: float = 37.3, lon: float = -79.2, heading: float = 90.0, speed_kt: float = 420.0, altitude_ft: float = 33000.0, vertical_rate_fpm: float = 0.0, points: int = 40, interval_s: float = 5.0, start: str = "2026-01-01 12:00:00", nic: int = 8, nacp: int = 9, callsign: str = "TEST123") -> DataFrame:
    """A straight flight of constant speed."""
    t = F.col("id") * interval_s
    la, lo = geo.destination(F.lit(lat), F.lit(lon), F.lit(heading), t * (speed_kt / geo.KT_PER_MPS))
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + (t * 1e6).cast("long")
    return spark.range(points).select(
        F.lit(icao24).alias("icao24"), F.timestamp_micros(micros).alias("observed_at"), la.alias("latitude"), lo.alias("longitude"), (F.lit(altitude_ft) + t * vertical_rate_fpm / 60).alias("altitude_ft"),
        F.lit(speed_kt).alias("ground_speed_kt"), F.lit(heading).alias("track_deg"), F.lit(vertical_rate_fpm).alias("vertical_rate_fpm"), F.lit(nic).alias("nic"), F.lit(nacp).alias("nacp"), F.lit("1200").alias("squawk"),
        F.lit(callsign).alias("callsign"), F.lit("rx").alias("receiver_id"), (F.lit(altitude_ft) + t * vertical_rate_fpm / 60).alias("alt_geom_ft"), F.lit(False).alias("on_ground"), F.lit("A3").alias("emitter_category"),
        F.concat(F.lit(icao24 + ":"), F.col("id").cast("string")).alias("source_row_id"), F.col("id").alias("seq"),
    )


def spoiled(track: DataFrame, first: int, last: int, **columns: Column) -> DataFrame:
    """Rows first to last (by ``seq``) with other values."""
    hit = F.col("seq").between(first, last)
    return track.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in columns.items()})


def teleport(track: DataFrame, at: int, jump_nm: float = 60.0) -> DataFrame:
    la, lo = geo.destination(F.col("latitude"), F.col("longitude"), F.lit(0.0), F.lit(jump_nm * geo.M_PER_NM))
    return spoiled(track, at, at, latitude=la, longitude=lo)


def speed_lie(track: DataFrame, first: int, last: int, factor: float = 2.0) -> DataFrame:
    return spoiled(track, first, last, ground_speed_kt=F.col("ground_speed_kt") * factor)


def climb_lie(track: DataFrame, first: int, last: int, rate_fpm: float = 4000.0) -> DataFrame:
    return spoiled(track, first, last, vertical_rate_fpm=F.lit(rate_fpm))


def impossible_turn(track: DataFrame, at: int, degrees: float = 120.0) -> DataFrame:
    return spoiled(track, at, at, track_deg=F.pmod(F.col("track_deg") + degrees, F.lit(360.0)))


def integrity_collapse(track: DataFrame, first: int, last: int, nic: int = 0) -> DataFrame:
    return spoiled(track, first, last, nic=F.lit(nic))


def silence(track: DataFrame, first: int, last: int) -> DataFrame:
    return track.where(~F.col("seq").between(first, last))


def impersonation(track: DataFrame, offset_nm: float = 80.0) -> DataFrame:
    """A second aircraft of the same address, reporting in between."""
    la, lo = geo.destination(F.col("latitude"), F.col("longitude"), F.lit(180.0), F.lit(offset_nm * geo.M_PER_NM))
    other = track.withColumns({"latitude": la, "longitude": lo, "observed_at": F.timestamp_micros(F.unix_micros("observed_at") + 2_000_000), "seq": F.col("seq") + 100_000})
    return track.unionByName(other)


def takeover(track: DataFrame, first: int, last: int, jump_nm: float = 120.0) -> DataFrame:
    """Silence, then the track goes on where it cannot have come to."""
    la, lo = geo.destination(F.col("latitude"), F.col("longitude"), F.lit(0.0), F.lit(jump_nm * geo.M_PER_NM))
    return spoiled(silence(track, first, last), last + 1, 1 << 30, latitude=la, longitude=lo)


def turning(track: DataFrame, rate_dps: float, interval_s: float = 5.0, speed_kt: float = 250.0) -> DataFrame:
    """The track bent to a circle, flown at a constant rate of turn."""
    radius = speed_kt / geo.KT_PER_MPS / (rate_dps * 3.141592653589793 / 180)
    heading = F.pmod(F.col("seq") * (interval_s * rate_dps), F.lit(360.0))
    # the centre is abeam; the first report lies west of it, heading north
    la, lo = geo.destination(F.lit(37.3), F.lit(-79.2), heading - 90.0, F.lit(radius))
    return track.withColumns({"latitude": la, "longitude": lo, "track_deg": heading, "ground_speed_kt": F.lit(speed_kt)})


def jittered(track: DataFrame, most_m: float) -> DataFrame:
    """Position errors of up to ``most_m``, the same on every run."""
    la, lo = geo.destination(F.col("latitude"), F.col("longitude"), F.pmod(F.col("seq") * 137.0, F.lit(360.0)), F.pmod(F.col("seq") * 0.618, F.lit(1.0)) * most_m)
    return track.withColumns({"latitude": la, "longitude": lo})


def labelled(spark: SparkSession) -> DataFrame:
    """Tracks of the evaluation, each of an address of its own, with ``label``: ``positive:rule``, ``guard:rule`` or ``negative:why``."""

    def clean(**options) -> DataFrame:
        return clean_track(spark, "a00000", **options)

    still = {"nic": F.lit(0)}
    one = {
        "positive:teleport_v1": teleport(clean(), 20, 47.0),
        "positive:speed_delta_v1": speed_lie(clean(), 10, 25, 0.65),
        "positive:vrate_delta_v1": climb_lie(clean(), 10, 25, 3500.0),
        "positive:turn_rate_v1": impossible_turn(clean(), 20, 95.0),
        "positive:coexistence_v1": impersonation(clean(), 90.0),
        "positive:reappear_v1": takeover(clean(points=60), 18, 33),
        "positive:nic_floor_v1": integrity_collapse(clean(), 12, 30),
        "guard:teleport_v1": teleport(clean(), 15, 450.0),
        "guard:turn_rate_v1": impossible_turn(clean(speed_kt=450.0), 20, 90.0),
        "guard:speed_delta_v1": spoiled(clean(interval_s=30.0, speed_kt=480.0), 5, 30, ground_speed_kt=F.lit(90.0)),
        "guard:vrate_delta_v1": climb_lie(clean(altitude_ft=35000.0), 10, 25, 5000.0),
        "guard:nic_floor_v1": spoiled(clean(points=80), 5, 65, **still),
        "guard:coexistence_v1": impersonation(clean(), 200.0),
        "negative:tailwind": clean(speed_kt=780.0),
        "negative:standard-turn": turning(clean(), 3.0),
        "negative:descent": clean(vertical_rate_fpm=-2400.0),
        "negative:quiet": silence(clean(points=60), 18, 41),
        "negative:brief-integrity-dip": integrity_collapse(clean(), 18, 22),
        "negative:vehicle": spoiled(clean(speed_kt=12.0, altitude_ft=900.0), 0, 99, on_ground=F.lit(True), track_deg=F.pmod(F.col("seq") * 113.0, F.lit(360.0))),
        "negative:jitter": jittered(clean(interval_s=0.55), 25.0),
        "negative:sparse": clean(points=2, interval_s=4.0),
        "negative:formation": clean().unionByName(clean_track(spark, "b00000", lat=37.304)),
    }
    out = None
    for k, (label, track) in enumerate(one.items()):
        own = track.withColumns({"icao24": F.concat(F.substring("icao24", 1, 4), F.lit(f"{k:02x}")), "label": F.lit(label)})
        out = own if out is None else out.unionByName(own)
    return out
