"""Activation of scheduled airspace as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# fixed values: the sunrise and sunset equations of the Almanac for Computers (United States Naval Observatory, 1990)
_ANOMALY, _ANOMALY_0 = 0.9856, 3.289
_CENTRE, _CENTRE_2, _PERIGEE = 1.916, 0.020, 282.634
_COS_TILT, _SIN_TILT = 0.91764, 0.39782
_ZENITH = 90.833
_SIDEREAL, _SIDEREAL_0 = 0.06571, 6.622


def solar_hour_utc(day_of_year: Column, latitude: Column, longitude: Column, *, sunrise: bool) -> Column:
    """Hour of the UTC day of sunrise or sunset after the published almanac equations; null in polar day or night."""
    hour = longitude / 15.0
    t = day_of_year + (F.lit(6.0 if sunrise else 18.0) - hour) / 24.0
    m = t * _ANOMALY - _ANOMALY_0
    sun = F.pmod(m + F.sin(F.radians(m)) * _CENTRE + F.sin(F.radians(m) * 2) * _CENTRE_2 + _PERIGEE, F.lit(360.0))
    ra = F.pmod(F.degrees(F.atan(F.tan(F.radians(sun)) * _COS_TILT)), F.lit(360.0))
    ra = (ra + F.floor(sun / 90.0) * 90.0 - F.floor(ra / 90.0) * 90.0) / 15.0
    sin_d = F.sin(F.radians(sun)) * _SIN_TILT
    cos_h = (F.cos(F.radians(F.lit(_ZENITH))) - sin_d * F.sin(F.radians(latitude))) / (F.cos(F.asin(sin_d)) * F.cos(F.radians(latitude)))
    h = F.degrees(F.acos(cos_h))
    h = (F.lit(360.0) - h if sunrise else h) / 15.0
    return F.when(F.abs(cos_h) <= 1, F.pmod(h + ra - t * _SIDEREAL - _SIDEREAL_0 - hour, F.lit(24.0)))


def in_annual_range(day: Column, start: Column, end: Column) -> Column:
    """Month-days as MM-DD, both ends included, wrapping over the new year."""
    d = F.date_format(day, "MM-dd")
    return F.when(start.isNull() | end.isNull(), True).when(start <= end, (d >= start) & (d <= end)).otherwise((d >= start) | (d <= end))


def in_recurring(window: Column, at: Column, zone: Column, latitude: Column, longitude: Column) -> Column:
    """Whether a UTC timestamp is in one recurring window, taken on the timestamp's own local day."""
    local = F.from_utc_timestamp(at, zone)
    day = F.to_date(local)

    def clock(text: Column) -> Column:
        return F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), text), "yyyy-MM-dd HH:mm")

    def solar(sunrise: bool) -> Column:
        hour = solar_hour_utc(F.dayofyear(day).cast("double"), latitude, longitude, sunrise=sunrise)
        utc = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + (hour * 3.6e9).cast("long"))
        return F.from_utc_timestamp(utc, zone)

    start = F.when(F.coalesce(window["start_sunrise"], F.lit(False)), solar(True)).otherwise(clock(window["start_time"]))
    end = F.when(F.coalesce(window["end_sunset"], F.lit(False)), solar(False)).otherwise(clock(window["end_time"]))
    end = F.when(end <= start, end + F.expr("interval 1 day")).otherwise(end)
    weekday = F.coalesce(F.size(window["weekdays"]) <= 0, F.lit(True)) | F.array_contains(window["weekdays"], F.weekday(day))
    hours = F.coalesce(window["all_day"], F.lit(False)) | F.coalesce((start <= local) & (local < end), F.lit(False))
    return F.coalesce(weekday, F.lit(True)) & in_annual_range(day, window["start_month_day"], window["end_month_day"]) & hours


def activation(zone: Column, at: Column, latitude: Column, longitude: Column) -> Column:
    """ACTIVE, UNKNOWN or INACTIVE.  zone: struct of the zone's columns."""
    fixed = F.exists(F.coalesce(zone["active_windows"], F.array()), lambda w: (w["start"] <= at) & (at < w["end"]))
    recurring = F.exists(F.coalesce(zone["recurring_windows"], F.array()), lambda w: in_recurring(w, at, F.coalesce(zone["schedule_timezone"], F.lit("UTC")), latitude, longitude))
    none = (F.coalesce(F.size(zone["active_windows"]), F.lit(0)) <= 0) & (F.coalesce(F.size(zone["recurring_windows"]), F.lit(0)) <= 0)
    return (
        F.when(zone["activation"] == "ALWAYS", "ACTIVE")
        .when((zone["activation"] == "NOTAM") | none, "UNKNOWN")
        .when(fixed, "ACTIVE")
        .when(recurring, F.when(F.coalesce(zone["unknown_within_schedule"], F.lit(False)), "UNKNOWN").otherwise("ACTIVE"))
        .when(F.coalesce(zone["unknown_outside_schedule"], F.lit(False)), "UNKNOWN")
        .otherwise("INACTIVE")
    )
