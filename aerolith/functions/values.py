"""Forgiving casts and validity tests of raw fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    """Finite double or null."""
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def integer(c: Column) -> Column:
    """By way of a double, truncated, so that 8.0 is 8."""
    return number(c).cast("int")


def boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def icao_address(c: Column) -> Column:
    """Six hexadecimal digits."""
    return c.rlike("^[0-9a-fA-F]{6}$")


def parsed_address(c: Column) -> Column:
    """An address of 24 bits at most as a number: 0x, blanks and underscores are allowed; anything else is null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^0[xX]", ""), "[ _]", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{1,6}$"), F.conv(bare, 16, 10).cast("long"))


def readable_callsign(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[A-Za-z0-9]+$"), F.lit(False))


def squawk(c: Column) -> Column:
    """Four octal digits, padded on the left; else null."""
    t = F.trim(c)
    padded = F.when(F.length(t) < 4, F.lpad(t, 4, "0")).otherwise(t)
    return F.when((F.length(t) > 0) & padded.rlike("^[0-7]{4}$"), padded)


def operator_code(callsign: Column) -> Column:
    return F.upper(F.substring(F.trim(callsign), 1, 3))


def rejection(entity: Column, time: Column, latitude: Column, longitude: Column) -> Column:
    """The first reason that makes a stored row unusable, or null.  Blank counts as absent."""
    bare = F.when(entity.startswith("icao24:"), F.substr(entity, F.lit(8))).otherwise(entity)
    return (
        F.when(text(entity).isNull(), "MISSING_ENTITY")
        .when(~entity.startswith("icao24:") | text(bare).isNull(), "BAD_ENTITY")
        .when(~icao_address(F.trim(bare)), "NON_ICAO_ADDRESS")
        .when(time.isNull(), "MISSING_TIME")
        .when(latitude.isNull() | longitude.isNull(), "MISSING_POSITION")
        .when(F.isnan(latitude) | F.isnan(longitude) | (F.abs(latitude) > 90) | (F.abs(longitude) > 180), "BAD_POSITION")
    )


def payload_fields(payload: Column) -> dict[str, Column]:
    """Optional fields of a stored row's JSON payload: flat, or wrapped with the message under ``payload``."""

    def at(path: str) -> Column:
        return F.get_json_object(payload, path)

    wrapped = at("$.payload").startswith("{")

    def either(flat: str, *inner: str) -> Column:
        return F.when(F.coalesce(wrapped, F.lit(False)), F.coalesce(*(at(f"$.payload.{k}") for k in inner))).otherwise(at(f"$.{flat}"))

    baro = either("altitude_ft", "alt_baro")
    words = F.coalesce(wrapped, F.lit(False)) & baro.isNotNull() & number(baro).isNull()
    return {
        "altitude_ft": number(baro),
        "alt_geom_ft": number(either("alt_geom_ft", "alt_geom")),
        "vertical_rate_fpm": number(either("vertical_rate_fpm", "baro_rate", "geom_rate")),
        "nic": integer(either("nic", "nic")),
        "nacp": integer(either("nacp", "nac_p")),
        "squawk": text(either("squawk", "squawk")),
        "callsign": text(either("callsign", "flight")),
        "emitter_category": text(either("emitter_category", "category")),
        "on_ground": F.when(words, baro == "ground").otherwise(boolean(either("on_ground", "on_ground"))),
    }
