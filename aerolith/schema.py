"""Schemas of observations, zones and detections."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OBSERVATION = _struct(
    icao24=_S, observed_at=_TS, latitude=_D, longitude=_D, altitude_ft=_D, ground_speed_kt=_D, track_deg=_D, vertical_rate_fpm=_D,
    nic=_I, nacp=_I, squawk=_S, callsign=_S, receiver_id=_S, alt_geom_ft=_D, on_ground=_B, emitter_category=_S, source_row_id=_S,
)

STATE = _struct(
    icao24=_S, timestamp=_TS, lat=_D, lon=_D, alt_baro_ft=_D, alt_geom_ft=_D, ground_speed_kt=_D, track_deg=_D,
    callsign=_S, squawk=_S, emitter_category=_S, nic=_I, nac_p=_I, on_ground=_B, source_row_id=_S,
)

RECURRING = _struct(start_time=_S, end_time=_S, weekdays=T.ArrayType(_I), start_month_day=_S, end_month_day=_S, start_sunrise=_B, end_sunset=_B, all_day=_B)

#: rings as arrays of [longitude, latitude]; all rings of all polygons, holes included (even-odd rule)
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(_D)))

ZONE = _struct(
    zone_id=_S, name=_S, zone_type=_S, activation=_S, floor_ft=_D, floor_datum=_S, ceiling_ft=_D, ceiling_datum=_S, rings=RINGS,
    active_windows=T.ArrayType(_struct(start=_TS, end=_TS)), recurring_windows=T.ArrayType(RECURRING), schedule_timezone=_S,
    unknown_outside_schedule=_B, unknown_within_schedule=_B, controlling_agency=_S, source=_S, source_asof=T.DateType(),
)

ENTITY = _struct(entity_type=_S, entity_id=_S)
EVIDENCE = _struct(kind=_S, description=_S, measured=_D, threshold=_D, unit=_S)

DETECTION = _struct(
    detector_id=_S, detector_version=_S, detection_type=_S, scope=_S, entity_ids=T.ArrayType(_S), severity=_S, score=_D, confidence=_D,
    start_at=_TS, end_at=_TS, latitude=_D, longitude=_D, evidence=T.ArrayType(EVIDENCE), limitations=T.ArrayType(_S), tags=T.ArrayType(_S), metadata=T.MapType(_S, _S),
)
