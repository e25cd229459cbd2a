"""Observations: their projection from the event stream, storage rows, windows and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import values as v
from aerolith.schema import OBSERVATION


def from_events(events: DataFrame) -> DataFrame:
    """The event stream read as position reports: integer arithmetic only, so any engine gets the same rows."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.lpad(F.lower(F.hex(F.col("user_id") + 10485760)), 6, "0").alias("icao24"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        (F.lit(37.0) + (e * 37 % 1000) / 1000.0).alias("latitude"),
        (F.lit(-79.0) + (e * 53 % 1000) / 1000.0).alias("longitude"),
        F.when(e % 17 != 0, F.col("value") * 100).alias("altitude_ft"),
        F.when(e % 23 != 0, F.col("value") * 2).alias("ground_speed_kt"),
        (e * 7 % 360).cast("double").alias("track_deg"),
        F.when(e % 13 != 0, (e * 11 % 4001 - 2000).cast("double")).alias("vertical_rate_fpm"),
        F.when(e % 19 != 0, k % 12).cast("int").alias("nic"),
        F.floor(k / 12).cast("int").alias("nacp"),
        (k + 1200).cast("string").alias("squawk"),
        F.col("event_type").alias("callsign"),
        F.concat(F.lit("rx-"), (e % 5).cast("string")).alias("receiver_id"),
        F.when(e % 17 != 0, F.col("value") * 100 + (e % 200 - 100)).alias("alt_geom_ft"),
        (k % 10 == 0).alias("on_ground"),
        F.lit("A3").alias("emitter_category"),
        F.concat(F.lit("events:"), e.cast("string")).alias("source_row_id"),
        e.alias("seq"),
    )


def validated(rows: DataFrame) -> DataFrame:
    """Rows that satisfy the observation contract: an address, a time and a position in range; the address trimmed and lower-cased."""
    fit = v.text(F.col("icao24")).isNotNull() & F.col("observed_at").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return rows.where(fit).withColumn("icao24", F.lower(F.trim("icao24")))


def to_storage(obs: DataFrame, source_id: str) -> DataFrame:
    """Storage rows: prefixed entity id, flat JSON payload, and a record reference that falls back to address and time."""
    payload = F.to_json(F.struct(F.col("icao24").alias("hex"), *(F.col(c) for c in ("altitude_ft", "alt_geom_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "nic", "nacp", "squawk", "callsign", "emitter_category", "on_ground", "receiver_id"))))
    return obs.select(
        "observed_at",
        F.concat(F.lit("icao24:"), "icao24").alias("entity_id"),
        F.lit("air").alias("domain"),
        F.lit(source_id).alias("source_id"),
        "latitude",
        "longitude",
        F.col("ground_speed_kt").alias("sog"),
        F.col("track_deg").alias("cog"),
        payload.alias("payload"),
        F.coalesce("source_row_id", F.concat_ws("@", "icao24", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).alias("raw_record_ref"),
    )


def with_reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", v.rejection(F.col("entity_id"), F.col("observed_at"), F.col("latitude"), F.col("longitude")))


def from_storage(rows: DataFrame) -> DataFrame:
    """Usable storage rows as observations; unusable ones are left out (``with_reason`` names them)."""
    p = v.payload_fields(F.col("payload"))
    fields = {f.name: p.get(f.name, F.lit(None)).cast(f.dataType) for f in OBSERVATION.fields}
    fields |= {
        "icao24": F.lower(F.trim(F.substr("entity_id", F.lit(8)))),
        "observed_at": F.col("observed_at"),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
        "ground_speed_kt": F.col("sog"),
        "track_deg": F.col("cog"),
        "receiver_id": v.text(F.get_json_object("payload", "$.receiver_id")),
        "source_row_id": F.col("raw_record_ref"),
    }
    return with_reason(rows).where("reason is null").select(*(c.alias(n) for n, c in fields.items()))


def to_states(obs: DataFrame) -> DataFrame:
    """Observations as states of the airspace rules; a state needs at least one altitude."""
    return obs.where("altitude_ft is not null or alt_geom_ft is not null").select(
        "icao24", F.col("observed_at").alias("timestamp"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.col("altitude_ft").alias("alt_baro_ft"), "alt_geom_ft", "ground_speed_kt", "track_deg", "callsign", "squawk", "emitter_category", "nic",
        F.col("nacp").alias("nac_p"), F.coalesce("on_ground", F.lit(False)).alias("on_ground"), "source_row_id", *(["seq"] if "seq" in obs.columns else []),
    )


# --- windows


def windowed(obs: DataFrame, window_s: int, step_s: int | None = None, *, time: str = "observed_at") -> DataFrame:
    """Every row in every window [k*step, k*step + window) that holds it, from the window of the first row on.

    step < window slides, step > window samples with gaps.  Windows without rows do not appear."""
    step = step_s or window_s
    if window_s <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    micros = F.unix_micros(time)
    w, s = window_s * 1_000_000, step * 1_000_000
    last = F.floor(micros / s).cast("long")
    if step >= window_s:
        return obs.withColumn("window_start", F.timestamp_micros(last * s)).where(micros - last * s < w)
    first = F.floor((micros - w) / s).cast("long") + 1
    # one row: the window that begins last before the first report
    begin = obs.agg(F.floor(F.min(micros) / s).cast("long").alias("_begin"))
    spread = obs.withColumn("_k", F.explode(F.sequence(first, last))).join(F.broadcast(begin))
    return spread.where("_k >= _begin").withColumn("window_start", F.timestamp_micros(F.col("_k") * s)).drop("_k", "_begin")


def dedup_key(scope: Column, start: Column, *, entities: str = "entity_ids") -> Column:
    """Detections with equal keys are one finding: of an event by its start, of an entity whatever its start."""
    known = F.when(scope == "event", F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(scope == "entity", F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("unknown scope "), F.coalesce(scope, F.lit("null")))).cast("string"))
    return F.to_json(F.array(F.struct("detector_id", "detector_version", "detection_type", F.array_sort(entities).alias("entities"), known.alias("start"))), {"ignoreNullFields": "false"})


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    kept = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(F.col(key).alias("_key")).agg(kept).select("_row.*")
