"""Findings in the common shape: who, what, when, where, how sure and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions.tables import GATE_TYPE, lookup
from aerolith.operators.observations import dedup_key
from aerolith.schema import DETECTION

#: rules about an aircraft as such, not about one moment
ENTITY_GATES = ("coexistence_v1", "pingpong_v1", "identity_drift_v1")


def assembled(df: DataFrame, *extra: str, **columns: Column) -> DataFrame:
    """Rows of DETECTION; columns not given are null.  Of rows made window by window, ``window_start`` stays, as do ``extra`` columns."""
    window = ["window_start"] if "window_start" in df.columns else []
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DETECTION.fields), *window, *extra)


def _evidence(kind: Column, text: Column, measured: Column, threshold: Column, unit: Column) -> Column:
    return F.array(F.struct(kind.alias("kind"), text.alias("description"), measured.cast("double").alias("measured"), threshold.cast("double").alias("threshold"), unit.cast("string").alias("unit")))


def _number(c: Column, places: int) -> Column:
    """With thousands separated, halves to even."""
    return F.format_number(c, places)


def _facts(*sentences: Column) -> Column:
    """Sentences that only state what the evidence holds; those without their numbers are left out."""
    return F.concat_ws(" ", *sentences)


def spoofing(scored: DataFrame, version: str = "1") -> DataFrame:
    """Scored episodes, abstentions left out."""
    facts = F.when(F.col("measured").isNull(), F.concat(F.col("gate"), F.lit(": unmeasured"))).otherwise(F.format_string("%s: measured %.1f, threshold %.1f", F.col("gate"), F.col("measured"), F.col("threshold")))
    weak = F.filter(F.array(F.when(F.col("n_reports") < 3, "fewer than three reports"), F.when(F.col("quality") < 1, "stated position quality is below best"), F.when(F.col("measured").isNull(), "not measured")), lambda x: x.isNotNull())
    unit = F.coalesce(F.concat(F.lit(" "), "unit"), F.lit(""))
    compared = F.concat(F.lit("Measured "), _number(F.col("measured"), 1), unit, F.lit(", limit "), _number(F.col("threshold"), 1), unit, F.lit("."))
    seen = F.concat(F.lit("Seen on "), "icao24", F.lit(" for "), _number(F.col("duration_s"), 0), F.lit(" s."))
    return assembled(
        scored.where("not abstains"),
        detector_id=F.lit("spoofing"), detector_version=F.lit(version), detection_type=lookup(F.col("gate"), GATE_TYPE), scope=F.when(F.col("gate").isin(list(ENTITY_GATES)), "entity").otherwise("event"),
        entity_ids=F.array(F.concat(F.lit("aircraft:"), "icao24")), severity=F.col("severity"), score=F.col("score"), confidence=F.col("confidence"), start_at=F.col("start_at"), end_at=F.col("end_at"),
        evidence=_evidence(F.col("gate"), facts, F.col("measured"), F.col("threshold"), F.col("unit")), limitations=weak, tags=F.array(F.col("gate")),
        metadata=F.create_map(F.lit("gate"), F.col("gate"), F.lit("hits"), F.col("hits").cast("string"), F.lit("facts"), _facts(compared, seen)),
    )


def altitude(rows: DataFrame, version: str = "1") -> DataFrame:
    """rows: observations with reason, excess, confidence, severity."""
    return assembled(
        rows, detector_id=F.lit("example_altitude"), detector_version=F.lit(version), detection_type=F.lit("altitude_out_of_band"), scope=F.lit("event"), entity_ids=F.array(F.concat(F.lit("aircraft:"), "icao24")), severity=F.col("severity"),
        score=F.col("confidence"), confidence=F.col("confidence"), start_at=F.col("observed_at"), end_at=F.col("observed_at"), latitude=F.col("latitude"), longitude=F.col("longitude"),
        evidence=_evidence(F.col("reason"), F.format_string("%s by %.0f ft", F.col("reason"), F.col("excess")), F.col("altitude_ft"), F.lit(None), F.lit("ft")), tags=F.array(F.col("reason")),
    )


def proximity(slots: DataFrame, version: str = "1", extra: tuple[str, ...] = ()) -> DataFrame:
    facts = F.format_string("predicted to pass within %.2f nm and %.0f ft in %.0f s", F.col("pred_nm"), F.col("pred_ft"), F.col("t_cpa_s"))
    now = F.concat(F.lit("Now "), _number(F.col("now_nm"), 2), F.lit(" nm apart."))
    then = F.concat(F.lit("At constant speed and track in "), _number(F.col("t_cpa_s"), 0), F.lit(" s "), _number(F.col("pred_nm"), 2), F.lit(" nm and "), _number(F.col("pred_ft"), 0), F.lit(" ft."))
    pair = F.array(F.concat(F.lit("icao24:"), "icao24_a"), F.concat(F.lit("icao24:"), "icao24_b"))
    return assembled(
        slots, *extra, detector_id=F.lit("proximity"), detector_version=F.lit(version), detection_type=F.lit("predicted_proximity"), scope=F.lit("event"), entity_ids=pair, severity=F.col("severity"), score=F.col("score"), confidence=F.col("confidence"),
        start_at=F.col("start_at"), end_at=F.col("end_at"), latitude=F.col("latitude"), longitude=F.col("longitude"), evidence=_evidence(F.lit("cpa"), facts, F.col("pred_nm"), F.lit(None), F.lit("nm")), tags=F.array(F.lit("cpa")),
        metadata=F.create_map(F.lit("now_nm"), F.format_string("%.3f", F.col("now_nm")), F.lit("slot"), F.col("slot").cast("string"), F.lit("facts"), _facts(now, then)),
    )


def airspace(episodes: DataFrame, version: str = "1", extra: tuple[str, ...] = ()) -> DataFrame:
    """The zone is a second entity, so that zones that overlap give findings of their own."""
    r = F.col("representative")
    unsure = F.col("limitations") if "limitations" in episodes.columns else F.filter(F.array(F.when(F.array_contains("activations", "UNKNOWN"), "activation is not known")), lambda x: x.isNotNull())
    stay = F.concat(F.lit("In "), "zone_id", F.lit(" for "), _number((F.unix_micros("end_at") - F.unix_micros("start_at")) / 1e6, 0), F.lit(" s and "), _number(F.col("hits"), 0), F.lit(" reports, peak score "), _number(F.col("peak.score"), 3), F.lit("."))
    later = F.create_map(F.lit("zone_id"), F.col("zone_id"), F.lit("hits"), F.col("hits").cast("string"), F.lit("facts"), _facts(stay))
    if "facts" in episodes.columns:
        seconds = lambda x: ((F.unix_micros(x["at"]) - F.unix_micros("start_at")) / 1e6).cast("long").cast("string")
        later = F.map_concat(later, F.map_from_entries(F.transform("facts", lambda x: F.struct(F.concat(F.lit("first_seen_s:"), x["what"]), seconds(x)))))
    return assembled(
        episodes, *extra, detector_id=F.lit("no_fly_zone"), detector_version=F.lit(version), detection_type=F.lit("restricted_airspace_incursion"), scope=F.lit("event"), entity_ids=F.array(F.concat(F.lit("icao24:"), "icao24"), F.concat(F.lit("zone:"), "zone_id")),
        severity=r["severity"], score=r["score"], confidence=F.col("confidence"), start_at=F.col("start_at"), end_at=F.col("end_at"), latitude=r["lat"], longitude=r["lon"],
        evidence=_evidence(F.lit("incursion"), F.format_string("%d reports inside, peak score %.2f", F.col("hits"), F.col("peak.score")), F.col("peak.score"), F.lit(None), F.lit(None)), limitations=unsure, tags=F.array(F.col("zone_id")),
        metadata=later,
    )


def keyed(detections: DataFrame) -> DataFrame:
    return detections.withColumn("dedup_key", dedup_key(F.col("scope"), F.col("start_at")))
