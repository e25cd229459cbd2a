"""Episodes: runs of rule hits merged into one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.config import Airspace, Spoofing
from aerolith.functions import geo

# fixed values: names of the context signals
SIGNALS = ("emergency_squawk", "atc_discrete_squawk", "lifeguard_callsign", "military_hex")


def consolidate(events: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Events of one rule, aircraft and segment whose gaps are at most ``episode_gap_s``: the most extreme one, with the
    bounds widened, the number of hits and the duration.  Extremity is the measure over the threshold, the first of equals."""
    keys = [*by, "gate", "icao24", "segment_id"]
    w = Window.partitionBy(*keys).orderBy("start_at", "end_at")
    reached = F.max("end_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = geo.elapsed(reached, F.col("start_at"))
    extremity = F.coalesce(F.abs("measured") / F.nullif(F.abs("threshold"), F.lit(0.0)), F.lit(0.0))
    runs = events.withColumn("_new", F.when(apart > cfg.episode_gap_s, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_x", extremity)
    kept = [c for c in events.columns if c not in {*keys, "start_at", "end_at"}]
    best = F.max_by(F.struct(*kept), F.struct("_x", (-F.unix_micros("start_at")).alias("a"), (-F.unix_micros("end_at")).alias("b")))
    out = runs.groupBy(*keys, "_run").agg(best.alias("_b"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.count("*").alias("hits"))
    return out.select(*keys, "start_at", "end_at", "_b.*", "hits", (geo.elapsed(F.col("start_at"), F.col("end_at"))).alias("duration_s"))


def report_numbers(reports: DataFrame, cfg: Airspace) -> DataFrame:
    """Adds each aircraft's report number ``rn`` and gap group ``gid``."""
    w = Window.partitionBy("icao24").orderBy("timestamp", "seq")
    gap = geo.elapsed(F.lag("timestamp").over(w), F.col("timestamp"))
    return reports.withColumns({"rn": F.row_number().over(w), "_new": F.when(gap > cfg.max_gap_s, 1).otherwise(0)}).withColumn("gid", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def incursions(hits: DataFrame, cfg: Airspace) -> DataFrame:
    """Episodes of hits (icao24, zone_id, timestamp, rn, gid, score, confidence, severity_rank, ...).

    An episode ends with a gap, or when ``clear_observations_to_close`` reports in a row do not hit the zone.  Its confidence
    is the best that an uninterrupted run of hits has reached, growing with the run's duration."""
    w = Window.partitionBy("icao24", "zone_id").orderBy("rn")
    step = F.col("rn") - F.lag("rn").over(w)
    moved = F.coalesce(F.lag("gid").over(w) != F.col("gid"), F.lit(True))
    df = hits.withColumns({"_e": F.when(moved | (step > cfg.clear_observations_to_close), 1).otherwise(0), "_r": F.when(moved | (step > 1), 1).otherwise(0)})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"episode": F.sum("_e").over(upto), "run": F.sum("_r").over(upto)})
    in_run = Window.partitionBy("icao24", "zone_id", "run").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    lasted = geo.elapsed(F.first("timestamp").over(in_run), F.col("timestamp"))
    low = cfg.persistence_min_factor
    ramp = F.least(lasted / cfg.persistence_saturation_s, F.lit(1.0)) * (1 - low) + low
    df = df.withColumn("_c", F.max("confidence").over(in_run) * ramp)
    peak = F.struct("score", (-F.col("rn")).alias("o"))
    whole = F.struct("severity_rank", "score", (-F.col("rn")).alias("o"))
    told = [c for c in ("signals",) if c in hits.columns]
    row = F.struct("timestamp", "lat", "lon", "score", "severity", "altitude_ft", "activation", *told)
    more = _first_times() if {"signals", "inside", "preferred_source"} <= set(hits.columns) else []
    if "zone_type" in hits.columns:  # one for each zone
        more = [F.max("zone_type").alias("zone_type"), *more]
    found = df.groupBy("icao24", "zone_id", "episode").agg(
        *more,
        F.min("timestamp").alias("start_at"),
        F.max("timestamp").alias("end_at"),
        F.count("*").alias("hits"),
        F.max("_c").alias("confidence"),
        F.max_by(row, peak).alias("peak"),
        F.max_by(row, whole).alias("representative"),
        F.array_sort(F.collect_set("activation")).alias("activations"),
    )
    return _told(found) if "_limit_0" in found.columns else found


def _limitations() -> dict[str, Column]:
    """What makes a finding weaker, by what hits say."""
    return {"activation is not known": F.col("activation") != "ACTIVE", "position is within its uncertainty only": ~F.col("inside"), "altitude is of the other source": ~F.col("preferred_source")}


def _first_times() -> list[Column]:
    """When each signal, and each limitation, was first there: a column for each, so nothing is gathered."""
    signals = [F.min(F.when(F.array_contains("signals", s), F.col("timestamp"))).alias(f"_signal_{k}") for k, s in enumerate(SIGNALS)]
    return signals + [F.min(F.when(c, F.col("timestamp"))).alias(f"_limit_{k}") for k, c in enumerate(_limitations().values())]


def _told(found: DataFrame) -> DataFrame:
    """Adds ``facts``, signals that the representative report does not show with the time of the first, and ``limitations`` in the
    order in which they first held."""

    def listed(names, prefix: str) -> Column:
        given = F.array(*(F.when(F.col(f"{prefix}{k}").isNotNull(), F.struct(F.col(f"{prefix}{k}").alias("at"), F.lit(n).alias("what"))) for k, n in enumerate(names)))
        return F.array_sort(F.filter(given, lambda x: x.isNotNull()))

    facts = F.filter(listed(SIGNALS, "_signal_"), lambda x: ~F.array_contains("representative.signals", x["what"]))
    out = found.withColumns({"facts": facts, "limitations": F.transform(listed(_limitations(), "_limit_"), lambda x: x["what"])})
    return out.drop(*(f"_signal_{k}" for k in range(len(SIGNALS))), *(f"_limit_{k}" for k in range(len(_limitations()))))


def first_seen(hits: DataFrame, *by: str, facts: str = "signals") -> DataFrame:
    """When each fact was first stated."""
    return hits.select(*by, "timestamp", F.explode(facts).alias("fact")).groupBy(*by, "fact").agg(F.min("timestamp").alias("first_at"), F.count("*").alias("times"))
