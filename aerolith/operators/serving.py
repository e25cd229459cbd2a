"""Read queries: newest positions, tracks, findings, and matching of findings to raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import values as v


def check_box(south: float | None, north: float | None, west: float | None, east: float | None) -> bool:
    """Whether there is a box; part of one, or one inside out, is an error."""
    given = [x is not None for x in (south, north, west, east)]
    if any(given) and not all(given):
        raise ValueError("a box needs all four sides")
    if all(given) and (south > north or west > east):
        raise ValueError("the box is inside out")
    return all(given)


def callsign_of(payload: str = "payload") -> Column:
    """Of either payload shape."""
    return F.coalesce(v.text(F.get_json_object(payload, "$.callsign")), v.text(F.get_json_object(payload, "$.payload.flight")))


def latest_positions(rows: DataFrame, now: Column, *, hex: str | None = None, callsign: str | None = None, box: tuple[float | None, ...] = (None,) * 4, limit: int | None = None) -> DataFrame:
    """The newest row of each entity; the filters apply to it, not to older ones."""
    newest = rows.groupBy("entity_id").agg(F.max_by(F.struct(*rows.columns), F.struct("observed_at", "raw_record_ref")).alias("r")).select("r.*")
    df = newest.withColumns({"icao24": F.substr("entity_id", F.lit(8)), "callsign": callsign_of(), "position_age_hours": (F.unix_micros(now) - F.unix_micros("observed_at")) / 3.6e9})
    if hex:
        df = df.where(F.col("icao24") == hex.strip().lower())
    if callsign:
        df = df.where(F.col("callsign").ilike(f"%{callsign}%"))
    if check_box(*box):
        south, north, west, east = box
        df = df.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return df.orderBy(F.desc("observed_at"), "entity_id").limit(limit) if limit else df


def track_lines(rows: DataFrame, *, limit: int = 5000) -> DataFrame:
    """Per entity its newest ``limit`` points in time order, as coordinates and times."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("observed_at"), F.desc("raw_record_ref"))
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    points = F.array_sort(F.collect_list(F.struct("observed_at", "raw_record_ref", "longitude", "latitude", "sog", "cog")))
    return kept.groupBy("entity_id").agg(points.alias("p")).select("entity_id", F.transform("p", lambda x: F.array(x["longitude"], x["latitude"])).alias("coordinates"), F.transform("p", lambda x: x["observed_at"]).alias("times"), F.size("p").alias("points"))


def findings(table: DataFrame, *, severity: str | None = None, entity: str | None = None, since: Column | None = None, limit: int = 100) -> DataFrame:
    """The newest findings that fit."""
    if severity:
        table = table.where(F.col("severity") == severity.upper())
    if entity:
        table = table.where(F.col("entity_id") == entity)
    if since is not None:
        table = table.where(F.col("start_at") >= since)
    return table.orderBy(F.desc("start_at"), "entity_id", "gate").limit(limit)


def latest_runs(runs: DataFrame, *, detector: str | None = None, limit: int = 50) -> DataFrame:
    """The newest runs, of one detector or of all."""
    if not 1 <= limit <= 500:
        raise ValueError(f"limit {limit}")
    rows = runs.where(F.col("detector_id") == detector) if detector else runs
    return rows.orderBy(F.desc("started_at"), "run_id").limit(limit)


def matched_rows(obs: DataFrame, raw: DataFrame) -> DataFrame:
    """Each observation with the raw row of its address and time; a raw row has two times (at, at_2) that may differ.  A row of
    the same altitude (within half a foot) is preferred, then the first line."""
    times = raw.withColumn("_at", F.explode(F.array_distinct(F.filter(F.array("at", "at_2"), lambda t: t.isNotNull())))).select(F.col("icao24").alias("_i"), "_at", F.struct("line", "ab", "ag").alias("r"))
    near = lambda c: F.coalesce(F.abs(F.col("altitude_ft") - F.col(f"r.{c}")) <= 0.5, F.lit(False))
    df = obs.join(times, (F.col("icao24") == F.col("_i")) & (F.col("observed_at") == F.col("_at")), "left").drop("_i", "_at")
    df = df.withColumn("source", F.when(F.col("r").isNull(), "unmatched").when(near("ab"), "baro").when(near("ag"), "geom").otherwise("other"))
    best = F.min_by(F.struct(*obs.columns, "r", "source"), F.struct(F.when(F.col("source").isin("baro", "geom"), 0).otherwise(1).alias("m"), F.col("r.line").alias("l")))
    return df.groupBy(F.col("icao24").alias("_i"), F.col("observed_at").alias("_t"), F.col("seq").alias("_q")).agg(best.alias("x")).select("x.*")
