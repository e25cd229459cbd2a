"""Restricted airspace: which reports are inside an active volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.config import Airspace
from aerolith.functions import geo, schedule, scoring
from aerolith.functions import values as v
from aerolith.functions.tables import EXIT_DEPTH, NIC_RADIUS_M, SEVERITY_RANK, lookup

#: degrees of the grid on which zones and reports meet
CELL = 0.25
#: cells of zones, of some 100 bytes, and edges of zones, of 32 bytes, that are broadcast
BROADCAST_TILES = 200_000
BROADCAST_EDGES = 500_000

# fixed values
EMERGENCY = ["7500", "7600", "7700"]
NOT_DISCRETE = ["0000", "1200"]


def prepared(zones: DataFrame, cfg: Airspace) -> DataFrame:
    """Zones of the configured types (None: all, empty: none) with their edges, bounds and centre, computed once."""
    if cfg.include_types is not None:
        zones = zones.where(F.col("zone_type").isin(list(cfg.include_types)) if cfg.include_types else F.lit(False))
    corners = F.flatten("rings")
    df = zones.withColumns({"edges": geo.edges(F.col("rings")), "_x": F.transform(corners, lambda p: F.get(p, F.lit(0))), "_y": F.transform(corners, lambda p: F.get(p, F.lit(1)))})
    df = df.withColumns({"west": F.array_min("_x"), "east": F.array_max("_x"), "south": F.array_min("_y"), "north": F.array_max("_y")}).drop("_x", "_y")
    return df.withColumns({"centre_lat": (F.col("south") + F.col("north")) / 2, "centre_lon": (F.col("west") + F.col("east")) / 2})


def uncertainty_nm(cfg: Airspace) -> Column:
    return F.coalesce(lookup(F.col("nic"), NIC_RADIUS_M), F.lit(cfg.default_uncertainty_m)) / geo.M_PER_NM


def candidates(states: DataFrame, zones: DataFrame, cfg: Airspace) -> DataFrame:
    """Left join of reports and zones whose bounds, widened by the position's uncertainty, hold the report.

    Each zone is keyed by the grid cells that its bounds touch when widened by the largest uncertainty there is, so a report
    has one cell and meets each zone at most once.  What is keyed by cell is the zone's id and bounds; its geometry is joined by id to
    the reports that are near.  Either table is broadcast when it is small (counted, in one job), and shuffled when not."""
    widest = max(cfg.default_uncertainty_m, *NIC_RADIUS_M.values()) / geo.M_PER_NM / 60
    stretch = F.greatest(F.cos(F.radians(F.greatest(F.abs("south"), F.abs("north")) + widest)), F.lit(0.01))

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(geo.cell(low, CELL), geo.cell(high, CELL))

    bounds = zones.select("zone_id", "south", "north", "west", "east", cells(F.col("south") - widest, F.col("north") + widest).alias("_rows"), cells(F.col("west") - widest / stretch, F.col("east") + widest / stretch).alias("_columns"), F.size("edges").alias("_edges"))
    n_tiles, n_edges = bounds.agg(F.coalesce(F.sum(F.size("_rows") * F.size("_columns")), F.lit(0)), F.coalesce(F.sum("_edges"), F.lit(0))).first()
    tiles = bounds.select(F.struct("zone_id", "south", "north", "west", "east").alias("_z"), F.explode("_rows").alias("_cy"), "_columns").select("_z", "_cy", F.explode("_columns").alias("_cx"))
    shapes = zones.select(F.col("zone_id").alias("_zone_id"), F.struct(*zones.columns).alias("zone"))
    tiles = F.broadcast(tiles) if n_tiles <= BROADCAST_TILES else tiles
    shapes = F.broadcast(shapes) if n_edges <= BROADCAST_EDGES else shapes
    df = states.withColumns({"uncertainty_nm": uncertainty_nm(cfg), "_s": F.monotonically_increasing_id(), "_y": geo.cell(F.col("lat"), CELL), "_x": geo.cell(F.col("lon"), CELL)})
    dy = F.col("uncertainty_nm") / 60
    dx = dy / F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    z = F.col("_z")
    near = F.col("lat").between(z["south"] - dy, z["north"] + dy) & F.col("lon").between(z["west"] - dx, z["east"] + dx)
    found = df.join(tiles, (F.col("_y") == F.col("_cy")) & (F.col("_x") == F.col("_cx")) & near, "left").drop("_y", "_x", "_cy", "_cx")
    return found.join(shapes, F.col("_z.zone_id") == F.col("_zone_id"), "left").drop("_z", "_zone_id")


def horizontal(df: DataFrame) -> DataFrame:
    """Adds inside, boundary_nm, horizontal (inside, on the boundary, or within the uncertainty) and depth_nm."""
    inside, d = geo.contains(F.col("zone.edges"), F.col("lat"), F.col("lon")), geo.boundary_nm(F.col("zone.edges"), F.col("lat"), F.col("lon"))
    df = df.withColumns({"boundary_nm": d, "inside": inside | (d == 0)})
    return df.withColumns({"horizontal": F.col("inside") | (F.col("boundary_nm") <= F.col("uncertainty_nm")), "depth_nm": F.when(F.col("inside"), F.col("boundary_nm")).otherwise(0.0)})


def _preferred(datum: Column) -> tuple[Column, Column]:
    """Altitude for a limit, and whether it is of the preferred source: barometric for flight levels, else geometric."""
    baro, geom = F.col("alt_baro_ft"), F.col("alt_geom_ft")
    level = datum == "FL"
    return F.when(level, F.coalesce(baro, geom)).otherwise(F.coalesce(geom, baro)), F.when(level, baro.isNotNull()).otherwise(geom.isNotNull())


def vertical(df: DataFrame, cfg: Airspace, terrain: Column | None = None) -> DataFrame:
    """Adds vertical (within, vertical_clear or bad_input), altitude_ft and preferred_source.

    A floor above ground needs the terrain; without it the floor lies between the lowest and the highest ground, and a
    report is judged only where both agree.  Limits are included."""
    z = F.col("zone")
    any_alt = F.coalesce(F.col("alt_geom_ft"), F.col("alt_baro_ft"))
    ground = geo.bilinear(terrain, F.col("lat"), F.col("lon")) if terrain is not None else F.lit(None).cast("double")
    low, _ = _preferred(z["floor_datum"])
    high, _ = _preferred(z["ceiling_datum"])
    above, below = high > z["ceiling_ft"], F.lit("vertical_clear")
    agl = z["floor_datum"] == "AGL"
    if cfg.off_grid_terrain_ft is None:
        unplaced = F.when(above, below).otherwise("bad_input")
    else:
        least, most = cfg.off_grid_terrain_ft
        unplaced = F.when(above, below).when(any_alt - least < z["floor_ft"], below).when(any_alt - most < z["floor_ft"], "bad_input").otherwise("within")
    floor = F.when(agl, any_alt - ground).otherwise(low)
    state = (
        F.when(any_alt.isNull() | (z["ceiling_datum"] == "AGL"), "bad_input")
        .when(agl & ground.isNull(), unplaced)
        .when(floor < z["floor_ft"], below)
        .when(above, below)
        .otherwise("within")
    )
    levels = (z["floor_datum"] == "FL") & (z["ceiling_datum"] == "FL")
    return df.withColumns({"vertical": state, "altitude_ft": F.when(levels, high).otherwise(any_alt), "preferred_source": F.when(levels, F.col("alt_baro_ft").isNotNull()).otherwise(F.col("alt_geom_ft").isNotNull())})


def signals(cfg: Airspace) -> Column:
    """Names of the context signals of a report; each lowers the score."""
    code, sign, address = v.squawk(F.col("squawk")), F.upper(F.trim("callsign")), v.parsed_address(F.col("icao24"))
    emergency = code.isin(EMERGENCY)
    medical, military = F.lit(False), F.lit(False)
    for p in cfg.lifeguard_prefixes:
        medical = medical | sign.startswith(p)
    for lo, hi in cfg.military_ranges:
        military = military | address.between(int(lo, 16), int(hi, 16))
    named = [("emergency_squawk", emergency), ("atc_discrete_squawk", code.isNotNull() & ~code.isin(EMERGENCY + NOT_DISCRETE)), ("lifeguard_callsign", medical), ("military_hex", military)]
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull())


def weight(names: Column, cfg: Airspace) -> Column:
    return F.aggregate(names, F.lit(0.0), lambda s, x: s + F.coalesce(lookup(x, cfg.context_weights), F.lit(0.0)))


def evaluated(states: DataFrame, zones: DataFrame, cfg: Airspace, terrain: Column | None = None) -> DataFrame:
    """Every report with each candidate zone (or none) and how far it got: ``reason`` is detection or why not."""
    df = vertical(horizontal(candidates(states, prepared(zones, cfg), cfg)), cfg, terrain)
    df = df.withColumn("activation", schedule.activation(F.col("zone"), F.col("timestamp"), F.col("zone.centre_lat"), F.col("zone.centre_lon")))
    reason = (
        F.when(F.col("on_ground") & F.lit(cfg.drop_on_ground), "on_ground")
        .when(F.col("zone").isNull(), "no_candidate")
        .when(~F.col("horizontal"), "horizontal_clear")
        .when(F.col("vertical") != "within", F.col("vertical"))
        .when(F.col("activation") == "INACTIVE", "zone_inactive")
        .otherwise("detection")
    )
    # filters on the reason stay above (see ``only``): pushed down they would work out geometry and schedules once more for each mention
    return df.withColumns({"reason": reason, "_fence": F.monotonically_increasing_id()})


def only(rows: DataFrame, reason: str) -> DataFrame:
    """Evaluated reports of one reason."""
    return rows.where((F.col("reason") == reason) & (F.col("_fence") >= 0))


def hits(rows: DataFrame, cfg: Airspace) -> DataFrame:
    """Scored detections of single reports."""
    df = only(rows, "detection").withColumns({"zone_id": F.col("zone.zone_id"), "zone_type": F.col("zone.zone_type"), "signals": signals(cfg)})
    df = df.withColumns(
        {
            "score": scoring.incursion_score(F.col("zone_type"), F.col("depth_nm"), weight(F.col("signals"), cfg), cfg),
            "confidence": scoring.incursion_confidence(F.col("activation"), F.col("inside"), F.col("depth_nm"), F.col("uncertainty_nm"), F.col("preferred_source"), cfg),
            "severity": scoring.incursion_severity(F.col("activation"), F.col("inside"), F.col("zone_type"), cfg),
        }
    )
    return df.withColumn("severity_rank", lookup(F.col("severity"), SEVERITY_RANK))


def exit_reasons(rows: DataFrame) -> DataFrame:
    """How many reports got how far; a report counts by the deepest stage that any zone reached."""
    deepest = rows.groupBy("_s").agg(F.max_by("reason", lookup(F.col("reason"), EXIT_DEPTH)).alias("reason"))
    return deepest.groupBy("reason").agg(F.count("*").alias("reports"))
