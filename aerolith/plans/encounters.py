"""Queries on close passes and restricted airspace, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geo, schedule
from aerolith.functions.tables import EXIT_DEPTH, NACP_RADIUS_NM, NIC_RADIUS_M, SEVERITY_RANK
from aerolith.operators import airspace, episodes, observations, proximity, reports, tracks
from aerolith.plans import base
from aerolith.plans.base import AIRSPACE, PROXIMITY
from aerolith.plans.tracking import OBS, case, hav, pmod, r3, us
from aerolith.schema import RECURRING

P, A = PROXIMITY, AIRSPACE
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- resampling and pairs

_STEP = int(P.grid_step_s * 1e6)
_LERPED = ("latitude", "longitude", "altitude_ft", "ground_speed_kt", "vertical_rate_fpm")
_F = "(CASE WHEN b > a THEN (tick * {0} - a) / (b - a)::DOUBLE ELSE 0 END)".format(_STEP)


def _blend(c: str) -> str:
    if c == "track_deg":
        d = f"({pmod('n.track_deg - track_deg + 180.0::DOUBLE', '360.0::DOUBLE')} - 180.0::DOUBLE)"
        x = pmod(f"track_deg + {d} * f", "360.0::DOUBLE")
    else:
        x = f"{c} + (n.{c} - {c}) * f"
    return f"CASE WHEN f = 0 THEN {c} WHEN f = 1 THEN n.{c} ELSE {x} END AS {c}"


_ALL = (*_LERPED, "track_deg", "nic", "nacp", "on_ground")
GRID = f"""{OBS},
led AS (SELECT *, us AS a, lead(us) OVER w AS b, lead(struct_pack({", ".join(f"{c} := {c}" for c in _ALL)})) OVER w AS n FROM obs WINDOW w AS (PARTITION BY icao24 ORDER BY observed_at, seq)),
spans AS (SELECT *, b > a AND b - a <= {int(P.max_gap_s * 1e6)} AS ok FROM led WHERE b IS NOT NULL),
ticks AS (SELECT *, unnest(CASE WHEN ok THEN range(CAST(ceil(a / {_STEP}::DOUBLE) AS BIGINT), CAST(floor(b / {_STEP}::DOUBLE) AS BIGINT) + 1) ELSE list_distinct(list_filter([CASE WHEN a % {_STEP} = 0 THEN a // {_STEP} END, CASE WHEN b % {_STEP} = 0 THEN b // {_STEP} END], lambda t: t IS NOT NULL)) END) AS tick FROM spans),
fr AS (SELECT *, {_F} AS f FROM ticks),
grid AS (SELECT icao24, tick, a, seq, {", ".join(_blend(c) for c in (*_LERPED, "track_deg"))}, CASE WHEN f = 1 THEN n.nic ELSE nic END AS nic, CASE WHEN f = 1 THEN n.nacp ELSE nacp END AS nacp, CASE WHEN f = 1 THEN n.on_ground ELSE on_ground END AS on_ground FROM fr QUALIFY row_number() OVER (PARTITION BY icao24, tick ORDER BY a, seq) = 1)"""
_C = f"{P.cell_size_deg}::DOUBLE"
PAIRED = f"""{GRID},
fly AS (SELECT *, floor(latitude / {_C}) AS cy, floor(longitude / {_C}) AS cx FROM grid WHERE altitude_ft IS NOT NULL AND ground_speed_kt IS NOT NULL AND NOT (altitude_ft < {P.ground_altitude_ft} AND ground_speed_kt < {P.ground_speed_kt}) AND NOT coalesce(on_ground, false) AND track_deg IS NOT NULL),
around AS (SELECT fly.*, cy + dy AS ny, cx + dx AS nx FROM fly, (VALUES (-1), (0), (1)) y(dy), (VALUES (-1), (0), (1)) x(dx)),
pr AS (SELECT l.tick, l AS a, r AS b FROM around l JOIN fly r ON l.tick = r.tick AND l.ny = r.cy AND l.nx = r.cx AND l.icao24 < r.icao24 AND abs(l.altitude_ft - r.altitude_ft) <= {P.max_vertical_prefilter_ft})"""
_K = geo.MPS_PER_KT
_E = "6371000.0::DOUBLE"
CPA = f"""{PAIRED},
g0 AS (SELECT *, radians(b.longitude - a.longitude) * cos(radians(a.latitude)) * {_E} AS rx, radians(b.latitude - a.latitude) * {_E} AS ry,
  b.ground_speed_kt * {_K} * sin(radians(b.track_deg)) - a.ground_speed_kt * {_K} * sin(radians(a.track_deg)) AS vx, b.ground_speed_kt * {_K} * cos(radians(b.track_deg)) - a.ground_speed_kt * {_K} * cos(radians(a.track_deg)) AS vy,
  b.altitude_ft - a.altitude_ft AS dz, coalesce(b.vertical_rate_fpm, 0) - coalesce(a.vertical_rate_fpm, 0) AS rate, {hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} / 1852.0 AS now_nm FROM pr),
g1 AS (SELECT *, CASE WHEN vx * vx + vy * vy >= 1e-18 THEN -(rx * vx + ry * vy) / (vx * vx + vy * vy) WHEN abs(rate) >= 1e-9 THEN -dz / (rate / 60) END AS t_cpa FROM g0),
g2 AS (SELECT *, sqrt(pow(rx + vx * t_cpa, 2) + pow(ry + vy * t_cpa, 2)) / 1852.0 AS pred_nm, abs(dz + rate * t_cpa / 60) AS pred_ft FROM g1)"""
_TIERS = "CASE " + " ".join(f"WHEN pred_nm < {t.max_horizontal_nm} AND pred_ft < {t.max_vertical_ft} THEN '{t.severity}'" for t in P.tiers) + " END"
FLAGS = f"""{CPA},
fl AS (SELECT *, {_TIERS} AS severity FROM g2 WHERE t_cpa > 0 AND t_cpa <= {P.max_tcpa_s} AND now_nm <= {P.max_current_separation_nm} AND a.altitude_ft >= {P.min_altitude_ft} AND b.altitude_ft >= {P.min_altitude_ft}),
flags AS (SELECT * FROM fl WHERE severity IS NOT NULL)"""


def _radius(c: str) -> str:
    return f"coalesce({case(c, NACP_RADIUS_NM)}, 0.3)::DOUBLE"


_TIGHT, _WIDE_H, _WIDE_V = min(t.max_horizontal_nm for t in P.tiers), max(t.max_horizontal_nm for t in P.tiers), max(t.max_vertical_ft for t in P.tiers)


def _even3(x: str) -> str:
    return f"(round_even(({x}) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE)"


_RAW = _even3(f"1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, t_cpa / {P.max_tcpa_s}::DOUBLE)) * 0.5::DOUBLE")
_QUAL = f"greatest(0.3::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - greatest({_radius('a.nacp')}, {_radius('b.nacp')}) / {_TIGHT}::DOUBLE))"
SLOTS = f"""{FLAGS},
sl AS (SELECT *, floor(tick * {P.grid_step_s}::DOUBLE / {P.alert_cooldown_s}::DOUBLE)::BIGINT AS slot FROM flags QUALIFY row_number() OVER (PARTITION BY a.icao24, b.icao24, floor(tick * {P.grid_step_s}::DOUBLE / {P.alert_cooldown_s}::DOUBLE) ORDER BY pred_nm, tick) = 1),
slots AS (SELECT a.icao24 AS icao24_a, b.icao24 AS icao24_b, slot, tick, severity, pred_nm, pred_ft, t_cpa, {_even3(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - greatest(pred_nm / {_WIDE_H}::DOUBLE, pred_ft / {_WIDE_V}::DOUBLE)))")} AS score, {_even3(f"{_RAW} * {_QUAL}")} AS confidence,
  slot * {int(P.alert_cooldown_s * 1e6)} AS start_us, CAST(greatest(slot * {P.alert_cooldown_s}::DOUBLE, floor(tick * {P.grid_step_s}::DOUBLE + t_cpa + 0.5)) * 1000000 AS BIGINT) AS end_us FROM sl)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.resample(base.obs(spark, sf_dir), P.grid_step_s, P.max_gap_s)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.resample(base.obs(spark, sf_dir), P.grid_step_s, P.max_gap_s, slot=proximity.slot(P))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.flagged(proximity.geometry(proximity.candidate_pairs(_dealt(spark, sf_dir), P, near=True)), P)


@query(f"WITH {GRID} SELECT icao24, tick, {', '.join(f'{r3(c)} AS {c}' for c in (*_LERPED, 'track_deg'))}, CAST(nic AS INTEGER) AS nic, CAST(nacp AS INTEGER) AS nacp, on_ground FROM grid")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("icao24", "tick", *(base.r3(c).alias(c) for c in (*_LERPED, "track_deg")), "nic", "nacp", "on_ground")


@query(f"WITH {PAIRED} SELECT tick, a.icao24 AS icao24_a, b.icao24 AS icao24_b FROM pr")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.candidates(_dealt(spark, sf_dir), P).select("tick", "icao24_a", "icao24_b")


@query(f"WITH {FLAGS} SELECT tick, a.icao24 AS icao24_a, b.icao24 AS icao24_b, {r3('now_nm')} AS now_nm, {r3('t_cpa')} AS t_cpa_s, {r3('pred_nm')} AS pred_nm, {r3('pred_ft')} AS pred_ft, severity FROM flags")
def cpa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = proximity.flags(_dealt(spark, sf_dir), P)
    return f.select("tick", "icao24_a", "icao24_b", *(base.r3(c).alias(c) for c in ("now_nm", "t_cpa_s", "pred_nm", "pred_ft")), "severity")


@query(f"WITH {SLOTS} SELECT icao24_a, icao24_b, slot, tick, severity, {r3('pred_nm')} AS pred_nm, {r3('pred_ft')} AS pred_ft, score, confidence, start_us, end_us FROM slots")
def proximity_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proximity.alerts(_dealt(spark, sf_dir), P)
    return s.select("icao24_a", "icao24_b", "slot", "tick", "severity", base.r3("pred_nm").alias("pred_nm"), base.r3("pred_ft").alias("pred_ft"), "score", "confidence", us("start_at").alias("start_us"), us("end_at").alias("end_us"))


# --- zones

ZONES = """corners(zone_id, i, x, y) AS (VALUES
  ('P-1', 0, -78.9::DOUBLE, 37.2::DOUBLE), ('P-1', 1, -78.7, 37.2), ('P-1', 2, -78.7, 37.4), ('P-1', 3, -78.9, 37.4),
  ('R-2', 0, -78.6, 37.1), ('R-2', 1, -78.3, 37.1), ('R-2', 2, -78.3, 37.5), ('R-2', 3, -78.45, 37.25), ('R-2', 4, -78.6, 37.5),
  ('T-3', 0, -78.9, 37.5), ('T-3', 1, -78.6, 37.5), ('T-3', 2, -78.6, 37.8), ('T-3', 3, -78.9, 37.8),
  ('M-4', 0, -78.5, 37.5), ('M-4', 1, -78.1, 37.5), ('M-4', 2, -78.1, 37.9), ('M-4', 3, -78.5, 37.9),
  ('W-5', 0, -78.3, 37.1), ('W-5', 1, -78.05, 37.1), ('W-5', 2, -78.05, 37.4), ('W-5', 3, -78.3, 37.4)),
zones(zone_id, zone_type, activation, floor_ft, floor_datum, ceiling_ft, ceiling_datum) AS (VALUES ('P-1', 'PROHIBITED', 'ALWAYS', 0.0::DOUBLE, 'SFC', 5000.0::DOUBLE, 'MSL'), ('R-2', 'RESTRICTED', 'ALWAYS', 1000.0, 'MSL', 8000.0, 'MSL'), ('T-3', 'TFR', 'WINDOW', 0.0, 'SFC', 7000.0, 'MSL'), ('M-4', 'MOA', 'SCHEDULED', 2000.0, 'MSL', 6000.0, 'FL'), ('W-5', 'WARNING', 'NOTAM', 500.0, 'AGL', 4000.0, 'MSL')),
bounds AS (SELECT zone_id, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM corners GROUP BY zone_id),
edges AS (SELECT zone_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM corners WINDOW w AS (PARTITION BY zone_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
ZONES = ZONES.replace("(coalesce", "coalesce")
_AX, _AY = "((x1 - lon) * cos(radians(lat)) * 60.0::DOUBLE)", "((y1 - lat) * 60.0::DOUBLE)"
_DX, _DY = "((x2 - x1) * cos(radians(lat)) * 60.0::DOUBLE)", "((y2 - y1) * 60.0::DOUBLE)"
HORIZONTAL = f"""{OBS}, {ZONES},
states AS (SELECT icao24, us, observed_at AS ts, latitude AS lat, longitude AS lon, altitude_ft AS baro, alt_geom_ft AS geom, squawk, callsign, on_ground, seq, coalesce({case("nic", NIC_RADIUS_M)}, {A.default_uncertainty_m})::DOUBLE / 1852.0 AS unc FROM obs WHERE altitude_ft IS NOT NULL OR alt_geom_ft IS NOT NULL),
cand AS (SELECT s.*, b.zone_id FROM states s JOIN bounds b ON lat BETWEEN south - unc / 60 AND north + unc / 60 AND lon BETWEEN west - unc / 60 / greatest(cos(radians(lat)), 0.01) AND east + unc / 60 / greatest(cos(radians(lat)), 0.01)),
seg_d AS (SELECT c.seq, c.zone_id, {_AX} AS ax, {_AY} AS ay, {_AX.replace('x1', 'x2')} - {_AX} AS dx, {_AY.replace('y1', 'y2')} - {_AY} AS dy, (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 AS crosses FROM cand c JOIN edges e USING (zone_id)),
dist AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0))) AS t FROM seg_d),
hz AS (SELECT seq, zone_id, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS boundary_nm, count(*) FILTER (crosses) % 2 = 1 AS odd FROM dist GROUP BY seq, zone_id),
hor AS (SELECT c.*, boundary_nm, odd OR boundary_nm = 0 AS inside, odd OR boundary_nm = 0 OR boundary_nm <= unc AS horizontal, CASE WHEN odd OR boundary_nm = 0 THEN boundary_nm ELSE 0 END AS depth_nm FROM cand c JOIN hz USING (seq, zone_id))"""
_LOW, _HIGH = (f"CASE WHEN z.{d}_datum = 'FL' THEN coalesce(baro, geom) ELSE coalesce(geom, baro) END" for d in ("floor", "ceiling"))
_ANY = "coalesce(geom, baro)"
_LEAST, _MOST = A.off_grid_terrain_ft
VERTICAL = f"""{HORIZONTAL},
ver AS (SELECT hor.*, z.* EXCLUDE (zone_id), CASE WHEN {_ANY} IS NULL OR z.ceiling_datum = 'AGL' THEN 'bad_input'
  WHEN z.floor_datum = 'AGL' THEN CASE WHEN {_HIGH} > z.ceiling_ft THEN 'vertical_clear' WHEN {_ANY} - {_LEAST} < z.floor_ft THEN 'vertical_clear' WHEN {_ANY} - {_MOST} < z.floor_ft THEN 'bad_input' ELSE 'within' END
  WHEN {_LOW} < z.floor_ft THEN 'vertical_clear' WHEN {_HIGH} > z.ceiling_ft THEN 'vertical_clear' ELSE 'within' END AS vertical, {_ANY} AS altitude_ft, geom IS NOT NULL AS preferred FROM hor JOIN zones z USING (zone_id))"""
_STATE = "CASE z WHEN 'P-1' THEN 'ACTIVE' WHEN 'R-2' THEN 'ACTIVE' WHEN 'T-3' THEN CASE WHEN ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' THEN 'ACTIVE' ELSE 'INACTIVE' END WHEN 'M-4' THEN CASE WHEN isodow(ts) <= 5 AND ts::TIME >= TIME '09:00' AND ts::TIME < TIME '17:30' THEN 'ACTIVE' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END"
_ACT = _STATE.replace("CASE z ", "CASE zone_id ")
REPORTS = f"""{VERTICAL},
act AS (SELECT *, {_ACT} AS act FROM ver),
eval AS (SELECT s.*, a.zone_id, a.zone_type, a.inside, a.depth_nm, a.preferred, a.altitude_ft, a.act, a.vertical, CASE WHEN s.on_ground THEN 'on_ground' WHEN a.zone_id IS NULL THEN 'no_candidate' WHEN NOT a.horizontal THEN 'horizontal_clear' WHEN a.vertical <> 'within' THEN a.vertical WHEN a.act = 'INACTIVE' THEN 'zone_inactive' ELSE 'detection' END AS reason FROM states s LEFT JOIN act a ON a.seq = s.seq)"""
_CODE = "lpad(trim(squawk), 4, '0')"
_EMERG = f"{_CODE} IN ('7500', '7600', '7700')"
_DISC = f"(regexp_full_match({_CODE}, '[0-7]{{4}}') AND {_CODE} NOT IN ('7500', '7600', '7700', '0000', '1200'))"
_MIL = "CAST('0x' || icao24 AS BIGINT) BETWEEN 11403264 AND 11534335"
_WEIGHTS = A.context_weights
_CTX = f"(0.0::DOUBLE + CASE WHEN {_EMERG} THEN {_WEIGHTS['emergency_squawk']}::DOUBLE ELSE 0 END + CASE WHEN {_DISC} THEN {_WEIGHTS['atc_discrete_squawk']}::DOUBLE ELSE 0 END + CASE WHEN {_MIL} THEN {_WEIGHTS['military_hex']}::DOUBLE ELSE 0 END)"
_CAP = "least(3, CASE WHEN act <> 'ACTIVE' THEN 1 END, CASE WHEN NOT inside THEN 0 END, CASE WHEN zone_type = 'MOA' THEN 1 END)"
_LOWP = A.strict_position_min_factor
HITS = f"""{REPORTS},
hits AS (SELECT *, {_CTX} AS ctx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {case("zone_type", A.base)}::DOUBLE + least(depth_nm * {A.depth_bump_per_nm}::DOUBLE, {A.depth_bump_max}::DOUBLE) - {_CTX})) AS score,
  CASE WHEN act = 'ACTIVE' THEN 1.0::DOUBLE ELSE {A.unknown_activation_factor}::DOUBLE END * CASE WHEN inside THEN least(depth_nm / unc, 1.0::DOUBLE) * {1 - _LOWP}::DOUBLE + {_LOWP}::DOUBLE ELSE {A.buffered_position_factor}::DOUBLE END * CASE WHEN preferred THEN 1.0::DOUBLE ELSE {A.fallback_altitude_factor}::DOUBLE END AS confidence,
  {_CAP} AS severity_rank FROM eval WHERE reason = 'detection')"""
_G = int(A.max_gap_s * 1e6)
_LO = A.persistence_min_factor
EPISODES = f"""{HITS},
num AS (SELECT seq, row_number() OVER w AS rn, sum(CASE WHEN us - p > {_G} THEN 1 ELSE 0 END) OVER (PARTITION BY icao24 ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS gid FROM (SELECT *, lag(us) OVER (PARTITION BY icao24 ORDER BY ts, seq) AS p FROM states) WINDOW w AS (PARTITION BY icao24 ORDER BY ts, seq)),
h AS (SELECT hits.*, rn, gid, lag(rn) OVER w AS prn, lag(gid) OVER w AS pgid FROM hits JOIN num USING (seq) WINDOW w AS (PARTITION BY icao24, zone_id ORDER BY rn)),
k AS (SELECT *, sum(CASE WHEN pgid IS DISTINCT FROM gid OR rn - prn > {A.clear_observations_to_close} THEN 1 ELSE 0 END) OVER w AS episode, sum(CASE WHEN pgid IS DISTINCT FROM gid OR rn - prn > 1 THEN 1 ELSE 0 END) OVER w AS run FROM h WINDOW w AS (PARTITION BY icao24, zone_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, max(confidence) OVER w * (least((us - first_value(us) OVER w) / 1e6::DOUBLE / {A.persistence_saturation_s}::DOUBLE, 1.0::DOUBLE) * {1 - _LO}::DOUBLE + {_LO}::DOUBLE) AS cc FROM k WINDOW w AS (PARTITION BY icao24, zone_id, run ORDER BY rn ROWS UNBOUNDED PRECEDING)),
ep AS (SELECT icao24, zone_id, episode, min(us) AS start_us, max(us) AS end_us, count(*) AS hits, max(cc) AS confidence, max(score) AS peak_score, first(us ORDER BY score DESC, rn) AS peak_us, max(severity_rank) AS severity_rank FROM c GROUP BY ALL)"""
_NAMES = {v: k for k, v in SEVERITY_RANK.items()}


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.to_states(base.obs(spark, sf_dir))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airspace.evaluated(episodes.report_numbers(_states(spark, sf_dir), A), base.zones(spark), A)


@query(f"WITH {HORIZONTAL} SELECT seq, zone_id, inside, horizontal, {r3('boundary_nm')} AS boundary_nm, {r3('depth_nm')} AS depth_nm FROM hor")
def zone_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = airspace.candidates(_states(spark, sf_dir), airspace.prepared(base.zones(spark), A), A).where("zone is not null")
    return airspace.horizontal(df).select("seq", "zone.zone_id", "inside", "horizontal", base.r3("boundary_nm").alias("boundary_nm"), base.r3("depth_nm").alias("depth_nm"))


@query(f"WITH {HORIZONTAL} SELECT zone_id, count(*) AS reports FROM cand GROUP BY zone_id")
def zone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = airspace.candidates(_states(spark, sf_dir), airspace.prepared(base.zones(spark), A), A).where("zone is not null")
    return df.groupBy(F.col("zone.zone_id").alias("zone_id")).agg(F.count("*").alias("reports"))


@query(f"WITH {VERTICAL} SELECT seq, zone_id, vertical, {r3('altitude_ft')} AS altitude_ft, preferred FROM ver")
def zone_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every zone, also the one whose ceiling is a flight level."""
    df = airspace.candidates(_states(spark, sf_dir), airspace.prepared(base.zones(spark), A), A).where("zone is not null")
    return airspace.vertical(df, A).select("seq", "zone.zone_id", "vertical", base.r3("altitude_ft").alias("altitude_ft"), F.col("preferred_source").alias("preferred"))


@query(f"WITH {OBS}, z(zone_id) AS (VALUES ('P-1'), ('R-2'), ('T-3'), ('M-4'), ('W-5')) SELECT zone_id, {_ACT.replace('ts', 'observed_at')} AS activation, count(*) AS reports FROM obs, z GROUP BY 1, 2")
def zone_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # five zones against all reports: the zones are an array of the row, not a join
    z = airspace.prepared(base.zones(spark), A)
    listed = z.agg(F.collect_list(F.struct(*z.columns)).alias("zs"))
    df = base.obs(spark, sf_dir).join(F.broadcast(listed)).withColumn("zone", F.explode("zs"))
    df = df.withColumn("activation", schedule.activation(F.col("zone"), F.col("observed_at"), F.col("zone.centre_lat"), F.col("zone.centre_lon")))
    return df.groupBy(F.col("zone.zone_id").alias("zone_id"), "activation").agg(F.count("*").alias("reports"))


@query(f"WITH {HITS} SELECT icao24, us, zone_id, act AS activation, inside, {r3('score')} AS score, {r3('confidence')} AS confidence, {case('severity_rank', _NAMES)} AS severity FROM hits")
def nfz_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = airspace.hits(_evaluated(spark, sf_dir), A)
    return h.select("icao24", us("timestamp").alias("us"), "zone_id", "activation", "inside", base.r3("score").alias("score"), base.r3("confidence").alias("confidence"), "severity")


@query(f"WITH {REPORTS}, d AS (SELECT seq, max({case('reason', EXIT_DEPTH)}) AS depth FROM eval GROUP BY seq) SELECT {case('depth', {v: k for k, v in EXIT_DEPTH.items()})} AS reason, count(*) AS reports FROM d GROUP BY 1")
def nfz_exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airspace.exit_reasons(_evaluated(spark, sf_dir))


@query(f"WITH {EPISODES} SELECT icao24, zone_id, start_us, end_us, CAST(hits AS BIGINT) AS hits, {r3('confidence')} AS confidence, {r3('peak_score')} AS peak_score, peak_us, {case('severity_rank', _NAMES)} AS severity FROM ep")
def nfz_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes.incursions(airspace.hits(_evaluated(spark, sf_dir), A), A)
    return e.select("icao24", "zone_id", us("start_at").alias("start_us"), us("end_at").alias("end_us"), "hits", base.r3("confidence").alias("confidence"), base.r3("peak.score").alias("peak_score"), us("peak.timestamp").alias("peak_us"), F.col("representative.severity").alias("severity"))


_FACTS = f"[CASE WHEN {_EMERG} THEN 'emergency_squawk' END, CASE WHEN {_DISC} THEN 'atc_discrete_squawk' END, CASE WHEN {_MIL} THEN 'military_hex' END]"
_LIMITS = "[CASE WHEN act <> 'ACTIVE' THEN 'activation is not known' END, CASE WHEN NOT inside THEN 'position is within its uncertainty only' END, CASE WHEN NOT preferred THEN 'altitude is of the other source' END]"


@query(
    f"WITH {EPISODES}, rep AS (SELECT icao24, zone_id, episode, list_filter({_FACTS}, lambda x: x IS NOT NULL) AS shown FROM c QUALIFY row_number() OVER (PARTITION BY icao24, zone_id, episode ORDER BY severity_rank DESC, score DESC, rn) = 1), "
    f"f AS (SELECT icao24, zone_id, episode, fact, min(us) AS us FROM (SELECT icao24, zone_id, episode, us, unnest({_FACTS}) AS fact FROM c) WHERE fact IS NOT NULL GROUP BY ALL), "
    f"l AS (SELECT icao24, zone_id, episode, what, min(us) AS us FROM (SELECT icao24, zone_id, episode, us, unnest({_LIMITS}) AS what FROM c) WHERE what IS NOT NULL GROUP BY ALL), "
    "fs AS (SELECT icao24, zone_id, episode, string_agg(fact || ':' || (f.us - start_us) // 1000000, ',' ORDER BY f.us, fact) AS facts FROM f JOIN rep USING (icao24, zone_id, episode) JOIN ep USING (icao24, zone_id, episode) WHERE NOT list_contains(shown, fact) GROUP BY ALL), "
    "ls AS (SELECT icao24, zone_id, episode, string_agg(what, ',' ORDER BY us, what) AS limitations FROM l GROUP BY ALL) "
    "SELECT icao24, zone_id, start_us, coalesce(facts, '') AS facts, coalesce(limitations, '') AS limitations FROM ep LEFT JOIN fs USING (icao24, zone_id, episode) LEFT JOIN ls USING (icao24, zone_id, episode)"
)
def episode_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an episode's findings say beside the representative report: later signals by seconds after entry, and merged limitations."""
    e = episodes.incursions(airspace.hits(_evaluated(spark, sf_dir), A), A)
    seconds = lambda x: F.floor((F.unix_micros(x["at"]) - us("start_at")) / 1_000_000).cast("string")
    return e.select("icao24", "zone_id", us("start_at").alias("start_us"), F.array_join(F.transform("facts", lambda x: F.concat(x["what"], F.lit(":"), seconds(x))), ",").alias("facts"), F.array_join("limitations", ",").alias("limitations"))


@query(
    f"WITH {OBS}, s AS (SELECT seq, us, icao24, unnest([CASE WHEN {_EMERG} THEN 'emergency_squawk' END, CASE WHEN {_DISC} THEN 'atc_discrete_squawk' END, CASE WHEN {_MIL} THEN 'military_hex' END]) AS fact FROM obs) "
    "SELECT icao24, fact, min(us) AS first_us, count(*) AS times FROM s WHERE fact IS NOT NULL GROUP BY icao24, fact"
)
def context_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.obs(spark, sf_dir).withColumn("timestamp", F.col("observed_at")).withColumn("signals", airspace.signals(A))
    return episodes.first_seen(s, "icao24").select("icao24", "fact", us("first_at").alias("first_us"), "times")


@query("SELECT zone_type, activation, CAST(count(*) AS BIGINT) AS zones, count(*) FILTER (floor_datum = 'AGL') AS agl_floors FROM (WITH " + ZONES + " SELECT * FROM zones) GROUP BY ALL")
def zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = base.zones(spark)
    return z.groupBy("zone_type", "activation").agg(F.count("*").alias("zones"), F.count_if(F.col("floor_datum") == "AGL").alias("agl_floors"))


def _sun(rise: bool) -> str:
    """The almanac equations at 37.3267 N, 79.2004 W."""
    hour = "(-79.2004::DOUBLE / 15)"
    t = f"(doy + ({6.0 if rise else 18.0} - {hour}) / 24.0)"
    return f"""SELECT *, {t} AS t, 0.9856 * {t} - 3.289 AS m FROM days"""


def _sun_sql() -> str:
    parts = []
    for name, rise in (("rise", True), ("sunset", False)):
        parts.append(f"""{name}0 AS ({_sun(rise)}),
{name}1 AS (SELECT *, {pmod('m + 1.916 * sin(radians(m)) + 0.020 * sin(2 * radians(m)) + 282.634', '360.0')} AS sun FROM {name}0),
{name}2 AS (SELECT *, {pmod('degrees(atan(0.91764 * tan(radians(sun))))', '360.0')} AS ra FROM {name}1),
{name}3 AS (SELECT *, (ra + floor(sun / 90) * 90 - floor(ra / 90) * 90) / 15 AS rah, 0.39782 * sin(radians(sun)) AS sd FROM {name}2),
{name}4 AS (SELECT *, (cos(radians(90.833)) - sd * sin(radians(37.3267))) / (cos(asin(sd)) * cos(radians(37.3267))) AS ch FROM {name}3),
{name}5 AS (SELECT doy, {pmod(('(360 - degrees(acos(ch)))' if rise else 'degrees(acos(ch))') + ' / 15 + rah - 0.06571 * t - 6.622 + 79.2004 / 15', '24.0')} AS h FROM {name}4)""")
    return ",\n".join(parts)


@query(f"WITH days AS (SELECT DISTINCT dayofyear(ts)::DOUBLE AS doy FROM events),\n{_sun_sql()}\nSELECT CAST(doy AS INTEGER) AS doy, {r3('rise5.h')} AS sunrise_h, {r3('sunset5.h')} AS sunset_h FROM rise5 JOIN sunset5 USING (doy)")
def solar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = base.table(spark, sf_dir, "events").select(F.dayofyear("ts").alias("doy")).distinct()
    lat, lon = F.lit(37.3267), F.lit(-79.2004)
    at = F.col("doy").cast("double")
    return days.select("doy", base.r3(schedule.solar_hour_utc(at, lat, lon, sunrise=True)).alias("sunrise_h"), base.r3(schedule.solar_hour_utc(at, lat, lon, sunrise=False)).alias("sunset_h"))


@query("SELECT o_orderkey, o_orderpriority AS name, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS unique_id FROM orders")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("string").alias("k"))
    return reports.unique_ids(o, "k", "o_orderkey").drop("k")


_LOCAL = "(ts - INTERVAL 5 HOUR)"  # of New York in January, where all events lie


def _recurring(**fields: str) -> str:
    """SQL: one recurring window."""
    return "named_struct(" + ", ".join(f"'{f.name}', cast({fields.get(f.name, 'null')} as {f.dataType.simpleString()})" for f in RECURRING.fields) + ")"


def _scheduled(zone_id: str, zone: str, within: bool, **fields: str) -> str:
    """SQL: what activation reads of a zone."""
    return f"named_struct('zone_id', '{zone_id}', 'activation', 'SCHEDULED', 'active_windows', cast(array() as array<struct<start:timestamp,end:timestamp>>), 'recurring_windows', array({_recurring(**fields)}), 'schedule_timezone', '{zone}', 'unknown_within_schedule', {str(within).lower()}, 'unknown_outside_schedule', false)"


@query(
    f"""WITH t AS (SELECT ts, {_LOCAL} AS local, date_trunc('day', {_LOCAL}) AS day, dayofyear({_LOCAL}) AS own FROM events),
days AS (SELECT DISTINCT dayofyear({_LOCAL})::DOUBLE AS doy FROM events),
{_sun_sql()},
sun AS (SELECT CAST(rise5.doy AS INTEGER) AS doy, rise5.h AS rise, sunset5.h AS sunset FROM rise5 JOIN sunset5 USING (doy)),
a AS (SELECT 'night' AS zone_id, CASE WHEN hour(ts) >= 22 AND strftime(ts, '%m-%d') <= '01-10' THEN 'ACTIVE' ELSE 'INACTIVE' END AS activation FROM t
UNION ALL SELECT 'daylight', CASE WHEN epoch(local) - epoch(day) >= (rise - 5) * 3600 AND epoch(local) - epoch(day) < (sunset - 5) * 3600 THEN 'UNKNOWN' ELSE 'INACTIVE' END FROM t JOIN sun ON doy = own
UNION ALL SELECT 'weekend', CASE WHEN isodow(local) >= 6 THEN 'ACTIVE' ELSE 'INACTIVE' END FROM t)
SELECT zone_id, activation, count(*) AS reports FROM a GROUP BY ALL"""
)
def schedule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours past midnight in a season past the new year, daylight of another time zone, and whole days of its weekend."""
    zones = [
        _scheduled("night", "UTC", False, start_time="'22:00'", end_time="'06:00'", start_month_day="'12-15'", end_month_day="'01-10'"),
        _scheduled("daylight", "America/New_York", True, start_sunrise="true", end_sunset="true"),
        _scheduled("weekend", "America/New_York", False, all_day="true", weekdays="array(5, 6)"),
    ]
    at, lat, lon = F.col("ts").cast("timestamp"), F.lit(37.3267), F.lit(-79.2004)
    states = F.array(*(F.struct(F.expr(z)["zone_id"].alias("zone_id"), schedule.activation(F.expr(z), at, lat, lon).alias("activation")) for z in zones))
    return base.table(spark, sf_dir, "events").select(F.explode(states).alias("s")).select("s.*").groupBy("zone_id", "activation").agg(F.count("*").alias("reports"))
