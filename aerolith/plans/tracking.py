"""Queries on tracks, rules, episodes and detections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geo, scoring
from aerolith.functions import values as v
from aerolith.functions.tables import GATE_TYPE, GATE_WEIGHT, NACP_EPU_M, lookup
from aerolith.operators import episodes, gates, observations, reports, tracks
from aerolith.plans import base
from aerolith.plans.base import ALTITUDE, SPOOFING

C = SPOOFING
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def us(c: str) -> F.Column:
    return F.unix_micros(c)


# --- SQL fragments

OBS = """obs AS (SELECT lpad(lower(to_hex(10485760 + user_id)), 6, '0') AS icao24, ts AS observed_at, epoch_us(ts) AS us, 37::DOUBLE + (event_id * 37 % 1000) / 1000::DOUBLE AS latitude,
  -79::DOUBLE + (event_id * 53 % 1000) / 1000::DOUBLE AS longitude, CASE WHEN event_id % 17 <> 0 THEN value * 100 END AS altitude_ft, CASE WHEN event_id % 23 <> 0 THEN value * 2 END AS ground_speed_kt,
  (event_id * 7 % 360)::DOUBLE AS track_deg, CASE WHEN event_id % 13 <> 0 THEN (event_id * 11 % 4001 - 2000)::DOUBLE END AS vertical_rate_fpm, CASE WHEN event_id % 19 <> 0 THEN k % 12 END AS nic, k // 12 AS nacp,
  (k + 1200)::VARCHAR AS squawk, event_type AS callsign, 'rx-' || (event_id % 5) AS receiver_id, CASE WHEN event_id % 17 <> 0 THEN value * 100 + (event_id % 200 - 100) END AS alt_geom_ft, k % 10 = 0 AS on_ground, 'events:' || event_id AS source_row_id, event_id AS seq
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def r3(x: str, by: int = 1000) -> str:
    """To three decimals, halves up, in double arithmetic."""
    return f"(floor(({x}) * {by}.0::DOUBLE + 0.5::DOUBLE) / {by}.0::DOUBLE)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def pmod(x: str, m: str) -> str:
    return f"(({x}) - {m} * floor(({x}) / {m}))"


def case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {x!r}" for k, x in table.items()) + " END"


W = "PARTITION BY icao24 ORDER BY observed_at, seq"
SEG = f"""{OBS},
gaps AS (SELECT *, (us - lag(us) OVER ({W})) / 1e6::DOUBLE AS gap_s FROM obs),
seg AS (SELECT *, CAST(sum(CASE WHEN gap_s > {C.max_gap_s} THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id FROM gaps)"""
_HEADING = pmod("track_deg - p_track + 180.0::DOUBLE", "360.0::DOUBLE") + " - 180.0::DOUBLE"
PAIRS = f"""{SEG},
prev AS (SELECT *, lag(segment_id) OVER w AS p_seg, lag(us) OVER w AS p_us, lag(latitude) OVER w AS p_lat, lag(longitude) OVER w AS p_lon, lag(altitude_ft) OVER w AS p_alt, lag(track_deg) OVER w AS p_track, lag(nic) OVER w AS p_nic, lag(nacp) OVER w AS p_nacp, lag(seq) OVER w AS p_seq FROM seg WINDOW w AS ({W})),
d AS (SELECT *, (us - p_us) / 1e6::DOUBLE AS dt_s, {hav("p_lat", "p_lon", "latitude", "longitude")} AS distance_m FROM prev WHERE p_seg = segment_id AND us > p_us),
f AS (SELECT *, distance_m / dt_s * {geo.KT_PER_MPS}::DOUBLE AS implied_speed_kt, (altitude_ft - p_alt) / dt_s * 60 AS implied_climb_fpm, ({_HEADING}) / dt_s AS turn_rate_dps FROM d),
pairs AS (SELECT *, implied_speed_kt - ground_speed_kt AS speed_delta_kt, implied_climb_fpm - vertical_rate_fpm AS climb_delta_fpm FROM f)"""
QUANTUM = f"""steps AS (SELECT icao24, segment_id, CAST(abs(round(altitude_ft - last_value(altitude_ft IGNORE NULLS) OVER (PARTITION BY icao24, segment_id ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS BIGINT) AS step FROM seg),
divisors AS (SELECT icao24, segment_id, count(*) AS n, list_reduce(list(DISTINCT step), lambda a, b: gcd(a, b)) AS divisor FROM steps WHERE step > 0 GROUP BY ALL),
quantum AS (SELECT icao24, segment_id, n, CASE WHEN n >= {C.altitude_quantum_min_samples} AND divisor > 1 AND divisor <= {C.altitude_quantum_max_ft} THEN divisor::DOUBLE END AS quantum_ft FROM divisors)"""


def _epu(c: str) -> str:
    return f"greatest(coalesce({case(c, NACP_EPU_M)}, 0.0)::DOUBLE, {C.position_error_m}::DOUBLE)"


_ERR = f"(({_epu('p_nacp')} + {_epu('nacp')}) / dt_s * {geo.KT_PER_MPS}::DOUBLE)"
_LIMIT = f"(greatest({C.speed_delta_kt}::DOUBLE, abs(ground_speed_kt) * {C.speed_delta_frac}::DOUBLE) + {_ERR} + abs(ground_speed_kt) * {C.timing_error_s}::DOUBLE / dt_s)"
_QUALITY = "coalesce(greatest(0.3::DOUBLE, least(p_nic, nic, p_nacp, nacp) / 11.0::DOUBLE), 1.0::DOUBLE)"
_EV = "icao24, segment_id, p_us AS start_us, us AS end_us, dt_s"
GATES = f"""joined AS (SELECT pairs.*, quantum_ft FROM pairs LEFT JOIN quantum USING (icao24, segment_id)),
measured AS (SELECT *, implied_speed_kt - {_ERR} AS over_kt, {_LIMIT} AS limit_kt, abs(climb_delta_fpm) - coalesce(quantum_ft, {C.altitude_quantum_ft}::DOUBLE) * 2 * 60 / dt_s AS climb_over, {_QUALITY} AS quality FROM joined WHERE dt_s >= {C.min_dt_s}),
pair_events AS (
  SELECT 'teleport_v1' AS gate, {_EV}, over_kt AS measured, {C.teleport_kt}::DOUBLE AS threshold, 2 AS n_reports, quality FROM measured WHERE over_kt > {C.teleport_kt}
  UNION ALL SELECT 'turn_rate_v1', {_EV}, turn_rate_dps, {C.turn_rate_dps}::DOUBLE, 2, quality FROM measured WHERE abs(ground_speed_kt) >= {C.turn_rate_min_speed_kt} AND abs(turn_rate_dps) > {C.turn_rate_dps}
  UNION ALL SELECT 'speed_delta_v1', {_EV}, speed_delta_kt, limit_kt, 2, quality FROM measured WHERE ground_speed_kt IS NOT NULL AND abs(speed_delta_kt) > limit_kt
  UNION ALL SELECT 'vrate_delta_v1', {_EV}, climb_over, {C.vrate_delta_fpm}::DOUBLE, 2, quality FROM measured WHERE abs(vertical_rate_fpm) <= {C.vrate_max_plausible_fpm} AND climb_over > {C.vrate_delta_fpm})"""
NIC = f"""low AS (SELECT *, coalesce(nic <= {C.nic_floor}, false) AS is_low FROM seg),
islands AS (SELECT *, sum(CASE WHEN is_low THEN 0 ELSE 1 END) OVER (PARTITION BY icao24, segment_id ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING) AS run FROM low),
nic_runs AS (SELECT icao24, segment_id, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n_reports, (max(us) - min(us)) / 1e6::DOUBLE AS span_s FROM islands WHERE is_low GROUP BY ALL),
nic_events AS (SELECT 'nic_floor_v1' AS gate, icao24, segment_id, start_us, end_us, NULL::DOUBLE AS dt_s, span_s AS measured, {C.nic_min_duration_s}::DOUBLE AS threshold, n_reports, 1.0::DOUBLE AS quality FROM nic_runs
  WHERE n_reports >= 2 AND span_s >= {C.nic_min_duration_s} QUALIFY row_number() OVER (PARTITION BY icao24, segment_id ORDER BY span_s DESC, start_us) = 1)"""
_X = "radians(longitude - p_lon) * cos(radians(p_lat)) * 6371000.0::DOUBLE"
_Y = "radians(latitude - p_lat) * 6371000.0::DOUBLE"
PING = f"""pp AS (SELECT *, lag(us) OVER w AS p_us, lag(latitude) OVER w AS p_lat, lag(longitude) OVER w AS p_lon FROM obs WINDOW w AS ({W})),
hop AS (SELECT *, (us - p_us) / 1e6::DOUBLE AS dt, {_X} AS x, {_Y} AS y, {hav("p_lat", "p_lon", "latitude", "longitude")} AS dist FROM pp WHERE p_us IS NOT NULL),
imp AS (SELECT *, CASE WHEN dt > 0 THEN dist / dt > {C.pingpong_speed_mps} ELSE dist > 1 END AS impossible FROM hop),
lagged AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(impossible) OVER w AS limp FROM imp WINDOW w AS ({W})),
flip AS (SELECT *, coalesce(impossible AND limp AND (x * lx + y * ly) / nullif(sqrt(x * x + y * y) * sqrt(lx * lx + ly * ly), 0) <= -{C.pingpong_reversal_cos}, false) AS flips FROM lagged),
chains AS (SELECT *, sum(CASE WHEN flips THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS chain FROM flip),
ping_runs AS (SELECT icao24, chain, count(*) AS n, min(p_us) AS start_us, max(us) AS end_us FROM chains WHERE impossible GROUP BY ALL HAVING count(*) >= {C.pingpong_min_hops}),
ping_events AS (SELECT 'pingpong_v1' AS gate, icao24, NULL::INTEGER AS segment_id, start_us, end_us, NULL::DOUBLE AS dt_s, n::DOUBLE AS measured, {float(C.pingpong_min_hops)}::DOUBLE AS threshold, n + 1 AS n_reports, 1.0::DOUBLE AS quality FROM ping_runs QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY n DESC, chain) = 1)"""
_CLIM = f"((b.us - a.us) / 1e6::DOUBLE * ({C.teleport_kt}::DOUBLE / {geo.KT_PER_MPS} / 1000) + {C.coexistence_slack_km})"
COEX = f"""co AS (SELECT a.icao24, a.us AS start_us, b.us AS end_us, a.seq AS s1, b.seq AS s2, {hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} / 1000 AS km, {_CLIM} AS lim
  FROM obs a JOIN obs b ON a.icao24 = b.icao24 AND (b.us > a.us OR b.us = a.us AND b.seq > a.seq) AND b.us - a.us <= {int(C.coexistence_window_s * 1e6)}),
co_events AS (SELECT 'coexistence_v1' AS gate, icao24, NULL::INTEGER AS segment_id, start_us, end_us, NULL::DOUBLE AS dt_s, km AS measured, lim AS threshold, 2 AS n_reports, 1.0::DOUBLE AS quality FROM co WHERE km > lim QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY start_us, end_us, s1, s2) = 1)"""
REAP = f"""re AS (SELECT *, lag(us) OVER w AS p_us, lag(latitude) OVER w AS p_lat, lag(longitude) OVER w AS p_lon FROM seg WINDOW w AS ({W})),
re_d AS (SELECT *, {hav("p_lat", "p_lon", "latitude", "longitude")} AS dist FROM re WHERE gap_s > {C.max_gap_s}),
re_events AS (SELECT 'reappear_v1' AS gate, icao24, segment_id, p_us AS start_us, us AS end_us, NULL::DOUBLE AS dt_s, dist / 1852.0 AS measured, gap_s * ({C.teleport_kt} / 3600)::DOUBLE AS threshold, 2 AS n_reports, 1.0::DOUBLE AS quality FROM re_d WHERE dist > gap_s * {C.reappear_speed_mps})"""
DRIFT = """signs AS (SELECT icao24, upper(trim(callsign)) AS sign, min(us) AS us, arg_min(seq, us) AS seq, max(us) AS last_us, count(*) AS n FROM obs WHERE regexp_full_match(trim(callsign), '[A-Za-z0-9]+') GROUP BY ALL),
drift_events AS (SELECT 'identity_drift_v1' AS gate, icao24, NULL::INTEGER AS segment_id, min(us) AS start_us, max(last_us) AS end_us, NULL::DOUBLE AS dt_s, NULL::DOUBLE AS measured, NULL::DOUBLE AS threshold, sum(n) AS n_reports, 1.0::DOUBLE AS quality, string_agg(sign, ',' ORDER BY us, seq) AS seen FROM signs GROUP BY icao24 HAVING count(*) > 1)"""
REG = f"""registry AS (SELECT lpad(lower(to_hex(s_suppkey + 10485760)), 6, '0') AS icao24, (s_suppkey % 7 * 20)::DOUBLE AS max_kt, (s_suppkey % 5 * 1000 + 1500)::DOUBLE AS ceiling FROM supplier),
fast AS (SELECT *, count(*) OVER (PARTITION BY icao24) AS n FROM obs WHERE ground_speed_kt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY ground_speed_kt DESC, us, seq) = 1),
reg AS (SELECT *, coalesce(ground_speed_kt > max_kt + {C.registry_over_kt} OR max_kt > 0 AND ground_speed_kt > max_kt * {C.registry_ratio}, false) AS f, coalesce(altitude_ft > ceiling + {C.registry_over_ft}, false) AS h FROM fast JOIN registry USING (icao24)),
reg_events AS (SELECT 'registry_mismatch_v1' AS gate, icao24, NULL::INTEGER AS segment_id, us AS start_us, us AS end_us, NULL::DOUBLE AS dt_s, CASE WHEN f THEN ground_speed_kt ELSE altitude_ft END AS measured, CASE WHEN f THEN max_kt ELSE ceiling END AS threshold, n AS n_reports, 1.0::DOUBLE AS quality FROM reg WHERE f OR h)"""
_COLS = "gate, icao24, segment_id, start_us, end_us, dt_s, measured, threshold, n_reports, quality"
ALL = f"""{PAIRS}, {QUANTUM}, {GATES}, {NIC}, {PING}, {COEX}, {REAP}, {DRIFT}, {REG},
ev AS (SELECT {_COLS} FROM pair_events UNION ALL SELECT {_COLS} FROM nic_events UNION ALL SELECT {_COLS} FROM ping_events UNION ALL SELECT {_COLS} FROM co_events UNION ALL SELECT {_COLS} FROM re_events UNION ALL SELECT {_COLS} FROM drift_events UNION ALL SELECT {_COLS} FROM reg_events)"""
EPISODES = f"""{ALL},
reach AS (SELECT *, max(end_us) OVER (PARTITION BY gate, icao24, segment_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached, coalesce(abs(measured) / nullif(abs(threshold), 0), 0) AS x FROM ev),
runs AS (SELECT *, sum(CASE WHEN (start_us - reached) / 1e6::DOUBLE > {C.episode_gap_s} THEN 1 ELSE 0 END) OVER (PARTITION BY gate, icao24, segment_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM reach),
ep AS (SELECT gate, icao24, segment_id, run, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS hits, (max(end_us) - min(start_us)) / 1e6::DOUBLE AS duration_s, first(struct_pack(dt_s := dt_s, measured := measured, threshold := threshold, n_reports := n_reports, quality := quality) ORDER BY x DESC, start_us, end_us) AS b FROM runs GROUP BY ALL),
episodes AS (SELECT gate, icao24, segment_id, start_us, end_us, hits, duration_s, b.dt_s AS dt_s, b.measured AS measured, b.threshold AS threshold, b.n_reports AS n_reports, b.quality AS quality FROM ep)"""
_OVER, _SPAN = "(abs(measured) - abs(threshold))", f"(abs(threshold) * {C.score_margin_frac})"
SCORED = f"""{EPISODES},
scored AS (SELECT *, CASE WHEN measured IS NULL OR threshold IS NULL THEN 0.6::DOUBLE WHEN {_OVER} <= 0 OR {_SPAN} <= 0 THEN 0.5::DOUBLE ELSE (round_even((least(1.0::DOUBLE, least({_OVER}, {_SPAN}) * 0.5::DOUBLE / {_SPAN} + 0.5::DOUBLE)) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) END AS score,
  (round_even((greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - CASE WHEN dt_s IS NULL THEN 0.3::DOUBLE WHEN dt_s < 1.0 THEN 0.3::DOUBLE WHEN dt_s < 2.0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN n_reports < 3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN measured IS NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) * quality))) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS confidence FROM episodes),
weighed AS (SELECT *, coalesce({case("gate", GATE_WEIGHT)}, 0.5)::DOUBLE * score AS w FROM scored),
detections AS (SELECT *, CASE WHEN w >= {C.severity_high_at} THEN 'HIGH' WHEN w >= {C.severity_medium_at} THEN 'MEDIUM' ELSE 'LOW' END AS severity, confidence < {C.min_confidence} AS abstains FROM weighed)"""


def _r(*names: str) -> str:
    return ", ".join(f"{r3(n)} AS {n}" for n in names)


_EVENT_SQL = "SELECT gate, icao24, segment_id, start_us, end_us, CAST(n_reports AS BIGINT) AS n_reports, " + _r("dt_s", "measured", "threshold", "quality") + " FROM "


def _events(df: DataFrame) -> DataFrame:
    rounded = [base.r3(c).alias(c) for c in ("dt_s", "measured", "threshold", "quality")]
    return df.select("gate", "icao24", "segment_id", us("start_at").alias("start_us"), us("end_at").alias("end_us"), "n_reports", *rounded)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.with_segments(base.obs(spark, sf_dir), C.max_gap_s)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    return tracks.pair_features(seg).join(tracks.altitude_quantum(seg, C).drop("n"), ["icao24", "segment_id"], "left")


def _pair_gate(gate: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _events(gates.pair_gates(_features(spark, sf_dir), C).where(F.col("gate") == gate))

    return run


# --- queries


@query(f"WITH {OBS} SELECT icao24, us, {_r('latitude', 'longitude', 'altitude_ft', 'ground_speed_kt')}, track_deg, vertical_rate_fpm, CAST(nic AS INTEGER) AS nic, CAST(nacp AS INTEGER) AS nacp, squawk, callsign, receiver_id, {_r('alt_geom_ft')}, on_ground, source_row_id FROM obs")
def observations_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations.validated(base.obs(spark, sf_dir))
    return o.select("icao24", us("observed_at").alias("us"), *(base.r3(c).alias(c) for c in ("latitude", "longitude", "altitude_ft", "ground_speed_kt", "alt_geom_ft")), "track_deg", "vertical_rate_fpm", "nic", "nacp", "squawk", "callsign", "receiver_id", "on_ground", "source_row_id")


@query(f"WITH {SEG} SELECT icao24, segment_id, count(*) AS reports, min(us) AS start_us, max(us) AS end_us FROM seg GROUP BY icao24, segment_id")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).groupBy("icao24", "segment_id").agg(F.count("*").alias("reports"), us(F.min("observed_at")).alias("start_us"), us(F.max("observed_at")).alias("end_us"))


@query(f"WITH {PAIRS} SELECT icao24, segment_id, us, {_r('dt_s', 'distance_m', 'implied_speed_kt', 'speed_delta_kt', 'implied_climb_fpm', 'climb_delta_fpm')}, {r3('turn_rate_dps', 1000000)} AS turn_rate_dps FROM pairs")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tracks.pair_features(_segments(spark, sf_dir))
    return f.select("icao24", "segment_id", us("observed_at").alias("us"), *(base.r3(c).alias(c) for c in ("dt_s", "distance_m", "implied_speed_kt", "speed_delta_kt", "implied_climb_fpm", "climb_delta_fpm")), base.r3("turn_rate_dps", 1_000_000).alias("turn_rate_dps"))


@query(f"WITH {SEG}, {QUANTUM} SELECT * FROM quantum")
def altitude_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.altitude_quantum(_segments(spark, sf_dir), C)


for _name, _gate in (("teleport_gate", "teleport_v1"), ("turn_gate", "turn_rate_v1"), ("speed_gate", "speed_delta_v1"), ("vrate_gate", "vrate_delta_v1")):
    QUERIES[_name] = _pair_gate(_gate)
    SQL[_name] = f"WITH {PAIRS}, {QUANTUM}, {GATES} {_EVENT_SQL} pair_events WHERE gate = '{_gate}'"


@query(f"WITH {SEG}, {NIC} SELECT icao24, segment_id, start_us, end_us, n_reports, {r3('span_s')} AS span_s FROM nic_runs")
def nic_floor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gates.nic_runs(_segments(spark, sf_dir), C)
    return r.select("icao24", "segment_id", us("start_at").alias("start_us"), us("end_at").alias("end_us"), "n_reports", base.r3("span_s").alias("span_s"))


@query(f"WITH {SEG}, {NIC} {_EVENT_SQL} nic_events")
def nic_floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(gates.nic_floor(_segments(spark, sf_dir), C))


@query(f"WITH {OBS}, {PING} {_EVENT_SQL} ping_events")
def pingpong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(gates.pingpong(base.obs(spark, sf_dir), C))


@query(f"WITH {OBS}, {COEX} {_EVENT_SQL} co_events")
def coexistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(gates.coexistence(base.obs(spark, sf_dir), C))


@query(f"WITH {SEG}, {REAP} {_EVENT_SQL} re_events")
def reappearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(gates.reappearance(_segments(spark, sf_dir), C))


@query(f"WITH {OBS}, {DRIFT} SELECT icao24, start_us, end_us, CAST(n_reports AS BIGINT) AS n_reports, seen FROM drift_events")
def identity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.identity_drift(base.obs(spark, sf_dir), C).select("icao24", us("start_at").alias("start_us"), us("end_at").alias("end_us"), "n_reports", F.array_join("seen", ",").alias("seen"))


@query(f"WITH {OBS}, {REG} {_EVENT_SQL} reg_events")
def registry_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(gates.registry_mismatch(base.obs(spark, sf_dir), base.registry(spark, sf_dir), C))


@query(
    f"WITH {OBS}, a AS (SELECT DISTINCT icao24, CAST('0x' || icao24 AS BIGINT) AS address FROM obs), b AS (SELECT n_nationkey * 8 + 10485760 AS lo, n_nationkey * 8 + 10485766 AS hi, n_name AS country FROM nation) "
    "SELECT icao24, address, country FROM a LEFT JOIN b ON address BETWEEN lo AND hi"
)
def address_block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = base.obs(spark, sf_dir).select("icao24").distinct().withColumn("address", v.parsed_address(F.col("icao24")))
    return gates.country_of(addresses, base.blocks(spark, sf_dir))


def _spoof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.spoofing_events(base.obs(spark, sf_dir), C, registry=base.registry(spark, sf_dir))


@query(f"WITH {ALL} {_EVENT_SQL} ev")
def spoof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_spoof_events(spark, sf_dir))


_EP_SQL = "SELECT gate, icao24, segment_id, start_us, end_us, CAST(hits AS BIGINT) AS hits, CAST(n_reports AS BIGINT) AS n_reports, " + _r("duration_s", "measured", "threshold")


@query(f"WITH {EPISODES} {_EP_SQL} FROM episodes")
def spoof_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes.consolidate(_spoof_events(spark, sf_dir), C)
    return e.select("gate", "icao24", "segment_id", us("start_at").alias("start_us"), us("end_at").alias("end_us"), "hits", "n_reports", *(base.r3(c).alias(c) for c in ("duration_s", "measured", "threshold")))


def spoof_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scored_spoofing(episodes.consolidate(_spoof_events(spark, sf_dir), C), C)


@query(f"WITH {SCORED} SELECT gate, {case('gate', GATE_TYPE)} AS detection_type, 'aircraft:' || icao24 AS entity_id, start_us, end_us, CAST(hits AS BIGINT) AS hits, score, confidence, severity, abstains FROM detections")
def spoof_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spoof_scored(spark, sf_dir)
    return d.select("gate", lookup(F.col("gate"), GATE_TYPE).alias("detection_type"), F.concat(F.lit("aircraft:"), "icao24").alias("entity_id"), us("start_at").alias("start_us"), us("end_at").alias("end_us"), "hits", "score", "confidence", "severity", "abstains")


@query(f"WITH {SCORED} SELECT gate, count(*) AS alerts, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, {r3('median(dt_s)')} AS median_dt_s, {r3('median(measured)')} AS median_measured, CAST(row_number() OVER (ORDER BY count(*) DESC, gate) AS INTEGER) AS place FROM detections GROUP BY gate")
def alert_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.breakdown(spoof_scored(spark, sf_dir)).withColumns({c: base.r3(c) for c in ("median_dt_s", "median_measured")})


_EXC = f"greatest({ALTITUDE.floor_ft}::DOUBLE - altitude_ft, altitude_ft - {ALTITUDE.ceiling_ft})"


@query(
    f"WITH {OBS}, a AS (SELECT icao24, us, altitude_ft, CASE WHEN altitude_ft < {ALTITUDE.floor_ft} THEN 'BELOW_FLOOR' WHEN altitude_ft > {ALTITUDE.ceiling_ft} THEN 'ABOVE_CEILING' END AS reason, {_EXC} AS excess FROM obs) "
    f"SELECT icao24, us, reason, {r3('excess')} AS excess_ft, (round_even((least(1.0::DOUBLE, least(excess, 2000.0::DOUBLE) * 0.5::DOUBLE / 2000.0::DOUBLE + 0.5::DOUBLE)) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE) AS confidence, CASE WHEN excess >= 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a WHERE reason IS NOT NULL"
)
def altitude_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.col("altitude_ft")
    o = base.obs(spark, sf_dir).withColumns({"reason": scoring.altitude_reason(alt, ALTITUDE), "excess": scoring.altitude_excess(alt, ALTITUDE)}).where("reason is not null")
    return o.select("icao24", us("observed_at").alias("us"), "reason", base.r3("excess").alias("excess_ft"), scoring.altitude_confidence(F.col("excess")).alias("confidence"), scoring.altitude_severity(F.col("excess")).alias("severity"))


# --- windows and keys

H = 3_600_000_000


@query(f"WITH {OBS} SELECT us // {24 * H} * {24 * H} AS window_us, icao24, count(*) AS reports, {r3('max(ground_speed_kt)')} AS top_kt FROM obs GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = observations.windowed(base.obs(spark, sf_dir), 86_400)
    return w.groupBy("window_start", "icao24").agg(F.count("*").alias("reports"), base.r3(F.max("ground_speed_kt")).alias("top_kt")).select(us("window_start").alias("window_us"), "icao24", "reports", "top_kt")


@query(f"WITH {OBS}, b AS (SELECT min(us) // {6 * H} AS k0 FROM obs), s AS (SELECT obs.*, unnest(range((us - {24 * H}) // {6 * H} + 1, us // {6 * H} + 1)) AS k FROM obs) SELECT k * {6 * H} AS window_us, count(*) AS reports, count(DISTINCT icao24) AS aircraft FROM s, b WHERE k >= k0 GROUP BY k")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = observations.windowed(base.obs(spark, sf_dir), 86_400, 21_600)
    return w.groupBy("window_start").agg(F.count("*").alias("reports"), F.countDistinct("icao24").alias("aircraft")).select(us("window_start").alias("window_us"), "reports", "aircraft")


@query(f"WITH {OBS} SELECT us // {6 * H} * {6 * H} AS window_us, count(*) AS reports FROM obs WHERE us - us // {6 * H} * {6 * H} < {2 * H} GROUP BY 1")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = observations.windowed(base.obs(spark, sf_dir), 7_200, 21_600)
    return w.groupBy(us("window_start").alias("window_us")).agg(F.count("*").alias("reports"))


_SCOPE = "CASE WHEN gate IN ('coexistence_v1', 'pingpong_v1', 'identity_drift_v1') THEN 'entity' ELSE 'event' END"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spoof_scored(spark, sf_dir)
    d = d.withColumns({"detector_id": F.lit("spoofing"), "detector_version": F.lit("1"), "detection_type": lookup(F.col("gate"), GATE_TYPE), "entity_ids": F.array(F.concat(F.lit("aircraft:"), "icao24")), "scope": F.expr(_SCOPE)})
    return d.withColumn("key", observations.dedup_key(F.col("scope"), F.col("start_at")))


@query(f"WITH {SCORED}, k AS (SELECT *, {case('gate', GATE_TYPE)} AS detection_type, {_SCOPE} AS scope FROM detections) SELECT icao24, detection_type, scope, CASE WHEN scope = 'event' THEN start_us END AS key_us, min(gate) AS first_gate, count(*) AS findings FROM k GROUP BY 1, 2, 3, 4")
def dedup_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    first = observations.first_of_key(k, "key", "gate", "start_at")
    many = k.groupBy("key").agg(F.count("*").alias("findings"))
    return first.join(many, "key").select("icao24", "detection_type", "scope", F.when(F.col("scope") == "event", us("start_at")).alias("key_us"), F.col("gate").alias("first_gate"), "findings")


@query(f"WITH {SCORED}, k AS (SELECT DISTINCT icao24, {case('gate', GATE_TYPE)} AS detection_type, CASE WHEN {_SCOPE} = 'event' THEN start_us END AS key_us, severity FROM detections), seen AS (SELECT DISTINCT icao24, detection_type, key_us FROM k WHERE severity = 'HIGH') SELECT DISTINCT k.icao24, k.detection_type, k.key_us FROM k WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.icao24 = k.icao24 AND s.detection_type = k.detection_type AND s.key_us IS NOT DISTINCT FROM k.key_us)")
def unseen_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed(spark, sf_dir)
    new = reports.not_seen(k, k.where("severity = 'HIGH'").select("key"))
    return new.select("icao24", "detection_type", F.when(F.col("scope") == "event", us("start_at")).alias("key_us")).distinct()
