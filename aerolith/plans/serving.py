"""Queries on values, storage, serving, evaluation and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import values as v
from aerolith.functions.tables import RC_TO_NIC, rc_to_nic
from aerolith.operators import episodes, observations, reports, serving, tracks
from aerolith.operators.airspace import hits as airspace_hits
from aerolith.operators.gates import pair_gates, spoofing_events
from aerolith.plans import base, detectors, encounters, tracking
from aerolith.plans.tracking import OBS, PAIRS, SCORED, H, r3, us
from aerolith.sinks import tables as sinks
from aerolith.sinks.shared import scratch
from aerolith.streaming import episodes as stream_episodes
from aerolith.streaming import live

C = base.SPOOFING
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- values

_RAW = "CASE CAST(event_id % 9 AS INTEGER) WHEN 0 THEN ' 8.0 ' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN ' true' WHEN 4 THEN '0' WHEN 5 THEN '-12.75' WHEN 6 THEN 'FALSE' WHEN 7 THEN '1e3' ELSE CAST(user_id AS {s}) END"


@query(
    f"WITH r AS (SELECT event_id, {_RAW.format(s='VARCHAR')} AS raw FROM events) SELECT event_id, nullif(trim(raw), '') AS text, TRY_CAST(trim(raw) AS DOUBLE) AS number, CAST(trunc(TRY_CAST(trim(raw) AS DOUBLE)) AS INTEGER) AS whole, "
    "CASE WHEN lower(trim(raw)) IN ('true', '1') THEN true WHEN lower(trim(raw)) IN ('false', '0') THEN false END AS flag FROM r"
)
def forgiving_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = base.table(spark, sf_dir, "events").select("event_id", F.expr(_RAW.format(s="STRING")).alias("raw"))
    raw = F.col("raw")
    return r.select("event_id", v.text(raw).alias("text"), v.number(raw).alias("number"), v.integer(raw).alias("whole"), v.boolean(raw).alias("flag"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN CASE " + " ".join(f"WHEN s_acctbal <= {m} THEN {n}" for m, n in RC_TO_NIC) + " ELSE 0 END END AS nic FROM supplier")
def containment_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "supplier").select("s_suppkey", rc_to_nic(F.col("s_acctbal")).alias("nic"))


_CODES = "CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN ' 77 ' WHEN 1 THEN '7700' WHEN 2 THEN '12000' WHEN 3 THEN '1289' WHEN 4 THEN '' ELSE '0012' END"


@query(f"WITH r AS (SELECT event_id, trim({_CODES}) AS t, event_type FROM events) SELECT event_id, CASE WHEN length(t) BETWEEN 1 AND 4 AND regexp_full_match(lpad(t, 4, '0'), '[0-7]{{4}}') THEN lpad(t, 4, '0') END AS squawk, upper(substr(event_type, 1, 3)) AS operator, regexp_full_match(event_type, '[A-Za-z0-9]+') AS readable FROM r")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.expr(_CODES).alias("raw"), "event_type")
    return e.select("event_id", v.squawk(F.col("raw")).alias("squawk"), v.operator_code(F.col("event_type")).alias("operator"), v.readable_callsign(F.col("event_type")).alias("readable"))


_SPOILED = """CASE WHEN seq % 31 = 0 THEN NULL WHEN seq % 31 = 1 THEN 'icao24:' WHEN seq % 31 = 2 THEN 'icao24:~a0001' WHEN seq % 31 = 3 THEN 'ship:1' ELSE 'icao24:' || icao24 END"""
_LAT = "CASE WHEN seq % 31 = 5 THEN NULL WHEN seq % 31 = 6 THEN 95.0 ELSE latitude END"
STORED = f"""{OBS}, stored AS (SELECT seq, us, observed_at, {_SPOILED} AS entity_id, CASE WHEN seq % 31 = 4 THEN NULL ELSE us END AS at_us, {_LAT} AS latitude, longitude FROM obs)"""


def _storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage rows, some spoiled."""
    o = base.obs(spark, sf_dir)
    rows = o.select("*", F.expr(_SPOILED).alias("_e"), F.expr(_LAT).cast("double").alias("_lat"))
    stored = observations.to_storage(rows, "events").drop("entity_id", "latitude")
    spoiled = rows.select("seq", F.col("_e").alias("entity_id"), F.col("_lat").alias("latitude"), "source_row_id")
    return stored.join(spoiled, stored["raw_record_ref"] == spoiled["source_row_id"]).drop("source_row_id").withColumn("observed_at", F.when(F.col("seq") % 31 != 4, F.col("observed_at")))


@query(
    f"WITH {STORED}, r AS (SELECT CASE WHEN nullif(trim(entity_id), '') IS NULL THEN 'MISSING_ENTITY' WHEN NOT starts_with(entity_id, 'icao24:') OR nullif(trim(substr(entity_id, 8)), '') IS NULL THEN 'BAD_ENTITY' WHEN NOT regexp_full_match(trim(substr(entity_id, 8)), '[0-9a-fA-F]{{6}}') THEN 'NON_ICAO_ADDRESS' WHEN at_us IS NULL THEN 'MISSING_TIME' WHEN latitude IS NULL OR longitude IS NULL THEN 'MISSING_POSITION' WHEN abs(latitude) > 90 OR abs(longitude) > 180 THEN 'BAD_POSITION' END AS reason FROM stored) "
    "SELECT coalesce(reason, 'usable') AS reason, count(*) AS n FROM r GROUP BY 1"
)
def row_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.with_reason(_storage(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"WITH {STORED} SELECT o.icao24, o.us, {r3('o.latitude')} AS latitude, {r3('o.altitude_ft')} AS altitude_ft, {r3('o.ground_speed_kt')} AS ground_speed_kt, o.track_deg, o.vertical_rate_fpm, CAST(o.nic AS INTEGER) AS nic, CAST(o.nacp AS INTEGER) AS nacp, o.squawk, o.callsign, o.on_ground, o.receiver_id FROM stored s JOIN obs o USING (seq) WHERE s.seq % 31 > 6"
)
def stored_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations.from_storage(_storage(spark, sf_dir))
    return o.select("icao24", us("observed_at").alias("us"), *(base.r3(c).alias(c) for c in ("latitude", "altitude_ft", "ground_speed_kt")), "track_deg", "vertical_rate_fpm", "nic", "nacp", "squawk", "callsign", "on_ground", "receiver_id")


_ENVELOPE = """concat('{"key":"k","source":"s","payload":{"alt_baro":', case when event_id % 5 = 0 then '"ground"' else cast(user_id * 10 as string) end, ',"geom_rate":', cast(user_id as string), case when event_id % 3 = 0 then ',"baro_rate":-64' else '' end, ',"flight":" ', event_type, ' ","nac_p":"9","squawk":""}}')"""


@query(
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (user_id * 10)::DOUBLE END AS altitude_ft, CASE WHEN event_id % 3 = 0 THEN -64 ELSE user_id END::DOUBLE AS vertical_rate_fpm, event_type AS callsign, 9 AS nacp, CASE WHEN event_id % 5 = 0 THEN true END AS on_ground, NULL::VARCHAR AS squawk FROM events"
)
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.expr(_ENVELOPE).alias("payload"))
    p = v.payload_fields(F.col("payload"))
    return e.select("event_id", *(p[c].alias(c) for c in ("altitude_ft", "vertical_rate_fpm", "callsign", "nacp", "on_ground", "squawk")))


# --- serving


@query(f"WITH {OBS}, n AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY us DESC, source_row_id DESC) = 1) SELECT 'icao24:' || icao24 AS entity_id, icao24, us, callsign, {r3('latitude')} AS latitude, {r3('longitude')} AS longitude, {r3('(1706745600000000 - us) / 3.6e9::DOUBLE')} AS position_age_hours FROM n WHERE callsign ILIKE '%c%' AND latitude BETWEEN 37.1 AND 37.9 AND longitude BETWEEN -78.9 AND -78.1")
def latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations.to_storage(base.obs(spark, sf_dir), "events")
    found = serving.latest_positions(rows, F.lit("2024-02-01").cast("timestamp"), callsign="c", box=(37.1, 37.9, -78.9, -78.1))
    return found.select("entity_id", "icao24", us("observed_at").alias("us"), "callsign", *(base.r3(c).alias(c) for c in ("latitude", "longitude", "position_age_hours")))


@query(f"WITH {OBS}, k AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY us DESC, source_row_id DESC) <= 50) SELECT 'icao24:' || icao24 AS entity_id, CAST(count(*) AS INTEGER) AS points, string_agg(us::VARCHAR, ',' ORDER BY us, source_row_id) AS times, {r3('first(longitude ORDER BY us, source_row_id)')} AS first_lon, {r3('last(latitude ORDER BY us, source_row_id)')} AS last_lat FROM k GROUP BY icao24")
def track_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = serving.track_lines(observations.to_storage(base.obs(spark, sf_dir), "events"), limit=50)
    return t.select("entity_id", "points", F.array_join(F.transform("times", lambda x: F.unix_micros(x).cast("string")), ",").alias("times"), base.r3(F.get(F.get("coordinates", F.lit(0)), F.lit(0))).alias("first_lon"), base.r3(F.get(F.get("coordinates", F.col("points") - 1), F.lit(1))).alias("last_lat"))


@query(f"WITH {SCORED} SELECT gate, 'aircraft:' || icao24 AS entity_id, start_us, severity FROM detections WHERE severity = 'HIGH' AND start_us >= 1704844800000000 ORDER BY start_us DESC, icao24, gate LIMIT 100")
def detections_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracking.spoof_scored(spark, sf_dir).withColumn("entity_id", F.concat(F.lit("aircraft:"), "icao24"))
    return serving.findings(d, severity="high", since=F.lit("2024-01-10").cast("timestamp"), limit=100).select("gate", "entity_id", us("start_at").alias("start_us"), "severity")


_SHIFT = "CASE WHEN seq % 4 = 0 THEN us + 1000000 ELSE us END"


@query(
    f"WITH {OBS}, raw AS (SELECT icao24 AS i, unnest(list_distinct([us, {_SHIFT}])) AS t, seq AS line, CASE WHEN seq % 3 = 0 THEN altitude_ft + 100 ELSE altitude_ft END AS ab, altitude_ft AS ag FROM obs WHERE seq % 10 <> 0), "
    "j AS (SELECT obs.*, line, CASE WHEN line IS NULL THEN 'unmatched' WHEN coalesce(abs(altitude_ft - ab) <= 0.5, false) THEN 'baro' WHEN coalesce(abs(altitude_ft - ag) <= 0.5, false) THEN 'geom' ELSE 'other' END AS source FROM obs LEFT JOIN raw ON i = icao24 AND t = us), "
    "b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE WHEN source IN ('baro', 'geom') THEN 0 ELSE 1 END, line) = 1) SELECT source, count(*) AS n FROM b GROUP BY source"
)
def altitude_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.obs(spark, sf_dir)
    at = F.col("observed_at")
    raw = o.where("seq % 10 <> 0").select("icao24", at.alias("at"), F.when(F.col("seq") % 4 == 0, at + F.expr("interval 1 second")).otherwise(at).alias("at_2"), F.col("seq").alias("line"), F.when(F.col("seq") % 3 == 0, F.col("altitude_ft") + 100).otherwise(F.col("altitude_ft")).alias("ab"), F.col("altitude_ft").alias("ag"))
    return serving.matched_rows(o, raw).groupBy("source").agg(F.count("*").alias("n"))


# --- evaluation

_FIRED = f"""{PAIRS}, {tracking.QUANTUM}, {tracking.GATES}, fired AS (SELECT DISTINCT icao24, gate FROM pair_events),
cases AS (SELECT i.icao24, g.gate, i.expected FROM (SELECT DISTINCT icao24, CAST('0x' || icao24 AS BIGINT) % 3 = 0 AS expected FROM obs) i, (SELECT DISTINCT gate FROM pair_events) g),
results AS (SELECT c.*, f.gate IS NOT NULL AS fired FROM cases c LEFT JOIN fired f ON f.icao24 = c.icao24 AND f.gate = c.gate)"""
_COUNTS = "count(*) FILTER (expected AND fired) AS tp, count(*) FILTER (NOT expected AND fired) AS fp, count(*) FILTER (expected AND NOT fired) AS fn, count(*) FILTER (NOT expected AND NOT fired) AS tn"


def _pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_gates(tracking._features(spark, sf_dir), C)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft and rule: whether it should fire (a label) and whether it does."""
    fired = _pair_events(spark, sf_dir).groupBy("icao24").agg(F.collect_set("gate").alias("gates"))
    aircraft = base.obs(spark, sf_dir).select("icao24").distinct()
    rules = F.array(*(F.lit(g) for g in ("teleport_v1", "turn_rate_v1", "speed_delta_v1", "vrate_delta_v1")))
    cases = aircraft.join(fired, "icao24", "left").withColumn("gate", F.explode(rules))
    return cases.select("icao24", "gate", (v.parsed_address(F.col("icao24")) % 3 == 0).alias("expected"), F.coalesce(F.array_contains("gates", F.col("gate")), F.lit(False)).alias("fired"))


@query(f"WITH {_FIRED} SELECT gate, {_COUNTS} FROM results GROUP BY gate")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion(_results(spark, sf_dir), "gate")


@query(f"WITH {_FIRED}, c AS (SELECT gate, {_COUNTS} FROM results GROUP BY gate) SELECT gate, {r3('tp / nullif(tp + fp, 0)::DOUBLE')} AS precision, {r3('tp / nullif(tp + fn, 0)::DOUBLE')} AS recall FROM c")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.precision_recall(reports.confusion(_results(spark, sf_dir), "gate")).select("gate", base.r3("precision").alias("precision"), base.r3("recall").alias("recall"))


@query(f"WITH {PAIRS} SELECT CAST(least(floor(implied_speed_kt / 5), 20) AS INTEGER) AS bin, count(*) AS n FROM pairs GROUP BY 1")
def speed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(tracks.pair_features(tracking._segments(spark, sf_dir)), "implied_speed_kt", 5.0, 100.0)


@query(f"WITH {SCORED} SELECT gate, {r3('count(*) / 720.0::DOUBLE')} AS per_hour FROM detections GROUP BY gate")
def alerts_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_hour(tracking.spoof_scored(spark, sf_dir), 720.0).select("gate", base.r3("per_hour").alias("per_hour"))


SETTINGS = [20.0, 50.0, 100.0, 400.0]


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    features = tracking._features(spark, sf_dir)
    return reports.swept(lambda x: pair_gates(features, replace(C, teleport_kt=x)).where("gate = 'teleport_v1'").agg(F.count("*").alias("alerts"), F.countDistinct("icao24").alias("positives")), SETTINGS)


_SWEEP = f"""{PAIRS}, e AS (SELECT *, implied_speed_kt - {tracking._ERR} AS over_kt FROM pairs WHERE dt_s >= {C.min_dt_s}), s(setting) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in SETTINGS)}),
sweep AS (SELECT setting, count(*) FILTER (over_kt > setting) AS alerts, count(DISTINCT icao24) FILTER (over_kt > setting) AS positives FROM e, s GROUP BY setting)"""


@query(f"WITH {_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir)


@query(f"WITH {_SWEEP} SELECT setting, alerts FROM sweep WHERE positives >= 100 ORDER BY alerts, setting LIMIT 1")
def recommended_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sweep(spark, sf_dir).withColumns({"place": F.col("setting"), "guards_held": F.lit(True), "baseline_positives": F.lit(100)})
    return reports.recommend(rows)


@query(f"WITH {OBS} SELECT count(*) AS reports, count(DISTINCT icao24) AS aircraft, min(us) AS first_us, max(us) AS last_us, {r3('min(altitude_ft)')} AS low_ft, {r3('max(altitude_ft)')} AS high_ft, count(altitude_ft) AS with_altitude FROM obs")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.obs(spark, sf_dir)
    return o.agg(F.count("*").alias("reports"), F.countDistinct("icao24").alias("aircraft"), us(F.min("observed_at")).alias("first_us"), us(F.max("observed_at")).alias("last_us"), base.r3(F.min("altitude_ft")).alias("low_ft"), base.r3(F.max("altitude_ft")).alias("high_ft"), F.count("altitude_ft").alias("with_altitude"))


@query(f"WITH {OBS} SELECT icao24, count(*) AS n FROM obs GROUP BY icao24 ORDER BY n DESC, icao24 LIMIT 15")
def busiest_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.obs(spark, sf_dir).groupBy("icao24").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "icao24").limit(15)


@query("WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS total FROM events) SELECT event_id FROM n WHERE i % greatest(1, CAST(ceil(total / 500::DOUBLE) AS BIGINT)) = 0")
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.thinned(base.table(spark, sf_dir, "events").select("event_id", "ts"), 500, "ts", "event_id").select("event_id")


@query("SELECT c_custkey AS key, c_nationkey AS nation FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 1")
def united_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return reports.united(c.where("key % 2 = 0"), c.where("key % 2 = 1"), "key")


# --- sinks


def _target(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("dedup_key"), F.col("o_orderstatus").alias("severity"), F.col("o_totalprice").alias("score"), F.col("o_custkey").alias("created_at"), "o_orderkey")
    old = o.where("o_orderkey % 3 <> 0").drop("o_orderkey")
    new = o.where("o_orderkey % 2 = 0").withColumns({"severity": F.lit("X"), "score": F.col("score") + 1, "created_at": F.lit(0).cast("long")}).drop("o_orderkey")
    return old, new


@query(
    "WITH o AS (SELECT o_orderkey::VARCHAR AS dedup_key, o_orderstatus AS severity, o_totalprice AS score, o_custkey AS created_at, o_orderkey AS k FROM orders) "
    f"SELECT dedup_key, CASE WHEN k % 2 = 0 THEN 'X' ELSE severity END AS severity, {r3('CASE WHEN k % 2 = 0 THEN score + 1 ELSE score END')} AS score, CASE WHEN k % 3 = 0 THEN 0 ELSE created_at END AS created_at, CASE WHEN k % 3 = 0 THEN 'inserted' WHEN k % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM o WHERE k % 3 <> 0 OR k % 2 = 0"
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _target(spark, sf_dir)
    return sinks.merged(old, new, "dedup_key", ("dedup_key", "created_at")).withColumnRenamed("_action", "action").withColumn("score", base.r3("score"))


@query("WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS ref FROM events WHERE event_id % 2 = 0), t AS (SELECT DISTINCT user_id, event_type AS ref FROM events WHERE event_id % 2 = 1 AND user_id % 2 = 0) SELECT ref, count(*) AS n FROM (SELECT DISTINCT user_id, ref FROM s WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = s.user_id AND t.ref = s.ref) UNION ALL SELECT user_id, ref FROM s WHERE ref IS NULL) GROUP BY ref")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events")
    rows = e.where("event_id % 2 = 0").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("ref"))
    target = e.where("event_id % 2 = 1 and user_id % 2 = 0").select("user_id", F.col("event_type").alias("ref"))
    return sinks.new_records(rows, target, "user_id", "ref").groupBy("ref").agg(F.count("*").alias("n"))


@query(f"WITH {OBS} SELECT 'icao24:' || icao24 AS entity_id, us, 'air' AS domain, source_row_id AS raw_record_ref, {r3('ground_speed_kt')} AS sog, track_deg AS cog FROM obs")
def storage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = observations.to_storage(base.obs(spark, sf_dir), "events")
    return s.select("entity_id", us("observed_at").alias("us"), "domain", "raw_record_ref", base.r3("sog").alias("sog"), "cog")


@query(f"WITH {encounters.REPORTS}, d AS (SELECT seq, max({encounters.case('reason', encounters.EXIT_DEPTH)}) AS depth FROM eval GROUP BY seq) SELECT count(*) AS states, count(*) FILTER (depth = 6) AS firing_reports, (SELECT count(*) FROM eval WHERE reason = 'detection') AS detections, (SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM (SELECT {encounters.case('depth', {v: k for k, v in encounters.EXIT_DEPTH.items()})} AS reason, count(*) AS n FROM d GROUP BY 1)) AS exits FROM d")
def exit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aerolith.operators import airspace

    rows = encounters._evaluated(spark, sf_dir)
    found = sinks.exit_summary(airspace.exit_reasons(rows), airspace.only(rows, "detection").count())
    return found.withColumn("exits", F.array_join(F.transform(F.array_sort(F.map_entries("exits")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","))


# --- detectors


@query(
    f"""WITH {SCORED} SELECT 'spoofing' AS detector_id, severity, count(*) AS findings FROM detections WHERE NOT abstains GROUP BY severity"""
)
def spoofing_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.run(base.obs(spark, sf_dir), [detectors.build("spoofing", cfg=C, registry=base.registry(spark, sf_dir))])
    return found.groupBy("detector_id", "severity").agg(F.count("*").alias("findings"))


@query(f"WITH {encounters.SLOTS} SELECT 'icao24:' || icao24_a AS first, 'icao24:' || icao24_b AS second, start_us, severity, confidence FROM slots")
def proximity_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.run(base.obs(spark, sf_dir), [detectors.build("proximity", cfg=base.PROXIMITY)], dedup=True)
    return found.select(F.get("entity_ids", F.lit(0)).alias("first"), F.get("entity_ids", F.lit(1)).alias("second"), us("start_at").alias("start_us"), "severity", "confidence")


@query(f"WITH {encounters.EPISODES} SELECT 'icao24:' || icao24 AS aircraft, 'zone:' || zone_id AS zone, start_us, end_us, {r3('confidence')} AS confidence FROM ep")
def airspace_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detectors.run(base.obs(spark, sf_dir), [detectors.build("no_fly_zone", zones=base.zones(spark), cfg=base.AIRSPACE)])
    return found.select(F.get("entity_ids", F.lit(0)).alias("aircraft"), F.get("entity_ids", F.lit(1)).alias("zone"), us("start_at").alias("start_us"), us("end_at").alias("end_us"), base.r3("confidence").alias("confidence"))


_ONE = "QUALIFY row_number() OVER (PARTITION BY detector_id, detection_type, entities, key_us ORDER BY start_us, severity, score) = 1"
_EXC = f"greatest({base.ALTITUDE.floor_ft}::DOUBLE - altitude_ft, altitude_ft - {base.ALTITUDE.ceiling_ft})"
_ALTITUDES = f"SELECT 'example_altitude' AS detector_id, 'altitude_out_of_band' AS detection_type, 'aircraft:' || icao24 AS entities, us AS key_us, us AS start_us, CASE WHEN {_EXC} >= 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, least({_EXC}, 2000) AS score"
_SPOOFS = f"SELECT 'spoofing' AS detector_id, {tracking.case('gate', tracking.GATE_TYPE)} AS detection_type, 'aircraft:' || icao24 AS entities, CASE WHEN {tracking._SCOPE} = 'event' THEN start_us END AS key_us, start_us, severity, score FROM detections WHERE NOT abstains"


@query(
    f"SELECT detector_id, detection_type, entities, start_us, severity FROM (WITH {OBS} {_ALTITUDES} FROM obs WHERE {_EXC} > 0 {_ONE}) UNION ALL SELECT detector_id, detection_type, entities, start_us, severity FROM (WITH {SCORED} {_SPOOFS} {_ONE}) "
    f"UNION ALL SELECT 'proximity', 'predicted_proximity', entities, start_us, severity FROM (WITH {encounters.SLOTS} SELECT 'icao24:' || icao24_a || ',icao24:' || icao24_b AS entities, start_us, severity FROM slots) "
    f"UNION ALL SELECT 'no_fly_zone', 'restricted_airspace_incursion', entities, start_us, severity FROM (WITH {encounters.EPISODES} SELECT 'icao24:' || icao24 || ',zone:' || zone_id AS entities, start_us, {encounters.case('severity_rank', encounters._NAMES)} AS severity FROM ep)"
)
def detection_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors as JSON documents, one for each key; what the documents say is read back."""
    o = base.obs(spark, sf_dir)
    all_ = [detectors.build("example_altitude", cfg=base.ALTITUDE), detectors.build("spoofing", cfg=C, registry=base.registry(spark, sf_dir)), detectors.build("proximity", cfg=base.PROXIMITY), detectors.build("no_fly_zone", zones=base.zones(spark), cfg=base.AIRSPACE)]
    documents = sinks.as_json(detectors.replay(o, all_))
    d = documents.select(F.from_json("value", "detector_id string, detection_type string, entity_ids array<string>, start_at timestamp, severity string").alias("d")).select("d.*")
    return d.select("detector_id", "detection_type", F.array_join("entity_ids", ",").alias("entities"), us("start_at").alias("start_us"), "severity")


_UNIT = "CASE gate WHEN 'teleport_v1' THEN 'kt' WHEN 'speed_delta_v1' THEN 'kt' WHEN 'turn_rate_v1' THEN 'deg/s' WHEN 'vrate_delta_v1' THEN 'fpm' WHEN 'nic_floor_v1' THEN 's' WHEN 'pingpong_v1' THEN 'hops' WHEN 'reappear_v1' THEN 'nm' WHEN 'coexistence_v1' THEN 'km' END"
_WEAK = "array_to_string(list_filter([CASE WHEN n_reports < 3 THEN 'fewer than three reports' END, CASE WHEN quality < 1 THEN 'stated position quality is below best' END, CASE WHEN measured IS NULL THEN 'not measured' END], lambda x: x IS NOT NULL), ',')"


@query(
    f"SELECT detector_id, detection_type, entity, start_us, kind, {r3('measured')} AS measured, {r3('threshold')} AS threshold, unit, limitations, tags, hits FROM (WITH {SCORED} SELECT 'spoofing' AS detector_id, {tracking.case('gate', tracking.GATE_TYPE)} AS detection_type, 'aircraft:' || icao24 AS entity, start_us, gate AS kind, measured, threshold, {_UNIT} AS unit, {_WEAK} AS limitations, gate AS tags, hits::VARCHAR AS hits FROM detections WHERE NOT abstains) "
    f"UNION ALL SELECT * FROM (WITH {OBS} SELECT 'example_altitude', 'altitude_out_of_band', 'aircraft:' || icao24, us, CASE WHEN altitude_ft < {base.ALTITUDE.floor_ft} THEN 'BELOW_FLOOR' ELSE 'ABOVE_CEILING' END AS k, {r3('altitude_ft')}, NULL, 'ft', NULL, k, NULL FROM obs WHERE {_EXC} > 0)"
)
def detection_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings are made of: evidence, limitations, tags and metadata."""
    o = base.obs(spark, sf_dir)
    d = detectors.run(o, [detectors.build("spoofing", cfg=C, registry=base.registry(spark, sf_dir)), detectors.build("example_altitude", cfg=base.ALTITUDE)])
    e = F.get("evidence", F.lit(0))
    return d.select(
        "detector_id", "detection_type", F.get("entity_ids", F.lit(0)).alias("entity"), us("start_at").alias("start_us"), e["kind"].alias("kind"), base.r3(e["measured"]).alias("measured"), base.r3(e["threshold"]).alias("threshold"), e["unit"].alias("unit"),
        F.array_join("limitations", ",").alias("limitations"), F.array_join("tags", ",").alias("tags"), F.try_element_at("metadata", F.lit("hits")).alias("hits"),
    )


def _said(x: str, places: int) -> str:
    """SQL: a number with thousands separated."""
    return f"format('{{:,.{places}f}}', ({x})::DOUBLE)"


_PER = f"coalesce(' ' || {_UNIT}, '')"


@query(
    f"SELECT * FROM (WITH {SCORED} SELECT 'spoofing' AS detector_id, 'aircraft:' || icao24 AS entity, gate AS tag, start_us, coalesce('Measured ' || {_said('measured', 1)} || {_PER} || ', limit ' || {_said('threshold', 1)} || {_PER} || '. ', '') || 'Seen on ' || icao24 || ' for ' || {_said('duration_s', 0)} || ' s.' AS facts FROM detections WHERE NOT abstains) "
    f"UNION ALL SELECT * FROM (WITH {encounters.SLOTS} SELECT 'proximity', 'icao24:' || slots.icao24_a, 'cpa', start_us, 'Now ' || {_said('now_nm', 2)} || ' nm apart. At constant speed and track in ' || {_said('slots.t_cpa', 0)} || ' s ' || {_said('slots.pred_nm', 2)} || ' nm and ' || {_said('slots.pred_ft', 0)} || ' ft.' FROM slots JOIN sl ON sl.a.icao24 = icao24_a AND sl.b.icao24 = icao24_b AND sl.slot = slots.slot) "
    f"UNION ALL SELECT * FROM (WITH {encounters.EPISODES} SELECT 'no_fly_zone', 'icao24:' || icao24, zone_id, start_us, 'In ' || zone_id || ' for ' || {_said('(end_us - start_us) / 1e6', 0)} || ' s and ' || {_said('hits', 0)} || ' reports, peak score ' || {_said('peak_score', 3)} || '.' FROM ep)"
)
def finding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What findings say in words."""
    o = base.obs(spark, sf_dir)
    d = detectors.run(o, [detectors.build("spoofing", cfg=C, registry=base.registry(spark, sf_dir)), detectors.build("proximity", cfg=base.PROXIMITY), detectors.build("no_fly_zone", zones=base.zones(spark), cfg=base.AIRSPACE)])
    return d.select("detector_id", F.get("entity_ids", F.lit(0)).alias("entity"), F.get("tags", F.lit(0)).alias("tag"), us("start_at").alias("start_us"), F.try_element_at("metadata", F.lit("facts")).alias("facts"))


# --- detectors window by window


def _windowed_sql(sql: str, window_h: int, step_h: int) -> str:
    """The same SQL over observations whose address carries the window that they are in."""
    span, step = window_h * H, step_h * H
    windows = f"(SELECT * EXCLUDE (k) REPLACE (icao24 || '@' || (k * {step}) AS icao24) FROM (SELECT *, unnest(range((us - {span}) // {step} + 1, us // {step} + 1)) AS k FROM all_obs) WHERE k >= (SELECT min(us) // {step} FROM all_obs))"
    return sql.replace(OBS, OBS.replace("obs AS (", "all_obs AS (", 1) + f",\nobs AS {windows}")


_PLAIN, _WINDOW = "split_part(icao24, '@', 1)", "CAST(split_part(icao24, '@', 2) AS BIGINT)"


@query(f"WITH {_windowed_sql(SCORED, 24, 24)} SELECT gate, {_PLAIN} AS icao24, {_WINDOW} AS window_us, start_us, end_us, CAST(hits AS BIGINT) AS hits, score, confidence, severity FROM detections")
def windowed_spoofing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of a day judged by itself: no pair, run or episode reaches over its end."""
    w = observations.windowed(base.obs(spark, sf_dir), 86_400)
    found = episodes.consolidate(spoofing_events(w, C, "window_start"), C, "window_start")
    d = reports.scored_spoofing(found, C)
    return d.select("gate", "icao24", us("window_start").alias("window_us"), us("start_at").alias("start_us"), us("end_at").alias("end_us"), "hits", "score", "confidence", "severity")


@query(
    f"WITH {_windowed_sql(SCORED, 24, 12)}, found AS (SELECT {tracking.case('gate', tracking.GATE_TYPE)} AS detection_type, 'aircraft:' || {_PLAIN} AS entity_id, {tracking._SCOPE} AS scope, {_WINDOW} AS window_us, start_us, severity, score FROM detections WHERE NOT abstains) "
    "SELECT detection_type, entity_id, scope, window_us, start_us, severity FROM found QUALIFY row_number() OVER (PARTITION BY detection_type, entity_id, CASE WHEN scope = 'event' THEN start_us END ORDER BY window_us, start_us, severity, score) = 1"
)
def sliding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day every half day: what two of them find is given once, as the first found it."""
    found = detectors.replay(base.obs(spark, sf_dir), [detectors.build("spoofing", cfg=C)], window_s=86_400, step_s=43_200)
    return found.select("detection_type", F.get("entity_ids", F.lit(0)).alias("entity_id"), "scope", us("window_start").alias("window_us"), us("start_at").alias("start_us"), "severity")


@query(f"WITH {OBS}, w AS (SELECT DISTINCT us // {24 * H} AS k FROM obs ORDER BY k LIMIT 3) SELECT 'aircraft:' || icao24 AS entity_id, us AS start_us, us // {24 * H} * {24 * H} AS window_us, CASE WHEN {_EXC} >= 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM obs WHERE {_EXC} > 0 AND us // {24 * H} IN (SELECT k FROM w)")
def max_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three windows that hold any report."""
    found = detectors.replay(base.obs(spark, sf_dir), [detectors.build("example_altitude", cfg=base.ALTITUDE)], window_s=86_400, max_windows=3)
    return found.select(F.get("entity_ids", F.lit(0)).alias("entity_id"), us("start_at").alias("start_us"), us("window_start").alias("window_us"), "severity")


@query(f"WITH {OBS}, e AS (SELECT * FROM obs ORDER BY us, seq LIMIT 200) SELECT 'aircraft:' || icao24 AS entity_id, us AS start_us FROM e WHERE {_EXC} > 0 GROUP BY ALL")
def earliest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest 200 reports through a detector: the limit is the feature."""
    found = detectors.replay(base.obs(spark, sf_dir), [detectors.build("example_altitude", cfg=base.ALTITUDE)], limit=200)
    return found.select(F.get("entity_ids", F.lit(0)).alias("entity_id"), us("start_at").alias("start_us"))


# --- reports


_SRC = "CASE ({0}) % 4 WHEN 0 THEN 'baro' WHEN 1 THEN 'geom' WHEN 2 THEN 'baro' END"
_CATEGORY = f"CASE WHEN coalesce({_SRC.format('p_seq')}, {_SRC.format('seq')}) IS NULL OR {_SRC.format('seq + 1')} IS NULL THEN 'unresolved' WHEN {_SRC.format('p_seq')} <> {_SRC.format('seq')} THEN 'altitude switched' WHEN {_SRC.format('p_seq')} <> {_SRC.format('seq + 1')} OR {_SRC.format('seq')} <> {_SRC.format('seq + 1')} THEN 'altitude and rate differ' ELSE 'consistent' END"
_CLIMBS = f"{PAIRS}, a AS (SELECT *, {_CATEGORY} AS category, {_SRC.format('seq')} AS altitude, {_SRC.format('seq + 1')} AS rate FROM pairs WHERE abs(climb_delta_fpm) > {C.vrate_delta_fpm})"


def _climb_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions of climb, with sources that go by the reports' numbers."""
    source = lambda c: F.expr(_SRC.format(c))
    f = tracks.pair_features(tracking._segments(spark, sf_dir)).where(F.abs("climb_delta_fpm") > C.vrate_delta_fpm)
    return f.select(F.col("climb_delta_fpm").alias("measured"), reports.source_category(source("p.seq"), source("seq"), source("seq + 1")).alias("category"), source("seq").alias("altitude"), source("seq + 1").alias("rate"))


@query(f"WITH {_CLIMBS}, c AS (SELECT category, count(*) AS alerts, median(abs(climb_delta_fpm)) AS m FROM a GROUP BY 1) SELECT category, alerts, {r3('m')} AS median, {r3('100.0::DOUBLE * alerts / (SELECT sum(alerts) FROM c)')} AS percent FROM c")
def altitude_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports.source_report(_climb_alerts(spark, sf_dir))
    return r.select("category", "alerts", base.r3("median").alias("median"), base.r3("percent").alias("percent"))


@query(f"WITH {_CLIMBS} SELECT altitude, rate, count(*) AS n FROM a GROUP BY 1, 2")
def source_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.combinations(_climb_alerts(spark, sf_dir), "altitude", "rate")


@query("SELECT event_type AS cause, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY 1")
def false_positive_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.concat(F.lit("negative:"), "event_type", F.lit("-"), (F.col("event_id") % 9).cast("string")).alias("label"))
    return reports.causes(e)


_COLUMNS = ("altitude_ft", "ground_speed_kt", "nic")


@query(
    f"WITH {OBS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, {r3(f'avg({c}::DOUBLE)')} AS mean, {r3(f'stddev({c}::DOUBLE)')} AS deviation, min({c})::DOUBLE AS least, {', '.join(r3(f'quantile_cont({c}::DOUBLE, {q / 4})') + f' AS q{q}' for q in (1, 2, 3))}, max({c})::DOUBLE AS most FROM obs" for c in _COLUMNS)
)
def described_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.described(base.obs(spark, sf_dir), *_COLUMNS)
    return d.select("column", "n", *(base.r3(c).alias(c) for c in ("mean", "deviation")), "least", *(base.r3(c).alias(c) for c in ("q1", "q2", "q3")), "most")


@query("SELECT o_orderkey::VARCHAR AS run_id, o_orderstatus AS status, epoch_us(o_orderdate::TIMESTAMP) AS started_us FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, run_id LIMIT 50")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 runs of one detector: the limit is the feature."""
    o = base.table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("detector_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    return serving.latest_runs(runs, detector="1-URGENT").select("run_id", "status", us("started_at").alias("started_us"))


# --- streams


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A table written as a few files, read as a stream file by file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _in_order(rows: DataFrame, time: str, path: str, parts: int = 3) -> None:
    """Write a table as files one after the other in time, as a feed would."""
    cuts = rows.approxQuantile(time, [k / parts for k in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col(time) >= low)
        part = part if high is None else part.where(F.col(time) < high)
        part.coalesce(1).write.mode("append").parquet(path)


def _ran(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@query(f"WITH {OBS} SELECT us // {24 * H} * {24 * H} AS window_us, icao24, count(*) AS reports, {r3('max(ground_speed_kt)')} AS top_kt FROM obs GROUP BY 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows of a stream, upserted batch by batch."""
    at = scratch(spark, "stream")
    _in_order(base.obs(spark, sf_dir).withColumn("us", us("observed_at")), "us", f"{at}/in")
    counted = live.tumbling(_stream(spark, f"{at}/in"), 86_400, lateness_s=120 * 86_400)
    keyed = counted.withColumn("key", F.concat_ws("@", "icao24", us("window_start").cast("string")))
    table = sinks.VersionedTable(spark, f"{at}/out", keyed.schema)
    _ran(live.upserting(keyed, table, "key", "reports", kept=("key",)), f"{at}/check")
    return table.read().select(us("window_start").alias("window_us"), "icao24", "reports", base.r3("top_kt").alias("top_kt"))


def _streamed(spark: SparkSession, sf_dir: str, silence: bool) -> DataFrame:
    """Episodes of a stream, upserted batch by batch in a table of several buckets."""
    at = scratch(spark, "episodes")
    rows = encounters._evaluated(spark, sf_dir)
    stream_episodes.report_lists(rows, airspace_hits(rows, base.AIRSPACE)).write.parquet(f"{at}/reports")
    listed = spark.read.parquet(f"{at}/reports")
    _in_order(listed.withColumn("us", F.col("us").cast("long")), "us", f"{at}/in")
    found = stream_episodes.episodes(_stream(spark, f"{at}/in"), base.AIRSPACE, silence=silence)
    keyed = found.withColumn("key", F.concat_ws("@", "icao24", "zone_id", F.col("start_us").cast("string")))
    table = sinks.VersionedTable(spark, f"{at}/out", keyed.schema, key="key", buckets=4)
    # of one batch's rows of an episode the closing one is the last
    _ran(live.upserting(keyed, table, "key", "end_us", "hits", "rank", kept=("key",), prepare=lambda df: df.withColumn("rank", F.when(F.col("status") == "CLOSED", 1).otherwise(0))), f"{at}/check")
    return table.read()


@query(f"WITH {encounters.EPISODES} SELECT icao24, zone_id, start_us, end_us, CAST(hits AS BIGINT) AS hits, {r3('confidence')} AS confidence FROM ep")
def streaming_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incursion episodes by stateful streaming: the same as in batch."""
    return _streamed(spark, sf_dir, False).select("icao24", "zone_id", "start_us", "end_us", "hits", base.r3("confidence").alias("confidence"))


_QUIET = int((base.AIRSPACE.max_gap_s + base.AIRSPACE.feed_lateness_s) * 1e6)


@query(
    f"WITH {encounters.EPISODES}, own AS (SELECT icao24, zone_id, episode, max(rn) AS rn, max(gid) AS gid, max(us) AS end_us FROM c GROUP BY ALL), "
    "seen AS (SELECT s.icao24, us, rn, gid FROM states s JOIN num USING (seq)), last AS (SELECT icao24, max(us) AS last_us, max(gid) AS last_gid FROM seen GROUP BY icao24), "
    "after AS (SELECT o.icao24, o.zone_id, o.episode, count(s.rn) AS clear FROM own o LEFT JOIN seen s ON s.icao24 = o.icao24 AND s.gid = o.gid AND s.rn > o.rn GROUP BY ALL) "
    f"SELECT ep.icao24, ep.zone_id, ep.start_us, CAST(ep.hits AS BIGINT) AS hits, CASE WHEN last_gid > own.gid OR clear >= {base.AIRSPACE.clear_observations_to_close} OR (SELECT max(us) FROM seen) - last_us > {_QUIET} THEN 'CLOSED' ELSE 'OPEN' END AS status "
    "FROM ep JOIN own USING (icao24, zone_id, episode) JOIN after USING (icao24, zone_id, episode) JOIN last ON last.icao24 = ep.icao24"
)
def closed_on_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream, with timers: aircraft that went quiet have their episodes closed, though they never report again."""
    return _streamed(spark, sf_dir, True).select("icao24", "zone_id", "start_us", "hits", "status")
