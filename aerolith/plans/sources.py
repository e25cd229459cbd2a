"""Readers as queries: the driver's tables are written out in each format, read back, and held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith import schema
from aerolith.config import Spoofing
from aerolith.functions import geo
from aerolith.functions.tables import RC_TO_NIC
from aerolith.operators import airspace, episodes, gates, observations, reports
from aerolith.plans import base
from aerolith.plans.tracking import OBS, r3, us
from aerolith.sinks import tables as sinks
from aerolith.sinks.shared import scratch
from aerolith.sources import airspace_service, generators, readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- receiver files: some addresses are no addresses, some fields do not parse

_BAD_ADDRESS, _BAD_TIME, _BAD_NUMBER = "seq % 29 = 0", "seq % 31 = 0", "seq % 7 = 0"


def _receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.obs(spark, sf_dir)
    bad = lambda when, value, c: F.when(F.expr(when), value).otherwise(c.cast("string"))
    return o.select(
        bad(_BAD_ADDRESS, "zz", F.upper("icao24")).alias("h"), bad(_BAD_TIME, "soon", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"),
        bad(_BAD_NUMBER, "ground", F.col("altitude_ft")).alias("ab"), F.col("alt_geom_ft").alias("ag"), F.col("ground_speed_kt").alias("gs"), F.col("track_deg").alias("tr"), F.expr("if(seq % 5 = 0, null, vertical_rate_fpm)").alias("br"),
        F.col("vertical_rate_fpm").alias("gr"), F.concat(F.col("nic").cast("string"), F.lit(".0")).alias("n"), F.col("nacp").alias("np"), F.col("squawk").alias("sq"), F.concat(F.lit(" "), "callsign", F.lit(" ")).alias("f"),
        F.when(F.col("on_ground"), "true").otherwise("0").alias("og"), F.lit("A3").alias("c"), F.expr("if(seq % 3 = 0, 'mlat', 'adsb_icao')").alias("t"), F.expr("cast(seq % 50 * 100 as double)").alias("rc"), "seq",
    )


def _written_csv(spark: SparkSession, sf_dir: str, *, ordered: bool = False) -> str:
    path = scratch(spark, "receiver") + ".csv"
    rows = _receiver(spark, sf_dir)
    rows = rows.orderBy("seq") if ordered else rows
    rows.drop("seq").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_KEPT = f"NOT {_BAD_ADDRESS} AND NOT {_BAD_TIME}"
_BARO = f"CASE WHEN NOT {_BAD_NUMBER} THEN altitude_ft END"


@query(
    f"WITH {OBS} SELECT icao24, us, {r3('latitude')} AS latitude, {r3('longitude')} AS longitude, {r3(_BARO)} AS altitude_ft, {r3('alt_geom_ft')} AS alt_geom_ft, {r3('ground_speed_kt')} AS ground_speed_kt, track_deg, vertical_rate_fpm, CAST(nic AS INTEGER) AS nic, CAST(nacp AS INTEGER) AS nacp, squawk, callsign, 'rx-1' AS receiver_id, on_ground FROM obs WHERE {_KEPT}"
)
def readsb_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.readsb_csv(spark, _written_csv(spark, sf_dir), receiver_id="rx-1")
    return df.select("icao24", us("observed_at").alias("us"), *(base.r3(c).alias(c) for c in ("latitude", "longitude", "altitude_ft", "alt_geom_ft", "ground_speed_kt")), "track_deg", "vertical_rate_fpm", "nic", "nacp", "squawk", "callsign", "receiver_id", "on_ground")


@query(f"WITH {OBS}, n AS (SELECT *, row_number() OVER (ORDER BY seq) AS place FROM obs) SELECT place, icao24, us FROM n WHERE {_KEPT}")
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files written in order: the files' names and the numbers in them give each row's place in the whole."""
    df = readers.readsb_csv(spark, _written_csv(spark, sf_dir, ordered=True))
    file, row = F.substring_index("source_row_id", ":", 1), F.substring_index("source_row_id", ":", -1).cast("long")
    # files hold what ``orderBy`` dealt them; the rows in files before are counted from the files themselves
    whole = readers.file_rows(spark, _path_of(df)).select(F.col("path").alias("_file"), "before")
    return df.select(file.alias("_file"), row.alias("_row"), "icao24", us("observed_at").alias("us")).join(whole, "_file").select((F.col("before") + F.col("_row")).alias("place"), "icao24", "us")


def _path_of(df: DataFrame) -> list[str]:
    return df.inputFiles()


@query(f"WITH {OBS} SELECT count(*) AS total, count(*) FILTER ({_KEPT}) AS normalized, count(*) FILTER (NOT ({_KEPT})) AS skipped FROM obs")
def csv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.counted(spark, _written_csv(spark, sf_dir))


@query(f"WITH {OBS} SELECT icao24, us, {r3(_BARO)} AS altitude_ft FROM obs WHERE {_KEPT} AND us BETWEEN epoch_us(TIMESTAMP '2024-01-03 06:00:00') AND epoch_us(TIMESTAMP '2024-01-20 18:00:00') AND latitude BETWEEN 37.2 AND 37.8 AND longitude BETWEEN -78.9 AND -78.3")
def pruned_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.pruned_csv(spark, _written_csv(spark, sf_dir), start="2024-01-03 06:00:00", end="2024-01-20 18:00:00", bbox=(37.2, 37.8, -78.9, -78.3), columns=["icao24", "observed_at", "altitude_ft"])
    return df.select("icao24", us("observed_at").alias("us"), base.r3("altitude_ft").alias("altitude_ft"))


_RC = "(seq % 50 * 100)::DOUBLE"
_NIC_OF = "CASE WHEN {0} <= 0 THEN NULL ".format(_RC) + " ".join(f"WHEN {_RC} <= {most} THEN {nic}" for most, nic in RC_TO_NIC) + " ELSE 0 END"


@query(f"WITH {OBS} SELECT CASE WHEN {_BAD_ADDRESS} THEN 'zz' ELSE icao24 END AS icao24, us, {r3('alt_geom_ft')} AS altitude_ft, vertical_rate_fpm, CAST({_NIC_OF} AS INTEGER) AS nic FROM obs WHERE NOT {_BAD_TIME} AND seq % 3 <> 0")
def superseded_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.superseded_csv(spark, _written_csv(spark, sf_dir))
    return df.select("icao24", us("observed_at").alias("us"), base.r3("altitude_ft").alias("altitude_ft"), "vertical_rate_fpm", "nic")


# --- states, fixtures, stored rows, feeds


#: rows of an array: it is made and read in one piece
_ARRAY_ROWS = 20_000


def _json_arrays(rows: DataFrame, path: str, wrap: str = "{}") -> None:
    """Rows as JSON arrays, a file for each share of them: eight, or as many as keep a share near ``_ARRAY_ROWS``.

    Rows, not arrays, are shuffled: without lists of a part of each share in every task, which would hold all that it reads."""
    parts = max(8, -(-rows.count() // _ARRAY_ROWS))
    share = F.pmod(F.xxhash64("seq"), F.lit(parts))
    body = F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.to_json(F.struct(*(c for c in rows.columns if c != "seq"))))), F.lit("]"))
    before, after = wrap.split("{}")
    dealt = rows.withColumn("_share", share).repartition(parts, "_share")
    dealt.groupBy("_share").agg(F.concat(F.lit(before), body, F.lit(after)).alias("value")).write.partitionBy("_share").text(path)


@query(
    f"WITH {OBS}, k(kind) AS (VALUES ('csv'), ('json'), ('parquet')) SELECT kind, icao24, us, {r3('latitude')} AS lat, {r3('altitude_ft')} AS alt_baro_ft, CAST(nic AS INTEGER) AS nic, CAST(nacp AS INTEGER) AS nac_p, on_ground FROM obs, k "
    f"WHERE (altitude_ft IS NOT NULL OR alt_geom_ft IS NOT NULL) AND (kind <> 'csv' OR NOT ({_BAD_NUMBER}) AND NOT {_BAD_TIME}) AND (kind <> 'csv' OR NOT {_BAD_ADDRESS})"
)
def states_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from three formats; in the CSV some rows do not parse."""
    at = scratch(spark, "states")
    st = observations.to_states(base.obs(spark, sf_dir))
    st.select(*(f.name for f in schema.STATE.fields)).write.parquet(f"{at}/states.parquet")
    _json_arrays(st.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), f"{at}/states.json")
    _receiver(spark, sf_dir).where(f"not {_BAD_ADDRESS}").drop("seq", "rc", "t").write.option("header", True).csv(f"{at}/states.csv")
    out = None
    for kind in ("csv", "json", "parquet"):
        df = readers.states(spark, f"{at}/states.{kind}").select(F.lit(kind).alias("kind"), "icao24", us("timestamp").alias("us"), base.r3("lat").alias("lat"), base.r3("alt_baro_ft").alias("alt_baro_ft"), "nic", "nac_p", "on_ground")
        out = df if out is None else out.unionByName(df)
    return out


@query(f"WITH {OBS} SELECT icao24, us, {r3('altitude_ft')} AS altitude_ft, nic::INTEGER AS nic, 'guard:' || callsign AS label FROM obs")
def fixtures_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "fixtures")
    o = base.obs(spark, sf_dir).withColumns({"icao24": F.upper("icao24"), "_label": F.concat(F.lit("guard:"), "callsign"), "_note": F.lit("not in the schema"), "observed_at": F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")})
    _json_arrays(o, path)
    return readers.fixtures(spark, path).select("icao24", us("observed_at").alias("us"), base.r3("altitude_ft").alias("altitude_ft"), "nic", "label")


@query(f"WITH {OBS} SELECT 'icao24:' || icao24 AS entity_id, us, source_row_id AS raw_record_ref FROM obs WHERE us >= epoch_us(TIMESTAMP '2024-01-05 03:00:00') AND us < epoch_us(TIMESTAMP '2024-01-09 21:00:00')")
def stored_window_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "stored")
    rows = observations.to_storage(base.obs(spark, sf_dir), "events").withColumn("day", F.to_date("observed_at"))
    rows.unionByName(rows.withColumn("domain", F.lit("sea"))).write.partitionBy("day").parquet(path)
    return readers.stored_window(spark, path, "2024-01-05 03:00:00", "2024-01-09 21:00:00").select("entity_id", us("observed_at").alias("us"), "raw_record_ref")


@query(
    f"WITH {OBS} SELECT 'icao24:' || icao24 AS entity_id, us, 'feed-1' AS source_id, {r3('latitude')} AS latitude, {r3('longitude')} AS longitude, {r3('ground_speed_kt')} AS sog, track_deg AS cog, CASE WHEN seq % 2 = 0 THEN 'e' || seq ELSE icao24 || '@' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%f') END AS raw_record_ref FROM obs WHERE seq % 11 <> 0"
)
def feed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents of a poll; features without an address are dropped."""
    path = scratch(spark, "feed")
    o = base.obs(spark, sf_dir)
    properties = F.struct(
        F.expr("if(seq % 11 = 0, ' ', upper(icao24))").alias("hex"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at"), F.col("ground_speed_kt").cast("string").alias("gs"), F.col("track_deg").cast("string").alias("track"),
        F.expr("if(seq % 2 = 0, concat('e', seq), null)").alias("event_id"),
    )
    f = o.select("seq", F.concat(F.lit("f"), "seq").alias("id"), F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    _json_arrays(f, path, wrap='{"type": "FeatureCollection", "features": {}}')
    rows = readers.poll(spark, path, "feed-1", stream=False)
    return rows.select("entity_id", us("observed_at").alias("us"), "source_id", *(base.r3(c).alias(c) for c in ("latitude", "longitude", "sog")), "cog", "raw_record_ref")


# --- zones, terrain, reference dimensions

_TYPES = ("PROHIBITED", "RESTRICTED", "TFR", "WARNING", "ALERT", "MOA", "CLASS_B")
_TYPE = "CASE n_nationkey % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES)) + " END"


def _geojson_zones(spark: SparkSession, sf_dir: str) -> str:
    """One zone a nation: squares, every fifth a pair of squares; some limits and datums are left out."""
    path = scratch(spark, "zones")
    n = base.table(spark, sf_dir, "nation").withColumns({"w": F.expr("-79 + n_nationkey * 0.03"), "s": F.expr("37 + n_nationkey % 6 * 0.15"), "zone_type": F.expr(_TYPE)})
    square = lambda dx: f"array(array(array(w + {dx}, s), array(w + {dx} + 0.02, s), array(w + {dx} + 0.02, s + 0.1), array(w + {dx}, s + 0.1)))"
    flat, pair = F.struct(F.lit("Polygon").alias("type"), F.expr(square(0)).alias("coordinates")), F.struct(F.lit("MultiPolygon").alias("type"), F.expr(f"array({square(0)}, {square(0.025)})").alias("coordinates"))
    properties = F.struct(
        F.concat(F.lit("Z-"), "n_nationkey").alias("zone_id"), F.col("n_name").alias("name"), "zone_type", F.lit("ALWAYS").alias("activation"), F.expr("if(n_nationkey % 3 = 0, null, n_nationkey * 100D)").alias("floor_ft"),
        F.expr("if(n_nationkey % 2 = 0, null, 'FL')").alias("floor_datum"), F.expr("if(n_nationkey % 4 = 0, null, 9000D)").alias("ceiling_ft"),
    )
    feature = F.when(F.col("n_nationkey") % 5 == 0, F.to_json(F.struct(F.lit("Feature").alias("type"), pair.alias("geometry"), properties.alias("properties")))).otherwise(F.to_json(F.struct(F.lit("Feature").alias("type"), flat.alias("geometry"), properties.alias("properties"))))
    body = F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.concat_ws(",", F.collect_list(feature)), F.lit("]}"))
    n.groupBy((F.col("n_nationkey") % 2).alias("_share")).agg(body.alias("value")).write.partitionBy("_share").text(path)
    return path


@query(
    f"SELECT 'Z-' || n_nationkey AS zone_id, n_name AS name, {_TYPE} AS zone_type, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_nationkey * 100 END::DOUBLE AS floor_ft, CASE WHEN n_nationkey % 3 = 0 THEN 'SFC' WHEN n_nationkey % 2 = 0 THEN 'MSL' ELSE 'FL' END AS floor_datum, "
    "CASE WHEN n_nationkey % 4 = 0 THEN 'inf'::DOUBLE ELSE 9000 END AS ceiling_ft, 'MSL' AS ceiling_datum, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS rings, 'UTC' AS schedule_timezone FROM nation"
)
def zones_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = readers.zones(spark, _geojson_zones(spark, sf_dir))
    return z.select("zone_id", "name", "zone_type", "floor_ft", "floor_datum", "ceiling_ft", "ceiling_datum", F.size("rings").alias("rings"), "schedule_timezone")


_SHOWN = base.AIRSPACE.include_types


@query(f"SELECT 'Z-' || n_nationkey AS zone_id, {r3('-79 + n_nationkey * 0.03')} AS west, {r3('-79 + n_nationkey * 0.03 + 0.02 + CASE WHEN n_nationkey % 5 = 0 THEN 0.025 ELSE 0 END')} AS east, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 8 ELSE 4 END AS INTEGER) AS edges FROM nation WHERE {_TYPE} IN {_SHOWN}")
def zone_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the zones read, those of the configured types, with bounds and edges."""
    z = airspace.prepared(readers.zones(spark, _geojson_zones(spark, sf_dir)), base.AIRSPACE)
    return z.select("zone_id", base.r3("west").alias("west"), base.r3("east").alias("east"), F.size("edges").alias("edges"))


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of five by five from the 25 nations."""
    path = scratch(spark, "terrain")
    n = base.table(spark, sf_dir, "nation").select(F.expr("n_nationkey div 5").alias("i"), F.struct((F.col("n_nationkey") % 5).alias("j"), (F.col("n_nationkey") * 250.0).alias("e")).alias("x"))
    rows = n.groupBy("i").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("r")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("elevations_ft"))
    rows.select(F.lit(37.1).alias("lat_min"), F.lit(-78.9).alias("lon_min"), F.lit(0.2).alias("lat_step"), F.lit(0.2).alias("lon_step"), "elevations_ft").write.json(path)
    return readers.terrain(spark, path)


_TY, _TX = "((latitude - 37.1) / 0.2)", "((longitude - -78.9) / 0.2)"
_TI, _TJ = f"least(floor({_TY}), 3)", f"least(floor({_TX}), 3)"
GROUND = f"""{OBS},
on_grid AS (SELECT *, {_TY} - {_TI} AS fy, {_TX} - {_TJ} AS fx, ({_TI} * 5 + {_TJ}) * 250.0::DOUBLE AS e FROM obs WHERE {_TY} >= 0 AND {_TX} >= 0 AND {_TY} <= 4 AND {_TX} <= 4),
ground AS (SELECT *, (e * (1 - fx) + (e + 250.0::DOUBLE) * fx) * (1 - fy) + ((e + 1250.0::DOUBLE) * (1 - fx) + (e + 1500.0::DOUBLE) * fx) * fy AS elevation_ft FROM on_grid)"""


def _over_ground(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    grid = _terrain(spark, sf_dir)  # one row
    df = base.obs(spark, sf_dir).join(F.broadcast(grid.select(F.struct(*grid.columns).alias("_grid"))))
    return df, geo.bilinear(F.col("_grid"), F.col("latitude"), F.col("longitude"))


@query(f"WITH {GROUND} SELECT seq, {r3('elevation_ft')} AS elevation_ft FROM ground")
def terrain_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, elevation = _over_ground(spark, sf_dir)
    return df.select("seq", base.r3(elevation).alias("elevation_ft")).where("elevation_ft is not null")


@query(f"WITH {GROUND} SELECT icao24, us, {r3('altitude_ft')} AS altitude_ft, {r3('elevation_ft - altitude_ft')} AS depth_ft FROM ground WHERE elevation_ft - altitude_ft > 0")
def subterrain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, elevation = _over_ground(spark, sf_dir)
    return gates.subterrain(df, elevation).select("icao24", us("observed_at").alias("us"), base.r3("altitude_ft").alias("altitude_ft"), base.r3("depth_ft").alias("depth_ft"))


@query("SELECT CAST(n_nationkey * 4096 AS BIGINT) AS lo, CAST(n_nationkey * 4096 + 4095 AS BIGINT) AS hi, n_name AS country FROM nation WHERE n_nationkey % 6 <> 5")
def address_blocks_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in hexadecimal; those that end before they begin are dropped."""
    path = scratch(spark, "blocks")
    n = base.table(spark, sf_dir, "nation")
    n.select(F.hex(F.col("n_nationkey") * 4096).alias("start_hex"), F.expr("if(n_nationkey % 6 = 5, '', hex(n_nationkey * 4096 + 4095))").alias("end_hex"), F.col("n_name").alias("country")).write.option("header", True).csv(path)
    return readers.address_blocks(spark, path)


@query("SELECT lpad(lower(to_hex(s_suppkey + 10485760)), 6, '0') AS icao24, s_name AS model, (s_suppkey % 7 * 20)::DOUBLE AS max_speed_kt, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 5 * 1000 + 1500)::DOUBLE END AS ceiling_ft FROM supplier WHERE s_suppkey % 9 <> 0")
def registry_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "registry")
    s = base.table(spark, sf_dir, "supplier")
    address = F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.lpad(F.hex(F.col("s_suppkey") + 10485760), 6, "0"))
    s.select(address.alias("mode_s_hex"), F.col("s_name").alias("model"), (F.col("s_suppkey") % 7 * 20).cast("double").alias("max_speed_kt"), F.expr("if(s_suppkey % 4 = 0, 'unknown', cast(s_suppkey % 5 * 1000 + 1500 as string))").alias("ceiling_ft")).write.option("header", True).csv(path)
    return readers.registry(spark, path).select("icao24", "model", "max_speed_kt", "ceiling_ft")


# fixed values: limits as published (value, unit, code) and what they mean as a ceiling; times of use and their activation
_LIMITS = [("180", "FL", "STD", "18000.0", "FL"), ("0", "FT", "SFC", "0.0", "SFC"), ("300", "FT", "SFC", "300.0", "AGL"), ("-9998", "FT", "", "NULL", "MSL"), ("5000", "FT", "MSL", "5000.0", "MSL"), ("", "FT", "MSL", "NULL", "MSL")]
_TIMES = [("0800-1700, MON-FRI; O/T BY NOTAM", "SCHEDULED", 1, True, False), ("INTERMITTENT, SUNRISE - SUNSET, DAILY", "SCHEDULED", 1, False, True), ("CONTINUOUS", "ALWAYS", 0, False, False), ("BY NOTAM", "NOTAM", 0, False, True), ("0700 - 2200 LOCAL", "SCHEDULED", 0, False, False)]


def _of(table: list, place: int, by: str) -> str:
    def shown(x) -> str:
        return "true" if x is True else "false" if x is False else f"'{x}'" if isinstance(x, str) and x != "NULL" and not x[:1].isdigit() else str(x)

    return f"CASE {by} % {len(table)} " + " ".join(f"WHEN {k} THEN {shown(row[place])}" for k, row in enumerate(table)) + " END"


@query(
    f"SELECT s_name || '' AS name, {_of(_LIMITS, 3, 's_suppkey')}::DOUBLE AS ceiling_ft, {_of(_LIMITS, 4, 's_suppkey')} AS ceiling_datum, {_of(_TIMES, 1, 's_suppkey')} AS activation, CAST({_of(_TIMES, 2, 's_suppkey')} AS INTEGER) AS windows, {_of(_TIMES, 3, 's_suppkey')} AS unknown_outside_schedule, {_of(_TIMES, 4, 's_suppkey')} AS unknown_within_schedule, upper(s_name) AS zone_id FROM supplier"
)
def airspace_service_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the airspace service as zones."""
    s = base.table(spark, sf_dir, "supplier")

    def pick(table: list, place: int) -> Column:
        return F.get(F.array(*(F.lit(row[place]) for row in table)), (F.col("s_suppkey") % len(table)).cast("int"))

    raw = s.select(
        F.col("s_name").alias("NAME"), F.lit("R").alias("TYPE_CODE"), F.lit("0").alias("LOWER_VAL"), F.lit("FT").alias("LOWER_UOM"), F.lit("SFC").alias("LOWER_CODE"), pick(_LIMITS, 0).alias("UPPER_VAL"), pick(_LIMITS, 1).alias("UPPER_UOM"),
        pick(_LIMITS, 2).alias("UPPER_CODE"), pick(_TIMES, 0).alias("TIMESOFUSE"), F.expr("array(array(array(-79D, 37D), array(-78.9D, 37D), array(-78.9D, 37.1D)))").alias("rings"), F.col("s_name").alias("_shown"),
    )
    z = airspace_service.features(raw, {"R": "RESTRICTED"}, asof="2024-01-01")
    names = s.select(F.upper("s_name").alias("name"), F.col("s_name").alias("_shown"))
    z = z.join(names, "name")
    return z.select(F.col("_shown").alias("name"), "ceiling_ft", "ceiling_datum", "activation", F.size("recurring_windows").alias("windows"), "unknown_outside_schedule", "unknown_within_schedule", "zone_id")


_LOW, _TOP = base.ALTITUDE.floor_ft, base.ALTITUDE.ceiling_ft


@query(f"WITH {OBS} SELECT 'aircraft:' || icao24 AS entity, us AS start_us, CASE WHEN greatest({_LOW} - altitude_ft, altitude_ft - {_TOP}) >= 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN altitude_ft < {_LOW} THEN 'BELOW_FLOOR' ELSE 'ABOVE_CEILING' END AS reason, {r3('altitude_ft')} AS measured, false AS bad FROM obs WHERE altitude_ft < {_LOW} OR altitude_ft > {_TOP} UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true FROM range(3)")
def detections_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON lines and read back, evidence included; lines that do not parse are marked."""
    from aerolith.plans import detectors

    path = scratch(spark, "findings")
    found = detectors.altitude(base.ALTITUDE).detect(base.obs(spark, sf_dir))
    sinks.write_jsonl(found, f"{path}/run=1")
    spark.range(3).select(F.concat(F.lit('{"detector_id": "x", '), F.col("id").cast("string")).alias("value")).write.text(f"{path}/run=2")
    d = readers.detections(spark, path)
    return d.select(F.get("entity_ids", F.lit(0)).alias("entity"), us("start_at").alias("start_us"), "severity", F.get("evidence", F.lit(0))["kind"].alias("reason"), base.r3(F.get("evidence", F.lit(0))["measured"]).alias("measured"), F.col("_bad").isNotNull().alias("bad"))


@query(f"WITH {OBS} SELECT strftime(observed_at, '%Y%m%dT%H') AS hour, count(*) AS states, {r3('max(altitude_ft)')} AS highest_ft FROM obs WHERE altitude_ft IS NOT NULL OR alt_geom_ft IS NOT NULL GROUP BY 1")
def hourly_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States written by hour, twice over in two appends, and the folder read back."""
    path = scratch(spark, "hourly")
    st = observations.to_states(base.obs(spark, sf_dir))
    for part in ("seq % 2 = 0", "seq % 2 = 1"):
        sinks.write_hourly(st.where(part), path)
    return readers.hourly(spark, path).groupBy("hour").agg(F.count("*").alias("states"), base.r3(F.max("alt_baro_ft")).alias("highest_ft"))


def _results(spark: SparkSession) -> DataFrame:
    cfg = Spoofing()
    o = generators.labelled(spark)
    scored = reports.scored_spoofing(episodes.consolidate(gates.spoofing_events(o.drop("label"), cfg), cfg), cfg)
    return reports.fixture_results(o, scored.where("not abstains"))


# fixed values: tracks of the evaluation by kind; every rule's positives and guards are found, nothing else is
_TRACKS = [("guard", 6), ("negative", 9), ("positive", 7)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}::BIGINT, {n if k != 'negative' else 0}::BIGINT, {n if k != 'negative' else 0}::BIGINT)" for k, n in _TRACKS) + ") t(kind, tracks, fired, right_rule)")
def generated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixtures of the evaluation with the documented thresholds: how many of each kind are found, and by the rule that they are made for."""
    del sf_dir
    r = _results(spark)
    return r.groupBy("kind").agg(F.count("*").alias("tracks"), F.count_if("fired").alias("fired"), F.count_if(F.expr("array_contains(gates, gate)")).alias("right_rule"))


@query("SELECT 13::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 9::BIGINT AS tn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall")
def fixture_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    del sf_dir
    return reports.precision_recall(reports.confusion(_results(spark)))
