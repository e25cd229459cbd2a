"""Readers, sinks, values and reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from aerolith.functions import values as v
from aerolith.functions.tables import rc_to_nic
from aerolith.operators import observations, reports, serving
from aerolith.plans import detectors
from aerolith.sinks import tables as sinks
from aerolith.sources import airspace_service as service
from aerolith.sources import generators as gen
from aerolith.sources import readers

HEADER = "h,timestamp,ra,la,lo,ab,ag,gs,tr,br,gr,n,np,rc,sq,f,c,og,t\n"
LINES = [
    "A1B2C3,2026-01-01 12:00:00.250000+00:00,,37.5,-79.1,10000,10100,250.5,90,64,,8,9,186,1200, ABC1 ,A3,False,adsb_icao",
    "A1B2C3,2026-01-01T12:00:05Z,,37.5,-79.1,bad,,0,90,,128,8.0,9,0,7700,,A3,true,adsb_icao",
    "A1B2C3,2026-01-01T12:00:10Z,,,-79.1,1,1,1,1,1,1,1,1,1,,,,False,adsb_icao",
    ",2026-01-01T12:00:15Z,,37.5,-79.1,1,1,1,1,1,1,1,1,1,,,,False,adsb_icao",
    "~a1b2c,2026-01-01T12:00:15Z,,37.5,-79.1,1,1,1,1,1,1,1,1,1,,,,False,tisb_other",
    "d4e5f6,2026-01-01T12:00:20Z,,37.9,-79.0,,,,,,,,,40000,,,,,tisb_other",
    "d4e5f6,not a time,,37.9,-79.0,,,,,,,,,,,,,,adsb_icao",
]


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "rows.csv"
    p.write_text(HEADER + "\n".join(LINES) + "\n")
    return str(p)


def test_receiver_csv(spark, csv):
    rows = readers.readsb_csv(spark, csv, receiver_id="r1").orderBy("observed_at").collect()
    assert [r.icao24 for r in rows] == ["a1b2c3", "a1b2c3", "d4e5f6"]
    a, b, c = rows
    assert (a.altitude_ft, a.vertical_rate_fpm, a.nic, a.callsign, a.on_ground, a.receiver_id) == (10000.0, 64.0, 8, "ABC1", False, "r1")
    assert (b.altitude_ft, b.vertical_rate_fpm, b.nic, b.on_ground, b.ground_speed_kt, b.callsign) == (None, 128.0, 8, True, 0.0, None)
    assert (c.nic, c.on_ground) == (None, None)
    assert [r.source_row_id.rsplit(":", 1)[1] for r in rows] == ["1", "2", "6"]
    assert readers.normalization_counts(spark, csv) == {"total": 7, "normalized": 3, "skipped": 4}
    pruned = readers.pruned_csv(spark, csv, start="2026-01-01 12:00:05", end="2026-01-01 12:00:20", bbox=(37.5, 37.6, -80, -79), columns=["icao24", "altitude_ft"])
    assert pruned.columns == ["icao24", "altitude_ft"] and pruned.count() == 1


def test_superseded_csv(spark, csv):
    rows = readers.superseded_csv(spark, csv).orderBy("observed_at").collect()
    assert [(r.nic, r.altitude_ft) for r in rows] == [(8, 10100.0), (None, None)]
    nic = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 7.5, 7.6, 37040.0, 50000.0)], "rc double").select(rc_to_nic(F.col("rc"))).collect()
    assert [r[0] for r in nic] == [None, None, None, 11, 10, 1, 0]


def test_states(spark, csv, tmp_path):
    rows = readers.states(spark, csv).collect()
    assert [(r.icao24, r.alt_geom_ft, r.on_ground) for r in rows] == [("a1b2c3", 10100.0, False), ("~a1b2c", 1.0, False)]
    good = {"icao24": "ABC123", "timestamp": "2026-01-01T00:00:00Z", "lat": 37.0, "lon": -79.0, "alt_baro_ft": 100}
    p = tmp_path / "s.json"
    p.write_text(json.dumps([good, good | {"alt_baro_ft": None}, good | {"lat": 95}, good | {"nic": "x"}, good | {"unknown": 1, "on_ground": True}]))
    assert [r.on_ground for r in readers.states(spark, str(p)).collect()] == [False, True]
    (tmp_path / "t.json").write_text(json.dumps([{"icao24": "a"}]))
    with pytest.raises(ValueError, match="lacks"):
        readers.states(spark, str(tmp_path / "t.json"))


def test_zones_and_terrain(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]

    def collection(*features):
        p = tmp_path / "z.json"
        p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": x} for g, x in features]}))
        return str(p)

    base = {"zone_type": "TFR", "activation": "WINDOW"}
    rows = {r.zone_id: r for r in readers.zones(spark, collection(({"type": "Polygon", "coordinates": [ring]}, base | {"zone_id": "A"}), ({"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, base | {"zone_id": "B", "floor_ft": 5, "ceiling_ft": 100, "ceiling_datum": "FL", "active_windows": [{"start": "2026-01-01T00:00:00Z", "end": "2026-01-02T00:00:00"}]}))).collect()}
    assert (rows["A"].floor_ft, rows["A"].floor_datum, rows["A"].ceiling_ft, rows["A"].ceiling_datum) == (0.0, "SFC", float("inf"), "MSL")
    assert (rows["B"].floor_datum, rows["B"].ceiling_datum, len(rows["B"].rings)) == ("MSL", "FL", 2) and rows["B"].active_windows[0].end.day == 2
    with pytest.raises(ValueError, match="not zones"):
        readers.zones(spark, collection(({"type": "Point", "coordinates": [0, 0]}, base | {"zone_id": "C"})))
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"lat_min": 0, "lon_min": 0, "lat_step": 1, "lon_step": 1, "elevations_ft": [[1, 2], [3, None]]}))
    assert readers.terrain(spark, str(p)).first().elevations_ft[1][1] is None
    p.write_text(json.dumps({"lat_min": 0, "lon_min": 0, "lat_step": 1, "lon_step": 1, "elevations_ft": [[1, 2], [3]]}))
    with pytest.raises(ValueError, match="terrain"):
        readers.terrain(spark, str(p))


def test_reference_tables(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("mode_s_hex,n_number,manufacturer,model,type_aircraft,engine_type,max_speed_kt,ceiling_ft\nABC123,N1,X,Y,4,1,140,14000\n,N2,X,Y,4,1,1,1\n")
    assert [(r.icao24, r.max_speed_kt) for r in readers.registry(spark, str(p)).collect()] == [("abc123", 140.0)]
    p.write_text(p.read_text() + "abc123,N3,X,Y,4,1,1,1\n")
    with pytest.raises(ValueError, match="abc123"):
        readers.registry(spark, str(p))
    b = tmp_path / "b.csv"
    b.write_text("start_hex,end_hex,country\nA00000,AFFFFF,US\n0x400000,43FFFF,UK\nzz,1,??\n")
    assert sorted(r.country for r in readers.address_blocks(spark, str(b)).collect()) == ["UK", "US"]


def test_feed(spark, tmp_path):
    def f(**p):
        return {"type": "Feature", "id": "1", "geometry": {"type": "Point", "coordinates": [-79.0, 37.0]}, "properties": p}

    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f(hex="ABC123", observed_at="2026-01-01T00:00:00Z", gs="100", event_id="e1"), f(hex="abc124", observed_at="1767225600"), f(hex="", observed_at="2026-01-01T00:00:00Z"), f(hex="abc125")]}))
    rows = readers.poll(spark, str(tmp_path / "feed"), "feed", stream=False).orderBy("entity_id").collect()
    assert [(r.entity_id, r.raw_record_ref) for r in rows] == [("icao24:abc123", "e1"), ("icao24:abc124", "abc124@2026-01-01T00:00:00.000000")]
    assert readers.poll(spark, str(tmp_path / "feed"), "feed").isStreaming


def test_airspace_service(spark):
    limits = [("180", "FL", "STD", (18000.0, "FL")), ("0", "FT", "SFC", (0.0, "SFC")), ("300", "FT", "SFC", (300.0, "AGL")), ("-9998", "FT", "", (None, "MSL")), ("10", "", "UNLTD", (None, "MSL")), (None, "FT", "MSL", (None, "MSL")), ("5000", "FT", "MSL", (5000.0, "MSL"))]
    df = spark.createDataFrame([x[:3] for x in limits], "v string, u string, c string")
    got = df.select(service.limit(F.col("v"), F.col("u"), F.col("c"), ceiling=True)).collect()
    assert [tuple(r[0]) for r in got] == [x[3] for x in limits]
    times = [("0800-1700, MON-FRI; O/T BY NOTAM", "SCHEDULED", True, False), ("630 - SUNSET, DAILY, BY NOTAM; OTHER TIMES BY NOTAM", "SCHEDULED", True, True), ("INTERMITTENT, SUNRISE - SUNSET, DAILY", "SCHEDULED", False, True), ("CONTINUOUS", "ALWAYS", False, False), ("", "NOTAM", False, False), (None, "NOTAM", False, False), ("0700 - 2200 LOCAL", "SCHEDULED", False, False), ("BY NOTAM", "NOTAM", False, True)]
    t = F.col("t")
    rows = spark.createDataFrame([(x[0],) for x in times], "t string").select(service.activation(t), service.schedule(t)["unknown_outside"], service.unknown_within(t), service.schedule(t)["windows"]).collect()
    assert [tuple(r)[:3] for r in rows] == [x[1:] for x in times]
    assert rows[0][3][0].start_time == "08:00" and rows[0][3][0].weekdays == [0, 1, 2, 3, 4] and rows[1][3][0].start_time == "06:30"
    assert (rows[1][3][0].end_sunset, rows[1][3][0].end_time, rows[2][3][0].start_sunrise, rows[2][3][0].end_sunset) == (True, None, True, True)
    assert [r[3] for r in rows[3:]] == [[]] * 5
    raw = spark.createDataFrame([("Alpha", "R", "0", "FT", "SFC", "100", "FL", "STD", "CONTINUOUS", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]), ("ALPHA", "R", "5000", "FT", "MSL", "200", "FL", "STD", None, [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.00000049]]])], "NAME string, TYPE_CODE string, LOWER_VAL string, LOWER_UOM string, LOWER_CODE string, UPPER_VAL string, UPPER_UOM string, UPPER_CODE string, TIMESOFUSE string, rings array<array<array<double>>>")
    z = service.features(raw, {"R": "RESTRICTED"}, asof="2026-01-01")
    assert sorted(r.zone_id for r in z.collect()) == ["ALPHA-1", "ALPHA-2"]
    assert service.keep_local(z, 0.0, 0.0, 10.0).count() == 2 and service.keep_local(z, 50.0, 50.0, 10.0, ["alpha"]).count() == 2
    with pytest.raises(ValueError, match="NOWHERE"):
        service.keep_local(z, 0.0, 0.0, 1.0, ["nowhere"])


def test_schedule_grammar(spark):
    """Hours, days, seasons and remarks in any order; what is no such phrase has no windows."""
    said = {
        "0700-1900, SAT - SUN": ("07:00", "19:00", [5, 6], None, None, False),
        "FRI-MON, SUNRISE-2130; O/T BY NOTAM": (None, "21:30", [0, 4, 5, 6], None, None, True),
        "0600-1200, MON, WED, FRI-SAT": ("06:00", "12:00", [0, 2, 4, 5], None, None, False),
        "continuous ,  nov 3 - mar 20 ; other times by notam 24 hours ahead": (None, None, None, "11-03", "03-20", True),
        "APR 1-OCT 9, 900-1700, DAILY, INTERMITTENT": ("09:00", "17:00", None, "04-01", "10-09", False),
    }
    none = ["INTERMITTENT BY NOTAM", "0700-1900", "CONTINUOUS, DAILY", "0700-1900, 0800-0900, DAILY", "0700-1900, SOMEDAY", "SUNSET-SUNRISE, DAILY", "0700-1900, DAILY; SEE CHART", "MAY 1-SEP 15", ","]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in [*said, *none]], "t string").select(service.schedule(t)["windows"], service.schedule(t)["unknown_outside"]).collect()
    for r, want in zip(rows, said.values(), strict=False):
        w = r[0][0]
        assert (w.start_time, w.end_time, w.weekdays, w.start_month_day, w.end_month_day, r[1]) == want
        assert bool(w.all_day) == (w.start_time is None and w.end_time is None)
    assert [tuple(r) for r in rows[len(said) :]] == [([], False)] * len(none)


def test_payload_parity(spark):
    """Both payload shapes give the same observation."""
    flat = {"altitude_ft": 100.0, "vertical_rate_fpm": -64, "nic": 8, "nacp": 9, "squawk": "1200", "callsign": "AB1", "emitter_category": "A3"}
    wrapped = {"key": "k", "payload": {"alt_baro": 100, "baro_rate": -64, "nic": 8, "nac_p": 9, "squawk": "1200", "flight": " AB1 ", "category": "A3"}}
    p = v.payload_fields(F.col("p"))
    rows = spark.createDataFrame([(json.dumps(flat),), (json.dumps(wrapped),), (json.dumps({"payload": {"alt_baro": "ground"}}),), (None,), ("not json",)], "p string").select(*(c.alias(n) for n, c in p.items())).collect()
    assert rows[0] == rows[1] and (rows[2].altitude_ft, rows[2].on_ground) == (None, True)
    assert set(rows[3]) == {None} and set(rows[4]) == {None}


def test_values(spark):
    row = spark.range(1).select(v.parsed_address(F.lit("0xAB_CD ef")), v.parsed_address(F.lit("zz")), v.parsed_address(F.lit("1234567")), v.squawk(F.lit("12000")), v.integer(F.lit(" 8.9 ")), v.number(F.lit("NaN")), v.readable_callsign(F.lit(" "))).first()
    assert tuple(row) == (0xABCDEF, None, None, None, 8, None, False)


def test_upsert_and_inserts_are_idempotent(spark, tmp_path):
    found = detectors.run(gen.teleport(gen.clean_track(spark, "abc123"), 20), [detectors.build("spoofing")], dedup=True)
    first = sinks.to_rows(found, "run1", F.lit("2026-01-01").cast("timestamp"))
    n = first.count()
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), first.schema)
    assert n and table.read().count() == 0
    assert table.upsert(first) == {"inserted": n, "updated": 0}
    later = sinks.to_rows(found, "run2", F.lit("2026-02-01").cast("timestamp"))
    assert table.upsert(later) == {"inserted": 0, "updated": n}
    rows = table.read().collect()
    assert len(rows) == n and {(r.run_id, r.created_at.month, r.updated_at.month) for r in rows} == {("run2", 1, 2)}
    with pytest.raises(ValueError, match="clash"):
        sinks.to_rows(found, "x", F.current_timestamp(), F.lit(1).alias("run_id"))
    obs = observations.to_storage(gen.clean_track(spark, "abc124", points=5), "s")
    stored = sinks.VersionedTable(spark, str(tmp_path / "o"), obs.schema)
    key = ("source_id", "raw_record_ref", "observed_at")
    assert [stored.insert_new(obs, *key), stored.insert_new(obs.unionByName(obs), *key)] == [5, 0]
    assert sinks.load(stored, observations.to_storage(gen.clean_track(spark, "abc125", points=9), "s"), *key, limit=3) == 3
    assert sinks.load(stored, obs.unionByName(obs), *key, truncate=True) == 5
    back = observations.from_storage(stored.read())
    assert back.count() == 5 and back.where("altitude_ft = 33000 and callsign = 'TEST123'").count() == 5


def test_runs(spark, tmp_path):
    runs = sinks.Runs(spark, str(tmp_path / "runs"))
    runs.start("a", "spoofing", "1", ("2026-01-01", "2026-01-02"))
    assert runs.table.read().first().status == "RUNNING"
    runs.finish("a", "SUCCESS", {"inserted": 3})
    row = runs.table.read().first()
    assert (row.status, row.counts) == ("SUCCESS", {"inserted": 3}) and row.finished_at
    with pytest.raises(KeyError):
        runs.finish("b", "FAILED", {})


def test_files_and_cursor(spark, tmp_path):
    found = detectors.run(gen.teleport(gen.clean_track(spark, "abc123"), 20), [detectors.build("spoofing")])
    sinks.write_jsonl(found, str(tmp_path / "d"))
    with open(tmp_path / "d" / "bad.txt", "w") as f:
        f.write("{broken\n")
    back = readers.detections(spark, str(tmp_path / "d")).cache()
    assert back.where("_bad is null").count() == found.count() and back.where("_bad is not null").count() == 1
    sinks.write_hourly(observations.to_states(gen.clean_track(spark, "abc123")), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).where("hour = '20260101T12'").count() == 40
    t = lambda s: F.lit(s).cast("timestamp")
    start, end = sinks.window_bounds(t("2026-01-01 00:00:00"), t("2026-01-01 00:02:00"), 300, 60)
    row = spark.range(1).select(start.cast("string"), end.cast("string"), sinks.advance(t("2026-01-02"), t("2026-01-01")).cast("string")).first()
    assert tuple(row) == ("2025-12-31 23:56:00", "2026-01-01 00:01:00", "2026-01-02 00:00:00")
    with pytest.raises(ValueError, match="identifier"):
        sinks.check_identifier("a; drop")


def test_reports(spark):
    r = spark.createDataFrame([("g", True, True), ("g", False, True), ("g", True, False), ("h", False, False)], "gate string, expected boolean, fired boolean")
    got = {x.gate: x for x in reports.precision_recall(reports.confusion(r, "gate")).collect()}
    assert (got["g"].precision, got["g"].recall, got["h"].precision, got["h"].recall) == (0.5, 0.5, None, None)
    tried = spark.createDataFrame([(1.0, 0, 9, True, 5), (2.0, 1, 4, True, 5), (3.0, 2, 4, True, 5), (4.0, 3, 1, False, 5), (5.0, 4, 0, True, 4)], "setting double, place int, alerts int, guards_held boolean, positives int").withColumn("baseline_positives", F.lit(5))
    assert reports.recommend(tried).first().setting == 2.0
    assert reports.recommend(tried.where("not guards_held")).count() == 0
    causes = reports.causes(spark.createDataFrame([("negative:jitter-1",), ("negative:jitter-2",), ("negative:gap",)], "label string"))
    assert {x.cause: x.n for x in causes.collect()} == {"jitter": 2, "gap": 1}
    with pytest.raises(ValueError, match="in both"):
        reports.united(r.withColumn("k", F.lit("a")), r.withColumn("k", F.lit("a")), "k")
    with pytest.raises(ValueError, match="four sides"):
        serving.check_box(1.0, None, None, None)
    with pytest.raises(ValueError, match="inside out"):
        serving.check_box(2.0, 1.0, 0.0, 1.0)


def test_unknown_scope_is_an_error(spark):
    df = spark.range(1).select(F.lit("d").alias("detector_id"), F.lit("1").alias("detector_version"), F.lit("t").alias("detection_type"), F.array(F.lit("e")).alias("entity_ids"))
    with pytest.raises(Exception, match="unknown scope"):
        df.select(observations.dedup_key(F.lit("galaxy"), F.current_timestamp())).collect()


def test_json_arrays_stay_small(spark, tmp_path):
    """However many rows there are, no file's array holds many more than the others' share; all rows are in them."""
    from aerolith.plans import sources

    path = str(tmp_path / "arrays")
    sources._json_arrays(spark.range(400_000).select(F.col("id").alias("seq"), F.col("id").alias("x")), path)
    held = spark.read.text(path, wholetext=True).select(F.size(F.split("value", '"x"')) - 1).collect()
    assert sum(r[0] for r in held) == 400_000 and max(r[0] for r in held) < 25_000


def test_rows_of_a_file_are_not_shuffled(spark):
    """Numbering rows of CSV files deals none of them out, and states without their numbers need no counts of splits."""
    from aerolith.plans import sources

    for name, joins in (("states_source", 0), ("readsb_csv_source", 0), ("csv_row_numbers", 1)):
        plan = sources.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= joins, name
        if not joins:
            assert "Join" not in plan, name
