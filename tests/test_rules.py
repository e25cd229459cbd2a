"""Rules and detectors on tracks of our own."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from aerolith.config import Airspace, Altitude, Proximity, Spoofing
from aerolith.functions import geo
from aerolith.operators import airspace, episodes, gates, observations, proximity, tracks
from aerolith.plans import base, detectors
from aerolith.sources import generators as gen

CFG = Spoofing()


def fired(spark, obs, **options):
    return {r.gate for r in gates.spoofing_events(obs, CFG, **options).select("gate").distinct().collect()}


@pytest.fixture(scope="module")
def clean(spark):
    return gen.clean_track(spark, "abc123")


def test_clean_track_is_quiet(spark, clean):
    assert fired(spark, clean) == set()


@pytest.mark.parametrize(
    ("spoil", "gate"),
    [
        (lambda t: gen.teleport(t, 20), "teleport_v1"),
        (lambda t: gen.impossible_turn(t, 20), "turn_rate_v1"),
        (lambda t: gen.speed_lie(t, 10, 30), "speed_delta_v1"),
        (lambda t: gen.climb_lie(t, 10, 30), "vrate_delta_v1"),
        (lambda t: gen.integrity_collapse(t, 10, 25), "nic_floor_v1"),
        (lambda t: gen.impersonation(t), "coexistence_v1"),
        (lambda t: gen.impersonation(t), "pingpong_v1"),
        (lambda t: gen.silence(gen.spoiled(t, 25, 39, latitude=F.col("latitude") + 3), 8, 24), "reappear_v1"),
        (lambda t: gen.spoiled(t, 20, 39, callsign=F.lit("OTHER9")), "identity_drift_v1"),
    ],
)
def test_fires(spark, clean, spoil, gate):
    assert gate in fired(spark, spoil(clean))


@pytest.mark.parametrize("spoil", [lambda t: gen.silence(t, 8, 24), lambda t: gen.integrity_collapse(t, 10, 14), lambda t: t.where("seq < 2"), lambda t: gen.spoiled(t, 0, 39, nic=F.lit(None).cast("int"), ground_speed_kt=F.lit(None).cast("double"))])
def test_stays_quiet(spark, clean, spoil):
    assert fired(spark, spoil(clean)) == set()


def test_null_breaks_an_integrity_run(spark, clean):
    low = gen.integrity_collapse(clean, 10, 25)
    holed = gen.spoiled(low, 17, 18, nic=F.lit(None).cast("int"))
    assert gates.nic_floor(tracks.with_segments(low, 60), CFG).count() == 1
    assert gates.nic_floor(tracks.with_segments(holed, 60), CFG).where("measured > 40").count() == 0


def test_registry_mismatch(spark, clean):
    reg = spark.createDataFrame([("abc123", 60.0, 5000.0)], "icao24 string, max_speed_kt double, ceiling_ft double")
    row = gates.registry_mismatch(clean, reg, CFG).first()
    assert (row.measured, row.threshold, row.n_reports) == (420.0, 60.0, 40)
    vehicle = gen.spoiled(clean, 0, 39, ground_speed_kt=F.lit(20.0), altitude_ft=F.lit(0.0))
    assert gates.registry_mismatch(vehicle, spark.createDataFrame([("abc123", 0.0, 0.0)], reg.schema), CFG).count() == 0


def test_quantum(spark):
    def of(values):
        rows = [("a", k, float(v) if v is not None else None) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "icao24 string, seq long, altitude_ft double").withColumns({"observed_at": F.timestamp_seconds("seq"), "segment_id": F.lit(0)})
        row = tracks.altitude_quantum(df, CFG).first()
        return row.quantum_ft if row else None

    assert of([0, 100, 350, 425, None, 500]) == 25
    assert of([0, 300, 450, 900, 1050]) is None  # 150 is beyond the limit
    assert of([0, 100, 200, 300]) is None  # too few steps
    assert of([0, 3, 7, 8, 20]) is None


def test_consolidation(spark):
    rows = [("t", 0, 0, 5, 10.0), ("t", 0, 50, 60, 30.0), ("t", 0, 121, 130, 20.0), ("t", 1, 131, 140, 5.0), ("u", 0, 0, 1, None)]
    df = spark.createDataFrame(rows, "gate string, segment_id int, a int, b int, measured double").select("gate", F.lit("x").alias("icao24"), "segment_id", F.timestamp_seconds("a").alias("start_at"), F.timestamp_seconds("b").alias("end_at"), "measured", F.lit(10.0).alias("threshold"))
    got = sorted((r.gate, r.segment_id, r.measured, r.hits, r.duration_s) for r in episodes.consolidate(df, CFG).where("gate = 't'").collect())
    assert got == [("t", 0, 20.0, 1, 9.0), ("t", 0, 30.0, 2, 60.0), ("t", 1, 5.0, 1, 9.0)]


def pair(spark, gap_nm, closing, alt=(10000.0, 10000.0)):
    a = gen.clean_track(spark, "aaaaaa", lat=37.0, lon=-79.0, heading=90.0, speed_kt=300.0, altitude_ft=alt[0], points=12)
    b = gen.clean_track(spark, "bbbbbb", lat=37.0, lon=-79.0 + gap_nm / 60 / math.cos(math.radians(37)), heading=270.0 if closing else 90.0, speed_kt=300.0, altitude_ft=alt[1], points=12)
    return a.unionByName(b.withColumn("observed_at", F.timestamp_micros(F.unix_micros("observed_at") + 300_000)))


@pytest.mark.parametrize(("gap", "closing", "alt", "severity"), [(9, True, (10000.0, 10000.0), {"HIGH"}), (9, True, (10000.0, 10600.0), {"MEDIUM"}), (9, True, (10000.0, 10800.0), {"LOW"}), (9, False, (10000.0, 10000.0), set()), (60, True, (10000.0, 10000.0), set()), (9, True, (4000.0, 4000.0), set()), (9, True, (10000.0, 11500.0), set())])
def test_close_passes(spark, gap, closing, alt, severity):
    found = detectors.run(pair(spark, gap, closing, alt), [detectors.build("proximity")], dedup=True).collect()
    assert {r.severity for r in found} == severity
    assert all(r.entity_ids == ["icao24:aaaaaa", "icao24:bbbbbb"] and 0 <= r.confidence <= 1 for r in found)


def test_resample(spark):
    rows = [("a", 0, 0.5, 0.0, 350.0), ("a", 1, 4.0, 7.0, 10.0), ("a", 2, 100.0, 9.0, 10.0)]
    df = spark.createDataFrame(rows, "icao24 string, seq long, s double, altitude_ft double, track_deg double").select("*", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("observed_at"), *(F.lit(1.0).alias(c) for c in ("latitude", "longitude", "ground_speed_kt", "vertical_rate_fpm")), F.lit(8).alias("nic"), F.lit(8).alias("nacp"), F.lit(False).alias("on_ground"))
    got = {r.tick: (round(r.altitude_ft, 6), round(r.track_deg, 6)) for r in tracks.resample(df, 1.0, 30.0).collect()}
    # blended up to 4 s; 100 s is a tick of its own across too long a gap
    assert got == {1: (1.0, round((350 + 20 / 7) % 360, 6)), 2: (3.0, round((350 + 60 / 7) % 360, 6)), 3: (5.0, round((350 + 100 / 7) % 360, 6)), 4: (7.0, 10.0), 100: (9.0, 10.0)}


@pytest.fixture(scope="module")
def zones(spark):
    return base.zones(spark)


def states(spark, *rows):
    df = spark.createDataFrame([(f"a{k:05d}", *r, k) for k, r in enumerate(rows)], "icao24 string, lat double, lon double, alt_baro_ft double, alt_geom_ft double, at string, on_ground boolean, seq long")
    return df.select("icao24", F.col("at").cast("timestamp").alias("timestamp"), "lat", "lon", "alt_baro_ft", "alt_geom_ft", F.lit(None).cast("string").alias("squawk"), F.lit("N1").alias("callsign"), F.lit(8).alias("nic"), F.lit(8).alias("nac_p"), "on_ground", "seq")


def test_airspace_reasons(spark, zones):
    cfg = replace(Airspace(), off_grid_terrain_ft=None)
    at = "2024-01-08 12:00:00"  # a Monday
    rows = states(
        spark, (37.3, -78.8, 3000.0, 3000.0, at, False), (37.3, -78.8, 9000.0, 9000.0, at, False), (37.3, -78.8, 3000.0, 3000.0, at, True), (30.0, -70.0, 3000.0, 3000.0, at, False), (37.6, -78.8, 3000.0, 3000.0, "2024-02-08 12:00:00", False),
        (37.6, -78.8, 3000.0, 3000.0, at, False), (37.25, -78.2, 3000.0, 3000.0, at, False), (37.6, -78.3, 3000.0, None, at, False), (37.2, -78.8, 3000.0, 3000.0, at, False), (37.1995, -78.8, 3000.0, 3000.0, at, False),
    )
    got = {}
    for r in airspace.evaluated(rows, zones, cfg).collect():
        got.setdefault(r.seq, []).append(r.reason)
    assert got == {0: ["detection"], 1: ["vertical_clear"], 2: ["on_ground"], 3: ["no_candidate"], 4: ["zone_inactive"], 5: ["detection"], 6: ["bad_input"], 7: ["detection"], 8: ["detection"], 9: ["detection"]}
    hits = {r.seq: r for r in airspace.hits(airspace.evaluated(rows, zones, cfg), cfg).collect()}
    assert (hits[0].severity, hits[7].severity, hits[9].severity, hits[9].inside) == ("HIGH", "LOW", "INFO", False)
    assert airspace.prepared(zones, replace(cfg, include_types=())).count() == 0 and airspace.prepared(zones, replace(cfg, include_types=None)).count() == 5


def test_terrain(spark, zones):
    grid = spark.createDataFrame([(37.0, -79.0, 0.5, 0.5, [[0.0, 100.0, 200.0], [0.0, 100.0, None], [0.0, 100.0, 200.0]])], "lat_min double, lon_min double, lat_step double, lon_step double, elevations_ft array<array<double>>")
    g = F.struct(*grid.columns)
    at = [(37.0, -79.0, 0.0), (37.25, -78.75, 50.0), (37.5, -78.6, 80.0), (37.4, -78.2, None), (36.9, -79.0, None)]
    for lat, lon, want in at:
        assert grid.select(geo.bilinear(g, F.lit(lat), F.lit(lon))).first()[0] == (pytest.approx(want) if want is not None else None)
    found = detectors.run(observations.from_events(spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")), [detectors.build("no_fly_zone", zones=zones, terrain=grid)])
    assert found.count() == 0


def brute_episodes(reports, cfg):
    out, open_, last = [], {}, None
    for at, zones in reports:
        gap = last is not None and at - last > cfg.max_gap_s
        last = at
        for z in list(open_):
            if gap or z not in zones:
                open_[z]["clear"] += 1
                if gap or open_[z]["clear"] >= cfg.clear_observations_to_close:
                    out.append((z, open_[z]["start"], open_[z]["end"], open_[z]["hits"]))
                    del open_[z]
        for z in zones:
            e = open_.setdefault(z, {"start": at, "hits": 0})
            e |= {"end": at, "hits": e["hits"] + 1, "clear": 0}
    return sorted(out + [(z, e["start"], e["end"], e["hits"]) for z, e in open_.items()])


def test_episodes_batch_stream_and_brute_force(spark):
    import random

    from aerolith.streaming.episodes import Tracker

    rng, cfg = random.Random(4), Airspace()
    rows, want = [], []
    for a in range(12):
        t, seen = 0, []
        for k in range(60):
            t += rng.choice([1, 5, 20, 31, 90])
            hit = {z: rng.random() for z in "PQ" if rng.random() < 0.6}
            seen.append((t, set(hit)))
            rows.append((f"x{a}", t, a * 100 + k, hit))
        want += [(f"x{a}", *e) for e in brute_episodes(seen, cfg)]
    reports = spark.createDataFrame([(a, t, s) for a, t, s, _ in rows], "icao24 string, t long, seq long").withColumn("timestamp", F.timestamp_seconds("t"))
    numbered = episodes.report_numbers(reports, cfg)
    hit = spark.createDataFrame([(s, z, c) for _, _, s, h in rows for z, c in h.items()], "seq long, zone_id string, confidence double")
    full = numbered.join(hit, "seq").withColumns({"score": F.lit(0.5), "severity_rank": F.lit(1), "severity": F.lit("LOW"), "lat": F.lit(0.0), "lon": F.lit(0.0), "altitude_ft": F.lit(0.0), "activation": F.lit("ACTIVE")})
    got = episodes.incursions(full, cfg).select("icao24", "zone_id", F.unix_seconds("start_at"), F.unix_seconds("end_at"), "hits", F.round("confidence", 9)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    streamed = []
    for a in range(12):
        tr = Tracker(cfg)
        for name, t, _, h in rows:
            if name == f"x{a}":
                if t == 500:
                    tr = Tracker(cfg, tr.state())
                streamed += [(name, z, e["start"] // 1_000_000, e["end"] // 1_000_000, e["hits"], round(e["best"], 9)) for z, e in tr.feed(t * 1_000_000, h)]
        streamed += [(f"x{a}", z, e["start"] // 1_000_000, e["end"] // 1_000_000, e["hits"], round(e["best"], 9)) for z, e in tr.open.items()]
    assert sorted(streamed) == sorted(map(tuple, got))


def test_altitude_detector_and_keys(spark, clean):
    high = gen.spoiled(clean, 0, 1, altitude_ft=F.lit(75000.0))
    found = detectors.run(high, [detectors.build("example_altitude", cfg=Altitude())]).collect()
    assert len(found) == 2 and {r.severity for r in found} == {"HIGH"} and len({r.dedup_key for r in found}) == 2
    assert detectors.run(high.unionByName(high), [detectors.build("example_altitude")], dedup=True).count() == 2
    with pytest.raises(KeyError):
        detectors.build("none")
    with pytest.raises(ValueError, match="floor"):
        Altitude(floor_ft=5, ceiling_ft=1)
    with pytest.raises(ValueError, match="positive"):
        replace(Proximity(), grid_step_s=0)


def test_windows(spark):
    df = spark.range(0, 100, 7).select(F.timestamp_seconds("id").alias("observed_at"), "id")
    starts = lambda w, s=None: sorted({(r[0], r[1]) for r in observations.windowed(df, w, s).select(F.unix_seconds("window_start"), "id").collect()})
    times = list(range(0, 100, 7))
    assert starts(20) == sorted((t // 20 * 20, t) for t in times)
    assert starts(20, 10) == sorted((k, t) for t in times for k in range(0, 100, 10) if k <= t < k + 20)
    assert starts(5, 10) == sorted((t // 10 * 10, t) for t in times if t % 10 < 5)
    with pytest.raises(ValueError, match="positive"):
        observations.windowed(df, 0)


def test_coexistence_has_no_cross_product(spark, clean):
    plan = gates.coexistence(clean, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_proximity_geometry(spark):
    def cpa(*x):
        c = [F.lit(float(v)) for v in x]
        return spark.range(1).select(geo.time_to_cpa(*c)).first()[0]

    assert cpa(1000, 0, -10, 0, 0, 0) == 100
    assert cpa(0, 0, 0, 0, 600, -600) == 60
    assert cpa(1, 1, 0, 0, 5, 0) is None
    assert proximity.airborne(Proximity()) is not None


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_pairs_are_met_where_positions_lie(spark):
    """Reports are shuffled by track and spans by slot, never positions; nor is there a join."""
    from aerolith.plans import encounters

    found = encounters.QUERIES["candidate_pairs"](spark, "/root/testdata/sf0.001")
    assert _shuffles(found) == 2 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_ticks_of_equal_times(spark):
    """Reports of one time on a tick: each tick once, from the earliest span, with and without slots."""
    rows = [("a", t, lat, n) for n, (t, lat) in enumerate([(0, 1.0), (0, 2.0), (2, 3.0), (2, 4.0), (2, 5.0), (100, 6.0), (200, 7.0)])]
    rows += [("b", 5, 1.0, 10), ("b", 5, 2.0, 11)]
    df = spark.createDataFrame(rows, "icao24 string, t long, latitude double, seq long").withColumn("observed_at", F.timestamp_seconds("t"))
    df = df.withColumns({c: F.lit(1.0) for c in ("longitude", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm")} | {"nic": F.lit(1), "nacp": F.lit(1), "on_ground": F.lit(False)})
    want = {("a", 0): 1.0, ("a", 1): 2.5, ("a", 2): 3.0, ("a", 100): 6.0, ("a", 200): 7.0, ("b", 5): 1.0}
    for slot in (None, lambda t: F.floor(t / 2).cast("long")):
        got = tracks.resample(df, 1.0, 30.0, slot=slot).collect()
        assert len(got) == len(want) and {(r.icao24, r.tick): r.latitude for r in got} == want


def test_alerts_are_made_where_pairs_are(spark):
    """Flagged pairs and their best of each slot need no shuffle beyond those of reports and spans."""
    from aerolith.plans import encounters

    for name in ("cpa_pairs", "proximity_slots"):
        assert _shuffles(encounters.QUERIES[name](spark, "/root/testdata/sf0.001")) == 2


def test_alerts_are_not_shuffled_to_find_equal_keys(spark):
    """A pair has one alert a slot, so its key is its own; windows and a detector given twice may find the same again."""
    from aerolith.plans import encounters, serving

    assert _shuffles(serving.QUERIES["proximity_detector"](spark, "/root/testdata/sf0.001")) == _shuffles(encounters.QUERIES["proximity_slots"](spark, "/root/testdata/sf0.001"))
    obs, d = pair(spark, 9, True), detectors.build("proximity")
    keys = lambda found: sorted(r.dedup_key for r in found.select("dedup_key").collect())
    once = keys(detectors.run(obs, [d], dedup=True))
    assert once and len(once) == len(set(once)) and once == keys(detectors.run(obs, [d, d], dedup=True))
    slid = keys(detectors.replay(obs, [d], window_s=20, step_s=10))
    assert slid and len(slid) == len(set(slid))


def test_alerts_beside_other_findings(spark):
    """Of several detectors only the findings whose keys may recur are compared; none is lost or twice."""
    from aerolith.plans import encounters, serving

    obs, d = pair(spark, 9, True), detectors.build("proximity")
    low = detectors.build("example_altitude", cfg=Altitude(floor_ft=50.0, ceiling_ft=100.0))
    found = detectors.run(obs, [d, low, low], dedup=True).select("detector_id", "dedup_key").collect()
    kinds = [r.detector_id for r in found]
    assert len({r.dedup_key for r in found}) == len(found)
    assert kinds.count("example_altitude") == obs.count() and kinds.count("proximity") == detectors.run(obs, [d]).count() > 0
    plan = serving.QUERIES["detection_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" or "Aggregate" not in plan.toString().split("Union")[0]


def test_few_slots_share_a_task(spark, monkeypatch):
    """A task holds the positions of few slots at once, however few partitions the session deals by itself."""
    from aerolith.plans import encounters

    monkeypatch.setattr(tracks, "_SHARE_REPORTS", 1)
    positions = encounters._dealt(spark, "/root/testdata/sf0.001")
    slots = positions.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("slot").alias("n"))
    assert positions.select("slot").distinct().count() > 300 and slots.agg(F.max("n")).first()[0] <= 8


def test_pairs_are_not_sorted_for_their_best(spark):
    """A slot's pairs are done with block by block: no plan gathers flagged pairs, which spilled."""
    from aerolith.plans import encounters

    plan = encounters.QUERIES["proximity_slots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort ") == 1  # of the reports of a track


@pytest.mark.parametrize("block", [1, 1000, 1 << 18])
def test_alerts_in_blocks(spark, monkeypatch, block):
    """Those of the flagged pairs, however few aircraft are taken at once; each pair and slot once."""
    from aerolith.plans import encounters

    monkeypatch.setattr(proximity, "_BLOCK", block)
    sf = "/root/testdata/sf0.001"

    def rows(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())

    got = rows(proximity.alerts(encounters._dealt(spark, sf), encounters.P))
    assert got and got == rows(proximity.slots(encounters._flags(spark, sf), encounters.P))


@pytest.mark.parametrize("cfg", [Proximity(cell_size_deg=0.02, max_current_separation_nm=3.0), Proximity(alert_cooldown_s=0.0), Proximity(tiers=())])
def test_alerts_of_other_settings(spark, cfg):
    """Small cells, so that pairs change bands within a slot and lie on either side of zero; no cooldown; no tiers.  Unknown and equal values."""
    rows = [(f"a{n:02}", t, (n * 7 % 11 - 5) * 0.009 + t * 0.0007 * (n % 3 - 1), (n * 5 % 13 - 6) * 0.009, 9000.0 + n % 4 * 300, None if n % 5 == 0 else 100.0 * (n % 7 - 3), 0.0 if n % 6 < 2 else 250.0, None if n == 9 else n * 37.0 % 360, None if n % 4 == 0 else 8) for n in range(24) for t in range(0, 90, 6)]
    df = spark.createDataFrame(rows, "icao24 string, t long, latitude double, longitude double, altitude_ft double, vertical_rate_fpm double, ground_speed_kt double, track_deg double, nacp int")
    df = df.withColumns({"observed_at": F.timestamp_seconds("t"), "seq": F.col("t"), "nic": F.lit(8), "on_ground": F.lit(False), "window_start": F.timestamp_seconds(F.col("t") - F.col("t") % 45)})
    for by in ((), ("window_start",)):
        at = tracks.resample(df, cfg.grid_step_s, cfg.max_gap_s, *by, slot=proximity.slot(cfg))
        pairs = proximity.geometry(proximity.candidate_pairs(at, cfg, *by, near=True))
        want, got = ({(*(r[k] for k in (*by, "icao24_a", "icao24_b", "slot", "tick", "severity", "nacp_a", "nacp_b")), *(round(r[k], 6) for k in ("now_nm", "pred_nm", "pred_ft", "t_cpa_s", "confidence", "latitude"))) for r in df.collect()} for df in (proximity.slots(proximity.flagged(pairs, cfg), cfg, *by), proximity.alerts(at, cfg, *by)))
        assert got == want and bool(got) == bool(cfg.tiers)


def test_findings_of_pairs_are_not_sorted(spark):
    """Nor does the detector gather flagged pairs, alone or beside others (finding_facts)."""
    from aerolith.plans import serving

    obs = pair(spark, 9, True)
    plan = detectors.run(obs, [detectors.build("proximity")])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort ") == 1
    findings = serving.QUERIES["finding_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert findings.toString().count("MapInArrow") == 1


def test_stored_close_passes_are_not_sorted(spark):
    """Nor are flagged pairs gathered for rows to be stored (proximity_rows)."""
    from aerolith.plans import storage

    plan = storage.QUERIES["proximity_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort ") == 1


def test_documents_of_pairs_are_not_sorted(spark):
    """All detectors' documents (detection_json): alerts come from blocks, and go beside the rest as they are."""
    from aerolith.plans import serving

    plan = serving.QUERIES["detection_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list(struct(v" not in plan


@pytest.mark.parametrize("block", [1, 1000, 1 << 18])
def test_candidates_in_blocks(spark, monkeypatch, block):
    """Pairs of cells are those of the lists, however few aircraft meet at once, and the query lists none of a band (F1)."""
    from aerolith.plans import encounters

    plan = encounters.QUERIES["candidate_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list" not in plan
    monkeypatch.setattr(proximity, "_BLOCK", block)
    cfg = Proximity(cell_size_deg=0.02)
    # near and far, on either side of zero, on edges of cells and of the vertical limit; unknown and infinite values
    rows = [(f"a{n:02}", t, (n * 7 % 11 - 5) * 0.01 + t * 0.0007 * (n % 3 - 1), (n * 5 % 13 - 6) * 0.01, {5: None, 9: float("nan"), 12: float("inf")}.get(n, 9000.0 + n % 5 * 1000), 100.0, 250.0, 90.0, 8) for n in range(24) for t in range(0, 90, 6)]
    df = spark.createDataFrame(rows, "icao24 string, t long, latitude double, longitude double, altitude_ft double, vertical_rate_fpm double, ground_speed_kt double, track_deg double, nacp int")
    df = df.withColumns({"observed_at": F.timestamp_seconds("t"), "seq": F.col("t"), "nic": F.lit(8), "on_ground": F.lit(False), "window_start": F.timestamp_seconds(F.col("t") - F.col("t") % 45)})
    for by in ((), ("window_start",)):
        at = tracks.resample(df, cfg.grid_step_s, cfg.max_gap_s, *by, slot=proximity.slot(cfg))
        listed = proximity.candidate_pairs(at, cfg, *by).select(*by, F.col("a.icao24").alias("icao24_a"), F.col("b.icao24").alias("icao24_b"), "tick")
        want, got = (sorted(tuple(r) for r in d.collect()) for d in (listed, proximity.candidates(at, cfg, *by)))
        assert want and got == want and len(set(got)) == len(got)


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_flags_in_blocks(spark, monkeypatch, block):
    """Flagged pairs are those of the lists, with what is measured of them, and the query lists none of a band (F5)."""
    from aerolith.plans import encounters

    sf, double = "/root/testdata/sf0.001", ("now_nm", "t_cpa_s", "pred_nm", "pred_ft")
    plan = encounters.QUERIES["cpa_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list" not in plan
    monkeypatch.setattr(proximity, "_BLOCK", block)
    listed = encounters._flags(spark, sf).select(F.col("a.icao24").alias("icao24_a"), F.col("b.icao24").alias("icao24_b"), "tick", "severity", *double)
    want, got = (sorted((r.icao24_a, r.icao24_b, r.tick, r.severity, *(round(r[c], 6) for c in double)) for r in d.collect()) for d in (listed, proximity.flags(encounters._dealt(spark, sf), encounters.P)))
    assert want and got == want


@pytest.mark.parametrize("block", [1, 400, 1 << 18])
def test_blocks_meet_once(block):
    """Every two positions of a tick that may meet are in one matrix, once; blocks out of reach do not meet (F2, F3, F4, F6, F7)."""
    import numpy as np

    from aerolith.operators import slotted

    cfg, rng = Proximity(cell_size_deg=0.5, max_vertical_prefilter_ft=2000.0), np.random.default_rng(7)
    code, tick = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(150), np.arange(4)))
    here = rng.random(len(code)) < 0.7
    n = int(here.sum())
    p = {"code": code[here], "tick": tick[here], "latitude": rng.uniform(-1, 2, n), "longitude": rng.uniform(-1, 2, n), "altitude_ft": rng.uniform(0, 900, n) + code[here] % 5 * 4000.0}
    tiles = [(same, i, j) for same, runs in slotted._tiles(p, cfg, block) for i, j in runs]
    seen: dict = {}
    for same, i, j in tiles:
        for a in range(i.start, i.stop):
            for b in range(j.start, j.stop):
                if not same or p["code"][a] < p["code"][b]:
                    k = (p["tick"][a], p["tick"][b], *sorted((p["code"][a], p["code"][b])))
                    seen[k] = seen.get(k, 0) + 1
    near = {(p["tick"][a], p["tick"][b], p["code"][a], p["code"][b]) for a in range(n) for b in range(n) if p["tick"][a] == p["tick"][b] and p["code"][a] < p["code"][b] and abs(p["altitude_ft"][a] - p["altitude_ft"][b]) <= 2000 and abs(p["x"][a] - p["x"][b]) <= 1 and abs(p["y"][a] - p["y"][b]) <= 1}
    assert near and near <= seen.keys() and set(seen.values()) == {1} and all(k[0] == k[1] for k in seen)
    met = [(p["altitude_ft"][i][:, None] - p["altitude_ft"][j]) for _, i, j in tiles]
    if block < 1 << 18:
        assert max(np.abs(m).min() for m in met) <= 2001
