"""Rules on tracks: kinematics, integrity and identity.

Each rule returns events: track keys, gate, segment, the times and rows it spans, what was measured, the threshold and unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.config import Spoofing
from aerolith.functions import geo
from aerolith.functions import values as v
from aerolith.functions.scoring import fix_quality
from aerolith.functions.tables import NACP_EPU_M, lookup
from aerolith.operators.tracks import altitude_quantum, track, with_segments

EVENT = ("gate", "icao24", "segment_id", "start_at", "end_at", "dt_s", "measured", "threshold", "unit", "n_reports", "quality")


def position_error_kt(cfg: Spoofing) -> Column:
    def error(nacp: str) -> Column:
        return F.greatest(F.coalesce(lookup(F.col(nacp), NACP_EPU_M), F.lit(0.0)), F.lit(cfg.position_error_m))

    return (error("p.nacp") + error("nacp")) / F.col("dt_s") * geo.KT_PER_MPS


def speed_limit_kt(cfg: Spoofing) -> Column:
    own = F.abs("ground_speed_kt")
    return F.greatest(F.lit(cfg.speed_delta_kt), own * cfg.speed_delta_frac) + position_error_kt(cfg) + own * cfg.timing_error_s / F.col("dt_s")


def pair_gates(features: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Teleport, turn rate, speed and climb contradictions, of features with ``quantum_ft`` (null: the usual step)."""
    speed = F.col("implied_speed_kt") - position_error_kt(cfg)
    quantisation = F.coalesce("quantum_ft", F.lit(cfg.altitude_quantum_ft)) * 2 * 60 / F.col("dt_s")
    quality = fix_quality(F.col("p.nic"), F.col("nic"), F.col("p.nacp"), F.col("nacp"))
    # what is measured is worked out once for each pair, then tested
    measured = {"_speed": speed, "_limit": speed_limit_kt(cfg), "_climb": F.abs("climb_delta_fpm") - quantisation, "_quality": quality, "_start": F.col("p.observed_at")}
    pairs = features.where(F.col("dt_s") >= cfg.min_dt_s).withColumns(measured)

    def hit(gate: str, when: str, value: str, threshold: str, unit: str) -> str:
        return f"if({when}, named_struct('gate', '{gate}', 'measured', cast({value} as double), 'threshold', cast({threshold} as double), 'unit', '{unit}'), null)"

    hits = ", ".join(
        [
            hit("teleport_v1", f"_speed > {cfg.teleport_kt}D", "_speed", f"{cfg.teleport_kt}D", "kt"),
            hit("turn_rate_v1", f"abs(ground_speed_kt) >= {cfg.turn_rate_min_speed_kt}D and abs(turn_rate_dps) > {cfg.turn_rate_dps}D", "turn_rate_dps", f"{cfg.turn_rate_dps}D", "deg/s"),
            hit("speed_delta_v1", "ground_speed_kt is not null and abs(speed_delta_kt) > _limit", "speed_delta_kt", "_limit", "kt"),
            hit("vrate_delta_v1", f"abs(vertical_rate_fpm) <= {cfg.vrate_max_plausible_fpm}D and _climb > {cfg.vrate_delta_fpm}D", "_climb", f"{cfg.vrate_delta_fpm}D", "fpm"),
        ]
    )
    # one pass over the pairs: the hits of each are exploded, not tested in four scans
    found = pairs.withColumn("h", F.explode(F.expr(f"array({hits})"))).where("h is not null")
    return found.select(*by, "h.gate", "icao24", "segment_id", F.col("_start").alias("start_at"), F.col("observed_at").alias("end_at"), "dt_s", "h.measured", "h.threshold", "h.unit", F.lit(2).cast("long").alias("n_reports"), F.col("_quality").alias("quality"))


def _event(gate: str, by: tuple[str, ...], *, segment: Column, start: Column, end: Column, dt: Column, measured: Column, threshold: float | Column, unit: str | None, n: Column, quality: Column | None = None) -> list:
    return [*by, F.lit(gate).alias("gate"), "icao24", segment.cast("int").alias("segment_id"), start.alias("start_at"), end.alias("end_at"), dt.cast("double").alias("dt_s"), measured.cast("double").alias("measured"), F.lit(threshold).cast("double").alias("threshold"), F.lit(unit).alias("unit"), n.cast("long").alias("n_reports"), (F.lit(1.0) if quality is None else quality).alias("quality")]


def _none() -> Column:
    return F.lit(None)


def nic_runs(segmented: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Runs of reports whose integrity is at or below the floor; an unknown one ends a run."""
    keys = [*by, "icao24", "segment_id"]
    w = Window.partitionBy(*keys).orderBy("observed_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    low = F.coalesce(F.col("nic") <= cfg.nic_floor, F.lit(False))
    runs = segmented.withColumn("_low", low).withColumn("run", F.sum(F.when(F.col("_low"), 0).otherwise(1)).over(w)).where("_low")
    out = runs.groupBy(*keys, "run").agg(F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"), F.count("*").alias("n_reports"))
    return out.withColumn("span_s", geo.elapsed(F.col("start_at"), F.col("end_at")))


def nic_floor(segmented: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """The longest run of each segment, if long enough."""
    keys = [*by, "icao24", "segment_id"]
    long = nic_runs(segmented, cfg, *by).where((F.col("n_reports") >= 2) & (F.col("span_s") >= cfg.nic_min_duration_s))
    best = F.max_by(F.struct("start_at", "end_at", "n_reports", "span_s"), F.struct("span_s", (-F.unix_micros("start_at")).alias("o")))
    row = long.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")
    return row.select(*_event("nic_floor_v1", by, segment=F.col("segment_id"), start=F.col("start_at"), end=F.col("end_at"), dt=_none(), measured=F.col("span_s"), threshold=cfg.nic_min_duration_s, unit="s", n=F.col("n_reports")))


def hops(obs: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Consecutive reports of a track as vectors, with whether the hop is impossible and turns back on the one before."""
    w = track(*by)
    prev = F.lag(F.struct("observed_at", "latitude", "longitude")).over(w)
    df = obs.withColumn("p", prev).where("p is not null")
    dt = geo.elapsed(F.col("p.observed_at"), F.col("observed_at"))
    x, y = geo.local_xy(F.col("latitude"), F.col("longitude"), F.col("p.latitude"), F.col("p.longitude"))
    d = geo.haversine_m(F.col("p.latitude"), F.col("p.longitude"), F.col("latitude"), F.col("longitude"))
    df = df.withColumns({"dt": dt, "x": x, "y": y, "d": d}).withColumn("impossible", F.when(F.col("dt") > 0, F.col("d") / F.col("dt") > cfg.pingpong_speed_mps).otherwise(F.col("d") > 1))
    last = F.lag(F.struct("x", "y", "impossible")).over(w)
    df = df.withColumn("l", last)
    cos = (F.col("x") * F.col("l.x") + F.col("y") * F.col("l.y")) / F.nullif(F.hypot("x", "y") * F.hypot("l.x", "l.y"), F.lit(0.0))
    return df.withColumn("flips", F.coalesce(F.col("impossible") & F.col("l.impossible") & (cos <= -cfg.pingpong_reversal_cos), F.lit(False)))


def pingpong(obs: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Impossible hops to and fro, at least ``pingpong_min_hops`` in a row: one finding a track, with the longest such run."""
    w = track(*by).rowsBetween(Window.unboundedPreceding, 0)
    chain = hops(obs, cfg, *by).withColumn("chain", F.sum(F.when(F.col("flips"), 0).otherwise(1)).over(w)).where("impossible")
    runs = chain.groupBy(*by, "icao24", "chain").agg(F.count("*").alias("n"), F.min("p.observed_at").alias("start_at"), F.max("observed_at").alias("end_at")).where(F.col("n") >= cfg.pingpong_min_hops)
    best = F.max_by(F.struct("n", "start_at", "end_at"), F.struct("n", (-F.col("chain")).alias("o")))
    row = runs.groupBy(*by, "icao24").agg(best.alias("r")).select(*by, "icao24", "r.*")
    return row.select(*_event("pingpong_v1", by, segment=_none(), start=F.col("start_at"), end=F.col("end_at"), dt=_none(), measured=F.col("n"), threshold=float(cfg.pingpong_min_hops), unit="hops", n=F.col("n") + 1))


def coexistence(obs: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Two reports of one address so near in time and far apart that they cannot be one aircraft; the first pair of each track.

    A band join on time: each report meets those of its own and the next bucket of the band's length only."""
    band = cfg.coexistence_window_s
    s = geo.seconds(F.col("observed_at"))
    # times as doubles: microseconds of an epoch second are exact
    cols = [*by, "icao24", "observed_at", "latitude", "longitude", "seq"]
    left = obs.select(*cols, s.alias("s"), F.explode(F.array(F.floor(s / band), F.floor(s / band) + 1)).alias("bucket"))
    right = obs.select(*[F.col(c).alias(f"{c}_2") for c in cols], s.alias("s_2"), F.floor(s / band).alias("bucket_2"))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in (*by, "icao24")] + [F.col("bucket") == F.col("bucket_2")]
    dt = F.col("s_2") - F.col("s")
    later = (dt > 0) | ((dt == 0) & (F.col("seq_2") > F.col("seq")))
    km = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("latitude_2"), F.col("longitude_2")) / 1000
    limit = dt * (cfg.teleport_kt / geo.KT_PER_MPS / 1000) + cfg.coexistence_slack_km
    for c in on:
        later = later & c
    pairs = left.join(right, later & (dt <= band) & (km > limit)).select(*by, "icao24", "observed_at", F.col("observed_at_2").alias("end_at"), km.alias("km"), limit.alias("limit"), F.struct("observed_at", "observed_at_2", "seq", "seq_2").alias("o"))
    row = pairs.groupBy(*by, "icao24").agg(F.min_by(F.struct("observed_at", "end_at", "km", "limit"), "o").alias("r")).select(*by, "icao24", "r.*")
    return row.select(*_event("coexistence_v1", by, segment=_none(), start=F.col("observed_at"), end=F.col("end_at"), dt=_none(), measured=F.col("km"), threshold=F.col("limit"), unit="km", n=F.lit(2)))


def reappearance(segmented: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """Across the gaps between segments: further than the fastest aircraft could have come."""
    w = track(*by)
    prev = F.lag(F.struct("observed_at", "latitude", "longitude")).over(w)
    df = segmented.withColumn("p", prev).where(F.col("gap_s") > cfg.max_gap_s)
    d = geo.haversine_m(F.col("p.latitude"), F.col("p.longitude"), F.col("latitude"), F.col("longitude"))
    return df.where(d > F.col("gap_s") * cfg.reappear_speed_mps).select(
        *_event("reappear_v1", by, segment=F.col("segment_id"), start=F.col("p.observed_at"), end=F.col("observed_at"), dt=_none(), measured=d / geo.M_PER_NM, threshold=F.col("gap_s") * (cfg.teleport_kt / 3600), unit="nm", n=F.lit(2))
    )


def identity_drift(obs: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """A readable callsign that differs from the track's first; ``seen`` lists them in order."""
    del cfg
    sign = F.upper(F.trim("callsign"))
    named = obs.where(v.readable_callsign(F.col("callsign"))).withColumn("sign", sign)
    # one row a callsign and track before they are gathered
    first = named.groupBy(*by, "icao24", "sign").agg(F.min(F.struct("observed_at", "seq")).alias("o"), F.max("observed_at").alias("last"), F.count("*").alias("n"))
    rows = first.groupBy(*by, "icao24").agg(F.count("*").alias("kinds"), F.array_sort(F.collect_list(F.struct("o", "sign"))).alias("x"), F.max("last").alias("end_at"), F.sum("n").alias("n")).where("kinds > 1")
    return rows.select(*_event("identity_drift_v1", by, segment=_none(), start=F.get("x", F.lit(0))["o"]["observed_at"], end=F.col("end_at"), dt=_none(), measured=F.lit(None), threshold=_none(), unit=None, n=F.col("n")), F.transform("x", lambda e: e["sign"]).alias("seen"))


def fastest(obs: DataFrame, *by: str) -> DataFrame:
    """The fastest report of each track, the first of equals; reports without a speed do not count."""
    row = F.max_by(F.struct("observed_at", "ground_speed_kt", "altitude_ft", "seq"), F.struct("ground_speed_kt", (-F.unix_micros("observed_at")).alias("o"), (-F.col("seq")).alias("q")))
    return obs.where("ground_speed_kt is not null").groupBy(*by, "icao24").agg(row.alias("r"), F.count("*").alias("n")).select(*by, "icao24", "n", "r.*")


def country_of(addresses: DataFrame, blocks: DataFrame, address: str = "address") -> DataFrame:
    """Left range lookup of numbers in inclusive, disjoint blocks (lo, hi, country); where they overlap, the last to begin counts.

    Blocks are keyed by the address buckets that they touch, so the join is on equality and neither side is crossed."""
    width = 1 << 16
    spread = blocks.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    keyed = addresses.withColumn("_bucket", F.floor(F.col(address) / width))
    hit = (keyed["_bucket"] == spread["_bucket"]) & F.col(address).between(F.col("lo"), F.col("hi"))
    own = addresses.columns
    found = keyed.join(spread, hit, "left").select(*[keyed[c] for c in own], "lo", "country")
    return found.groupBy(*own).agg(F.max_by("country", "lo").alias("country"))


def registry_mismatch(obs: DataFrame, registry: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """The fastest report against the registered type: registry has icao24, max_speed_kt, ceiling_ft (null: unknown)."""
    rows = fastest(obs, *by).join(registry.select("icao24", "max_speed_kt", "ceiling_ft"), "icao24")
    rows = rows.where(v.parsed_address(F.col("icao24")).isNotNull())
    fast = (F.col("ground_speed_kt") > F.col("max_speed_kt") + cfg.registry_over_kt) | ((F.col("max_speed_kt") > 0) & (F.col("ground_speed_kt") > F.col("max_speed_kt") * cfg.registry_ratio))
    high = F.col("altitude_ft") > F.col("ceiling_ft") + cfg.registry_over_ft
    fast, high = F.coalesce(fast, F.lit(False)), F.coalesce(high, F.lit(False))
    rows = rows.withColumns({"fast": fast, "high": high}).where("fast or high")
    pick = lambda a, b: F.when(F.col("fast"), F.col(a)).otherwise(F.col(b))
    return rows.select(*_event("registry_mismatch_v1", by, segment=_none(), start=F.col("observed_at"), end=F.col("observed_at"), dt=_none(), measured=pick("ground_speed_kt", "altitude_ft"), threshold=pick("max_speed_kt", "ceiling_ft"), unit=None, n=F.col("n")))


def subterrain(obs: DataFrame, elevation: Column) -> DataFrame:
    """Reports below the ground, with the depth."""
    return obs.withColumn("depth_ft", elevation - F.col("altitude_ft")).where("depth_ft > 0")


# fixed values: units of what the rules measure
_UNITS = {"teleport_v1": "kt", "turn_rate_v1": "deg/s", "speed_delta_v1": "kt", "vrate_delta_v1": "fpm", "nic_floor_v1": "s", "pingpong_v1": "hops", "reappear_v1": "nm"}


def track_events(obs: DataFrame, cfg: Spoofing, *by: str) -> DataFrame:
    """The events of the rules on consecutive reports, of integrity, of to and fro, and of reappearance, in one pass.

    A track is shuffled and sorted once; its windows follow one another on that order.  Every report states what it adds to
    any rule, and one aggregation, which the same partitioning serves, makes hits and runs of it."""
    w, upto = track(*by), track(*by).rowsBetween(Window.unboundedPreceding, 0)
    carried = ("observed_at", "latitude", "longitude", "altitude_ft", "track_deg", "nic", "nacp")
    df = obs.select(*by, "icao24", "seq", "ground_speed_kt", "vertical_rate_fpm", *carried)
    df = df.withColumns({"p": F.lag(F.struct(*carried)).over(w), "row": F.row_number().over(w).cast("long")})
    x, y = geo.local_xy(F.col("latitude"), F.col("longitude"), F.col("p.latitude"), F.col("p.longitude"))
    moved = geo.haversine_m(F.col("p.latitude"), F.col("p.longitude"), F.col("latitude"), F.col("longitude"))
    df = df.withColumns({"dt_s": geo.elapsed(F.col("p.observed_at"), F.col("observed_at")), "x": x, "y": y, "distance_m": moved})
    low = F.coalesce(F.col("nic") <= cfg.nic_floor, F.lit(False))
    df = df.withColumns({"broken": F.coalesce(F.col("dt_s") > cfg.max_gap_s, F.lit(False)), "low": low, "impossible": F.when(F.col("dt_s") > 0, F.col("distance_m") / F.col("dt_s") > cfg.pingpong_speed_mps).otherwise(F.col("distance_m") > 1)})
    df = df.withColumns(
        {
            "segment_id": F.sum(F.when(F.col("broken"), 1).otherwise(0)).over(upto).cast("int"),
            "low_run": F.sum(F.when(F.col("low"), 0).otherwise(1)).over(upto),
            "l": F.lag(F.struct("x", "y", "impossible")).over(w),
        }
    )
    cos = (F.col("x") * F.col("l.x") + F.col("y") * F.col("l.y")) / F.nullif(F.hypot("x", "y") * F.hypot("l.x", "l.y"), F.lit(0.0))
    flips = F.coalesce(F.col("impossible") & F.col("l.impossible") & (cos <= -cfg.pingpong_reversal_cos), F.lit(False))
    df = df.withColumn("chain", F.sum(F.when(flips, 0).otherwise(1)).over(upto))
    df = df.withColumn("pair", F.col("p").isNotNull() & ~F.col("broken") & (F.col("dt_s") >= max(cfg.min_dt_s, 1e-9)))
    implied, climb = F.col("distance_m") / F.col("dt_s") * geo.KT_PER_MPS, (F.col("altitude_ft") - F.col("p.altitude_ft")) / F.col("dt_s") * 60
    paired = {"implied_kt": implied, "_over": implied - position_error_kt(cfg), "_limit": speed_limit_kt(cfg), "_climb": F.abs(climb - F.col("vertical_rate_fpm")), "_turn": geo.heading_delta(F.col("p.track_deg"), F.col("track_deg")) / F.col("dt_s"), "_quality": fix_quality(F.col("p.nic"), F.col("nic"), F.col("p.nacp"), F.col("nacp"))}
    df = df.withColumns({c: F.when(F.col("pair"), e) for c, e in paired.items()})
    df = df.withColumns({"_slip": F.col("implied_kt") - F.col("ground_speed_kt"), "_start": F.col("p.observed_at")})

    def fact(gate: str, when: str, *, run: str = "row", segment: str = "segment_id", start: str = "_start", dt: str = "null", measured: str = "null", threshold: str = "null", quality: str = "1D") -> str:
        parts = {"gate": f"'{gate}'", "segment_id": f"cast({segment} as int)", "run": f"cast({run} as bigint)", "start_at": start, "end_at": "observed_at", "dt_s": f"cast({dt} as double)", "measured": f"cast({measured} as double)", "threshold": f"cast({threshold} as double)", "quality": quality}
        return f"if({when}, named_struct({', '.join(f'{n!r}, {x}' for n, x in parts.items())}), null)"

    of_pair = {"dt": "dt_s", "quality": "_quality"}
    facts = [
        fact("teleport_v1", f"_over > {cfg.teleport_kt}D", measured="_over", threshold=f"{cfg.teleport_kt}D", **of_pair),
        fact("turn_rate_v1", f"abs(ground_speed_kt) >= {cfg.turn_rate_min_speed_kt}D and abs(_turn) > {cfg.turn_rate_dps}D", measured="_turn", threshold=f"{cfg.turn_rate_dps}D", **of_pair),
        fact("speed_delta_v1", "abs(_slip) > _limit", measured="_slip", threshold="_limit", **of_pair),
        # what the steps of the altitude explain comes off below
        fact("vrate_delta_v1", f"abs(vertical_rate_fpm) <= {cfg.vrate_max_plausible_fpm}D and _climb > {cfg.vrate_delta_fpm}D", measured="_climb", threshold=f"{cfg.vrate_delta_fpm}D", **of_pair),
        fact("nic_floor_v1", "low", run="low_run", start="observed_at"),
        fact("pingpong_v1", "p is not null and impossible", run="chain", segment="null"),
        fact("reappear_v1", f"broken and distance_m > dt_s * {cfg.reappear_speed_mps}D", measured=f"distance_m / {geo.M_PER_NM}D", threshold=f"dt_s * {cfg.teleport_kt / 3600}D"),
    ]
    stated = df.withColumn("f", F.explode(F.expr(f"array({', '.join(facts)})"))).where("f is not null").select(*by, "icao24", "f.*")
    most = [F.max(c).alias(c) for c in ("end_at", "dt_s", "measured", "threshold", "quality")]  # a hit is a group of one
    found = stated.groupBy(*by, "icao24", "gate", "segment_id", "run").agg(F.count("*").alias("n"), F.min("start_at").alias("start_at"), *most)

    steps = altitude_quantum(with_segments(obs.select(*by, "icao24", "observed_at", "altitude_ft", "seq"), cfg.max_gap_s, *by), cfg, *by).drop("n")
    found = found.join(steps, [*by, "icao24", "segment_id"], "left")
    is_ = lambda g: F.col("gate") == g
    span = geo.elapsed(F.col("start_at"), F.col("end_at"))
    explained = F.coalesce("quantum_ft", F.lit(cfg.altitude_quantum_ft)) * 2 * 60 / F.col("dt_s")
    measured = F.when(is_("vrate_delta_v1"), F.col("measured") - explained).when(is_("nic_floor_v1"), span).when(is_("pingpong_v1"), F.col("n").cast("double")).otherwise(F.col("measured"))
    threshold = F.when(is_("nic_floor_v1"), cfg.nic_min_duration_s).when(is_("pingpong_v1"), float(cfg.pingpong_min_hops)).otherwise(F.col("threshold"))
    found = found.withColumns({"measured": measured, "threshold": threshold})
    enough = F.when(is_("vrate_delta_v1"), F.col("measured") > cfg.vrate_delta_fpm).when(is_("nic_floor_v1"), (F.col("n") >= 2) & (F.col("measured") >= cfg.nic_min_duration_s)).when(is_("pingpong_v1"), F.col("n") >= cfg.pingpong_min_hops).otherwise(True)
    # of runs the greatest counts, the first of equals; of hits each
    runs = is_("nic_floor_v1") | is_("pingpong_v1")
    place = F.row_number().over(Window.partitionBy(*by, "icao24", "gate", "segment_id").orderBy(F.when(runs, -F.col("measured")), F.when(is_("nic_floor_v1"), F.col("start_at")), "run"))
    found = found.where(enough).withColumn("_place", place).where(~runs | (F.col("_place") == 1))
    n = F.when(is_("nic_floor_v1"), F.col("n")).when(is_("pingpong_v1"), F.col("n") + 1).otherwise(2)
    return found.select(*by, "gate", "icao24", "segment_id", "start_at", "end_at", "dt_s", "measured", "threshold", lookup(F.col("gate"), _UNITS).alias("unit"), n.cast("long").alias("n_reports"), "quality")


def spoofing_events(obs: DataFrame, cfg: Spoofing, *by: str, registry: DataFrame | None = None) -> DataFrame:
    """The events of every rule."""
    parts = [track_events(obs, cfg, *by), coexistence(obs, cfg, *by), identity_drift(obs, cfg, *by).drop("seen")]
    if registry is not None:
        parts.append(registry_mismatch(obs, registry, cfg, *by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
