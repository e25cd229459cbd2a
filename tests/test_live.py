"""Tables written version by version, ticks over stored rows, the loop, and streams that close on silence."""

from __future__ import annotations

import os
import signal
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from aerolith.config import Airspace, Altitude
from aerolith.operators import observations
from aerolith.plans import detectors
from aerolith.sinks import tables as sinks
from aerolith.sources import generators
from aerolith.streaming import episodes, live

ROWS = "dedup_key string, severity string, score double"


def table_of(spark, path, **options):
    schema = spark.createDataFrame([], ROWS).schema
    return sinks.VersionedTable(spark, str(path), schema, **options)


def contents(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.mark.parametrize("buckets", [1, 5])
def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, buckets, monkeypatch):
    table = table_of(spark, tmp_path / "t", key="dedup_key", buckets=buckets)
    assert contents(table) == []
    rows = lambda *x: spark.createDataFrame(list(x), ROWS)
    assert table.upsert(rows(("a", "LOW", 1.0), ("b", "LOW", 2.0)), kept=("dedup_key",)) == {"inserted": 2, "updated": 0}
    was = contents(table)
    with monkeypatch.context() as m:
        m.setattr(sinks.VersionedTable, "_point", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.upsert(rows(("a", "HIGH", 9.0)), kept=("dedup_key",))
    assert contents(table) == was == contents(table_of(spark, tmp_path / "t", key="dedup_key", buckets=buckets))
    assert table.upsert(rows(("a", "HIGH", 9.0), ("c", "LOW", 3.0)), kept=("dedup_key",)) == {"inserted": 1, "updated": 1}
    assert contents(table) == [("a", "HIGH", 9.0), ("b", "LOW", 2.0), ("c", "LOW", 3.0)]
    # another writer of the same version cannot make it current as well
    with pytest.raises(Exception, match="exist"):
        table._fs.create(table._path(f"{table.path}/_CURRENT.{table.version()}"), False)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", key="dedup_key", buckets=8)
    table.replace(spark.range(200).select(F.col("id").cast("string").alias("dedup_key"), F.lit("LOW").alias("severity"), F.lit(1.0).alias("score")))
    before = table._folders(table.version())
    assert table.upsert(spark.createDataFrame([("7", "HIGH", 2.0)], ROWS), kept=("dedup_key",)) == {"inserted": 0, "updated": 1}
    after = table._folders(table.version())
    assert sum(after[b] != before[b] for b in before) == 1 and table.read().count() == 200
    for k in range(4):
        table.upsert(spark.createDataFrame([("7", "HIGH", float(k))], ROWS), kept=("dedup_key",))
    assert table.read().where("score = 3").count() == 1 and table.read().count() == 200
    # versions that nothing names are gone, those that hold the other buckets are not
    assert len([f for f in os.listdir(tmp_path / "t") if f.startswith("v")]) <= 3


def test_ticks_follow_the_cursor(spark, tmp_path):
    track = generators.clean_track(spark, "abc123", points=100, interval_s=10.0, altitude_ft=70_000.0).drop("seq")
    observations.to_storage(track, "s").write.parquet(str(tmp_path / "rows"))
    detector = replace(detectors.altitude(Altitude()), name="proximity")  # the cadence of that detector: 120 s every 30 s
    some = sinks.to_rows(detectors.run(track.withColumn("seq", F.lit(1)), [detector]), "r", F.current_timestamp())
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), some.schema, key="dedup_key", buckets=2)
    cursors = sinks.VersionedTable(spark, str(tmp_path / "c"), spark.createDataFrame([], "detector_id string, cursor_at timestamp").schema)
    runs = sinks.Runs(spark, str(tmp_path / "r"))
    ticks = live.Ticks(spark, detector, str(tmp_path / "rows"), table, cursors, runs)
    now = datetime(2026, 1, 1, 12, 5, tzinfo=timezone.utc)
    assert ticks.tick(now) == 0 and table.read().count() == 12  # 12:03 to 12:05, half open
    later = now + timedelta(seconds=75)
    assert ticks.bounds(later)[1] == now + timedelta(seconds=30)
    assert ticks.tick(later) == 45 and ticks.tick(later) == 15 and ticks.tick(later) == 0
    assert ticks.cursor() == later and table.read().count() == 12 + 7 or table.read().count() == 12 + 8
    n = table.read().count()
    failing = replace(detector, detect=lambda obs, *by: (_ for _ in ()).throw(RuntimeError("no")))
    bad = live.Ticks(spark, failing, str(tmp_path / "rows"), table, cursors, runs)
    with pytest.raises(RuntimeError):
        bad.tick(later + timedelta(seconds=60))
    assert ticks.cursor() == later and table.read().count() == n
    assert {r[0]: r[1] for r in runs.table.read().groupBy("status").count().collect()} == {"SUCCESS": 4, "FAILED": 1}
    with pytest.raises(ValueError):
        live.Ticks(spark, detectors.no_fly_zone(spark.createDataFrame([], "zone_id string")), "", table, cursors, runs)


def test_loop_catches_up_backs_off_and_drains():
    slept, drained = [], []
    outcomes = iter([0.0, 12.0, 100.0, None, None, None, None, None, None, 3.0])
    loop = None

    def tick():
        lag = next(outcomes)
        if lag is None:
            raise OSError("down")
        return lag

    def sleep(s):
        slept.append(s)
        if len(slept) == 10:
            os.kill(os.getpid(), signal.SIGTERM)

    loop = live.Loop(tick, 30.0, drain=lambda: drained.append(True), sleep=sleep)
    loop.run()
    assert slept == [30.0, 18.0, 0.0, 30.0, 60.0, 120.0, 240.0, 300.0, 300.0, 27.0] and drained == [True]
    assert signal.getsignal(signal.SIGTERM) == signal.SIG_DFL
    with pytest.raises(OSError):
        live.Loop(lambda: (_ for _ in ()).throw(OSError("down")), 1.0).run(once=True)


def test_quiet_aircraft_are_closed_by_the_clock(spark, tmp_path):
    """One aircraft hits and is silent, another goes on: at the clock less the lateness the first one's episode closes."""
    cfg = replace(Airspace(), max_gap_s=30.0, feed_lateness_s=120.0, seen_retention_s=600.0)
    hit = [{"zone_id": "Z", "confidence": 0.5}]
    schema = "icao24 string, us long, seq long, hits array<struct<zone_id:string,confidence:double>>"
    at = lambda s: 1_767_268_800_000_000 + s * 1_000_000
    batches = [
        [("aaa", at(s), s, hit) for s in range(0, 30, 10)] + [("bbb", at(s), 100 + s, hit) for s in range(0, 30, 10)],
        [("bbb", at(s), 100 + s, hit) for s in range(30, 120, 10)],
        [("bbb", at(s), 100 + s, hit) for s in range(120, 200, 10)],
        [("aaa", at(195), 20, hit), ("bbb", at(200), 400, hit)],
    ]
    source = str(tmp_path / "in")
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = episodes.episodes(stream, cfg)
        q = found.writeStream.outputMode("update").foreachBatch(lambda df, n, k=k: seen.extend((k, *r) for r in df.select("icao24", "start_us", "hits", "status").collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    own = [(k, start, hits, status) for k, a, start, hits, status in seen if a == "aaa"]
    # open at first; closed once the clock is 150 s past its last report, in the batch that says so; then a new one
    assert own[0] == (0, at(0), 3, "OPEN") and (2, at(0), 3, "CLOSED") in own and own[-1] == (3, at(195), 1, "OPEN")
    assert not any(status == "CLOSED" for k, _, _, status in own if k < 2)
    other = [(start, status) for k, a, start, _, status in seen if a == "bbb"]
    assert {x for x in other} == {(at(0), "OPEN")}
