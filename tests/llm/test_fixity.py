from __future__ import annotations

import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from aerolith.llm import fixity as fx

RECORD = "archive string, offset long, length long, digest string"


def rows(n, archive="a", size=1000):
    return [(archive, k * size, size, f"d{k}") for k in range(n)]


def found(spark, a, b, **options):
    df = fx.audit(spark.createDataFrame(a, RECORD), spark.createDataFrame(b, RECORD), **options)
    return sorted((r.archive, r.offset, r.status) for r in df.collect())


def test_locates_every_kind_of_damage(spark):
    a = rows(900) + rows(40, "b") + rows(30, "same")
    b = [r for r in a if (r[0], r[1]) != ("a", 5000)]
    b = [(x, o, n, "bad" if (x, o) in {("a", 700_000), ("b", 0)} else d) for x, o, n, d in b] + [("b", 90_000, 10, "new"), ("c", 0, 1, "z")]
    assert found(spark, a, b, range_bytes=8000, fan=4) == [("a", 5000, "missing"), ("a", 700_000, "changed"), ("b", 0, "changed"), ("b", 90_000, "extra"), ("c", 0, "extra")]
    assert found(spark, a, a) == []


def test_nulls_repeats_and_empty(spark):
    a = [("a", 0, 5, "x"), ("a", 0, 5, "x"), (None, None, None, None), ("a", 5, None, "y")]
    assert found(spark, a, a) == []
    assert found(spark, a, a[1:]) == [("a", 0, "changed")]
    assert [s for *_, s in found(spark, a, [])] == ["missing"] * 3
    assert found(spark, [], []) == []


def test_only_differing_branches_are_followed(spark):
    a, b = (spark.createDataFrame(x, RECORD) for x in (rows(500), [("a", o, n, "bad" if o == 123_000 else d) for _, o, n, d in rows(500)]))
    one, two = fx.tree(a, 3, range_bytes=4000, fan=8), fx.tree(b, 3, range_bytes=4000, fan=8)
    assert [fx._differing(x, y).count() for x, y in zip(one, two, strict=True)] == [1, 1, 1, 1]


def test_warc_round_trip(spark, tmp_path):
    records = [("http://a/", b"one"), ("http://b/", b"WARC/1.0\r\n\r\nnot a record"), ("http://c/", b"")]
    data = fx.write_warc(records)
    parsed = list(fx.parse_warc(data))
    assert [(h["warc-target-uri"], block) for _, _, h, block in parsed] == records and parsed[-1][0] + parsed[-1][1] == len(data)
    with pytest.raises(ValueError, match="byte"):
        list(fx.parse_warc(data[:-1] + b"x"))
    for name, content in (("one", data), ("two", data.replace(b"one", b"onE"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(content)
    a, b = (fx.read_replica(spark, str(tmp_path / n)) for n in ("one", "two"))
    assert [(r.archive, r.offset, r.status) for r in fx.audit(a, b).collect()] == [("x.warc", 0, "changed")]


@pytest.mark.parametrize("split", [1 << 27, 700])
def test_archives_of_any_size_and_compression(spark, tmp_path, split):
    """Splits of a few records, one member a record when compressed, blocks that look like records."""
    rng = random.Random(7)
    records = [(f"http://a/{k}", bytes(rng.choice(b"ab\r\n W") for _ in range(rng.randint(0, 300)))) for k in range(60)]
    tricky = [*records[:20], ("http://t/", b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), ("http://u/", b"\r\n\r\nWARC/1.1"), *records[20:]]
    files = {"plain.warc": records, "tricky.warc": tricky, "zipped.warc.gz": records, "tricky.warc.gz": tricky}
    for name, own in files.items():
        data = fx.write_warc(own)
        if name.endswith(".gz"):
            ends = [at + n for at, n, _, _ in fx.parse_warc(data)]
            data = b"".join(gzip.compress(data[a:b]) for a, b in zip([0, *ends], ends, strict=False))
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {}
        for r in fx.read_replica(spark, str(tmp_path)).collect():
            got.setdefault(r.archive, []).append((r.offset, r.length, r.uri, r.digest))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, own in files.items():
        want = [(at, n, h["warc-target-uri"], hashlib.sha256(block).hexdigest()) for at, n, h, block in fx.parse_warc(fx.write_warc(own))]
        assert sorted(got[name]) == want


def test_records_at_one_offset_are_compared_whole(spark):
    a = [("a", 0, 5, "x"), ("a", 0, 9, "x")]
    assert found(spark, a, [("a", 0, 4, "x"), ("a", 0, 9, "x")]) == [("a", 0, "changed")]
    assert found(spark, a, a[::-1]) == []


def test_query_against_sql(spark, tmp_path):
    pages = spark.range(3500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") % 50 != 3, F.repeat(F.concat(F.lit("é"), F.col("id").cast("string")), 40)).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(None, None, "lost id"), (None, "u\r\nv", None)], "page_id long, url string, html string"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(fx.OP6_SQL)
    got = fx.op6_merkle_fixity(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
