"""Merkle fixity audit of WARC archives.

A replica is a table of records: archive, offset, length, digest.  A record's
leaf is its digest; ordered offset ranges of ``RANGE`` bytes hash the offset,
length and digest of the records that begin in them; every ``FAN`` nodes in order
hash into a node of the level above, up to one root an archive.  Roots of two
replicas are compared, and only the children of differing nodes are looked at,
level by level, down to the records that were changed, are missing or are extra.

Archives are read record by record: Spark's text reader cuts files, compressed ones
too, where one record ends and the next begins, so a file of any size streams
through its tasks, and one that is not compressed is split among several.  Where
what it cuts is shorter than its record says (an archive within an archive), the
pieces of that file are put together again in order, one file a task.

Ranges bound what is gathered for one hash (``RANGE`` over the shortest record),
and a tree is grouped by archive and range, so an archive may hold any share of
the rows.  Null digests, lengths or offsets count as the word ``null``; rows with
a null archive form an archive of that name.  Repeated records are counted before
they are hashed, as often as they occur, and records of one offset are compared as a
sorted list of digest and length.  An empty replica has no roots: all of the other
one's archives differ.  Very long records are hashed whole.  Results have columns of
their own only, so other columns of the records may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm.scratch import stored
from aerolith.sinks.shared import scratch

RANGE = 1 << 16
FAN = 16
LEVELS = 3


# --- WARC files


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers (lower-cased names) and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        stop = end + 4 + size
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not {size} bytes long")
        yield at, stop + 4 - at, headers, data[end + 4 : stop]
        at = stop + 4


def write_warc(records: list[tuple[str, bytes]]) -> bytes:
    """A WARC file of resource records."""
    out = []
    for uri, block in records:
        out.append(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return b"".join(out)


#: where one record ends and the next begins
_CUT, _OPEN = b"\r\n\r\nWARC/1.", b"WARC/1."
_RECORD = "path string, block long, local long, spanned long, length long, uri string, digest string, whole boolean"


def _record(data: bytes | bytearray, strict: bool) -> tuple[int, str | None, str] | None:
    """Length, address and digest of a record without its opening; None if it is cut short, or, unless ``strict``, no record."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[bytes(name).strip().lower()] = bytes(value).strip()
    try:
        size = int(headers[b"content-length"])
    except (KeyError, ValueError):
        if strict:
            raise ValueError("a record without a length") from None
        return None
    have = len(data) - end - 4
    if have < size:
        return None
    # the last record of a file keeps its end
    if data[end + 4 + size :] not in (b"", b"\r\n\r\n"):
        if strict:
            raise ValueError(f"a record of {size} bytes has {have}")
        return None
    uri = headers.get(b"warc-target-uri")
    return len(_OPEN) + end + 4 + size + 4, uri.decode("utf-8", "replace") if uri is not None else None, hashlib.sha256(data[end + 4 : end + 4 + size]).hexdigest()


def _opened(data: bytes, first: bool, path: str) -> bytes:
    if first and not data.startswith(_OPEN):
        raise ValueError(f"{path} does not begin with a record")
    return data[len(_OPEN) :] if first else data


def _each(batches):
    """One row a piece; ``local`` is its place in the split, whatever the pieces hold."""
    now, at = None, 0
    for batch in batches:
        out: list[tuple] = []
        for path, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (path, block) != now:
                now, at = (path, block), 0
            first = block == 0 and at == 0
            found = _record(_opened(data, first, path), False)
            out.append((path, block, at if first else at - len(_OPEN), len(data) + len(_CUT), *(found or (None, None, None)), found is not None))
            at += len(data) + len(_CUT)
        yield _rows(out)


def _put_together(batches):
    """Over the pieces of whole files in order: one row a record."""
    now, at, begin, held = None, 0, 0, bytearray()
    for batch in batches:
        out: list[tuple] = []
        for path, _, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if path != now:
                if held:
                    raise ValueError(f"{now} ends within a record")
                now, at, held = path, 0, bytearray()
            if held:
                held += _CUT + data
            else:
                begin, held = (at - len(_OPEN) if at else 0), bytearray(_opened(data, at == 0, path))
            at += len(data) + len(_CUT)
            if found := _record(held, True):
                out.append((path, 0, begin, 0, *found, True))
                held = bytearray()
        yield _rows(out)
    if held:
        raise ValueError(f"{now} ends within a record")


def _rows(rows: list[tuple]):
    import pyarrow as pa

    kinds = [("path", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("spanned", pa.int64()), ("length", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("whole", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def write_archives(dealt: DataFrame, path: str, *by: str) -> None:
    """dealt: ``by``, archive, place (order in the archive), uri, block; the rows of an archive lie in one partition.  A compressed
    WARC file of resource records for each archive, in the folder ``archive=`` of its name, below those of ``by``.  The records of
    an archive stream through their task."""
    header = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), "uri", F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    ordered = dealt.sortWithinPartitions(*by, "archive", "place").select(*by, "archive", F.concat(header, "block").alias("value"))
    # the end of a record is what separates lines
    ordered.write.partitionBy(*by, "archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_replica(spark: SparkSession, path: str, *, named: str = "([^/]+)$") -> DataFrame:
    """Records of all WARC files under ``path``, plain or compressed: archive (what ``named`` finds in the path: the file name),
    offset (of the plain bytes), length, uri, digest."""
    pieces = spark.read.option("lineSep", _CUT.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))
    found = stored(pieces.mapInArrow(_each, _RECORD), "records")
    torn = found.where("not whole").select("path").distinct()
    # a split's records lie behind those of the splits before it; a few rows a file
    behind = found.groupBy("path", "block").agg(F.sum("spanned").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = found.join(torn, "path", "left_anti").join(behind.withColumn("before", before).drop("bytes"), ["path", "block"])
    if torn.limit(1).count():
        ordered = pieces.withColumn("id", F.monotonically_increasing_id()).join(torn, "path", "left_semi").repartition("path").sortWithinPartitions("path", "block", "id")
        again = ordered.select("path", "block", "data").mapInArrow(_put_together, _RECORD)
        out = out.unionByName(again.withColumn("before", F.lit(0).cast("long")))
    return out.select(F.regexp_extract("path", named, 1).alias("archive"), (F.col("before") + F.col("local")).alias("offset"), "length", "uri", "digest")


# --- trees


def _digest(parts) -> F.Column:
    return F.sha2(F.array_join(parts, "\n").cast("binary"), 256)


def _text(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def _keyed(records: DataFrame, range_bytes: int) -> DataFrame:
    return records.select(
        _text("archive").alias("archive"),
        F.col("offset").cast("long").alias("offset"),
        F.floor(F.coalesce(F.col("offset"), F.lit(0)) / range_bytes).cast("long").alias("node"),
        F.col("length").cast("long").alias("length"),
        _text("digest").alias("digest"),
    )


def tree(records: DataFrame, levels: int, *, range_bytes: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """Nodes (archive, node, hash) from level 0, the ranges, to ``levels``."""
    line = F.concat_ws(":", _text("offset"), _text("length"), "digest")
    # repeated records become one line with their number, so copies never gather in one group
    keyed = _keyed(records, range_bytes).groupBy("archive", "node", "offset", line.alias("line")).agg(F.count("*").alias("n"))
    leaf = F.struct("offset", F.when(F.col("n") == 1, F.col("line")).otherwise(F.concat_ws("*", "line", F.col("n").cast("string"))).alias("line"))
    out = [stored(keyed.groupBy("archive", "node").agg(F.sort_array(F.collect_list(leaf)).alias("x")).select("archive", "node", _digest(F.transform("x", lambda x: x["line"])).alias("hash")), "ranges")]
    for _ in range(levels):
        child = F.struct("node", "hash")
        up = out[-1].groupBy("archive", F.floor(F.col("node") / fan).cast("long").alias("above")).agg(F.sort_array(F.collect_list(child)).alias("x"))
        out.append(up.select("archive", F.col("above").alias("node"), _digest(F.transform("x", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))).alias("hash")))
    return out


def needed_levels(records: DataFrame, *, range_bytes: int = RANGE, fan: int = FAN) -> int:
    most = _keyed(records, range_bytes).agg(F.max("node")).first()[0] or 0
    levels = 0
    while most > 0:
        most //= fan
        levels += 1
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    on = ["archive", "node"]
    return a.withColumnRenamed("hash", "hash_a").join(b.withColumnRenamed("hash", "hash_b"), on, "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(a: DataFrame, b: DataFrame, *, range_bytes: int = RANGE, fan: int = FAN, levels: int = 0) -> DataFrame:
    """archive, offset, length, status (changed, missing from b, extra in b), digests and roots for every place whose records differ."""
    levels = max(levels, needed_levels(a, range_bytes=range_bytes, fan=fan), needed_levels(b, range_bytes=range_bytes, fan=fan))
    one, two = tree(a, levels, range_bytes=range_bytes, fan=fan), tree(b, levels, range_bytes=range_bytes, fan=fan)
    roots = stored(_differing(one[-1], two[-1]), "roots")
    bad = roots.select("archive", "node")
    for x, y in zip(one[-2::-1], two[-2::-1], strict=True):
        parents = bad.withColumnRenamed("node", "above")
        down = [t.withColumn("above", F.floor(F.col("node") / fan).cast("long")).join(parents, ["archive", "above"], "left_semi").drop("above") for t in (x, y)]
        bad = _differing(*down).select("archive", "node")
    bad = stored(bad, "branches")
    # records of differing ranges; those alike on both sides, times included, drop out
    sides = []
    for side, records in (("a", a), ("b", b)):
        own = _keyed(records, range_bytes).join(bad, ["archive", "node"], "left_semi").groupBy("archive", "offset", "digest", "length").agg(F.count("*").alias("n"))
        listed = F.sort_array(F.collect_list(F.struct("digest", "length", "n")))
        sides.append(own.groupBy("archive", "offset").agg(listed.alias(f"list_{side}")))
    x, y = sides
    found = x.join(y.withColumnsRenamed({"archive": "_archive", "offset": "_offset"}), (F.col("archive") == F.col("_archive")) & F.col("offset").eqNullSafe(F.col("_offset")), "full")
    found = found.where(~F.col("list_a").eqNullSafe(F.col("list_b")))
    for side in ("a", "b"):
        times = F.flatten(F.transform(f"list_{side}", lambda x: F.array_repeat(x["digest"], x["n"].cast("int"))))
        found = found.withColumns({f"digest_{side}": F.when(F.col(f"list_{side}").isNotNull(), F.array_join(times, ",")), f"length_{side}": F.array_max(F.transform(f"list_{side}", lambda x: x["length"]))})
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    found = found.select(F.coalesce("archive", "_archive").alias("archive"), F.coalesce("offset", "_offset").alias("offset"), F.coalesce("length_a", "length_b").alias("length"), status.alias("status"), "digest_a", "digest_b")
    tops = roots.groupBy("archive").agg(F.max("hash_a").alias("root_a"), F.max("hash_b").alias("root_b"))
    return found.join(tops, "archive", "left")


# --- the pages table as archives

PER_ARCHIVE = 1000
#: bytes of a record besides its block, its address and the digits of its length
_FRAME = len(write_warc([("", b"")])) - 1


def page_replicas(pages: DataFrame) -> DataFrame:
    """Records (replica, archive, place, uri, block) of archives of ``PER_ARCHIVE`` pages in order, as they were (a) and as a damaged
    replica holds them (b): in one of 97 the first character was overwritten, every fourth archive lost its end, and behind every
    fifth lies a stray copy.  Pages are shuffled once, by archive; the replicas part after it."""
    html, at = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("page_id"), F.lit(0)) % PER_ARCHIVE
    archive = F.coalesce(F.floor(F.col("page_id") / PER_ARCHIVE), F.lit(-1))
    own = pages.select("page_id", archive.alias("archive"), at.alias("at"), F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ").alias("uri"), html.alias("block")).repartition("archive")
    hit = (F.col("page_id") % 97 == 13) & (F.octet_length(F.substring("block", 1, 1)) == 1)
    held = F.when(hit, F.concat(F.lit("#"), F.substring("block", 2, 1 << 30))).otherwise(F.col("block"))
    own = own.withColumns({"digest": F.sha2(F.col("block").cast("binary"), 256), "held": held})

    def record(replica: str, stray: int, block: str):
        return F.struct(F.lit(replica).alias("replica"), F.struct(F.lit(stray).alias("stray"), "page_id", "digest").alias("place"), F.col(block).alias("block"))

    lost, again = (F.col("archive") % 4 == 1) & (F.col("at") >= 990), (F.col("archive") % 5 == 2) & (F.col("at") == 3)
    records = F.array_compact(F.array(record("a", 0, "block"), F.when(~lost, record("b", 0, "held")), F.when(again, record("b", 1, "held"))))
    return own.select("archive", "uri", F.explode(records).alias("r")).select("r.replica", "archive", "r.place", "uri", "r.block")


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas are written as archives, read record by record, and audited."""
    path = scratch(spark, "replicas")
    write_archives(page_replicas(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), path, "replica")
    sides = (read_replica(spark, f"{path}/replica={name}", named="archive=([^/]+)").select("archive", "offset", "length", "digest") for name in "ab")
    return audit(*(stored(s, "records") for s in sides), levels=LEVELS)


def _oracle() -> str:
    def side(name: str, source: str) -> str:
        out = f"""{name}0 AS (SELECT archive, "offset" // {RANGE} AS node, sha256(string_agg("offset" || ':' || length || ':' || digest, chr(10) ORDER BY "offset")) AS hash FROM {source} GROUP BY 1, 2)"""
        for k in range(1, LEVELS + 1):
            out += f""",
{name}{k} AS (SELECT archive, node // {FAN} AS node, sha256(string_agg(c.node || ':' || hash, chr(10) ORDER BY c.node)) AS hash FROM {name}{k - 1} c GROUP BY archive, c.node // {FAN})"""
        return out

    long = f"CAST({_FRAME} + length(CAST(octet_length(encode({{0}})) AS VARCHAR)) + octet_length(encode(uri)) + octet_length(encode({{0}})) AS BIGINT)"
    order = "PARTITION BY archive ORDER BY stray, page_id NULLS FIRST, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH n AS (SELECT page_id, coalesce(page_id // {PER_ARCHIVE}, -1) AS n, coalesce(page_id, 0) % {PER_ARCHIVE} AS k, translate(coalesce(url, ''), chr(13) || chr(10), '  ') AS uri, coalesce(html, '') AS block, sha256(coalesce(html, '')) AS place FROM pages),
d AS (SELECT *, CAST(n AS VARCHAR) AS archive, CASE WHEN page_id % 97 = 13 AND octet_length(encode(substr(block, 1, 1))) = 1 THEN '#' || substr(block, 2) ELSE block END AS held FROM n),
ra AS (SELECT archive, 0 AS stray, page_id, place, {long.format('block')} AS length, place AS digest FROM d),
rb AS (SELECT archive, stray, page_id, place, {long.format('held')} AS length, sha256(held) AS digest FROM (SELECT *, 0 AS stray FROM d WHERE NOT (n % 4 = 1 AND k >= 990) UNION ALL SELECT *, 1 FROM d WHERE n % 5 = 2 AND k = 3)),
a AS (SELECT *, CAST(coalesce(sum(length) OVER ({order}), 0) AS BIGINT) AS "offset" FROM ra),
b AS (SELECT *, CAST(coalesce(sum(length) OVER ({order}), 0) AS BIGINT) AS "offset" FROM rb),
{side("x", "a")},
{side("y", "b")}
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a."offset", b."offset") AS "offset", coalesce(a.length, b.length) AS length, CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status, a.digest AS digest_a, b.digest AS digest_b, r.hash AS root_a, s.hash AS root_b
FROM a FULL JOIN b ON a.archive = b.archive AND a."offset" = b."offset" LEFT JOIN x{LEVELS} r ON r.archive = coalesce(a.archive, b.archive) LEFT JOIN y{LEVELS} s ON s.archive = coalesce(a.archive, b.archive)
WHERE a.digest IS DISTINCT FROM b.digest OR a.length IS DISTINCT FROM b.length
"""


OP6_SQL = _oracle()
