"""Readers: raw receiver files, states, stored rows, feeds, fixtures, zones, terrain and reference dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith import schema
from aerolith.functions import values as v
from aerolith.functions.tables import rc_to_nic


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``source_row_id``: path and 1-based data row of each file.

    Rows are numbered within their split; what the splits before it in the file hold is added, from a count for each split, so
    a file of any size is numbered by all its tasks, and no row is shuffled for it."""
    df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_id", F.monotonically_increasing_id())
    splits = df.groupBy("_path", "_block").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    # a few rows a file: one for each split
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("_path").alias("_p"), F.col("_block").alias("_b"), "_first", before.alias("_before"))
    # every split is counted, so this keeps all rows as they are; where numbers are not asked for it is left out of the plan
    out = df.join(F.broadcast(splits), (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")), "left")
    n = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return out.withColumn("source_row_id", F.concat_ws(":", F.regexp_replace("_path", "^file:(//)?", ""), n.cast("string"))).drop("_path", "_block", "_id", "_p", "_b", "_first", "_before")


def file_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """path, rows and rows in the files before it, by name, of CSV files."""
    raw = _raw_csv(spark, files).select(F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("path"))
    counts = raw.groupBy("path").agg(F.count("*").alias("rows"))
    whole = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(whole), F.lit(0)))


def _raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # every column a string: a field that does not parse is null, it does not drop the row
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _as(schema_: T.StructType, columns: dict[str, Column]) -> list[Column]:
    return [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_.fields]


def readsb_csv(spark: SparkSession, path: str, *, receiver_id: str | None = None) -> DataFrame:
    """Receiver CSV as observations.  A bad optional field is null; rows without a valid address, time or position are dropped."""
    rows = _readsb(numbered(_raw_csv(spark, path)), receiver_id)
    return rows.where(_VALID)


#: fixed values: what makes a receiver's row an observation
_VALID = "icao24 rlike '^[0-9a-fA-F]{6}$' and observed_at is not null and latitude between -90 and 90 and longitude between -180 and 180"


def _readsb(raw: DataFrame, receiver_id: str | None = None) -> DataFrame:
    c = lambda n: _column(raw, n)
    # fixed values: the receiver's column names
    columns = {
        "icao24": F.lower(F.trim(c("h"))),
        "observed_at": F.trim(c("timestamp")).try_cast("timestamp"),
        "latitude": v.number(c("la")),
        "longitude": v.number(c("lo")),
        "altitude_ft": v.number(c("ab")),
        "alt_geom_ft": v.number(c("ag")),
        "ground_speed_kt": v.number(c("gs")),
        "track_deg": v.number(c("tr")),
        "vertical_rate_fpm": F.coalesce(v.number(c("br")), v.number(c("gr"))),
        "nic": v.integer(c("n")),
        "nacp": v.integer(c("np")),
        "squawk": v.text(c("sq")),
        "callsign": v.text(c("f")),
        "receiver_id": F.lit(receiver_id),
        "on_ground": v.boolean(c("og")),
        "emitter_category": v.text(c("c")),
        "source_row_id": c("source_row_id"),
    }
    return raw.select(*_as(schema.OBSERVATION, columns))


def counted(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows read, kept and skipped, in one scan."""
    rows = _readsb(_raw_csv(spark, path))
    kept = F.count_if(F.coalesce(F.expr(_VALID), F.lit(False)))
    return rows.agg(F.count("*").alias("total"), kept.alias("normalized"), (F.count("*") - kept).alias("skipped"))


def normalization_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows read, kept and skipped."""
    return counted(spark, path).first().asDict()


def pruned_csv(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None, bbox: tuple[float, float, float, float] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Receiver CSV: barometric altitude only, both ends of the time range and of the box (south, north, west, east) included, by time.
    Only the columns asked for are parsed."""
    df = readsb_csv(spark, path).drop("alt_geom_ft", "source_row_id")
    if start:
        df = df.where(F.col("observed_at") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("observed_at") <= F.lit(end).cast("timestamp"))
    if bbox:
        south, north, west, east = bbox
        df = df.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    return df.orderBy("observed_at").select(*(columns or df.columns))


def superseded_csv(spark: SparkSession, path: str) -> DataFrame:
    """The older CSV: direct reports only, geometric altitude, integrity from the radius of containment."""
    raw = _raw_csv(spark, path)
    c = lambda n: _column(raw, n)
    rows = raw.where(F.lower(F.trim(c("t"))) == "adsb_icao")
    columns = {
        "icao24": F.lower(F.trim(c("h"))), "observed_at": F.trim(c("timestamp")).try_cast("timestamp"), "latitude": v.number(c("la")), "longitude": v.number(c("lo")), "altitude_ft": v.number(c("ag")),
        "ground_speed_kt": v.number(c("gs")), "track_deg": v.number(c("tr")), "vertical_rate_fpm": F.coalesce(v.number(c("br")), v.number(c("gr"))), "nic": rc_to_nic(v.number(c("rc"))), "nacp": v.integer(c("np")),
        "squawk": v.text(c("sq")), "callsign": v.text(c("f")),
    }
    return rows.select(*_as(schema.OBSERVATION, columns)).where("icao24 is not null and observed_at is not null and latitude is not null and longitude is not null")


_STATE_NUMBERS = ("lat", "lon", "alt_baro_ft", "alt_geom_ft", "ground_speed_kt", "track_deg")


def states(spark: SparkSession, path: str) -> DataFrame:
    """States from CSV (receiver columns), Parquet or a JSON array, by extension.

    A number that does not parse rejects the row; so does the lack of both altitudes.  A missing column that is required is an
    error.  An unstated ground flag is false."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        raw = numbered(_raw_csv(spark, path))
        names = {"icao24": "h", "timestamp": "timestamp", "lat": "la", "lon": "lo", "alt_baro_ft": "ab", "alt_geom_ft": "ag", "ground_speed_kt": "gs", "track_deg": "tr", "callsign": "f", "squawk": "sq", "emitter_category": "c", "nic": "n", "nac_p": "np", "on_ground": "og", "source_row_id": "source_row_id"}
        df = raw.select(*(_column(raw, src).alias(dst) for dst, src in names.items()))
        missing = [s for s in ("h", "timestamp", "la", "lo") if s not in raw.columns]
    else:
        df = spark.read.parquet(path) if kind == "parquet" else spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        missing = [s for s in ("icao24", "timestamp", "lat", "lon") if s not in df.columns]
        df = df.select(*(_column(df, f.name).alias(f.name) for f in schema.STATE.fields))
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    text = {c: v.text(F.col(c).cast("string")) for c in df.columns}
    parsed = {c: v.number(text[c]) for c in (*_STATE_NUMBERS, "nic", "nac_p")} | {"timestamp": text["timestamp"].try_cast("timestamp")}
    # the filters read parsed columns and the fence: every field is parsed once, not for each mention
    df = df.select(*(t.alias(c) for c, t in text.items()), *(p.alias(f"_{c}") for c, p in parsed.items()), F.monotonically_increasing_id().alias("_fence"))
    text, parsed = {c: F.col(c) for c in text}, {c: F.col(f"_{c}") for c in parsed}
    numbers = {c: parsed[c] for c in parsed if c != "timestamp"}
    bad = F.col("_fence") < 0
    for c, n in numbers.items():
        bad = bad | (text[c].isNotNull() & n.isNull())
    df = df.where(~bad)
    columns = {c: text.get(c, F.lit(None)) for c in ("callsign", "squawk", "emitter_category", "source_row_id")} | numbers
    columns |= {"nic": numbers["nic"].cast("int"), "nac_p": numbers["nac_p"].cast("int"), "icao24": F.lower(text["icao24"]), "timestamp": parsed["timestamp"], "on_ground": F.coalesce(v.boolean(text["on_ground"]), F.lit(False))}
    out = df.select(*_as(schema.STATE, columns))
    return out.where("icao24 is not null and timestamp is not null and lat between -90 and 90 and lon between -180 and 180 and (alt_baro_ft is not null or alt_geom_ft is not null)")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of observations; annotations beside the schema are ignored but for ``_label``."""
    with_label = T.StructType([*schema.OBSERVATION.fields, T.StructField("_label", T.StringType())])
    df = spark.read.schema(with_label).option("multiLine", True).json(path)
    return df.withColumn("icao24", F.lower(F.trim("icao24"))).withColumnRenamed("_label", "label")


def stored_window(spark: SparkSession, path: str, start: str, end: str, *, domain: str = "air") -> DataFrame:
    """Stored rows of [start, end) of one domain, by entity and time; a table partitioned by ``day`` is pruned to its days."""
    df = spark.read.parquet(path)
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if "day" in df.columns:
        df = df.where((F.col("day") >= F.to_date(lo)) & (F.col("day") <= F.to_date(hi)))
    return df.where((F.col("observed_at") >= lo) & (F.col("observed_at") < hi) & (F.col("domain") == domain)).orderBy("entity_id", "observed_at")


FEED = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType([T.StructField("id", T.StringType()), T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])
            ),
        ),
    ]
)


def feed_rows(documents: DataFrame, source_id: str) -> DataFrame:
    """Feed documents (FEED's columns, batch or stream) as stored rows; features without address, position or time are dropped."""
    f = documents.select(F.explode("features").alias("f")).select("f.*")
    p = lambda k: F.element_at("properties", F.lit(k))
    hex_ = v.text(F.lower(p("hex")))
    at = F.coalesce(p("observed_at").try_cast("timestamp"), F.timestamp_seconds(v.number(p("observed_at"))))
    lon, lat = F.get("geometry.coordinates", F.lit(0)), F.get("geometry.coordinates", F.lit(1))
    df = f.select(
        at.alias("observed_at"), F.concat(F.lit("icao24:"), hex_).alias("entity_id"), F.lit("air").alias("domain"), F.lit(source_id).alias("source_id"), lat.alias("latitude"), lon.alias("longitude"),
        v.number(p("gs")).alias("sog"), v.number(p("track")).alias("cog"), F.to_json("properties").alias("payload"),
        F.coalesce(v.text(p("event_id")), F.concat_ws("@", hex_, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).alias("raw_record_ref"),
    )
    return df.where("entity_id is not null and observed_at is not null and latitude between -90 and 90 and longitude between -180 and 180")


def poll(spark: SparkSession, path: str, source_id: str, *, stream: bool = True) -> DataFrame:
    """Feed documents dropped into a folder, as stored rows; a stream by default."""
    reader = (spark.readStream if stream else spark.read).schema(FEED).option("multiLine", True)
    return feed_rows(reader.json(path), source_id)


_ZONE_PROPERTIES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("zone_id", "name", "zone_type", "activation", "floor_datum", "ceiling_datum", "schedule_timezone", "controlling_agency", "source", "source_asof")]
    + [T.StructField(n, T.DoubleType()) for n in ("floor_ft", "ceiling_ft")]
    + [T.StructField(n, T.BooleanType()) for n in ("unknown_outside_schedule", "unknown_within_schedule")]
    + [T.StructField("active_windows", T.ArrayType(T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]))), T.StructField("recurring_windows", T.ArrayType(schema.RECURRING))]
)
_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])), T.StructField("properties", _ZONE_PROPERTIES)])))])


def zones(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON zones.  Polygons and multipolygons only; a missing floor is the surface, a missing ceiling unlimited, a datum
    alone missing is MSL, and times without a zone are UTC."""
    f = spark.read.schema(_COLLECTION).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.geometry.*", "f.properties.*")
    wrong = f.where(~F.col("type").isin("Polygon", "MultiPolygon") | F.col("zone_id").isNull()).select("zone_id", "type").limit(5).collect()
    if wrong:
        raise ValueError(f"not zones: {[tuple(r) for r in wrong]}")
    polygon = F.from_json("coordinates", "array<array<array<double>>>")
    rings = F.when(F.col("type") == "Polygon", polygon).otherwise(F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>")))
    times = F.transform("active_windows", lambda w: F.struct(w["start"].cast("timestamp").alias("start"), w["end"].cast("timestamp").alias("end")))
    columns = {f.name: F.col(f.name) for f in schema.ZONE.fields if f.name != "rings"} | {
        "name": F.coalesce("name", F.lit("")),
        "floor_ft": F.coalesce("floor_ft", F.lit(0.0)),
        "floor_datum": F.when(F.col("floor_ft").isNull(), "SFC").otherwise(F.coalesce("floor_datum", F.lit("MSL"))),
        "ceiling_ft": F.coalesce("ceiling_ft", F.lit(float("inf"))),
        "ceiling_datum": F.when(F.col("ceiling_ft").isNull(), "MSL").otherwise(F.coalesce("ceiling_datum", F.lit("MSL"))),
        "rings": rings,
        "active_windows": F.coalesce(times, F.array().cast("array<struct<start:timestamp,end:timestamp>>")),
        "recurring_windows": F.coalesce("recurring_windows", F.array().cast(T.ArrayType(schema.RECURRING))),
        "schedule_timezone": F.coalesce("schedule_timezone", F.lit("UTC")),
        "unknown_outside_schedule": F.coalesce("unknown_outside_schedule", F.lit(False)),
        "unknown_within_schedule": F.coalesce("unknown_within_schedule", F.lit(False)),
        "source": F.coalesce("source", F.lit("")),
    }
    return f.select(*_as(schema.ZONE, columns))


TERRAIN = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("lat_min", "lon_min", "lat_step", "lon_step")), T.StructField("elevations_ft", T.ArrayType(T.ArrayType(T.DoubleType())))])


def terrain(spark: SparkSession, path: str) -> DataFrame:
    """One row with the grid, south to north; at least two by two, steps positive, rows of equal length."""
    df = spark.read.schema(TERRAIN).option("multiLine", True).json(path)
    width = F.size(F.get("elevations_ft", F.lit(0)))
    ok = (F.col("lat_step") > 0) & (F.col("lon_step") > 0) & (F.size("elevations_ft") >= 2) & (width >= 2) & F.forall("elevations_ft", lambda r: F.size(r) == width)
    if df.count() != 1 or df.where(ok).count() != 1:
        raise ValueError(f"{path} is no terrain grid")
    return df


def address_blocks(spark: SparkSession, path: str) -> DataFrame:
    raw = _raw_csv(spark, path)
    return raw.select(v.parsed_address(F.col("start_hex")).alias("lo"), v.parsed_address(F.col("end_hex")).alias("hi"), v.text(F.col("country")).alias("country")).where("lo is not null and hi >= lo")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Aircraft by address; blank addresses are skipped, repeated ones are an error."""
    raw = _raw_csv(spark, path)
    df = raw.select(F.lower(v.text(F.col("mode_s_hex"))).alias("icao24"), *(_column(raw, c).alias(c) for c in ("n_number", "manufacturer", "model", "type_aircraft", "engine_type")), v.number(F.col("max_speed_kt")).alias("max_speed_kt"), v.number(F.col("ceiling_ft")).alias("ceiling_ft")).where("icao24 is not null")
    twice = df.groupBy("icao24").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated addresses: {sorted(r[0] for r in twice)}")
    return df


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections written as JSON lines; a line that does not parse has ``_bad`` set and nothing else."""
    with_bad = T.StructType([*schema.DETECTION.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """A folder of states by hour, ``hour`` as text."""
    with_hour = T.StructType([*schema.STATE.fields, T.StructField("hour", T.StringType())])
    return spark.read.schema(with_hour).parquet(path)


def exit_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries written as JSON: reports, firing reports, detections and the histogram of exits."""
    return spark.read.schema("states long, firing_reports long, detections long, exits map<string,long>").json(path)
