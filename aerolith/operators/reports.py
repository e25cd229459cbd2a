"""Scored findings, reports over them, and the evaluation harness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.config import Spoofing
from aerolith.functions import scoring


def scored_spoofing(found: DataFrame, cfg: Spoofing) -> DataFrame:
    """Adds score, confidence, severity and whether the finding is too weak to report."""
    df = found.withColumns({"score": scoring.spoof_score(F.col("measured"), F.col("threshold"), cfg), "confidence": scoring.spoof_confidence(F.col("dt_s"), F.col("n_reports"), F.col("measured"), F.col("quality"))})
    return df.withColumns({"severity": scoring.spoof_severity(F.col("gate"), F.col("score"), cfg), "abstains": F.col("confidence") < cfg.min_confidence})


def breakdown(found: DataFrame) -> DataFrame:
    """Findings by rule with medians, the most frequent first."""
    agg = found.groupBy("gate").agg(
        F.count("*").alias("alerts"),
        *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")),
        F.percentile("dt_s", 0.5).alias("median_dt_s"),
        F.percentile("measured", 0.5).alias("median_measured"),
    )
    # as many rows as there are rules
    return agg.withColumn("place", F.row_number().over(Window.orderBy(F.desc("alerts"), "gate")))


def not_seen(rows: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def confusion(results: DataFrame, *by: str) -> DataFrame:
    """results: expected, fired (booleans)."""
    e, f = F.col("expected"), F.col("fired")
    return results.groupBy(*by).agg(F.count_if(e & f).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & ~f).alias("tn"))


def fixture_results(observations: DataFrame, found: DataFrame) -> DataFrame:
    """label, kind, gate, expected and fired of labelled observations (label, icao24); found: gate, icao24.  One row a label."""
    kind, gate = labels(F.col("label"))
    fired = found.select("icao24", F.col("gate").alias("_gate")).distinct()
    rows = observations.select("label", "icao24").distinct().join(fired, "icao24", "left")
    by = rows.groupBy("label").agg(F.array_sort(F.collect_set("_gate")).alias("gates"))
    return by.select("label", kind.alias("kind"), gate.alias("gate"), (kind != "negative").alias("expected"), (F.size("gates") > 0).alias("fired"), "gates")


def precision_recall(counts: DataFrame) -> DataFrame:
    """Null where nothing fired, or nothing should have."""
    return counts.withColumns({"precision": F.expr("try_divide(tp, tp + fp)"), "recall": F.expr("try_divide(tp, tp + fn)")})


def histogram(rows: DataFrame, value: str, width: float, most: float) -> DataFrame:
    """Counts by bin of ``width``; the last bin holds all from ``most`` on."""
    bins = int(most / width)
    return rows.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(F.col(value) / width), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def per_hour(found: DataFrame, hours: float) -> DataFrame:
    return found.groupBy("gate").agg((F.count("*") / F.lit(float(hours))).alias("per_hour"))


def source_category(before: Column, now: Column, rate: Column) -> Column:
    """How the sources (baro, geom, null: unknown) of two altitudes and of a climb rate go together."""
    known = F.coalesce(before, now).isNotNull() & rate.isNotNull()
    other = F.coalesce(before != rate, F.lit(False)) | F.coalesce(now != rate, F.lit(False))
    switched = F.coalesce(before != now, F.lit(False))
    return F.when(~known, "unresolved").when(switched, "altitude switched").when(other, "altitude and rate differ").otherwise("consistent")


def source_report(alerts: DataFrame) -> DataFrame:
    """alerts: category, measured.  By category: alerts, the median size, and the share of all alerts in percent."""
    by = alerts.groupBy("category").agg(F.count("*").alias("alerts"), F.percentile(F.abs("measured"), 0.5).alias("median"))
    # four rows at most
    return by.withColumn("percent", 100 * F.col("alerts") / F.sum("alerts").over(Window.partitionBy(F.lit(1))))


def combinations(rows: DataFrame, *columns: str, limit: int | None = None) -> DataFrame:
    """How often values occur together, the most frequent first."""
    out = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), *columns).limit(limit) if limit else out


def described(rows: DataFrame, *columns: str) -> DataFrame:
    """For each column a row: known values, mean, deviation, least, quartiles and most."""
    stats = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")
    agg = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("deviation"), F.min("x").alias("least"), *(F.percentile("x", q / 4).alias(f"q{q}") for q in (1, 2, 3)), F.max("x").alias("most")]
    return rows.select(stats).select("s.*").groupBy("column").agg(*agg)


def causes(false_positives: DataFrame) -> DataFrame:
    """False positives by the cause named in their label: ``kind:gate``, with trailing numbers left out."""
    cause = F.regexp_replace(F.regexp_replace("label", "^[a-z]+:", ""), "[-_ ]?[0-9]+$", "")
    return false_positives.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def labels(label: Column) -> tuple[Column, Column]:
    """Kind and gate of ``kind:gate``."""
    parts = F.split(label, ":", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def swept(run: Callable[[float], DataFrame], values: list[float]) -> DataFrame:
    """Results of one setting's values, one after the other, marked by the value.  The values are the caller's few."""
    out = None
    for value in values:
        df = run(value).withColumn("setting", F.lit(float(value)))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no values")
    return out


def recommend(rows: DataFrame) -> DataFrame:
    """rows: setting, place (order of trial), alerts, guards_held, positives, baseline_positives.  The setting with the fewest
    alerts of those that hold every guard and lose no positive; of equals the first tried."""
    fit = rows.where(F.col("guards_held") & (F.col("positives") >= F.col("baseline_positives")))
    return fit.agg(F.min_by(F.struct("setting", "alerts"), F.struct("alerts", "place")).alias("r")).select("r.*").where("setting is not null")


def thinned(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """Every n-th row in order, so that at most ``limit`` stay."""
    total = rows.count()
    step = max(1, -(-total // limit))
    if step == 1:
        return rows
    # numbers by range partition: the offsets are sums of counts, one a partition
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(before.select("_p", "_before")), "_p")
    return numbered.where((F.coalesce("_before", F.lit(0)) + F.col("_n") - 1) % step == 0).drop("_p", "_n", "_before")


def unique_ids(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Names that occur once stay; the others get their rank as a suffix."""
    w = Window.partitionBy(name)
    rank = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("unique_id", F.when(F.count("*").over(w) == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), rank.cast("string"))))


def united(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Union of two sets whose keys must not clash."""
    clash = one.select(key).intersect(other.select(key)).limit(5).collect()
    if clash:
        raise ValueError(f"{key} in both: {sorted(str(r[0]) for r in clash)}")
    return one.unionByName(other, allowMissingColumns=True)
