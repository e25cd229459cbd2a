"""Corpus preparation: toxic documents go, one document of each group of near
duplicates stays, contaminated documents go, secrets are masked, and what is left
is packed.  All stages but the last return the columns of ``documents``, and keep
whatever other columns there are, whatever their names.

A null text is an empty one: it is not toxic, links with nothing, holds no benchmark
passage and no secret, and is packed as its end mark alone.  Rows with null or
repeated ids are documents of their own.  An empty table stays empty.  Very long texts
are read whole by every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import decontamination, ngram_join, packing, secret_scan, toxicity
from aerolith.llm.arrowmap import fresh, quoted
from aerolith.llm.scratch import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    model = toxicity.learn_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    (name,) = fresh(docs.columns, "_toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(*(quoted(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity of 0.8 or more of five-word shingles, the document of the smallest id
    (of several such rows, or of null ids, one); documents without words stay."""
    row, component, first = fresh(docs.columns, "_row", "_component", "_first")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngram_join.similar_documents(numbered, id_col=row, n=5, percent=80)
    linked = stored(found.where(F.col("component_id") != F.col(row)).select(row, F.col("component_id").alias(component)), "linked")
    members = linked.unionByName(linked.select(F.col(component).alias(row), component).distinct())
    ids = members.join(numbered.select(row, "doc_id"), row)
    kept = ids.groupBy(component).agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", row)).alias(first)).select(F.col(first)[row].alias(row))
    gone = stored(members.select(row).join(kept, row, "left_anti"), "gone")
    if gone.count() <= ngram_join.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return numbered.join(gone, row, "left_anti").select(*(quoted(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark windows."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets masked; ``n_chars`` follows the text."""
    masked = secret_scan.redact(docs, secret_scan.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*(quoted(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins for every document."""
    return packing.pack_documents(packing.lengths(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: the first stage is a fitted model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
