"""Approximate nearest neighbours by a hash-prefix forest.

Hash strings are signs of random projections.  A first, short string deals the rows to
shards: rows of one prefix lie together, and a prefix that many rows share is split
by salt into shards of about ``SHARD`` rows.  Each shard holds ``TREES`` arrays of long
hash strings (``BITS`` long), sorted.  A query goes to the shards of its own prefix
and of those that differ from it where its projections are least certain.  There it
descends each tree to its longest matching prefix; then all trees ascend in step, one
prefix length at a time, to a given length and on until the ranges under the prefixes
hold ``LEAST`` entries.  Ranges are taken whole, however many rows share a prefix, so no copy is cut
off.  Candidates are compared by exact cosine in double precision, and each shard's
nearest are merged.

How many prefixes a query visits, and how far it ascends, is measured: on a sample of
at most about ``SAMPLE`` rows and ``SAMPLE_QUERIES`` queries (the documented bound)
against brute force, as the least that finds ``VISITED`` and ``FOUND`` of the true
neighbours.  Rows of a sample are further apart than those of the table, so the
table's share is higher.  Every row is indexed.  Where vectors cluster, few prefixes and
long common strings suffice; nearly random ones in many dimensions need most rows.

Vectors that are null, empty, zero, or hold a null or non-finite component take
no part; nor do rows with a null id.  Finite vectors of any magnitude do.  Vectors are
compared with those of their own length only.  Ties go to the smaller id; rows that
share an id are compared as they are, repeated ones too, and a query never finds its
own id.  An empty table has an empty result, and the result has columns of its own only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm.scratch import stored

TREES = 48
BITS = 24
SHARD = 4096
BLOCK = 512
#: longest string that deals rows to shards
MOST_PREFIX = 16
SAMPLE = 6_000
SAMPLE_QUERIES = 200
VISITED, FOUND = 0.985, 0.96
#: entries, over all trees, that a query asks of a shard at least
LEAST = 200


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def planes(size: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(size * 1_000_003 + trees * 101 + bits).normal(size=(trees * bits, size))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which no cosine notices, so that squares neither overflow nor vanish."""
    most = np.abs(vectors).max(axis=1) if vectors.shape[1] else np.ones(len(vectors))
    return np.ldexp(vectors, -np.frexp(most)[1][:, None])


def prefix_planes(size: int, bits: int) -> np.ndarray:
    return np.random.default_rng(size * 7919 + 31).normal(size=(MOST_PREFIX, size))[:bits]


def prefixes(projected: np.ndarray) -> np.ndarray:
    """Prefix of each row of projections: the first sign is the highest bit."""
    return (projected > 0) @ (1 << np.arange(projected.shape[1] - 1, -1, -1, dtype=np.int64)) if projected.shape[1] else np.zeros(len(projected), dtype=np.int64)


def distances(projected: np.ndarray) -> np.ndarray:
    """[row, prefix]: the sum of the projections whose signs differ, for each of all prefixes."""
    bits = projected.shape[1]
    codes = np.arange(1 << bits)[:, None] >> np.arange(bits - 1, -1, -1) & 1
    return np.where(projected > 0, projected, 0) @ (1 - codes.T) + np.where(projected <= 0, -projected, 0) @ codes.T


class Forest:
    """Hash strings of one shard as integers, sorted by tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, bits: int = BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.trees, self.bits = trees, bits
        self.planes = planes(vectors.shape[1], trees, bits)
        strings = self.strings(self.vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """[tree, row]: the first sign is the highest bit."""
        signs = (vectors @ self.planes.T > 0).reshape(len(vectors), self.trees, self.bits)
        return (signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T

    def candidates(self, queries: np.ndarray, least: int, longest: int | None = None):
        """For each query the rows under the longest common prefix length, of ``longest`` at most, that yields ``least``
        entries over all trees."""
        own = self.strings(queries)
        least = min(least, self.trees * len(self.ids))
        low = np.zeros((self.trees, len(queries)), dtype=np.int64)
        high = np.full((self.trees, len(queries)), len(self.ids), dtype=np.int64)
        open_ = np.arange(len(queries))
        for length in range(self.bits, 0, -1):  # ascend in step
            rest = self.bits - length
            first = own[:, open_] >> rest << rest
            a = np.stack([np.searchsorted(self.sorted[t], first[t]) for t in range(self.trees)])
            b = np.stack([np.searchsorted(self.sorted[t], first[t] + (1 << rest)) for t in range(self.trees)])
            enough = (b - a).sum(axis=0) >= (least if longest is None or length <= longest else np.inf)
            low[:, open_[enough]], high[:, open_[enough]] = a[:, enough], b[:, enough]
            open_ = open_[~enough]
            if not len(open_):
                break
        mark = np.zeros(len(self.ids), dtype=bool)
        for q in range(len(queries)):
            mark[:] = False
            for t in range(self.trees):
                mark[self.order[t, low[t, q] : high[t, q]]] = True
            yield q, np.flatnonzero(mark)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: int, longest: int | None = None):
        """query id, id, cosine of the k nearest of each query."""
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        for q, rows in self.candidates(queries, least, longest):
            rows = rows[self.ids[rows] != query_ids[q]]
            if not len(rows):
                continue
            rough = self.vectors[rows] @ queries[q] / (self.norm[rows] * norm[q])
            if len(rows) > k:
                # what could tie with the k-th within rounding is kept and measured in one fixed order of summation
                cut = np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-9
                rows = rows[rough >= cut]
            exact = np.einsum("ij,j->i", np.ascontiguousarray(self.vectors[rows]), queries[q], optimize=False) / (self.norm[rows] * norm[q])
            best = np.lexsort((self.ids[rows], -exact))[:k]
            yield query_ids[q], self.ids[rows[best]], exact[best]


def _matrix(column: pa.Array) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def calibrated(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, bits: int, k: int, trees: int, length: int) -> tuple[int, int]:
    """Prefixes to visit, and the longest prefix of the trees to look under, by brute force over a sample."""
    queries = vectors[asked]
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    cosine = queries @ vectors.T / (norm[asked, None] * norm)
    cosine[ids[asked][:, None] == ids] = -np.inf
    k = min(k, len(ids) - 1)
    best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    projected = vectors @ prefix_planes(vectors.shape[1], bits).T
    far = distances(projected[asked])
    # the place, in a query's order of prefixes, of that of each true neighbour
    wanted = prefixes(projected)[best]
    place = np.sort((far[:, None, :] < np.take_along_axis(far, wanted, axis=1)[:, :, None]).sum(axis=2).ravel())
    visits = int(place[min(len(place) - 1, int(np.ceil(VISITED * len(place))) - 1)]) + 1
    strings = Forest(np.arange(len(ids)), vectors, trees, length).strings(vectors)
    apart = strings[:, asked, None] ^ strings[:, best]
    # the longest common prefix of a query and a neighbour, in the tree where it is longest
    common = length - np.ceil(np.log2(apart.min(axis=0) + 1)).astype(np.int64)
    return visits, int(np.sort(-common.ravel())[min(common.size - 1, int(np.ceil(FOUND * common.size)) - 1)] * -1)


def _placed(bits: int):
    """size, prefix, then the other columns."""

    def run(batches):
        for batch in batches:
            size = batch.column(0).to_numpy()
            prefix = np.zeros(len(size), dtype=np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                prefix[at] = prefixes(_matrix(batch.column(2).take(pa.array(at))) @ prefix_planes(int(n), bits).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prefix), *(batch.column(k) for k in range(1, 4))], names=["size", "prefix", "id", "vector", "query"])

    return run


def _visits(bits: int, visits: dict[int, int]):
    """Queries, once for each prefix that they visit."""

    def run(batches):
        for batch in batches:
            size = batch.column(0).to_numpy()
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                for first in range(0, len(own), BLOCK):
                    at = own[first : first + BLOCK]
                    some = batch.take(pa.array(at))
                    far = distances(_matrix(some.column(2)) @ prefix_planes(int(n), bits).T)
                    many = visits.get(int(n), 1 << bits)
                    order = np.argpartition(far, many - 1, axis=1)[:, :many] if many < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(at), 1))
                    for part in range(0, many, 64):
                        shown = order[:, part : part + 64]
                        again = pa.array(np.repeat(np.arange(len(at)), shown.shape[1]))
                        yield pa.RecordBatch.from_arrays([some.column(0).take(again), pa.array(shown.ravel()), some.column(1).take(again), some.column(2).take(again)], names=["size", "prefix", "id", "vector"])

    return run


def _answers(k: int, longest: dict[int, int], trees: int, bits: int):
    """Over rows sorted by shard, with the shard's own vectors before the queries."""

    def run(batches):
        shard, ids, vectors, forest = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                *own_shard, query = keys[a]
                own_ids = batch.column(4).slice(a, b - a).to_numpy()
                own = _matrix(batch.column(5).slice(a, b - a))
                if own_shard != shard:
                    shard, ids, vectors, forest = own_shard, [], [], None
                if not query:
                    ids.append(own_ids)
                    vectors.append(own)
                    continue
                if not ids:
                    continue
                if forest is None:
                    forest = Forest(np.concatenate(ids), np.concatenate(vectors), trees, bits)
                deepest = longest.get(own_shard[0], 0)
                for at in range(0, len(own), BLOCK):
                    found = list(forest.nearest(own_ids[at : at + BLOCK], own[at : at + BLOCK], k, LEAST, deepest))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in found]), pa.int64()), pa.array(np.concatenate([s for _, _, s in found]))],
                            names=["query_id", "id", "score"],
                        )

    return run


def _sampled(some: DataFrame, n: int, bits: int, k: int, trees: int, length: int) -> tuple[dict[int, int], dict[int, int]]:
    """Visits and longest prefixes of each length of vector that the sample holds enough of; any other is searched whole."""
    share = max(1, int(1_000_000 * min(1.0, SAMPLE / max(n, 1))))
    rows = some.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1_000_000)) < share).select("size", "id", "vector").limit(2 * SAMPLE).toArrow()
    size = rows["size"].to_numpy()
    visits, longest = {}, {}
    for own in np.unique(size):
        at = np.flatnonzero(size == own)
        if len(at) < 200:
            continue
        part = rows.take(pa.array(at)).combine_chunks()
        ids, vectors = part["id"].to_numpy(), _matrix(part["vector"].combine_chunks())
        asked = np.argsort((ids * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) ^ (ids >> 7), kind="stable")[:SAMPLE_QUERIES]
        visits[int(own)], longest[int(own)] = calibrated(ids, vectors, asked, bits, k, trees, length)
    return visits, longest


def search(rows: DataFrame, queries: Column, *, id_col: str, vector_col: str, k: int = 5, shard: int = SHARD, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest rows found for each row where ``queries`` holds."""
    some = rows.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.size(vector_col).alias("size"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
    n = some.count()
    short = max(0, min(MOST_PREFIX, int(np.ceil(np.log2(max(1, n) / shard)))))
    visits, longest = _sampled(some, n, short, k, trees, bits)
    placed = stored(some.mapInArrow(_placed(short), "size int, prefix long, id long, vector array<double>, query boolean"), "placed")
    salts = placed.groupBy("size", "prefix").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("salts"))
    own = placed.withColumn("row", F.monotonically_increasing_id()).join(salts, ["size", "prefix"]).select("size", "prefix", F.pmod(F.xxhash64("id", "row"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("asks"), "id", "vector")
    asked = placed.where("query").select("size", "id", "vector").mapInArrow(_visits(short, visits), "size int, prefix long, id long, vector array<double>")
    asked = asked.join(salts, ["size", "prefix"]).select("size", "prefix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("asks"), "id", "vector")
    dealt = own.unionByName(asked).repartition("size", "prefix", "salt").sortWithinPartitions("size", "prefix", "salt", "asks")
    found = dealt.mapInArrow(_answers(k, longest, trees, bits), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0, id_col="vec_id", vector_col="embedding")
