"""Language-model scoring of whole texts.

Token counts cover all training texts: they give the base (unigram) score, the
commonest words, and the static part of the model's open classes.  The ``SURE``
commonest tokens and their counts are broadcast (a fixed bound); the counts of
all others come by a shuffle join on the token's hash, pre-aggregated by text.

Every text becomes a row of token numbers, written once: training and scoring read
those.  The recurrent model (``recurrent.py``) is trained on all training texts,
each learnt from once: the hash of id and text deals them to ``ROUNDS`` rounds and,
within a round, to shards of about ``SHARD_TOKENS`` tokens, however the table is
split into tasks.  Every shard trains a copy of the round's weights, and copies are
averaged by tokens in a tree, in order of shard: the weights can be reproduced, and
scores but for the rounding of single precision.  A text is scored to its end: the state is carried over all its tokens.

A null text is an empty one: its only token is the end.  Rows with a null id are
scored and count as training rows by the remainder of the empty id.  Repeated rows
are learnt from and scored each time, and score alike; ties in order do not occur.
A very long text is one sequence of any length.  Without training texts the model
keeps its first weights; an empty table has an empty result.  The result has its
own columns only, so other columns of ``docs`` may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import recurrent as rn
from aerolith.llm import textscan as ts
from aerolith.llm.ngram_join import _FAN
from aerolith.llm.scratch import stored
from aerolith.llm.toxicity import remainder

SURE = 1 << 19
ROUNDS = 2
SHARD_TOKENS = 1_000_000
#: most partitions that shards are dealt to; a task takes several beyond it
MOST_PARTS = 8192
#: tokens that are laid in lanes at once, and that are scored at once
BLOCK_TOKENS = 500_000
SCORE_TOKENS = 4_000_000
BATCH_BYTES = 12 << 20
END = np.uint64(0x1D8AF066D1F3C9A5)


def _tail_class(chunk: ts.Chunk, words: ts.Words) -> np.ndarray:
    """Open class of each word, from its first two bytes and whether it ends in a letter or digit."""
    low = np.append(ts.LOWER[chunk.data], 0)
    two = low[words.start].astype(np.int64) * 256 + np.where(words.stop - words.start > 1, low[words.start + 1], 0)
    return (two * 40503 >> 7) % (rn.TAIL // 2) * 2 + ts.ALNUM[low[words.stop - 1]]


def _token_counts(batches):
    """token hash, open class, count of each task; END is counted by its hash, class -1."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, k, n = h[order], k[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], k[first], np.add.reduceat(n, first)

    size = 0
    for batch in batches:
        for chunk in ts.chunks(batch.column(0)):
            words = chunk.words(ts.NON_SPACE)
            h, k = (words.hash(), _tail_class(chunk, words)) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((np.append(u, END), np.append(k[first], -1), np.append(n, chunk.rows)))
            size += len(u)
            if size > 1_500_000:
                held[:] = [merged()]
                size = len(held[0][0]) // 2
    if held:
        h, k, n = merged()
        for at in range(0, len(h), 100_000):
            w = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[w].view(np.int64)), pa.array(k[w], pa.int32()), pa.array(n[w], pa.int64())], names=["token", "kind", "n"])


class Counts:
    """Hash -> count, for the commonest tokens."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        order = np.argsort(token)
        self.token, self.n = token[order], n[order].astype(np.float64)
        self.begin = np.searchsorted(self.token >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.begin).max()) if len(token) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        bucket = (h >> np.uint64(46)).astype(np.int64)
        at, end, left = self.begin[bucket], self.begin[bucket + 1], np.arange(len(h))
        for _ in range(self.most):
            open_ = at < end
            at, end, left = at[open_], end[open_], left[open_]
            if not len(left):
                break
            same = self.token[at] == h[left]
            out[left[same]] = at[same]
            at, end, left = at[~same] + 1, end[~same], left[~same]
        return out


class Scorer:
    """What tasks need: counts of common tokens, numbers of the commonest, class masses."""

    def __init__(self, counts: Counts, total: int, distinct: int, tail_mass: np.ndarray, shape: rn.Shape, number: np.ndarray):
        self.counts, self.shape, self.number = counts, shape, number
        #: denominators: of the base, and of each open class
        self.base = np.log10(total + 0.5 * (distinct + 1))
        self.tail = np.log10(tail_mass)

    def tokens(self, chunk: ts.Chunk):
        """Row, hash, place in counts, number of each token; ends come last in each row."""
        words = chunk.words(ts.NON_SPACE)
        per = words.counts() + 1
        n = int(per.sum())
        last = np.cumsum(per) - 1
        inner = np.ones(n, dtype=bool)
        inner[last] = False
        h = np.full(n, END, dtype=np.uint64)
        kind = np.zeros(n, dtype=np.int64)
        if len(words):
            h[inner], kind[inner] = words.hash(), _tail_class(chunk, words)
        at = self.counts.find(h)
        number = np.where(at >= 0, self.number[at], -1) if len(self.number) else np.full(n, -1)
        number = np.where(number >= 0, number, self.shape.head + kind)
        return np.repeat(np.arange(chunk.rows), per), h, at, number, last


_OUT = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("place", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("static", T.DoubleType()),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("rest", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)


def _numbered(shared):
    """Rows of ``_OUT`` without the model: counts, base and static parts, unknown tokens, and the numbers of all tokens."""

    def run(batches):
        scorer: Scorer = shared.value
        for batch in batches:
            cols, size, first = [], 0, 0

            def flush(first, rows):
                part = [pa.concat_arrays(c) for c in zip(*cols, strict=True)]
                own = [batch.column(k).slice(first, rows) for k in range(4)]
                return pa.RecordBatch.from_arrays([*own, *part], names=_OUT.names)

            for chunk in ts.chunks(batch.column(4)):
                rows, h, at, number, last = scorer.tokens(chunk)
                found = at >= 0
                log = np.where(found, np.log10(scorer.counts.n[np.maximum(at, 0)] + 0.5), 0.0) if len(scorer.counts.n) else np.zeros(len(at))
                open_ = number >= scorer.shape.head
                still = np.where(open_, log - scorer.tail[np.maximum(number - scorer.shape.head, 0)], 0.0)
                rest = np.flatnonzero(~found)
                order = rest[np.lexsort((h[rest], rows[rest]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (rows[order][1:] != rows[order][:-1]) | (h[order][1:] != h[order][:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(order)))
                offsets = np.zeros(chunk.rows + 1, dtype=np.int32)
                np.cumsum(np.bincount(rows[order][begin], minlength=chunk.rows), out=offsets[1:])
                ends = np.concatenate([[0], 2 * (last + 1)]).astype(np.int32)
                cols.append(
                    [
                        pa.array(np.bincount(rows, minlength=chunk.rows), pa.int64()),
                        pa.array(np.bincount(rows, found, minlength=chunk.rows).astype(np.int64)),
                        pa.array(np.bincount(rows, log - scorer.base, minlength=chunk.rows)),
                        pa.array(np.bincount(rows, still, minlength=chunk.rows)),
                        pa.Array.from_buffers(pa.binary(), chunk.rows, [None, pa.py_buffer(ends), pa.py_buffer(number.astype("<u2"))]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[order][begin].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times, pa.int32())),
                    ]
                )
                size += len(chunk.data)
                if size >= BATCH_BYTES:
                    yield flush(first, chunk.first + chunk.rows - first)
                    first, size, cols = chunk.first + chunk.rows, 0, []
            if cols:
                yield flush(first, batch.num_rows - first)

    return run


def _documents(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks of about ``SCORE_TOKENS`` tokens: the first row and the numbers of each row."""
    rows, first, held = [], 0, 0
    for k, x in enumerate(column):
        rows.append(np.frombuffer(x.as_buffer(), dtype="<u2"))
        held += len(rows[-1])
        if held >= SCORE_TOKENS:
            yield first, rows
            rows, first, held = [], k + 1, 0
    if rows:
        yield first, rows


def _modelled(shape: rn.Shape, weights):
    """Adds the model's log10 probability of the numbers in the last column, in its place."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 1
            for first, rows in _documents(batch.column(n)):
                model = rn.log_probability(shape, weights.value, rows) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(rows)) for k in range(n)), pa.array(model)], names=[*batch.schema.names[:n], "model"])

    return run


def _packed(total: np.ndarray) -> bytes:
    return zlib.compress(total.tobytes(), 1)


def _unpacked(v: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(v), dtype=np.float64)


def _learnt(shape: rn.Shape, start):
    """Over rows sorted by shard: weights times tokens, and tokens, of the copy that each shard trains."""

    def run(batches):
        now, trainer, waiting, held = None, None, [], 0

        def learn():
            trainer.lanes(waiting)
            waiting.clear()

        def done():
            learn()
            total = np.append(trainer.flat.astype(np.float64) * trainer.tokens, trainer.tokens)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["shard", "v"])

        for batch in batches:
            for shard, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, trainer, held = shard, rn.Trainer(shape, start.value), 0
                waiting.append(np.frombuffer(x.as_buffer(), dtype="<u2").astype(np.int32))
                held += len(waiting[-1])
                if held >= BLOCK_TOKENS:
                    learn()
                    held = 0
        if now is not None:
            yield done()

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sum of arrays, in order of shard."""
    table = table.sort_by("child")
    total = sum(_unpacked(x.as_py()) for x in table.column("v"))
    return pa.table({"shard": table.column("shard").slice(0, 1).cast(pa.int64()), "v": pa.array([_packed(total)], pa.binary())})


def _trained(told: DataFrame, shape: rn.Shape, flat: np.ndarray, tokens: int, rounds: int, shard_tokens: int) -> np.ndarray:
    """Weights after rounds of training.  ``told``: place (a hash), numbers."""
    spark = told.sparkSession
    shards = max(1, -(-tokens // (rounds * shard_tokens)))
    parts = min(shards, MOST_PARTS)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(flat)
        own = told.where(F.pmod("place", F.lit(rounds)) == k).select(F.pmod(F.shiftright("place", 8), F.lit(shards)).alias("shard"), "numbers", "place")
        own = own.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "place", "numbers").select("shard", "numbers")
        found, n = own.mapInArrow(_learnt(shape, start), "shard long, v binary"), shards
        while n > _FAN:
            n = -(-n // _FAN)
            found = found.select(F.floor(F.col("shard") / _FAN).alias("shard"), F.col("shard").alias("child"), "v").groupBy("shard").applyInArrow(_added, "shard long, v binary")
        last = sorted(found.collect())  # at most _FAN arrays
        total = sum(_unpacked(v) for _, v in last)
        if last and total[-1] > 0:
            flat = (total[:-1] / total[-1]).astype(np.float32)
        start.unpersist()
    return flat


def _least_count(counts: DataFrame, sure: int) -> int:
    """The least count that at most ``sure`` tokens reach; above 1000 in steps of a tenth."""
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.floor(F.pow(F.lit(1.1), F.floor(F.log(1.1, F.col("n"))))))
    least, held = 1 << 62, 0
    for at, many in counts.groupBy(step.cast("long").alias("at")).count().orderBy(F.desc("at")).collect():
        held += many
        if held > sure:
            break
        least = at
    return least


def score_documents(docs: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, sure: int = SURE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out (not ``training``), n_tokens, n_known, train_tokens, base_score, score (log10) for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~training).alias("held_out"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"))
    taught = docs.where(~F.col("held_out"))
    counts = stored(taught.select("text").mapInArrow(_token_counts, "token long, kind int, n long").groupBy("token").agg(F.first("kind").alias("kind"), F.sum("n").alias("n")), "counts")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = counts.where(F.col("n") >= _least_count(counts, sure)).toArrow()  # at most ``sure`` rows
    token, n, kinds = common["token"].to_numpy().view(np.uint64), common["n"].to_numpy(), common["kind"].to_numpy()
    order = np.lexsort((token, -n))
    token, n, kinds = token[order], n[order], kinds[order]
    shape = rn.Shape(max(1, min(rn.HEAD, len(token))))
    mass = np.zeros(rn.TAIL)
    for kind, k, m in counts.where("kind >= 0").groupBy("kind").agg(F.sum("n"), F.count("*")).collect():
        mass[kind] = k + 0.5 * m
    for kind, k in zip(kinds[: shape.head].tolist(), n[: shape.head].tolist(), strict=True):
        if kind >= 0:
            mass[kind] -= k + 0.5
    mass = np.maximum(mass, 0) + 0.5
    known = Counts(token, n)
    number = np.full(len(token), -1, dtype=np.int64)
    number[known.find(token[: shape.head])] = np.arange(len(token[: shape.head]))
    shared = spark.sparkContext.broadcast(Scorer(known, int(total), int(distinct), mass, shape, number))
    flat = rn.initial(shape, np.pad(n[: shape.head], (0, shape.head - len(n[: shape.head]))), mass)
    place = F.xxhash64("key", "text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", place.alias("place"), "text")
    tokens = stored(rows.mapInArrow(_numbered(shared), _OUT), "tokens")
    flat = _trained(tokens.where(~F.col("held_out")).select("place", "numbers"), shape, flat, int(total), rounds, shard_tokens)
    weights = spark.sparkContext.broadcast(flat)
    narrow = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "static"]
    scored = tokens.select(*narrow, "numbers").mapInArrow(_modelled(shape, weights), T.StructType([*(_OUT[c] for c in narrow), T.StructField("model", T.DoubleType())]))
    rest = tokens.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    rest = rest.join(counts.select("token", "n"), "token", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + F.col("static") + more).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, remainder("doc_id", 5) != 1)
