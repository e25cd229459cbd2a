"""Variable-capacity best-fit packing: several permitted bin sizes, optimised jointly.

A bin of ``s`` words costs ``OVERHEAD + s * (1 + s / ATTENTION)``: a fixed part, a
part in proportion, and one that grows with the square, as attention does.
Documents become pieces of at most the largest size, all but the last of a
document full.  Pieces are dealt to shards of about ``SHARD`` and packed shard by
shard, longest first: each goes to the open bin that it leaves least room in.  If
none fits, every size that holds the piece is tried on the lengths still to pack:
it would be filled by the longest that fit, one after the other, and by no more
than its share of the words that are left for all open room.  The size that costs
least for each word so held is opened.  In the end every bin is downsized to the
least permitted size that holds its contents.

A document's length is its number of whitespace-delimited words and one end
mark, so a null or empty text has length 1; a very long one is cut into pieces, none
is lost.  Repeated rows, and rows with null ids, are packed as often as they occur;
pieces of one length are packed in order of id.  An empty table has an empty result.
The result has its own columns only, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import textscan as ts
from aerolith.llm.arrowmap import map_rows
from aerolith.llm.scratch import stored

SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
#: words at which the part that grows with the square equals the one in proportion
ATTENTION = 24_576
SHARD = 100_000


def cost(size: int) -> float:
    """What a bin of this size costs."""
    return OVERHEAD + size * (1 + size / ATTENTION)


def _filled(room: int, have: int, count: list[int]) -> int:
    """Words of ``room`` that the lengths still to pack (bits of ``have``, times ``count``) would fill, longest first."""
    left, most = room, room
    while most > 0 and (fits := have & ((2 << most) - 1)):
        n = fits.bit_length() - 1
        left -= n * min(count[n], left // n)
        most = min(left, n - 1)
    return room - left


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (longest first, none longer than the largest size); the size of each bin."""
    room: list[int] = []
    opened: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(max(sizes) + 1)]
    free, all_room = 0, 0  # bit r: there is a bin with room r; the room of all bins
    count = [0] * (max(sizes) + 1)
    for n in lengths:
        count[n] += 1
    have = sum(1 << n for n, k in enumerate(count) if k)
    bins, offsets = [], []
    left = sum(lengths)
    for n in lengths:
        left -= n
        count[n] -= 1
        if not count[n]:
            have &= ~(1 << n)
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            best = None
            for s in sizes:
                if s >= n:
                    more = min(_filled(s - n, have, count), left * (s - n) / max(1, all_room + s - n))
                    best = min(best or (float("inf"), s), (cost(s) / (n + more), s))
            size = best[1]
            b, r = len(room), size
            room.append(size)
            opened.append(size)
            all_room += size
        bins.append(b)
        offsets.append(opened[b] - r)
        room[b] = r - n
        all_room -= n
        by_room[r - n].append(b)
        free |= 1 << (r - n)
    used = [s - r for s, r in zip(opened, room, strict=True)]
    return bins, offsets, [min(s for s in sizes if s >= u) for u in used]


def lengths(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, length."""

    def make():
        def f(batch):
            return [pa.array(np.concatenate([c.words(ts.NON_SPACE).counts() + 1 for c in ts.chunks(batch.column(1))]), pa.int64())]

        return f

    return map_rows(docs.select(id_col, text_col), make, [id_col], [T.StructField("length", T.LongType())])


def _packed(sizes: tuple[int, ...]):
    def out(shard: int, ids, pieces, starts, sizes_of):
        bins, offsets, bin_sizes = pack(sizes_of, sizes)
        b = np.array(bins, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(pieces, pa.int64()),
                pa.array(starts, pa.int64()),
                pa.array(sizes_of, pa.int64()),
                pa.array((shard << 32) + b, pa.int64()),
                pa.array(np.array(bin_sizes, dtype=np.int64)[b] if len(b) else b, pa.int64()),
                pa.array(offsets, pa.int64()),
            ],
            names=_NAMES,
        )

    def run(batches):
        now, held = None, [[], [], [], []]
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cols = [batch.column(k).to_pylist() for k in range(1, 5)]
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now is not None and int(shard[a]) != now:
                    yield out(now, *held)
                    held = [[], [], [], []]
                now = int(shard[a])
                for h, c in zip(held, cols, strict=True):
                    h += c[a:b]
        if now is not None:
            yield out(now, *held)

    return run


_NAMES = ["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_offset"]


def pack_documents(items: DataFrame, *, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, shard: int = SHARD) -> DataFrame:
    """items: id, length.  One row per piece: id, piece, start and length in the document, bin_id, bin_size, bin_offset."""
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    items = stored(items.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.col("length"), F.lit(1)).cast("long").alias("n")), "lengths")
    shards = max(1, -(-items.count() // shard))
    # dealt by the row's place in the written table: neither null nor repeated ids gather in a shard
    piece = items.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most).cast("long"))).alias("piece"))
    piece = piece.select(F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"), "doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("n") - F.col("piece") * most, F.lit(most)).alias("length"))
    dealt = piece.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    packed = dealt.mapInArrow(_packed(sizes), ", ".join(f"{c} long" for c in _NAMES))
    return packed.withColumnRenamed("doc_id", id_col)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
