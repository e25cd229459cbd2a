"""N-gram Jaccard join with set-relation skipping.

Texts become sets of distinct word shingles.  The join is exact:

1. Bucket counts over all shingles of all texts give the global order (rare
   first; any order is right, this one keeps lists short).
2. A large set is dealt by hash into units; if two sets reach the threshold, so
   does at least one pair of equal-numbered units.  Each unit puts its prefix
   into inverted lists, with its size and the position.  Lists of one set are
   dropped; the others' entries get a 256-bit parity map of their unit, whose
   distance bounds the symmetric difference from below.  Equal sets count as one.
3. Within a list, in order of size, blocks of partners are skipped by size, by
   position and by parity map.  What passes yields star edges, which are
   contracted to candidate components: each true link lies within one.
4. Each candidate component is joined exactly.  A set's overlaps with all others
   are derived from those of a highly similar set that were computed before, by
   visiting the lists of their differing shingles only.  Components of many sets or
   of more than ``GROUP`` shingles are dealt to blocks, one task for each pair of
   blocks; the number of blocks grows with the root of the number of sets, so no
   task has more than a few hundred times that root.

A text that is null, empty or blank has an empty set and no link; a very long one is
as good as any.  Rows with a null id have a null component and no link.  Rows that
share an id are documents of their own: each is linked by its own text, copies are
linked with each other, and the smallest id of a component names it.  An empty table
has an empty result.  The result has its own columns only, so other columns of
``docs`` may have any names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import textscan as ts
from aerolith.llm.arrowmap import map_rows
from aerolith.llm.components import components
from aerolith.llm.scratch import stored

PERCENT = 90
WORDS = 3
GROUP = 4_000_000
ORDER_BITS = 17
SMALL_LIST = 33
LARGE_LIST = 20_000
#: most sets of a component that are joined as a whole; beyond, blocks number the root of a share of the sets
WHOLE_SETS = 128
BLOCK_SHARE = 40
BROADCAST_ROWS = 1_000_000
_STEP = np.uint64(0xD1342543DE82EF95)


class Sets:
    """Distinct shingle hashes of each text of a chunk: ``hash`` by text, each text's sorted by ``order``."""

    def __init__(self, chunk: ts.Chunk, n: int = WORDS):
        words = chunk.words(ts.NON_SPACE)
        counts = words.counts()
        hashes = words.hash() if len(words) else np.zeros(0, dtype=np.uint64)
        many = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        doc = np.repeat(np.arange(chunk.rows), many)
        first = words.of[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(counts, n)[doc]
        value = size.astype(np.uint64)
        for k in range(n):
            there = size > k
            value = np.where(there, value * _STEP + hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else value, value)
        value = ts.mix64(value)
        order = sort_within(doc, value)
        doc, value = doc[order], value[order]
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        self.doc, self.hash = doc[fresh], value[fresh]
        self.size = np.bincount(self.doc, minlength=chunk.rows)


def sort_within(group: np.ndarray, value: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """argsort by group, rank (0 to 15), value."""
    groups = int(group[-1]) + 1 if len(group) else 0
    bits = max(groups - 1, 1).bit_length()
    if bits > 28:
        return np.lexsort((value, rank, group) if rank is not None else (value, group))
    key = group.astype(np.uint64) << np.uint64(64 - bits)
    used = bits
    if rank is not None:
        key |= rank.astype(np.uint64) << np.uint64(60 - bits)
        used += 4
    key |= value >> np.uint64(used)
    order = np.argsort(key)
    key, v = key[order], value[order]
    if ((key[1:] == key[:-1]) & (v[1:] != v[:-1])).any():
        return np.lexsort((value, rank, group) if rank is not None else (value, group))
    return order


#: partial sums that one task, or the driver, adds up
_FAN = 8


def _sum_arrays(df: DataFrame, make, width: int, kind=np.int64) -> np.ndarray:
    """Sum of the arrays that ``make()``'s function adds up over each task's batches, in a tree, compressed on the way."""

    def packed(total):
        return pa.array([zlib.compress(total.astype(kind).tobytes(), 1)], pa.binary())

    def run(batches):
        add, total = make()
        for batch in batches:
            add(batch)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), packed(total)], names=["k", "v"])

    def add_up(table):
        total = np.zeros(width, dtype=kind)
        for x in table.column("v"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), dtype=kind)
        return pa.table({"k": pa.array([0], pa.int32()), "v": packed(total)})

    parts = df.mapInArrow(run, "k int, v binary")
    n = df.rdd.getNumPartitions()
    while n > _FAN:
        n = -(-n // _FAN)
        parts = parts.select(F.pmod(F.spark_partition_id(), F.lit(n)).alias("k"), "v").groupBy("k").applyInArrow(add_up, "k int, v binary")
    total = np.zeros(width, dtype=kind)
    for (v,) in parts.select("v").collect():
        total += np.frombuffer(zlib.decompress(v), dtype=kind)
    return total


def shingle_order(docs: DataFrame, text_col: str, n: int = WORDS) -> np.ndarray:
    """Rank (0: rare, to 15) of each bucket of shingle hashes, from counts over all texts."""
    width = 1 << ORDER_BITS

    def make():
        total = np.zeros(width, dtype=np.int64)

        def add(batch):
            for chunk in ts.chunks(batch.column(0)):
                words = chunk.words(ts.NON_SPACE)
                if len(words) < n:
                    continue
                hashes = words.hash()
                after = np.repeat(words.of[1:], words.counts())
                start = np.flatnonzero(np.arange(len(words)) + n <= after)
                value = np.full(len(start), n, dtype=np.uint64)
                for k in range(n):
                    value = value * _STEP + hashes[start + k]
                total[:] += np.bincount((ts.mix64(value) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=width)

        return add, total

    counts = _sum_arrays(docs.select(text_col), make, width)
    usual = max(float(np.median(counts)), 1.0)
    return np.clip(np.floor(2 * np.log2(np.maximum(counts, 1) / usual)), 0, 15).astype(np.uint8)


def unit_size(percent: int) -> int:
    """Most shingles of a unit: so many that similar units differ in about 55 at most, of 256 bits."""
    return 1 << round(math.log2(55 * (100 + percent) / (2 * max(1, 100 - percent))))


def _level(size: np.ndarray, percent: int) -> np.ndarray:
    """2**level units for a set of this size."""
    return np.ceil(np.log2(np.maximum(size, 1) / unit_size(percent))).clip(0).astype(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class Signatures:
    """What each text of a chunk puts into the index."""

    def __init__(self, chunk: ts.Chunk, rank: np.ndarray, n: int, percent: int):
        sets = Sets(chunk, n)
        rows = chunk.rows
        self.size = sets.size
        own = np.add.reduceat if len(sets.hash) else None
        full = np.flatnonzero(sets.size)
        self.fp = [np.zeros(rows, dtype=np.uint64) for _ in range(2)]
        if own:
            begin = (np.cumsum(sets.size) - sets.size)[full]
            for k, fp in enumerate(self.fp):
                fp[full] = np.add.reduceat(ts.mix64(sets.hash + np.uint64(0x5851F42D4C957F2D * (k + 1) & ts._MASK)), begin)
        # a set is indexed at every level that a similar set, as large or larger, can be of
        low, high = _level(sets.size, percent), _level(sets.size * 100 // percent, percent)
        doc, value, level = sets.doc, sets.hash, low[sets.doc]
        for k in range(1, int((high - low).max()) + 1 if rows else 0):
            again = np.flatnonzero((low + k <= high)[sets.doc])
            doc, value, level = np.concatenate([doc, sets.doc[again]]), np.concatenate([value, sets.hash[again]]), np.concatenate([level, (low + k)[sets.doc[again]]])
        # units are numbered by text, then level, then part; levels from ``low`` on have 2**low, 2**(low + 1), ... units
        per = np.where(sets.size > 0, (1 << high + 1) - (1 << low), 0)
        base = np.cumsum(per) - per
        part = (value & np.uint64(0xFFFF)).astype(np.int64) & ((1 << level) - 1)
        unit = base[doc] + (1 << level) - (1 << low[doc]) + part
        pre = np.argsort(unit, kind="stable")
        unit, value, level = unit[pre], value[pre], level[pre]
        order = sort_within(unit, value, rank[(value >> np.uint64(64 - ORDER_BITS)).astype(np.int64)])
        unit, value, level = unit[order], value[order], level[order]
        units = int(per.sum())
        size = np.bincount(unit, minlength=units) if units else np.zeros(0, dtype=np.int64)
        begin = np.cumsum(size) - size
        at = np.arange(len(unit)) - begin[unit] if units else np.zeros(0, dtype=np.int64)
        prefix = size - -(-percent * size // 100) + 1
        taken = at < prefix[unit] if units else np.zeros(0, dtype=bool)
        self.keys = (value ^ (level.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))[taken]
        self.unit_size = size
        self.key_of_unit = np.bincount(unit[taken], minlength=units) if units else size
        bit = ((value >> np.uint64(16)) & np.uint64(63)).astype(np.uint64)
        word = ((value >> np.uint64(22)) & np.uint64(3)).astype(np.int64)
        self.map = np.zeros((units, 4), dtype=np.uint64)
        if units:
            some = np.flatnonzero(size)
            for k in range(4):
                self.map[some, k] = np.bitwise_xor.reduceat(np.where(word == k, np.uint64(1) << bit, np.uint64(0)), begin[some])
        self.units = per
        total = np.concatenate([[0], np.cumsum(self.key_of_unit)])
        ends = np.cumsum(per)
        self.keys_of_doc = total[ends] - total[ends - per]


_SIGNATURE = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("fp0", T.LongType()),
    T.StructField("fp1", T.LongType()),
    T.StructField("unit_size", T.ArrayType(T.IntegerType())),
    T.StructField("unit_keys", T.ArrayType(T.IntegerType())),
    T.StructField("unit_map", T.ArrayType(T.LongType())),
    T.StructField("keys", T.ArrayType(T.LongType())),
]


def signatures(docs: DataFrame, id_col: str, text_col: str, rank, n: int, percent: int) -> DataFrame:
    def make():
        table = rank.value

        def f(batch):
            out: list[list] = [[] for _ in _SIGNATURE]
            for chunk in ts.chunks(batch.column(batch.schema.get_field_index(text_col))):
                s = Signatures(chunk, table, n, percent)
                columns = [
                    pa.array(s.size, pa.int64()),
                    pa.array(s.fp[0].view(np.int64)),
                    pa.array(s.fp[1].view(np.int64)),
                    _lists(s.unit_size.astype(np.int32), s.units, pa.int32()),
                    _lists(s.key_of_unit.astype(np.int32), s.units, pa.int32()),
                    _lists(s.map.view(np.int64).reshape(-1), s.units * 4, pa.int64()),
                    _lists(s.keys.view(np.int64), s.keys_of_doc, pa.int64()),
                ]
                for o, c in zip(out, columns, strict=True):
                    o.append(c)
            return [pa.concat_arrays(o) for o in out]

        return f

    return map_rows(docs.select(id_col, text_col), make, [id_col], _SIGNATURE)


def _index_rows(batches):
    """One row for each key of each unit: key, set, and the unit's number, size and the key's place in it."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        _, once = np.unique(node, return_index=True)  # copies near each other enter once
        batch = batch.take(pa.array(np.sort(once)))
        node = batch.column(0).to_numpy()
        size, keys_of, keys = (batch.column(k) for k in range(1, 4))
        units = np.diff(size.offsets.to_numpy())
        unit_keys = keys_of.flatten().to_numpy()
        unit = np.repeat(np.arange(len(unit_keys)), unit_keys)
        begin = np.cumsum(unit_keys) - unit_keys
        number = np.arange(len(unit_keys)) - np.repeat(np.cumsum(units) - units, units)
        place = number[unit] << 32 | size.flatten().to_numpy()[unit].astype(np.int64) << 16 | np.arange(len(unit)) - begin[unit]
        key, node = keys.flatten().to_numpy(), np.repeat(node, units)[unit]
        for at in range(0, len(key), 50_000):
            w = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[w]), pa.array(node[w]), pa.array(place[w])], names=["key", "node", "place"])


def _shared_keys(batches):
    """Of rows sorted by key and node: those whose key another node has, each node once a key."""
    rest = None
    for batch in batches:
        key, node, place = (batch.column(k).to_numpy() for k in range(3))
        if rest is not None:
            key, node, place = (np.concatenate(x) for x in zip(rest[:3], (key, node, place), strict=True))
        if not len(key):
            continue
        # the last node's rows of the last key stay, with one row before them, for what follows
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, place = key[fresh], node[fresh], place[fresh]
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        if rest is not None and rest[3]:
            keep[0] = False  # given out already
        yield _shared(key[:-1], node[:-1], place[:-1], keep[:-1])
        given = False
        if keep[-1]:
            yield _shared(key[-1:], node[-1:], place[-1:], keep[-1:])
            given = True
        elif rest is not None and rest[3] and len(key) == 1:
            given = True
        rest = (key[-1:], node[-1:], place[-1:], given)
    return


def _shared(key, node, place, keep):
    key, node, place = key[keep], node[keep], place[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(node), pa.array(place >> 32, pa.int32()), pa.array(place >> 16 & 0xFFFF, pa.int32()), pa.array(place & 0xFFFF, pa.int32())],
        names=["key", "node", "unit", "size", "at"],
    )


_INDEX = ["key", "node", "size", "at", "m0", "m1", "m2", "m3"]


class _Lists:
    """Columns of rows sorted by key, size, node."""

    def __init__(self, key, node, size, at, bits):
        self.key, self.node, self.size, self.at, self.bits = key, node, size, at, bits

    def __len__(self):
        return len(self.key)

    def take(self, i) -> _Lists:
        return _Lists(self.key[i], self.node[i], self.size[i], self.at[i], self.bits[i])

    def join(self, other: _Lists) -> _Lists:
        return _Lists(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("key", "node", "size", "at", "bits")))

    @staticmethod
    def of(batch) -> _Lists:
        c = [batch.column(k).to_numpy() for k in range(8)]
        return _Lists(c[0], c[1], c[2].astype(np.int64), c[3].astype(np.int64), np.stack(c[4:], axis=1).view(np.uint64))

    def passing(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Pairs that can reach the threshold, skipping by size, then by position, then by parity map."""
        a, b = self.size[i], self.size[j]
        need = -(-percent * (a + b) // (100 + percent))
        ok = np.flatnonzero((np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (np.minimum(a - self.at[i], b - self.at[j]) >= need))
        apart = np.bitwise_count(self.bits[i[ok]] ^ self.bits[j[ok]]).sum(axis=1, dtype=np.int64)
        out = np.zeros(len(i), dtype=bool)
        out[ok] = apart <= (a + b - 2 * need)[ok]
        return out


def _stars(rows: _Lists, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that span what passes within each list."""
    n = len(rows)
    again = np.zeros(n, dtype=bool)
    again[1:] = rows.key[1:] == rows.key[:-1]
    keep = again.copy()
    keep[:-1] |= again[1:]
    rows = rows.take(np.flatnonzero(keep))
    n = len(rows)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = rows.key[1:] != rows.key[:-1]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    head = np.arange(n)
    next_to = np.flatnonzero(~new)
    linked = next_to[rows.passing(next_to - 1, next_to, percent)]
    head[linked] = 0
    head = np.maximum.accumulate(head)
    left, right = [head[linked]], [linked]
    label = head
    small = np.repeat(length <= SMALL_LIST, length)
    run = np.repeat(np.arange(len(begin)), length)
    for d in range(2, min(SMALL_LIST, int(length.max()))):
        i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:]) & (label[:-d] != label[d:]))
        if len(i):
            i = i[rows.passing(i, i + d, percent)]
            left.append(i)
            right.append(i + d)
    for r in np.flatnonzero(length > SMALL_LIST):
        for a, b in _large_list(rows, int(begin[r]), int(begin[r] + length[r]), label, percent):
            left.append(a)
            right.append(b)
    a, b = rows.node[np.concatenate(left)], rows.node[np.concatenate(right)]
    return a, b


def _large_list(rows: _Lists, begin: int, end: int, label: np.ndarray, percent: int):
    own = label[begin:end].copy()
    values, counts = np.unique(own, return_counts=True)
    if len(values) == 1:
        return
    if end - begin > LARGE_LIST:  # no comparing: neighbours whose sizes fit count as passing, which can only widen candidates
        i = np.arange(begin, end - 1)
        i = i[rows.size[i] * 100 >= rows.size[i + 1] * percent]
        yield i, i + 1
        return
    main = values[counts.argmax()]
    rest = np.flatnonzero(own != main)
    all_ = np.arange(begin, end)
    done = np.zeros(end - begin, dtype=bool)
    # all pairs of different labels have an end outside the largest label
    for k in rest:
        low = np.searchsorted(rows.size[begin:end], -(-rows.size[begin + k] * percent // 100))
        high = np.searchsorted(rows.size[begin:end], rows.size[begin + k] * 100 // percent, side="right")
        other = np.arange(low, high)
        other = other[(own[other] != own[k]) & ~done[other]]
        done[k] = True
        if not len(other):
            continue
        got = other[rows.passing(np.full(len(other), begin + k), begin + other, percent)]
        if len(got):
            _, once = np.unique(own[got], return_index=True)
            got = got[once]
            yield np.full(len(got), begin + k), all_[got]
            own[np.isin(own, own[got])] = own[k]


def _chained(rows: _Lists, end: int, percent: int):
    """Pairs of neighbours among the first ``end`` rows whose sizes fit: they count as passing."""
    i = np.arange(end - 1)
    i = i[rows.size[i] * 100 >= rows.size[i + 1] * percent]
    return _pairs(rows.node[i], rows.node[i + 1])


def _edges(percent: int):
    def run(batches):
        rest: _Lists | None = None
        chained = False  # whether the list of the row in ``rest`` is chained: then it is to its end
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Lists.of(batch)
            if rest is not None:
                rows = rest.join(rows)
            if chained:
                end = int(np.searchsorted(rows.key, rows.key[0], side="right"))
                yield _chained(rows, end, percent)
                chained = end == len(rows)
                rows = rows.take(np.arange(end - chained, len(rows)))
                if chained:
                    rest = rows
                    continue
            cut = int(np.searchsorted(rows.key, rows.key[-1])) if rows.key[0] != rows.key[-1] else 0
            if not cut and len(rows) > LARGE_LIST:
                # the last row stays for what follows
                yield _chained(rows, len(rows), percent)
                rest, chained = rows.take(np.arange(len(rows) - 1, len(rows))), True
                continue
            rest = rows.take(np.arange(cut, len(rows)))
            if cut:
                yield _pairs(*_stars(rows.take(np.arange(cut)), percent))
        if rest is not None and len(rest):
            yield _pairs(*_stars(rest, percent))

    return run


def _pairs(a: np.ndarray, b: np.ndarray):
    a, b = np.minimum(a, b), np.maximum(a, b)
    differ = a != b
    pairs = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 1]), pa.int64())], names=["a", "b"])


# --- exact join within candidate components


class Group:
    """Sets of one candidate component, or of two of its blocks."""

    MOST_ANCHORS = 256

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.id = np.empty(len(flat), dtype=np.int64)
        self.id[order] = np.cumsum(new) - 1
        self.owner = owner[order]
        self.list_begin = np.append(np.flatnonzero(new), len(flat))

    def ids(self, k: int) -> np.ndarray:
        return self.id[self.begin[k] : self.begin[k + 1]]

    def overlap(self, ids: np.ndarray) -> np.ndarray:
        """How many of these shingles each set holds."""
        first, n = self.list_begin[ids], self.list_begin[ids + 1] - self.list_begin[ids]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[at], minlength=len(self.size))

    def links(self):
        """For each set its number and the mask of sets that it links with, itself included if not empty."""
        m = len(self.size)
        near = np.full(m, -1, dtype=np.int64)
        apart = np.full(m, np.iinfo(np.int64).max, dtype=np.int64)
        answers: dict[int, np.ndarray] = {}
        mark = np.zeros(len(self.list_begin) - 1, dtype=bool)
        for k in range(m):
            ids = self.ids(k)
            a = int(near[k])
            if a in answers and apart[k] * 2 < self.size[k]:
                other = self.ids(a)
                mark[other] = True
                more = ids[~mark[ids]]
                mark[other] = False
                mark[ids] = True
                less = other[~mark[other]]
                mark[ids] = False
                count = answers[a] + self.overlap(more) - self.overlap(less)
            else:
                count = self.overlap(ids)
                if len(answers) >= self.MOST_ANCHORS:
                    answers.pop(next(iter(answers)))
                answers[k] = count
                d = self.size + self.size[k] - 2 * count
                closer = d < apart
                apart[closer], near[closer] = d[closer], k
            yield k, 100 * count >= self.percent * (self.size + self.size[k] - count)


def join_group(node: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int):
    """node, links with rows of other texts, smallest node linked to it here.  side: 2 if on both sides of the pair of blocks, else 0 or 1."""
    parent = np.arange(len(node))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    across = not (side == 2).all()
    total = np.zeros(len(node), dtype=np.int64)
    for k, hit in Group(sets, percent).links():
        if across:
            hit = hit & (side != side[k])
        hit[k] = False
        total[k] = copies[hit].sum()
        mine = root(k)
        for x in np.flatnonzero(hit & (parent != mine)).tolist():
            other = root(x)
            if other != mine:
                parent[max(other, mine)] = mine = min(other, mine)
    roots = np.array([root(x) for x in range(len(node))])
    least = np.full(len(node), np.iinfo(np.int64).max, dtype=np.int64)
    np.minimum.at(least, roots, node)
    return total, least[roots]


def _join_groups(percent: int):
    """Over rows sorted by component and blocks."""

    def out(rows):
        node = np.array([r[3] for r in rows], dtype=np.int64)
        copies = np.array([r[4] for r in rows], dtype=np.int64)
        side = np.array([2 if r[1] == r[2] else r[5] for r in rows], dtype=np.int64)
        return node, *join_group(node, copies, side, [np.frombuffer(r[6], dtype=np.uint64) for r in rows], percent)

    def run(batches):
        rows: list[tuple] = []
        done: list[tuple] = []
        held = 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "root"])

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if rows and rows[0][:3] != r[:3]:
                    done.append(out(rows))
                    held += len(rows)
                    rows = []
                    if held > 20_000:
                        held = 0
                        yield flush()
                rows.append(r)
        if rows:
            done.append(out(rows))
        if done:
            yield flush()

    return run


def _sets(members: DataFrame, text_col: str, n: int) -> DataFrame:
    """members with text -> with the set's hashes as binary."""

    def make():
        def f(batch):
            out = []
            for chunk in ts.chunks(batch.column(batch.schema.get_field_index(text_col))):
                s = Sets(chunk, n)
                ends = np.cumsum(s.size)
                out += [s.hash[b - k : b].tobytes() for b, k in zip(ends.tolist(), s.size.tolist(), strict=True)]
            return [pa.array(out, pa.binary())]

        return f

    return map_rows(members, make, [c for c in members.columns if c != text_col], [T.StructField("hashes", T.BinaryType())])


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (smallest id with an equal set), n_links (other documents whose
    sets reach ``percent`` of Jaccard similarity, copies included), component_id (smallest id reachable by links)."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent {percent}")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if docs.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        found = _by_row(docs, n, percent, group)
    else:
        found = _similar(docs, n, percent, group)
    return found.withColumnRenamed("id", id_col)


def _by_row(docs: DataFrame, n: int, percent: int, group: int) -> DataFrame:
    """Of rows that may share ids: joined by number of row, then named by id."""
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = _similar(numbered.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("id"), "text"), n, percent, group)
    told = stored(found.withColumnRenamed("id", "row").where("row is not null").join(numbered.select("row", "id"), "row"), "told")
    names = [told.groupBy(F.col(c).alias(f"{c}_row")).agg(F.min("id").alias(c)) for c in ("class_id", "component_id")]
    out = told.withColumnsRenamed({"class_id": "class_id_row", "component_id": "component_id_row"})
    for name in names:
        out = out.join(name, name.columns[0])
    alone = found.where("id is null")
    return out.select(*alone.columns).unionByName(alone)


def _similar(docs: DataFrame, n: int, percent: int, group: int) -> DataFrame:
    """``similar_documents`` of id, text, with unique ids or null ones."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(shingle_order(docs, "text", n))
    signed = stored(signatures(docs, "id", "text", rank, n, percent), "signatures")
    some = signed.where("n_shingles > 0 and id is not null")
    one = ["n_shingles", "fp0", "fp1"]
    thin = some.select("fp0", "unit_size", "unit_keys", "keys").mapInArrow(_index_rows, "key long, node long, place long")
    shared = thin.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared_keys, "key long, node long, unit int, size int, at int")
    maps = some.groupBy(F.col("fp0").alias("node")).agg(F.first("unit_map").alias("unit_map"))
    index = shared.join(maps, "node").select("key", "node", "size", "at", *(F.get("unit_map", F.col("unit") * 4 + k).alias(f"m{k}") for k in range(4)))
    index = index.repartition("key").sortWithinPartitions("key", "size", "node")
    found = components(index.mapInArrow(_edges(percent), "a long, b long"))

    # two classes of one fp0 would enter the same component, which is no harm
    named = some.groupBy(*one).agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    members = stored(named.join(found, named["fp0"] == found["node"]).select("class_id", "copies", "n_shingles", "component"), "members")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(group / 2)).cast("int").alias("n"), F.count("*").alias("sets"))
    by_sets = F.when(F.col("sets") > WHOLE_SETS, F.ceil(F.sqrt(F.col("sets") / BLOCK_SHARE)).cast("int")).otherwise(1)
    blocks = blocks.select("component", F.greatest(F.when(F.col("n") <= 2, 1).otherwise(F.col("n")), by_sets).alias("n"))
    cut = blocks.where("n > 1").limit(1).count() > 0
    members = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("n")).cast("int"))
    small = members.count() <= BROADCAST_ROWS
    side = members.select(F.col("class_id"), "component", "copies", "n", "block")
    told = docs.join(F.broadcast(side) if small else side, docs["id"] == side["class_id"])
    hashed = _sets(told.select("component", "n", "block", "class_id", "copies", "text"), "text", n)
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), F.when(j < F.col("block"), 1).otherwise(0).alias("side")))
    dealt = hashed.select("component", F.explode(pairs).alias("p"), "class_id", "copies", "hashes").select("component", "p.i", "p.j", "class_id", "copies", "p.side", "hashes")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", F.octet_length("hashes"), "class_id")
    linked = dealt.mapInArrow(_join_groups(percent), "node long, links long, root long")
    if cut:
        linked = stored(linked, "linked")
        joined = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "root")
        linked = linked.groupBy("node").agg(F.sum("links").alias("links")).join(joined, "node", "left")
    else:
        linked = linked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    named = named.join(linked, named["class_id"] == linked["node"], "left").select(*one, "class_id", "copies", "links", "root")
    narrow = signed.select("id", *one)
    joined = narrow.where("n_shingles > 0 and id is not null").join(named, one).select(
        F.col("id"),
        "n_shingles",
        "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "class_id").alias("component_id"),
    )
    alone = narrow.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS f FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id, count(*) OVER (PARTITION BY f) AS copies FROM k),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
d AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
m AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
