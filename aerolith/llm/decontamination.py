"""Benchmark decontamination: hash set of normalised test n-grams.

Benchmark items are cut into windows of ``n`` words; hashes of the windows, and
the words themselves, are broadcast in a block of at most ``BLOCK_WORDS`` item
words (or one longer item), which bounds what the driver and a task hold.  A larger
benchmark takes several passes over the rows, one after the other: each block is
built, broadcast, applied and released, the hits of a pass are written as narrow
rows, and in the end each row's hits are put together.  Each text is hashed window
by window, hits are looked up in the sorted hash set and verified word by word, and
the words of verified windows are marked.

Nulls and texts without words have no windows: nothing is hit.  A very long text is
scanned whole.  An item without words is ignored, and a null item id counts as the id
``null``.  Repeated rows are judged one by one; repeated items count once per id; items
are listed in order of their ids as strings.  Empty tables give no rows, or no hits.
``scan`` replaces columns that have the names of its own; ``decontaminate`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import textscan as ts
from aerolith.llm.arrowmap import fresh, map_rows, quoted
from aerolith.llm.scratch import stored

N = 13
BLOCK_WORDS = 500_000
_STEP = 0xD1342543DE82EF95

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def _window_hash(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` word hashes from each of ``start``."""
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_STEP) + words[start + k]
    return ts.mix64(out)


class Grams:
    """Windows of some items, by window length, with their items and words."""

    def __init__(self, items: list[tuple[str, str]], n: int = N):
        chunk = ts.of_texts([text for _, text in items])
        words = chunk.words(ts.ALNUM)
        hashes = words.hash()
        raw = ts.LOWER[chunk.data].tobytes()
        self.vocabulary = {h: raw[a:b] for h, a, b in zip(hashes.tolist(), words.start.tolist(), words.stop.tolist(), strict=True)}
        by_length: dict[int, list[tuple[int, str]]] = {}
        for k, (item, _) in enumerate(items):
            first, last = int(words.of[k]), int(words.of[k + 1])
            if first < last:
                size = min(n, last - first)
                by_length.setdefault(size, []).extend((i, item) for i in range(first, last - size + 1))
        #: length -> sorted distinct window hashes, word hashes of each, item ids of each
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[str, ...]]]] = {}
        for size, found in by_length.items():
            start = np.array([i for i, _ in found], dtype=np.int64)
            keys = _window_hash(hashes, start, size)
            owners: dict[int, dict[str, None]] = {}
            first_at: dict[int, int] = {}
            for key, (at, item) in zip(keys.tolist(), found, strict=True):
                owners.setdefault(key, {})[item] = None
                first_at.setdefault(key, at)
            order = sorted(owners)
            at = np.array([first_at[k] for k in order], dtype=np.int64)
            self.windows[size] = (
                np.array(order, dtype=np.uint64),
                hashes[at[:, None] + np.arange(size)],
                [tuple(owners[k]) for k in order],
            )
        self.bits = {size: self._bits(keys) for size, (keys, _, _) in self.windows.items()}

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, dtype=bool)
        out[(keys >> np.uint64(44)).astype(np.int64)] = True
        return out

    def scan(self, chunk: ts.Chunk) -> tuple[ts.Words, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Rows with verified hits: their word ranges (within the text, merged) and the items."""
        words = chunk.words(ts.ALNUM)
        hit_at, hit_size, hit_key = [], [], []
        if len(words):
            hashes = words.hash()
            after = np.repeat(words.of[1:], words.counts())
            for size, (keys, _, _) in self.windows.items():
                start = np.flatnonzero(np.arange(len(words)) + size <= after)
                if not len(start):
                    continue
                got = _window_hash(hashes, start, size)
                maybe = np.flatnonzero(self.bits[size][(got >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, got[maybe]), len(keys) - 1)
                sure = keys[at] == got[maybe]
                maybe, at = start[maybe[sure]], at[sure]
                if len(maybe):
                    same = (hashes[maybe[:, None] + np.arange(size)] == self.windows[size][1][at]).all(axis=1)
                    hit_at.append(maybe[same])
                    hit_key.append(at[same])
                    hit_size.append(np.full(int(same.sum()), size))
        if not hit_at or not sum(map(len, hit_at)):
            return words, {}
        at, size, key = np.concatenate(hit_at), np.concatenate(hit_size), np.concatenate(hit_key)
        ok = self._spelled(words, hashes, at, size)
        rows = np.searchsorted(words.of, at, side="right") - 1
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for row, a, n, k in sorted(zip(rows[ok].tolist(), at[ok].tolist(), size[ok].tolist(), key[ok].tolist(), strict=True)):
            ranges, items = found.setdefault(row, ([], set()))
            items.update(self.windows[n][2][k])
            a -= int(words.of[row])
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], a + n))
            else:
                ranges.append((a, a + n))
        return words, found

    def _spelled(self, words: ts.Words, hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which windows consist of the very words of the items."""
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        wrong = np.zeros(len(words) + 1, dtype=np.int64)
        data = ts.LOWER[words.chunk.data].tobytes()
        for i in np.flatnonzero(np.cumsum(cover)[:-1]):
            wrong[i + 1] = self.vocabulary.get(int(hashes[i])) != data[words.start[i] : words.stop[i]]
        wrong = np.cumsum(wrong)
        return wrong[at + size] == wrong[at]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    block: list[tuple[str, str]] = []
    words = 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        size = len(text) // 2 + 1  # words at most
        if block and words + size > block_words:
            yield block
            block, words = [], 0
        block.append((item, text))
        words += size
    yield block


NAMES = ("n_words", "hit_words", "hit_items", "clean_text")


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, keep: list[str] | None = None, cut: bool = False, block_words: int = BLOCK_WORDS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """``keep`` columns (all by default) plus ``n_words``, ``hit_words`` (merged word ranges), ``hit_items`` (sorted)
    and, with ``cut``, ``clean_text``: the text without the bytes from the first to the last word of each range."""
    spark: SparkSession = docs.sparkSession
    keep = list(docs.columns) if keep is None else keep
    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))]
    if cut:
        fields.append(T.StructField(names[3], T.StringType()))
    used = docs.select(*(quoted(c) for c in dict.fromkeys([*keep, text_col])))
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return map_rows(used, _maker(text_col, cut, block=spark.sparkContext.broadcast(Grams(first, n))), keep, fields)
    row, spans, items = fresh([*used.columns, *names], "_row", "_spans", "_items")
    rows = stored(used.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = [T.StructField(spans, SPANS), T.StructField(items, T.ArrayType(T.StringType()))]
    found = None
    for items_of in _chain([first, second], blocks):
        block = spark.sparkContext.broadcast(Grams(items_of, n))
        part = map_rows(rows.select(row, quoted(text_col)), _maker(text_col, False, block=block, count=False), [row], narrow).where(F.size(items) > 0)
        part = stored(part, "hits")
        block.destroy()
        found = part if found is None else found.unionByName(part)
    both = found.groupBy(row).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    return map_rows(rows.join(both, row, "left"), _maker(text_col, cut, had=(spans, items)), keep, fields)


def _chain(begin: list, rest: Iterator) -> Iterator:
    while begin:
        yield begin.pop(0)
    yield from rest


def _maker(text_col: str, cut: bool, *, block=None, had: tuple[str, str] | None = None, count: bool = True):
    """Hits of the items of ``block``, or those in the columns ``had`` of earlier passes."""
    type_ = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def make():
        grams: Grams | None = block.value if block else None

        def f(batch):
            column = batch.column(batch.schema.get_field_index(text_col))
            ours = [batch.column(batch.schema.get_field_index(c)) for c in had or ()]
            counts, ranges, items, texts = [], [], [], []
            for chunk in ts.chunks(column):
                words, found = grams.scan(chunk) if grams else (chunk.words(ts.ALNUM), {})
                counts.append(words.counts())
                for r in range(chunk.rows):
                    own, names = found.get(r, ((), ()))
                    if had:
                        own, names = (c[chunk.first + r].as_py() or [] for c in ours)
                        own = _merged([(x["start"], x["stop"]) for x in own])
                    ranges.append([{"start": a, "stop": b} for a, b in own])
                    items.append(sorted(names))
                    if cut:
                        texts.append(_without(chunk, words, r, own) if column[chunk.first + r].is_valid else None)
            out = [pa.array(np.concatenate(counts), pa.int64())] if count else []
            out += [pa.array(ranges, type_), pa.array(items, pa.list_(pa.string()))]
            return [*out, pa.array(texts, pa.string())] if cut else out

        return f

    return make


def _without(chunk: ts.Chunk, words: ts.Words, row: int, ranges) -> str:
    raw, at, out = chunk.data, int(chunk.bounds[row]), []
    first = int(words.of[row])
    for a, b in ranges:
        out.append(raw[at : words.start[first + a]].tobytes())
        at = int(words.stop[first + b - 1])
    out.append(raw[at : chunk.bounds[row + 1]].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def n_hit(spans: str = "hit_words") -> F.Column:
    return F.aggregate(quoted(spans), F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))


def contaminated(least_percent: int = 5, *, words: str = "n_words", spans: str = "hit_words") -> F.Column:
    """At least that share of the words is in windows of the benchmark."""
    return (n_hit(spans) > 0) & (n_hit(spans) * 100 >= quoted(words) * least_percent)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with all texts cut at verified windows."""
    names = tuple(fresh(docs.columns, *NAMES))
    if remove == "spans":
        out = scan(docs, benchmark, text_col=text_col, cut=True, names=names, **options)
        return out.select(*(quoted(names[3]).alias(c) if c == text_col else quoted(c) for c in docs.columns))
    if remove != "documents":
        raise ValueError(remove)
    kept = scan(docs, benchmark, text_col=text_col, names=names, **options).where(~contaminated(words=names[0], spans=names[1]))
    return kept.select(*(quoted(c) for c in docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
WITH dw AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dg JOIN bg USING (n, g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
