"""Toxicity: noisy-channel restoration of disguised words, then a linear score.

A character trigram model is counted over all texts.  Places where text may be
disguised (symbols or digits beside letters, letters three times or more in a
row, three or more single letters with gaps between) become lattices: a symbol may stand for
letters, a repetition for one or two letters, a gap for nothing or a space.
Viterbi decoding finds the likeliest reading under the trigram model; any other
place has one reading, itself.  The words of the text and of the readings, and
their beginnings, are features of a logistic regression.

The regression learns from at most about ``LABELS`` labelled rows, chosen by a
hash of their id (its documented bound), from at most ``MOST_FEATURES`` features chosen of
the ``CANDIDATES`` most frequent ones of toxic texts; the trigram counts cover every text.
A null text scores as an empty one: the intercept.  Without labels of both
kinds every score is 0.  If an id has several labels, the highest counts; null
labels and ids count as none.  Repeated rows are scored alike; of readings that are
equally likely the first found is taken.  A very long text is scanned whole, and a very
long place is decoded whole, without a beam.  An empty table has an empty result.
``score`` replaces a column that has the name of its result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import textscan as ts
from aerolith.llm.arrowmap import map_rows, quoted
from aerolith.llm.ngram_join import _sum_arrays

LABELS = 20_000
MOST_FEATURES = 4_000
#: features of toxic texts that are counted, the most frequent first
CANDIDATES = 1 << 20
PREFIXES = (4, 6, 8)
_PREFIX_SALT = {n: np.uint64(0x632BE59BD9B4E019 * n & (1 << 64) - 1) for n in PREFIXES}

#: fixed values: the letters that a symbol or digit may stand for
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h"}

#: log10 costs of the channel
SUBSTITUTED, KEPT, REPEATED, SPLIT = 0.4, 4.0, 0.3, 0.7

# --- character model

#: 0 ends a word, 1-26 are a-z, 27-58 are U+00E0 to U+00FF (upper case folded in), 59 is any other letter
SYMBOLS = 64
_CODE = np.zeros(256, dtype=np.int64)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0x80:0xA0] = _CODE[0xA0:0xC0] = np.arange(27, 59)
_CODE[0xC0:] = 59


def code_of(c: str) -> int:
    n = ord(c)
    if n < 0x80:
        return int(_CODE[n])
    return 27 + (n - 0xC0) % 32 if 0xC0 <= n <= 0xFF else 59


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts over all texts, by two symbols before (0 outside the word) and the symbol."""
    width = SYMBOLS**3

    def make():
        total = np.zeros(width, dtype=np.int64)

        def add(batch):
            for chunk in ts.chunks(batch.column(0)):
                total[:] += np.bincount(_trigrams(chunk), minlength=width)

        return add, total

    return _sum_arrays(docs.select(text_col), make, width)


def _trigrams(chunk: ts.Chunk) -> np.ndarray:
    """Number of each trigram; a text's first symbols have nothing before them."""
    kept = chunk.data != 0xC3
    code = _CODE[chunk.data[kept]]
    begin = np.concatenate([[0], np.cumsum(kept)])[chunk.bounds[:-1]]
    one, two = np.concatenate([[0], code[:-1]])[: len(code)], np.concatenate([[0, 0], code[:-2]])[: len(code)]
    one[begin[begin < len(code)]] = 0
    two[begin[begin < len(code)]] = 0
    two[begin[begin + 1 < len(code)] + 1] = 0
    two[one == 0] = 0
    used = (one != 0) | (code != 0)
    return (((two << 6) + one << 6) + code)[used]


class CharacterModel:
    """log10 P(symbol | two before), interpolated with lower orders."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        one = three.sum(axis=(0, 1)) + 1
        p = one / one.sum()
        two = three.sum(axis=0)
        p = (two + 20 * p) / (two.sum(axis=1, keepdims=True) + 20)
        p = (three + 20 * p) / (three.sum(axis=2, keepdims=True) + 20)
        self.log = np.log10(p).astype(np.float32)

    def restore(self, place: str) -> str:
        """The likeliest reading of a disguised place."""
        units = _lattice(place)
        log = self.log
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        for unit in units:
            now: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for state, score in best.items():
                for out, cost in unit:
                    s, to = score - cost, state
                    for c in out:
                        k = 0 if c == " " else code_of(c)
                        s += float(log[to[0], to[1], k])
                        to = (to[1], k) if k else (0, 0)
                    if s > now.get(to, -1e18):
                        now[to], came[to] = s, (state, out)
            best = now
            back.append(came)
        end = max(best, key=lambda s: best[s] + float(log[s[0], s[1], 0]))
        out: list[str] = []
        for came in reversed(back):
            end, text = came[end]
            out.append(text)
        return "".join(reversed(out))


def _lattice(place: str) -> list[list[tuple[str, float]]]:
    place = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in place)
    units: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(place):
        c = place[k]
        run = 1
        while k + run < len(place) and place[k + run] == c:
            run += 1
        if c in STANDS_FOR:
            for _ in range(run):
                units.append([(x, SUBSTITUTED) for x in STANDS_FOR[c]] + [("", KEPT), (" ", KEPT)])
        elif c.isalpha():
            if run == 1:
                units.append([(c, 0.0)])
            else:
                units.append([(c, REPEATED), (c * 2, REPEATED * (run > 2))])
        else:
            units.append([("", 0.0), (" ", SPLIT)])
        k += run
    return units


# --- disguised places

_LEET = np.zeros(256, dtype=bool)
_LEET[[ord(c) for c in STANDS_FOR]] = True
_ALONE = ts.LETTER.copy()
_ALONE[0x30:0x3A] = _ALONE[[ord("@"), ord("$")]] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
#: first bytes of letters of two bytes
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True
#: most bytes between spaced letters
GAP = 5


def disguised(chunk: ts.Chunk) -> list[tuple[int, int, int]]:
    """Places that may be disguised: row, first and last byte."""
    data = chunk.data
    if len(data) < 2:
        return []
    out: list[tuple[int, int, int]] = []
    low = ts.LOWER[data]
    # what stands together must be of one text
    last = np.zeros(len(data) + 1, dtype=bool)
    last[chunk.bounds[1:] - 1] = True
    last = last[: len(data)]
    odd = np.zeros(len(data), dtype=bool)
    leet, letter = _LEET[data], ts.LETTER[data]
    beside = (leet[:-1] & letter[1:] | letter[:-1] & leet[1:]) & ~last[:-1]
    odd[:-1] = beside
    odd[:-2] |= (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & _ASCII_LETTER[data[:-2]] & ~last[:-2] & ~last[1:-1]
    if len(data) >= 6:
        again = _LEAD[data[:-2]] & (data[:-2] == data[2:]) & ~last[1:-1]
        again[:-1] &= data[1:-2] == data[3:]
        again[-1] = False
        odd[:-4] |= again[:-2] & again[2:]
    at = np.flatnonzero(odd)
    if len(at):
        words = chunk.words(ts.NON_SPACE)
        hit = np.unique(np.searchsorted(words.start, at, side="right") - 1)
        hit = hit[hit >= 0]
        rows = np.searchsorted(words.of, hit, side="right") - 1
        out += list(zip(rows.tolist(), words.start[hit].tolist(), words.stop[hit].tolist(), strict=True))
    words = chunk.words(_ALONE)
    if len(words) >= 3:
        size = words.stop - words.start
        alone = (size == 1) | (size == 2) & _LEAD[data[words.start]]
        near = np.zeros(len(words), dtype=bool)
        near[1:] = alone[1:] & alone[:-1] & (words.start[1:] - words.stop[:-1] <= GAP)
        near[words.of[:-1][words.of[:-1] < len(words)]] = False
        edge = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1
        long = last - first >= 2
        first, last = first[long], last[long]
        rows = np.searchsorted(words.of, first, side="right") - 1
        out += list(zip(rows.tolist(), words.start[first].tolist(), words.stop[last].tolist(), strict=True))
    return out


# --- features


def _features(words: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word and each of its beginnings."""
    rows, size = words.text_of(), words.stop - words.start
    h, r = [words.hash()], [rows]
    for n in PREFIXES:
        i = np.flatnonzero(size > n)
        h.append(words.hash(words.start[i], words.start[i] + n) ^ _PREFIX_SALT[n])
        r.append(rows[i])
    return np.concatenate(r), np.concatenate(h)


class Reader:
    """Features of chunks, disguised places restored."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def restored(self, chunk: ts.Chunk) -> list[tuple[int, str]]:
        out = []
        raw = chunk.data.tobytes() if (places := disguised(chunk)) else b""
        for row, a, b in places:
            place = raw[a:b]
            if (read := self.known.get(place)) is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                read = self.known[place] = self.model.restore(place.decode("utf-8", "replace"))
            out.append((row, read))
        return out

    def features(self, chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        rows, hashes = _features(chunk.words(ts.LETTER))
        if read := self.restored(chunk):
            more = ts.of_texts([t for _, t in read])
            r, h = _features(more.words(ts.LETTER))
            rows, hashes = np.concatenate([rows, np.array([r for r, _ in read], dtype=np.int64)[r]]), np.concatenate([hashes, h])
        return rows, hashes


def _in(table: np.ndarray, bits: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``h`` is in the sorted table, and its place there."""
    maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, h[maybe]), max(len(table) - 1, 0))
    sure = table[at] == h[maybe] if len(table) else np.zeros(len(maybe), dtype=bool)
    return maybe[sure], at[sure]


def _bits(table: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    out[(table >> np.uint64(44)).astype(np.int64)] = True
    return out


@dataclass
class Model:
    characters: CharacterModel
    intercept: float = -np.inf
    #: sorted hashes, the weight of a feature that occurs, and what is added if it occurs more than once
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    once: np.ndarray = field(default_factory=lambda: np.zeros(0))
    again: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scorer(self):
        reader, bits = Reader(self.characters), _bits(self.table)

        def score(chunk: ts.Chunk) -> np.ndarray:
            z = np.full(chunk.rows, self.intercept)
            if len(self.table):
                rows, hashes = reader.features(chunk)
                i, at = _in(self.table, bits, hashes)
                pair, n = np.unique(rows[i] * len(self.table) + at, return_counts=True)
                k = pair % len(self.table)
                z += np.bincount(pair // len(self.table), self.once[k] + np.where(n > 1, self.again[k], 0), minlength=chunk.rows)
            return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))

        return score


# --- learning


def _told(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """id, label of at most about ``most`` labelled rows."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return known


def _per_row(docs: DataFrame, make_features, fields) -> DataFrame:
    def make():
        read = make_features()

        def f(batch):
            out = []
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in ts.chunks(batch.column(0)):
                rows, values = read(chunk, label[chunk.first : chunk.first + chunk.rows])
                counts = np.bincount(rows, minlength=chunk.rows)
                offsets = np.zeros(chunk.rows + 1, dtype=np.int32)
                np.cumsum(counts, out=offsets[1:])
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())))
            return [pa.concat_arrays(out)]

        return f

    return map_rows(docs.select("text", "label"), make, ["label"], fields)


_LONGS = [T.StructField("features", T.ArrayType(T.LongType()))]


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labels: int = LABELS, most_candidates: int = CANDIDATES) -> Model:
    """Character counts from all of ``docs``, weights from ``labels`` (id, 0 or 1)."""
    spark = docs.sparkSession
    model = Model(CharacterModel(trigram_counts(docs, text_col)))
    told = _told(docs, labels, id_col, label_col, most_labels)
    sample = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(told), id_col).select("text", "label")
    characters = spark.sparkContext.broadcast(model.characters)

    def of_toxic():
        reader = Reader(characters.value)

        def read(chunk, label):
            rows, hashes = reader.features(chunk)
            some = label[rows] == 1
            order = np.lexsort((hashes[some], rows[some]))
            rows, hashes = rows[some][order], hashes[some][order]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            return rows[new], hashes[new].view(np.int64)

        return read

    n_toxic = sample.where("label = 1").count()
    if not n_toxic:
        return model
    # features of at least three toxic texts; the number that comes to the driver is bounded, however long the texts are
    found = _per_row(sample, of_toxic, _LONGS).where("label = 1").select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    found = found.where(F.col("n") >= min(3, n_toxic)).orderBy(F.desc("n"), "feature").limit(most_candidates)
    table = np.sort(found.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))
    if not len(table):
        table = np.zeros(1, dtype=np.uint64)
    candidates = spark.sparkContext.broadcast(table)

    width = 2 * len(table)

    def counted():
        # texts with a feature once, and more than once, by label; then texts by label
        total = np.zeros(2 * width + 2, dtype=np.int64)
        reader, own = Reader(characters.value), candidates.value
        bits = _bits(own)

        def add(batch):
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in ts.chunks(batch.column(0)):
                mine = label[chunk.first : chunk.first + chunk.rows]
                rows, value = _occurring(own, bits, *reader.features(chunk))
                total[: 2 * width] += np.bincount(value + width * mine[rows], minlength=2 * width)
                total[2 * width :] += np.bincount(mine, minlength=2)[:2]

        return add, total

    counts = _sum_arrays(sample.withColumn("label", (F.col("label") != 0).cast("int")), counted, 2 * width + 2)
    b, a = counts[:width], counts[width : 2 * width]
    n0, n1 = (float(x) for x in counts[2 * width :])
    if not n0 or not n1:
        return model
    g = _association(a, b, n1, n0)
    fit = np.flatnonzero((a >= min(3, n1)) & (a / n1 > b / n0) & (g > 8))
    fit = np.sort(fit[np.argsort(-g[fit], kind="stable")][:MOST_FEATURES])
    used = np.unique(fit // 2)
    place = np.full(2 * len(used), -1)
    place[2 * np.searchsorted(used, fit // 2) + fit % 2] = np.arange(len(fit))
    chosen = spark.sparkContext.broadcast((table[used] if len(used) else np.zeros(1, dtype=np.uint64), place))

    def of_chosen():
        reader, (own, place) = Reader(characters.value), chosen.value
        bits = _bits(own)

        def read(chunk, label):
            rows, value = _occurring(own, bits, *reader.features(chunk))
            if not len(place):
                rows, value = rows[:0], value[:0]
            value = place[value] if len(value) else value
            return rows[value >= 0], value[value >= 0]

        return read

    found = _per_row(sample, of_chosen, _LONGS).toArrow()
    seen = found["features"].combine_chunks()
    row = np.repeat(np.arange(len(seen)), np.diff(seen.offsets.to_numpy()))
    w, intercept = _logistic(row, seen.flatten().to_numpy(), (found["label"].to_numpy() != 0).astype(float), len(fit))
    full = np.zeros((len(used), 2))
    full[np.searchsorted(used, fit // 2), fit % 2] = w
    model.intercept, model.table = float(intercept), table[used]
    model.once, model.again = full[:, 0], full[:, 1]
    return model


def _occurring(own: np.ndarray, bits: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and twice the place of each feature of ``own`` in a text, and plus one if it is there more than once; by row."""
    i, at = _in(own, bits, hashes)
    pair, n = np.unique(rows[i] * len(own) + at, return_counts=True)
    rows, value = pair // len(own), pair % len(own) * 2
    both = np.flatnonzero(n > 1)
    rows, value = np.concatenate([rows, rows[both]]), np.concatenate([value, value[both] + 1])
    order = np.argsort(rows, kind="stable")
    return rows[order], value[order]


def _association(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """G statistic of feature and label."""
    total, n = a + b, n1 + n0

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    return 2 * (part(a, total * n1 / n) + part(b, total * n0 / n) + part(n1 - a, (n - total) * n1 / n) + part(n0 - b, (n - total) * n0 / n))


def _logistic(row, column, y, width, *, ridge: float = 0.2, steps: int = 400, rate: float = 0.5):
    w, b = np.zeros(width), np.log(y.mean() / (1 - y.mean()))
    seen, seen_b = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(row, w[column], minlength=len(y))
        error = 1 / (1 + np.exp(-z)) - y
        g, g_b = np.bincount(column, error[row], minlength=width) + ridge * w, error.sum()
        seen, seen_b = seen + g * g, seen_b + g_b * g_b
        w, b = w - rate * g / np.sqrt(seen), b - rate * g_b / np.sqrt(seen_b)
    return w, b


# --- scoring


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """``keep`` columns (all by default) and the score, 0 to 1, in the column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()

        def f(batch):
            column = batch.column(batch.schema.get_field_index(text_col))
            return [pa.array(np.concatenate([scorer(c) for c in ts.chunks(column)]), pa.float64())]

        return f

    keep = list(docs.columns) if keep is None else keep
    return map_rows(docs.select(*(quoted(c) for c in dict.fromkeys([*keep, text_col]))), make, keep, [T.StructField(name, T.DoubleType())])


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def learn_from_tables(docs: DataFrame, labels: DataFrame) -> Model:
    return learn(docs, labels.where(remainder("doc_id", 5) != 0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = score(docs, model, keep=["doc_id"], name="score")
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
