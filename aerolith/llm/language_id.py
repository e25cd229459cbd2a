"""Language identification: scripts, word scores, Viterbi over words.

For every language a table of hashed byte 4-grams of its words is counted over
all labelled texts, and the share of its letters in each script.  The script of
a word, from Unicode ranges, narrows the languages to those that use it; each
word gets a log-probability under each of them; and Viterbi decoding over a
text's words, with a penalty for each switch, labels spans of mixed-language
text.  All texts of a chunk are decoded side by side, word by word.

A text that is null or has no letter is ``und`` with score 0.  Words in a script
that no language uses are decided by their neighbours; if a text has no other
words, its language is the likeliest overall.  Rows without a label teach
nothing; if none has one, everything is ``und``.  Of languages that are equally likely
the first by name is taken.  Repeated rows, and rows with null ids, are labelled each
time and alike; a very long text is decoded whole; an empty table has an empty result.
``identify`` replaces columns that have the names of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import textscan as ts
from aerolith.llm.arrowmap import map_rows, quoted
from aerolith.llm.toxicity import remainder

GRAM_BITS = 16
SWITCH = 12.0
#: a language uses a script that holds at least this share of its letters
SCRIPT_SHARE = 0.002

#: fixed values: first code point, last code point, script
SCRIPTS = (
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
)
NAMES = list(dict.fromkeys(name for _, _, name in SCRIPTS))
OTHER = len(NAMES)


def _script_table() -> np.ndarray:
    """Script of the first two bytes of a character: index (lead byte << 8) + next byte."""
    out = np.full(1 << 16, OTHER, dtype=np.int8)
    for lead in range(256):
        for follow in range(256):
            if lead < 0x80:
                point = lead
            elif 0xC2 <= lead < 0xE0:
                point = (lead & 0x1F) << 6 | follow & 0x3F
            elif 0xE0 <= lead < 0xF0:
                point = (lead & 0x0F) << 12 | (follow & 0x3F) << 6 | 0x20
            else:
                continue
            for first, last, name in SCRIPTS:
                if first <= point <= last:
                    out[lead << 8 | follow] = NAMES.index(name)
                    break
    return out


_SCRIPT = _script_table()


def _word_script(chunk: ts.Chunk, words: ts.Words) -> np.ndarray:
    """Script of each word's first character."""
    after = np.append(chunk.data, 0)
    return _SCRIPT[(after[words.start].astype(np.int64) << 8) + after[words.start + 1]]


def _grams(chunk: ts.Chunk, words: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 4-gram that ends at each byte of each word, and one past it; where each word's grams begin."""
    low = ts.LOWER[chunk.data].astype(np.uint32)
    size = words.stop - words.start + 1
    begin = np.cumsum(size) - size
    n = int(size.sum())
    at = np.arange(n) - np.repeat(begin - words.start, size)
    inner = np.ones(n, dtype=bool)
    inner[begin + size - 1] = False
    byte = np.where(inner, low[np.minimum(at, len(low) - 1)], 0).astype(np.uint32)
    offset = np.arange(n) - np.repeat(begin, size)
    code = byte.copy()
    for k in (1, 2, 3):
        code[k:] += np.where(offset[k:] >= k, byte[:-k] << np.uint32(8 * k), 0).astype(np.uint32)
    code = code * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code = code * np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - GRAM_BITS)).astype(np.int64), begin


@dataclass
class Model:
    languages: list[str]
    #: [bucket, language] natural logarithms; [script, language] whether used
    gram: np.ndarray
    uses: np.ndarray

    def word_scores(self, chunk: ts.Chunk, words: ts.Words) -> np.ndarray:
        """[word, language] log-probability; languages that don't use the word's script get -50 a word."""
        grams, begin = _grams(chunk, words)
        scores = np.add.reduceat(self.gram[grams], begin, axis=0)
        script = _word_script(chunk, words)
        uses = self.uses[script]
        known = uses.any(axis=1)
        scores[known] -= 50.0 * ~uses[known]
        scores[~known] = 0
        return scores

    def label(self, chunk: ts.Chunk, switch: float = SWITCH) -> tuple[ts.Words, np.ndarray, np.ndarray]:
        """Language number of each word; the sum of word scores by text."""
        words = chunk.words(ts.LETTER)
        if not len(words) or not self.languages:
            return words, np.zeros(len(words), dtype=np.int64), np.zeros((chunk.rows, max(1, len(self.languages))))
        scores = self.word_scores(chunk, words)
        total = np.add.reduceat(np.concatenate([scores, np.zeros((1, scores.shape[1]), scores.dtype)]), np.minimum(words.of[:-1], len(words)), axis=0)
        total[words.counts() == 0] = 0
        return words, viterbi(scores, words.of, switch), total


def viterbi(scores: np.ndarray, of: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of the words of each text; words of text r are of[r] to of[r + 1]."""
    count = np.diff(of)
    rows = np.argsort(-count, kind="stable")
    rows = rows[count[rows] > 0]
    longest = int(count[rows[0]]) if len(rows) else 0
    # texts that still have a word at step t are the first active[t] in this order
    active = np.searchsorted(-count[rows], -np.arange(longest), side="left")
    first = of[:-1][rows]
    stay = np.empty(scores.shape, dtype=bool)
    jump = np.empty(len(scores), dtype=np.int16)
    value = scores[first].astype(np.float64)
    ended = np.empty(len(rows), dtype=np.int64)
    for t in range(1, longest + 1):
        left = int(active[t]) if t < longest else 0
        if left < len(value):
            ended[left : len(value)] = value[left:].argmax(axis=1)
            value = value[:left]
        if not left:
            break
        at = first[:left] + t
        top = value.argmax(axis=1)
        high = value[np.arange(left), top] - switch
        keep = value >= high[:, None]
        stay[at] = keep
        jump[at] = top
        value = np.where(keep, value, high[:, None]) + scores[at]
    out = np.empty(len(scores), dtype=np.int64)
    now = np.empty(0, dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        have = int(active[t])
        if have > len(now):
            now = np.concatenate([now, ended[len(now) : have]])
        at = first[:have] + t
        out[at] = now
        if t:
            now = np.where(stay[at, now], now, jump[at])
    return out


def learn(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang") -> Model:
    """Counts over all rows that have a label."""
    width = 1 << GRAM_BITS
    told = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for chunk in ts.chunks(batch.column(1)):
                words = chunk.words(ts.LETTER)
                if not len(words):
                    continue
                own = labels[chunk.first : chunk.first + chunk.rows]
                names = sorted(set(own))
                number = np.array([names.index(x) for x in own])[words.text_of()]
                code, begin = _grams(chunk, words)
                size = np.diff(np.append(begin, len(code)))
                script = _word_script(chunk, words)
                counts = np.bincount(code + width * np.repeat(number, size), minlength=width * len(names))
                letters = np.bincount(script + (OTHER + 1) * number, weights=size - 1, minlength=(OTHER + 1) * len(names))
                for k, name in enumerate(names):
                    if name not in grams:
                        grams[name], scripts[name] = np.zeros(width, dtype=np.int64), np.zeros(OTHER + 1, dtype=np.int64)
                    grams[name] += counts[k * width : (k + 1) * width]
                    scripts[name] += letters[k * (OTHER + 1) : (k + 1) * (OTHER + 1)].astype(np.int64)
        for name, count in grams.items():
            for at, values in ((0, count), (width, scripts[name])):
                some = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some + at, pa.int32()), pa.array(values[some], pa.int64())], names=["lang", "at", "n"])

    counted = told.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    # bounded: 2**GRAM_BITS buckets a language
    table = counted.toArrow().to_pydict()
    languages = sorted(set(table["lang"]))
    number = np.array([languages.index(x) for x in table["lang"]], dtype=np.int64)
    counts = np.zeros((width + OTHER + 1, len(languages)))
    counts[np.array(table["at"], dtype=np.int64), number] = table["n"]
    gram, script = counts[:width], counts[width:]
    total = gram.sum(axis=0, keepdims=True)
    # smoothed towards the mean of all languages
    mean = (gram.sum(axis=1, keepdims=True) + 0.5) / (gram.sum() + 0.5 * width) if languages else gram
    p = (gram + 50 * mean) / (total + 50)
    share = script / np.maximum(script.sum(axis=0, keepdims=True), 1)
    return Model(languages, np.log(p).astype(np.float32), share >= SCRIPT_SHARE)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``keep`` columns (all by default), ``lang_pred`` (the language of most letters), ``score`` (its share of the letters, times
    how much likelier it is than the next), ``n_spans`` and, with ``spans``, ``lang_spans`` in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())]
    if spans:
        fields.append(T.StructField("lang_spans", SPANS))

    def make():
        own: Model = shared.value
        names = np.array([*own.languages, "und"], dtype=object)

        def f(batch):
            column = batch.column(batch.schema.get_field_index(text_col))
            langs, scores, counts, found = [], [], [], []
            for chunk in ts.chunks(column):
                lang, score, n, labels, words = _decide(own, chunk)
                langs.append(names[lang])
                scores.append(score)
                counts.append(n)
                if spans:
                    found += [_spans(chunk, words, labels, r, own.languages) if n[r] else [] for r in range(chunk.rows)]
            out = [pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts), pa.int32())]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))))
            return out

        return f

    keep = list(docs.columns) if keep is None else keep
    return map_rows(docs.select(*(quoted(c) for c in dict.fromkeys([*keep, text_col]))), make, keep, fields)


def _decide(model: Model, chunk: ts.Chunk):
    words, labels, total = model.label(chunk)
    n = max(1, len(model.languages))
    rows = words.text_of()
    letters = np.bincount(rows * n + labels, weights=words.stop - words.start, minlength=chunk.rows * n).reshape(-1, n)
    lang = letters.argmax(axis=1)
    share = letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1)
    total = total.astype(np.float64)
    own = np.take_along_axis(total, lang[:, None], axis=1)
    odds = 1 / np.exp(np.clip(total - own, -700, 600)).sum(axis=1)
    score = np.clip(share * np.maximum(odds, 1 / n), 0, 1)
    change = np.ones(len(labels), dtype=bool)
    change[1:] = (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])
    spans = np.bincount(rows[change], minlength=chunk.rows)
    bare = spans == 0
    ascii_ = np.zeros(256, dtype=bool)
    ascii_[0x41:0x5B] = ascii_[0x61:0x7B] = True
    some = np.zeros(chunk.rows, dtype=bool)
    some[rows[ascii_[chunk.data[words.start]] | ascii_[chunk.data[words.stop - 1]]]] = True
    for r in np.flatnonzero(~bare & ~some):  # words of other bytes only: look at the characters
        bare[r] = not any(c.isalpha() for c in chunk.text(r))
    if not model.languages:
        bare[:] = True
    lang[bare], score[bare], spans[bare] = len(model.languages), 0.0, 0
    return lang, score, spans, labels, words


def _spans(chunk: ts.Chunk, words: ts.Words, labels: np.ndarray, row: int, languages: list[str]) -> list[dict]:
    a, b = int(words.of[row]), int(words.of[row + 1])
    begin = int(chunk.bounds[row])
    # code points before each byte: bytes that do not continue a character
    points = np.concatenate([[0], np.cumsum((chunk.data[begin : chunk.bounds[row + 1]] & 0xC0) != 0x80)])
    cut = [a, *(k for k in range(a + 1, b) if labels[k] != labels[k - 1]), b]
    return [{"start": int(points[words.start[i] - begin]), "stop": int(points[words.stop[j - 1] - begin]), "lang": languages[labels[i]]} for i, j in zip(cut, cut[1:], strict=False)]


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(remainder("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")
