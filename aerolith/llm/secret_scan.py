"""Secret scans with native expressions only.

Three patterns give the base spans.  The method adds runs of 16 or more key
characters that look random: character bigram (Markov) models of random strings
and of ordinary identifiers are compared by their mean log-likelihood ratio.
Labelled samples train them: random strings are cut from SHA-256 digests in
hexadecimal and base 64; ordinary ones are the runs outside base spans in at
most about ``SAMPLE`` texts, chosen by a hash of the text (the documented
bound).  Added spans never overlap base spans.

Positions are code points, found by laying the pieces between matches and the
matches end to end.  Running sums and overlaps go by blocks of ``BLOCK`` spans, and
texts are cut by pieces of ``PIECE`` characters, so a very long text, run of
characters or list of spans takes time nearly in proportion to its length.

A null text counts as an empty one and has no span.  Repeated rows are scanned each
time and alike; an empty table has an empty result and the models of the random
strings alone.  Spans that start together are ordered by kind.  ``scan`` replaces
columns named ``spans`` or ``base_spans``; ``redact`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.arrowmap import fresh, quoted

SAMPLE = 2_000
RANDOM_STRINGS = 4_000
#: weight, in pairs, of the characters' own frequencies in the models
BACKOFF = 20.0
#: least mean log-likelihood ratio of an added span, in nats a character
LEAST = 0.5
#: fewest different characters of an added span: a short pattern repeated is not random
DISTINCT = 8

#: fixed values
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ["assign", "access", "hex", "random"]
MASK = "<SECRET>"

#: spans that are added up one by one; above that, block by block
BLOCK = 128
#: code points of the pieces that a text is cut by
PIECE = 4096

_NONE = "cast(array() as array<struct<start:int,kind:int,stop:int,text:string>>)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _blocks(array: str) -> str:
    """SQL: a non-empty array in blocks."""
    return f"transform(sequence(0, (size({array}) - 1) div {BLOCK}), bi -> slice({array}, bi * {BLOCK} + 1, {BLOCK}))"


def _before(array: str, most: bool = False) -> str:
    """SQL: for each number of a non-empty array the sum (or the greatest, 0 at least) of those before it."""
    whole = (lambda x: f"coalesce(array_max({x}), 0)") if most else (lambda x: f"aggregate({x}, 0, (st, sv) -> st + sv)")
    both = (lambda x, y: f"greatest({x}, {y})") if most else (lambda x, y: f"{x} + {y}")
    inner = f"transform(sequence(0, size(bx) - 1), wi -> {both('bs', whole('slice(bx, 1, wi)'))})"
    starts = f"transform(sequence(0, size(bl) - 1), ti -> {whole('slice(tops, 1, ti)')})"
    return _let(_blocks(array), "bl", _let(f"transform(bl, tx -> {whole('tx')})", "tops", f"flatten(zip_with(bl, {starts}, (bx, bs) -> {inner}))"))


def _located(text: str, found: str, pattern: str, kind: int) -> str:
    """SQL: spans of the matches ``found`` of ``pattern`` in ``text``."""
    cut = f"zip_with(slice(split({text}, {_sql(pattern)}, -1), 1, size({found})), {found}, (ca, cb) -> struct(length(ca) as gap, length(cb) as wide, cb as text))"
    span = f"struct(lp + lc.gap as start, {kind} as kind, lp + lc.gap + lc.wide as stop, lc.text as text)"
    return f"case when size({found}) = 0 then {_NONE} else " + _let(cut, "cs", _let("transform(cs, wx -> wx.gap + wx.wide)", "ws", f"zip_with(cs, {_before('ws')}, (lc, lp) -> {span})")) + " end"


def _apart(added: str, base: str) -> str:
    """SQL: the ``added`` spans that overlap none of ``base``, which is in order of start."""
    block = "struct(get(ob, 0).start as lo, array_max(transform(ob, oy -> oy.stop)) as hi, ob as own)"
    hit = "exists(os, oo -> oo.lo < oa.stop and oa.start < oo.hi and exists(oo.own, oz -> oz.start < oa.stop and oa.start < oz.stop))"
    return f"case when size({base}) = 0 then {added} else " + _let(f"transform({_blocks(base)}, ob -> {block})", "os", f"filter({added}, oa -> not {hit})") + " end"


def _sql(pattern: str) -> str:
    """A raw string literal."""
    return "r'" + pattern + "'"


#: ASSIGN with the quote characters as escapes, which a raw SQL literal can hold
_ASSIGN = ASSIGN.replace("[\"']", r"[\x22\x27]")


_TEXT, _MATCHES, _BASE, _RANDOM, _ADDED = "_ss_text", ["_ss_assign", "_ss_access", "_ss_hex", "_ss_key"], "_ss_base", "_ss_random", "_ss_added"


def _with_base(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the text, the matches of each pattern and the base spans; a cheap test of the letters goes before the dear pattern."""
    df = docs.withColumn(_TEXT, F.coalesce(text, F.lit("")))
    some = " or ".join(f"contains(lower({_TEXT}), '{word}')" for word in ("pass", "secret", "token", "api"))
    empty = "cast(array() as array<string>)"
    assign, access, hex_, key = _MATCHES
    df = df.withColumns(
        {
            assign: F.expr(f"case when {some} then regexp_extract_all({_TEXT}, {_sql(_ASSIGN)}, 0) else {empty} end"),
            access: F.expr(f"case when contains({_TEXT}, 'AKIA') then regexp_extract_all({_TEXT}, {_sql(ACCESS)}, 0) else {empty} end"),
            hex_: F.expr(f"regexp_extract_all({_TEXT}, {_sql(HEX)}, 0)"),
            key: F.expr(f"regexp_extract_all({_TEXT}, {_sql(KEY)}, 0)"),
        }
    )
    parts = [_located(_TEXT, name, pattern, k) for k, (name, pattern) in enumerate([(assign, _ASSIGN), (access, ACCESS), (hex_, HEX)])]
    # a value of fewer than 6 characters is no secret
    value = f"length(regexp_extract(fx.text, {_sql(_ASSIGN)}, 2))"
    return df.withColumn(_BASE, F.expr(f"array_sort(concat(filter({parts[0]}, fx -> {value} >= 6), {parts[1]}, {parts[2]}))"))


# --- Markov models


def _bigrams(strings: DataFrame) -> DataFrame:
    """strings: s, label -> counts of bigrams by label."""
    letters = F.split("s", "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.length("s") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return strings.where(F.length("s") >= 2).select("label", F.explode(pairs).alias("pair")).where("pair is not null").groupBy("label", "pair").count()


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")).cast("binary"), 256)
    kind = F.pmod("id", F.lit(4))
    wide = F.base64(F.unhex(digest))
    return spark.range(n).select(
        F.when(kind == 0, F.substring(digest, 1, 40)).when(kind == 1, F.upper(F.substring(digest, 1, 40))).when(kind == 2, F.substring(wide, 1, 40)).otherwise(F.regexp_replace(F.substring(wide, 1, 40), "[+/=]", "")).alias("s"),
        F.lit(1).alias("label"),
    )


def ordinary_strings(docs: DataFrame, text_col: str, id_col: str, most: int = SAMPLE) -> DataFrame:
    """Runs of key characters outside base spans; the sample goes by id and text, so copies do not come all or none."""
    n = docs.count()
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1_000_000))
    sample = docs.where(key < max(1, int(1_000_000 * min(1.0, most / max(n, 1))))) if n > most else docs
    rest = F.coalesce(F.col(text_col), F.lit(""))
    for p in (_ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, p, " ")
    return sample.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("s"), F.lit(0).alias("label"))


def ratio_table(strings: DataFrame) -> list[float]:
    """log P(next | character, random) - log P(next | character, ordinary), row by row; collected counts are at most two alphabets squared."""
    n = len(ALPHABET)
    counts = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for label, pair, count in _bigrams(strings).collect():
        a, b = ALPHABET.find(pair[0]), ALPHABET.find(pair[1])
        if a >= 0 and b >= 0:
            counts[label][a][b] += count
    logs = []
    for own in counts:
        # unseen pairs fall back on how common the second character is
        single = [0.5 + sum(row[b] for row in own) for b in range(n)]
        whole = sum(single)
        logs.append([math.log((own[a][b] + BACKOFF * single[b] / whole) / (sum(own[a]) + BACKOFF)) for a in range(n) for b in range(n)])
    return [r - o for o, r in zip(*logs, strict=True)]


def learn(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", most: int = SAMPLE) -> list[float]:
    return ratio_table(ordinary_strings(docs, text_col, id_col, most).unionByName(random_strings(docs.sparkSession)))


def _random(s: str, table: list[float], least: float) -> str:
    """SQL: whether the mean log-likelihood ratio of a string of key characters, and their number, suffice."""
    n = len(ALPHABET)
    values = ",".join(f"{x:.4f}" for x in table)
    ratio = f"get(cast(split('{values}', ',') as array<double>), (ra - 1) * {n} + rb - 1)"
    total = f"aggregate(zip_with(rc, slice(rc, 2, size(rc) - 1), (ra, rb) -> {ratio}), 0D, (rt, rx) -> rt + coalesce(rx, 0D))"
    codes = f"transform(split({s}, ''), rl -> instr('{ALPHABET}', rl))"
    return _let(codes, "rc", f"size(array_distinct(rc)) >= {DISTINCT} and {total} / (size(rc) - 1) >= {least}")


# --- scan


def scan(docs: DataFrame, table: list[float], *, text_col: str = "text", least: float = LEAST, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (or other ``names``): arrays of start, kind (place in KINDS), stop, text, by start and kind."""
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    packed = docs.select(F.struct(*(quoted(c) for c in own)).alias("_ss_row"), quoted(text_col).alias("_ss_given")) if own else docs.select(quoted(text_col).alias("_ss_given"))
    df = _with_base(packed, F.col("_ss_given"))
    key = _MATCHES[3]
    # runs are located only where any looks random
    df = df.withColumn(_RANDOM, F.expr(f"transform({key}, kx -> {_random('kx', table, least)})"))
    where = f"filter(zip_with({_located(_TEXT, key, KEY, 3)}, {_RANDOM}, (zx, zr) -> if(zr, zx, null)), zn -> zn is not null)"
    df = df.withColumn(_ADDED, F.expr(f"case when not exists({_RANDOM}, er -> er) then {_NONE} else {where} end"))
    df = df.withColumn(_ADDED, F.expr(f"case when size({_ADDED}) = 0 then {_ADDED} else {_apart(_ADDED, _BASE)} end"))
    return df.select(*(F.col("_ss_row")[c].alias(c) for c in own), F.col(_BASE).alias(names[0]), F.array_sort(F.concat(_BASE, _ADDED)).alias(names[1]))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.kind), ':', x.start, ':', x.stop)), ',')")


def redacted(text: str, spans: str = "spans") -> Column:
    """The text with a mask in place of each run of overlapping spans."""

    def piece(a: str, b: str) -> str:
        """SQL: code points ``a`` to ``b``."""
        first, last = f"({a}) div {PIECE}", f"({b} - 1) div {PIECE}"
        near = f"substr(get(ps, {first}), ({a}) % {PIECE} + 1, {b} - ({a}))"
        far = f"concat(substr(get(ps, {first}), ({a}) % {PIECE} + 1), array_join(slice(ps, {first} + 2, {last} - {first} - 1), ''), substr(get(ps, {last}), 1, ({b} - 1) % {PIECE} + 1))"
        return f"case when {a} >= {b} then '' when {first} = {last} then {near} else {far} end"

    each = f"case when mx.start < mp then '' else concat({piece('mp', 'mx.start')}, '{MASK}') end"
    body = f"concat(array_join(zip_with({spans}, {_before('ms', most=True)}, (mx, mp) -> {each}), ''), {piece('array_max(ms)', f'length({text})')})"
    cut = f"regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)"
    return F.expr(f"case when size({spans}) = 0 then {text} else " + _let(cut, "ps", _let(f"transform({spans}, mz -> mz.stop)", "ms", body)) + " end")


def redact(docs: DataFrame, table: list[float], *, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret masked; texts without any stay as they are, null texts stay null."""
    names = fresh(docs.columns, "_ss_found_base", "_ss_found")
    found = scan(docs, table, text_col=text_col, names=names)
    masked = F.when(F.size(names[1]) > 0, redacted(f"`{text_col}`", names[1])).otherwise(quoted(text_col))
    return found.select(*(masked.alias(c) if c == text_col else quoted(c) for c in docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, learn(docs))
    count = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *count, F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
