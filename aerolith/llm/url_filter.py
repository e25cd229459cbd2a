"""URL filter: fixed rules, then a tree of path templates with labelled purity.

Per host, the segments of all paths, however deep, make a tree.  Segments that look
variable are generalised by form: digit runs become ``{n}``, long or hexadecimal ones
``{x}``; the characters of these marks are doubled where a segment holds them itself.
Then, from the top down, the children of a node become ``*`` if there are more than
``CHILDREN`` of them and none holds half of the node's urls.  Then, from the bottom
up, branches that differ in one segment only are siblings: they are merged into one
branch, with ``~`` in that place, but for those whose share of bad labels differs
from that of all siblings by more than two standard errors.  A branch is rejected if
its share of bad labels, smoothed towards its host's and that towards all hosts', is
at least ``REJECT``.

Both ways a step goes to the next level at which there is anything to do, so the
number of steps is that of the levels with wide nodes or with siblings, not the depth
of the deepest path.

Labels are given as a column (1 bad, 0 good, null none).  Counts are aggregated
by lexical template before any shuffle, and urls are joined to their template
with a salt, so a host may hold any share of the rows.

A null url, or one without ``://``, has empty host and path and is judged by the
template of the empty host.  Repeated rows, and rows with null ids, are judged each
time and alike; of rules that fit and are of one length, which would be one rule
twice, the later counts; very long urls are judged whole; an empty table has an empty
result.  The result has columns of its own only, so others may have any names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.scratch import stored

CHILDREN = 8
SMOOTHING = 4.0
REJECT = 0.8
SALT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: the contract's rules
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def by_rules(rules: list[Rule], host: Column, path: Column) -> Column:
    """Place in ``rules`` of the longest that fits, else null."""
    out = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: len(rules[k].text)):
        r = rules[k]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, k).otherwise(out)
    return out


#: the marks of templates are doubled where a segment holds them itself
_ESCAPES = {mark: mark * 2 for mark in "*{}~"}


def _lexical(path: Column) -> Column:
    """Segments by form."""

    def form(s: Column) -> Column:
        plain = s
        for mark, escape in _ESCAPES.items():
            plain = F.replace(plain, F.lit(mark), F.lit(escape))
        odd = (F.length(s) > 24) | (s.rlike("^[0-9a-f-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-f-]"))
        return F.when(odd, "{x}").otherwise(F.regexp_replace(plain, "[0-9]+", "{n}"))

    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), form)


def _totals(*by: str, df: DataFrame) -> DataFrame:
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good")))


def _replaced(segments: str, at: int, mark: str) -> Column:
    """The segments with ``mark`` in one place."""
    return F.concat(F.slice(segments, 1, at), F.array(F.lit(mark)), F.slice(segments, F.lit(at + 2), F.greatest(F.size(segments) - at - 1, F.lit(0))))


def _generalised(tree: DataFrame) -> DataFrame:
    """tree: host, lexical, t, n, ...  From the top down, places with many children become ``*``."""
    begin = 0
    while True:
        places = tree.select("host", "n", "t", F.posexplode("t").alias("at", "segment")).where(F.col("at") >= begin)
        node = F.xxhash64("host", F.slice("t", F.lit(1), F.col("at"))).alias("node")
        children = places.select("host", "at", node, "segment", "n").groupBy("host", "at", "node", "segment").agg(F.sum("n").alias("n"))
        wide = children.groupBy("host", "at", "node").agg(F.count("*").alias("children"), F.max("n").alias("most"), F.sum("n").alias("all"))
        wide = stored(wide.where((F.col("children") > CHILDREN) & (2 * F.col("most") < F.col("all"))).select("host", "at", "node"), "wide")
        (level,) = wide.agg(F.min("at")).first()
        if level is None:
            return tree
        hit = wide.where(F.col("at") == level).select("host", "node", F.lit(True).alias("_wide"))
        above = F.when(F.size("t") > level, F.xxhash64("host", F.slice("t", 1, level)))
        tree = tree.withColumn("node", above).join(hit, ["host", "node"], "left").withColumn("t", F.when(F.col("_wide"), _replaced("t", level, "*")).otherwise(F.col("t"))).drop("node", "_wide")
        tree, begin = stored(tree, "tree"), level + 1


def _merged(leaves: DataFrame) -> DataFrame:
    """leaves: host, t, n, bad, good.  Adds ``b``, the branch: from the bottom up, siblings that are alike become ``~``."""
    leaves, below = leaves.withColumn("b", F.col("t")), 1 << 30
    told = F.col("bad") + F.col("good")
    while True:
        places = _totals("host", "b", df=leaves).select("host", "b", "bad", "good", F.posexplode("b").alias("at", "segment")).where(F.col("at") < below)
        size = F.size("b")
        family = F.xxhash64("host", "at", size, F.slice("b", F.lit(1), F.col("at")), F.slice("b", F.col("at") + 2, F.greatest(size - F.col("at") - 1, F.lit(0))))
        members = stored(places.select("host", "at", "b", "bad", "good", family.alias("family")), "members")
        families = members.groupBy("host", "at", "family").agg(F.count("*").alias("members"), (F.sum("bad") / F.nullif(F.sum("bad") + F.sum("good"), F.lit(0))).alias("p")).where("members > 1")
        families = stored(families, "families")
        (level,) = families.agg(F.max("at")).first()
        if level is None:
            return leaves
        # the error of a share, with one more label so that a few labels alone never part siblings
        apart = (told > 0) & (F.abs(F.col("bad") / F.nullif(told, F.lit(0)) - F.col("p")) > 2 * F.sqrt(F.col("p") * (1 - F.col("p")) / (told + 1)) + 1 / (told + 1))
        alike = members.where(F.col("at") == level).join(families.where(F.col("at") == level).select("host", "family", "p"), ["host", "family"]).where(~F.coalesce(apart, F.lit(False)))
        leaves = leaves.join(alike.select("host", "b", F.lit(True).alias("_alike")), ["host", "b"], "left").withColumn("b", F.when(F.col("_alike"), _replaced("b", level, "~")).otherwise(F.col("b"))).drop("_alike")
        leaves, below = stored(leaves, "leaves"), level


def templates(urls: DataFrame) -> DataFrame:
    """urls: host, path, label.  One row per host and lexical template: its template, branch, purity and whether it is rejected."""
    flagged = urls.select("host", _lexical(F.col("path")).alias("lexical"), F.lit(1).alias("n"), F.coalesce(F.expr("cast(label = 1 as int)"), F.lit(0)).alias("bad"), F.coalesce(F.expr("cast(label = 0 as int)"), F.lit(0)).alias("good"))
    # the tables from here on are aggregates; each is used more than once, so each is written
    lexical = stored(_totals("host", "lexical", df=flagged), "lexical")
    tree = _generalised(lexical.withColumn("t", F.col("lexical")))
    leaves = _merged(stored(_totals("host", "t", df=tree), "leaves"))
    branches = _totals("host", "b", df=leaves)
    hosts = _totals("host", df=leaves).withColumnsRenamed({"bad": "host_bad", "good": "host_good"}).drop("n")
    # two numbers: the labels of everything
    all_bad, all_good = leaves.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    prior = F.lit((all_bad + 0.5) / (all_bad + all_good + 1))
    of_host = (F.col("host_bad") + SMOOTHING * prior) / (F.col("host_bad") + F.col("host_good") + SMOOTHING)
    purity = (F.col("bad") + SMOOTHING * of_host) / (F.col("bad") + F.col("good") + SMOOTHING)
    judged = branches.join(hosts, "host").select("host", "b", purity.alias("purity"), (purity >= REJECT).alias("rejected"))

    def shown(segments: str) -> Column:
        return F.concat(F.lit("/"), F.array_join(segments, "/"))

    named = leaves.select("host", "t", "b").join(judged, ["host", "b"]).select("host", "t", shown("b").alias("branch"), "purity", "rejected")
    return tree.select("host", "lexical", "t").join(named, ["host", "t"]).select("host", "lexical", shown("t").alias("template"), "branch", "purity", "rejected")


def judge(urls: DataFrame, *, id_col: str, url_col: str = "url", rules: list[Rule] = RULES, label_col: str | None = None, salt: int = SALT) -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule (its text or null), verdict, template, branch, purity.

    Without ``label_col`` the rules' own verdicts are the labels: what they decide teaches about urls they do not."""
    host, path = parsed(F.col(url_col))
    found = urls.select(F.col(id_col), host.alias("host"), path.alias("path"), *([F.col(label_col).cast("int").alias("label")] if label_col else []))
    found = found.withColumn("_rule", by_rules(rules, F.col("host"), F.col("path")))
    names, verdicts = (F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>") for xs in ([r.text for r in rules], [r.verdict for r in rules]))
    found = found.withColumns({"rule": F.get(names, F.col("_rule")), "_verdict": F.get(verdicts, F.col("_rule"))})
    if not label_col:
        found = found.withColumn("label", F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0))
    tree = templates(found.select("host", "path", "label"))
    spread = tree.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    keyed = found.withColumn("lexical", _lexical(F.col("path"))).withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col).cast("string"), "path"), F.lit(salt)).cast("int"))
    out = keyed.join(spread, ["host", "lexical", "_salt"])
    verdict = F.coalesce("_verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "branch", "purity")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), id_col="page_id")


def _oracle(depth: int) -> str:
    """The same for paths of up to ``depth`` segments, level by level."""
    steps = []
    for k in range(depth):
        steps.append(f"""w{k} AS MATERIALIZED (SELECT host, node, true AS wide FROM (SELECT host, t[1:{k}] AS node, t[{k + 1}] AS segment, sum(n) AS n FROM l{k} WHERE len(t) > {k} GROUP BY ALL) GROUP BY host, node HAVING count(*) > {CHILDREN} AND 2 * max(n) < sum(n)),
l{k + 1} AS MATERIALIZED (SELECT l.host, lexical, CASE WHEN wide THEN list_concat(t[1:{k}], ['*'], t[{k + 2}:]) ELSE t END AS t, n, bad, good FROM l{k} l LEFT JOIN w{k} w ON l.host = w.host AND len(t) > {k} AND t[1:{k}] = w.node)""")
    steps.append(f"b{depth} AS MATERIALIZED (SELECT host, t, t AS b, sum(bad) AS bad, sum(good) AS good FROM l{depth} GROUP BY host, t)")
    for k in reversed(range(depth)):
        steps.append(f"""m{k} AS MATERIALIZED (SELECT host, b, b[1:{k}] AS pre, b[{k + 2}:] AS post, sum(bad) AS bad, sum(good) AS good FROM b{k + 1} WHERE len(b) > {k} GROUP BY host, b),
f{k} AS MATERIALIZED (SELECT host, pre, post, sum(bad) / nullif(sum(bad) + sum(good), 0) AS p FROM m{k} GROUP BY host, pre, post HAVING count(*) > 1),
a{k} AS MATERIALIZED (SELECT host, b, true AS alike FROM m{k} JOIN f{k} USING (host, pre, post) WHERE NOT coalesce(bad + good > 0 AND abs(bad / nullif(bad + good, 0) - p) > 2 * sqrt(p * (1 - p) / (bad + good + 1)) + 1 / (bad + good + 1), false)),
b{k} AS MATERIALIZED (SELECT x.host, t, CASE WHEN alike THEN list_concat(x.b[1:{k}], ['~'], x.b[{k + 2}:]) ELSE x.b END AS b, bad, good FROM b{k + 1} x LEFT JOIN a{k} a ON x.host = a.host AND x.b = a.b)""")
    plain = "x"
    for mark, escape in _ESCAPES.items():
        plain = f"replace({plain}, '{mark}', '{escape}')"
    form = f"CASE WHEN length(x) > 24 OR (regexp_full_match(x, '[0-9a-f-]{{8,}}') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-f-]')) THEN '{{x}}' ELSE regexp_replace({plain}, '[0-9]+', '{{n}}', 'g') END"
    ruled = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{{k}}}" for k, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].text))) + " END"
    rule = ruled.format(*(f"'{r.text}'" for r in RULES))
    verdict = ruled.format(*(f"'{r.verdict}'" for r in RULES))
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
s AS (SELECT *, {rule} AS rule, {verdict} AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {form}) AS lexical FROM p),
l0 AS MATERIALIZED (SELECT host, lexical, lexical AS t, count(*) AS n, count(*) FILTER (said = 'block') AS bad, count(*) FILTER (said = 'allow') AS good FROM s GROUP BY host, lexical),
{", ".join(steps)},
h AS (SELECT host, sum(bad) AS hb, sum(good) AS hg FROM b0 GROUP BY host),
a AS (SELECT (sum(hb) + 0.5) / (sum(hb) + sum(hg) + 1) AS prior FROM h),
v AS (SELECT host, b, (sum(bad) + {SMOOTHING} * any_value((hb + {SMOOTHING} * prior) / (hb + hg + {SMOOTHING}))) / (sum(bad) + sum(good) + {SMOOTHING}) AS purity FROM b0 JOIN h USING (host), a GROUP BY host, b)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(t, '/') AS template, '/' || array_to_string(b, '/') AS branch, purity
FROM s JOIN (SELECT host, lexical, t FROM l{depth}) USING (host, lexical) JOIN (SELECT host, t, b FROM b0) USING (host, t) JOIN v USING (host, b)
"""


#: the tables' paths have two segments
OP1_SQL = _oracle(6)
