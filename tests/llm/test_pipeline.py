from __future__ import annotations

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

PLAIN = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi", "go", "hu") for b in ("ra", "mi", "to", "sel", "nor", "pax")]


def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("sf"))
    bench = [" ".join(rng.choice(PLAIN) for _ in range(30)) for _ in range(4)]
    texts, kinds = [], []

    def add(text, kind):
        texts.append(text)
        kinds.append(kind)

    for k in range(240):
        w = [rng.choice(PLAIN) for _ in range(rng.randint(40, 120))]
        if k % 6 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
            add(" ".join(w), "toxic")
        else:
            add(" ".join(w), "plain")
    for k in range(0, 40, 4):  # exact and near copies of plain documents
        add(texts[k + 1], "copy")
        w = texts[k + 1].split()
        w[3] = "other"
        add(" ".join(w), "copy")
    add("intro words " + bench[0], "contaminated")
    add("here token=abcdef0123456789 is told " + " ".join(rng.choice(PLAIN) for _ in range(40)), "secret")
    add(None, "null")
    add("", "empty")
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(x == "toxic")) for k, x in enumerate(kinds) if x in ("toxic", "plain")], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, kinds


def test_stages_against_brute_force(spark, folder):
    path, texts, kinds = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "best_fit_packing":
            assert docs.columns == columns, name
        docs = docs.cache()
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    toxic = {k for k, x in enumerate(kinds) if x == "toxic"}
    assert set(range(len(texts))) - ids["toxicity"] == toxic
    # of each linked group the smallest id
    left = sorted(ids["toxicity"])
    parent = {k: k for k in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {k: shingles(texts[k] or "") for k in left}
    for i in left:
        for j in left:
            if i < j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert ids["ngram_jaccard_join"] == {k for k in left if root(k) == k}
    assert ids["ngram_jaccard_join"] - ids["decontamination"] == {k for k, x in enumerate(kinds) if x == "contaminated"}
    masked = {r.doc_id: r for r in kept["secret_scan"]}
    assert ids["secret_scan"] == ids["decontamination"]
    for k, r in masked.items():
        if kinds[k] == "secret":
            assert "<SECRET>" in r.text and not re.search("abcdef01", r.text) and r.n_chars == len(r.text)
        else:
            assert r.text == texts[k]
    assert ids["best_fit_packing"] == ids["secret_scan"]


def test_run(spark, folder):
    path, *_ = folder
    assert pipeline.run(spark, path).count() > 100
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]


def odd_tables(spark, path, rows):
    names = ["_toxicity", "n_words", "hit_words", "hit_items", "spans", "_text", "_row", "component_id", "length", "label", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(pipeline.F.lit(k).alias(c) for k, c in enumerate(names)))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs.columns


def test_clashing_columns_null_and_repeated_ids(spark, tmp_path):
    """Copies leave one row, whatever their ids; a text under an id that another text has stays."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (3, a), (5, b), (5, b), (None, b), (None, None), (None, None), (7, "token=abcdef0123"), (8, "")]
    path, columns = odd_tables(spark, str(tmp_path), [(i, t, "en", "s", 1) for i, t in rows])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns
        assert all(tuple(r)[5:] == tuple(range(11)) for r in docs.collect())
    assert sorted(((r.doc_id or 0, r.text or "") for r in docs.collect())) == [(0, ""), (0, ""), (3, a), (5, b), (7, "<SECRET>"), (8, "")]
    assert pipeline.run(spark, path).count() == 6


def test_empty_tables(spark, tmp_path):
    path, _ = odd_tables(spark, str(tmp_path), [])
    assert pipeline.run(spark, path).count() == 0
