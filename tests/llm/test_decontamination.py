from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from aerolith.llm import decontamination as dc


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items, n=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(n, len(v))
        for i in range(len(v) - size + 1) if v else ():
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "ß1"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 13, 20, 30])))) for k in range(12)] + [(50, None), (51, "!!"), (7, "Again, another text of the same id")]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 14))
            parts.insert(rng.randint(0, len(parts)), "-".join(v[a : a + rng.randint(10, 20)]).upper())
        texts.append(". ".join(parts))
    return texts, items


def test_against_brute_force(spark, documents, odd_texts):
    texts, items = cases()
    texts = odd_texts + texts
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK_WORDS, 20):  # one broadcast, and several passes
        rows = dc.scan(documents(texts), bench, keep=["doc_id"], block_words=block).select("*", dc.n_hit().alias("n"), dc.contaminated().alias("c")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, hit, found = brute(texts[r.doc_id], items)
            assert (r.n_words, r.n, r.hit_items) == (n, hit, found)
            assert r.c == (hit > 0 and 20 * hit >= n)


def test_empty_tables_and_clashing_columns(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(["a b c", None])
    assert [r.n_words for r in dc.scan(docs, none).orderBy("doc_id").collect()] == [3, 0]
    assert dc.scan(docs.limit(0), none).count() == 0
    clash = docs.withColumn("item_id", F.lit(1))
    assert dc.decontaminate(clash, none).columns == clash.columns
    bench = spark.createDataFrame([(1, "a b c"), (2, "b c"), (3, None)], "item_id long, text string")
    clash = documents(["a b c", None, "q"], ids=[None, None, 4]).selectExpr("*", "1 as n_words", "2 as hit_words", "3 as Hit_Items", "4 as clean_text", "5 as _row", "6 as `a.b`")
    for words in (dc.BLOCK_WORDS, 1):
        for remove, want in (("documents", [None, "q"]), ("spans", ["", None, "q"])):
            out = dc.decontaminate(clash, bench, remove=remove, block_words=words)
            rows = out.collect()
            assert out.columns == clash.columns and sorted((r.text for r in rows), key=str) == sorted(want, key=str)
            assert {tuple(r)[5:] for r in rows} == {(1, 2, 3, 4, 5, 6)}
        out = dc.scan(clash, bench, block_words=words)
        assert out.columns[-3:] == list(dc.NAMES[:3]) and "Hit_Items" not in out.columns
        assert sorted((r.n_words, r.hit_items) for r in out.collect()) == [(0, []), (1, []), (3, ["1", "2"])]


def test_spans_are_cut(spark, documents):
    bench = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(13)))], "item_id long, text string")
    text = "Keep this. " + " ".join(f"T{k}" for k in range(13)) + "; and this."
    out = dc.decontaminate(documents([text, None, "clean"]), bench, remove="spans").orderBy("doc_id").collect()
    assert [r.text for r in out] == ["Keep this. ; and this.", None, "clean"]
    assert dc.decontaminate(documents([text, None, "clean"]), bench).count() == 2


def test_digest(spark, tmp_path, documents):
    documents(["a b", None]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, "a b"), (10, "b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in dc.op2_decontamination(spark, str(tmp_path)).collect()}
    assert rows[0].items_sha256 == hashlib.sha256(b"10,2").hexdigest() and rows[0].contaminated
    assert rows[1].items_sha256 == hashlib.sha256(b"").hexdigest() and not rows[1].contaminated
