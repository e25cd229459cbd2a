from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from aerolith.llm import ann


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=np.float64)).all() and any(v)]
    out = {}
    for i, q in ok:
        if not queries(i):
            continue
        scored = [(-float(q @ w / (np.linalg.norm(q) * np.linalg.norm(w))), j) for j, w in ok if j != i and len(w) == len(q)]
        out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in scored)[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 24)) * 2
    rows = [(k, (centres[k % 8] + rng.normal(size=24)).astype(np.float32).astype(float).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    want = brute(rows, lambda i: i % 50 == 0)
    for shard in (4096, 200):
        got = {}
        for r in ann.search(df, F.col("id") % 50 == 0, id_col="id", vector_col="v", shard=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
            assert r.rank == len(got[r.query_id])
        hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want)
        assert hits / (5 * len(want)) >= 0.9
        exact = dict(rows)
        for q, found in got.items():
            for j, s in found:
                a, b = np.array(exact[q]), np.array(exact[j])
                assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (350, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [0.5, 0.5]), *((k, [2.0, 0.0]) for k in range(7, 20))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = ann.search(df, F.col("id") % 50 == 0, id_col="id", vector_col="v").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, k) for k in range(7, 12)]
    assert ann.search(df.limit(0), F.lit(True), id_col="id", vector_col="v").count() == 0


def test_many_copies_are_not_cut_off(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(400)] + [(1000 + k, rng.normal(size=3).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = ann.search(df, F.col("id") == 200, id_col="id", vector_col="v", shard=64).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4]


def test_prefixes():
    rng = np.random.default_rng(2)
    f = ann.Forest(np.arange(300), rng.normal(size=(300, 8)), trees=3, bits=12)
    own = f.strings(f.vectors[:5])
    for q, rows in f.candidates(f.vectors[:5], 30):
        for length in range(12, -1, -1):  # the longest length with enough entries, whole ranges
            same = [(f.strings(f.vectors)[t] >> (12 - length)) == (own[t, q] >> (12 - length)) for t in range(3)]
            if sum(s.sum() for s in same) >= 30:
                break
        assert set(rows) == set(np.flatnonzero(np.any(same, axis=0)))


def test_random_vectors_are_found(spark):
    """Nearly random vectors in many dimensions, several shards and lengths."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=48 if k % 10 else 3).tolist()) for k in range(2400)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = brute(rows, lambda i: i % 20 == 0)
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0, id_col="id", vector_col="v", shard=300).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len({j for j, _ in want[q]} & got[q]) for q in want) / (5 * len(want)) >= 0.9


def test_clusters_need_few_prefixes_and_entries():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    vectors = centres[rng.integers(0, 100, 4000)] + rng.normal(size=(4000, 32)) * 0.2
    visits, longest = ann.calibrated(np.arange(4000), ann.scaled(vectors), np.arange(150), 8, 5, ann.TREES, ann.BITS)
    assert visits <= 64 and longest >= 9


def test_magnitudes_and_repeated_rows(spark):
    """Squares that overflow or vanish; rows that occur several times; other columns with the result's names."""
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-300, 1.1e-300]), (3, [-1e300, 1e300]), (3, [-1e300, 1e300]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumns({"rank": F.lit(1), "score": F.lit(2), "query": F.lit(3), "prefix": F.lit(4)})
    got = [(r.rank, r.id, round(r.score, 9)) for r in ann.search(df, F.col("id") == 0, id_col="id", vector_col="v").orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, round(2.1 / np.sqrt(2 * 2.21), 9)), (3, 4, round(1 / np.sqrt(2), 9)), (4, 3, 0.0), (5, 3, 0.0)]


def test_nearest_prefixes_by_brute_force():
    rng = np.random.default_rng(7)
    projected = rng.normal(size=(20, 5))
    far, own = ann.distances(projected), ann.prefixes(projected)
    for q in range(20):
        assert far[q].argmin() == own[q] and far[q].min() == 0
        for code in range(32):
            signs = [(code >> (4 - j)) & 1 for j in range(5)]
            assert np.isclose(far[q, code], sum(abs(x) for x, s in zip(projected[q], signs, strict=True) if (x > 0) != bool(s)))
