from __future__ import annotations

import random
import re

import numpy as np
import pytest

from aerolith.llm import components as cc
from aerolith.llm import ngram_join as nj


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i), links[i]) for i, s in enumerate(sets)]


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(80)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for _ in range(n_docs):
        kind = rng.random()
        if kind < 0.35 or not texts:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 40, 90, 300, 900, 1500]))))
        elif kind < 0.5:
            texts.append(rng.choice(texts))
        elif kind < 0.65:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(50)) + " " + passage)
        else:  # edits of an earlier text, from few to too many
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                k = rng.randrange(len(w))
                w[k : k + 1] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                if not w:
                    w = ["z"]
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("seed", "n", "percent", "group"), [(1, 3, 90, nj.GROUP), (2, 5, 80, nj.GROUP), (3, 3, 90, 400), (4, 2, 60, 2000), (5, 3, 50, nj.GROUP), (6, 3, 45, nj.GROUP), (7, 2, 30, 3000)])
def test_against_brute_force(documents, odd_texts, seed, n, percent, group):
    texts = odd_texts + corpus(seed)
    rows = nj.similar_documents(documents(texts), n=n, percent=percent, group=group).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows}
    assert got == dict(enumerate(brute(texts, n, percent)))


def test_null_and_repeated_ids_and_empty_table(documents):
    docs = documents(["a b c d"] * 3 + ["x"], ids=[None, 5, 5, 6])
    rows = sorted((r.doc_id or -1, r.component_id, r.n_links) for r in nj.similar_documents(docs).collect())
    assert rows == [(-1, None, 0), (5, 5, 1), (5, 5, 1), (6, 6, 0)]
    assert nj.similar_documents(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_linked_by_their_own_texts(documents):
    a, b, c = ("one two three four five", "six seven eight nine ten", "some other words are told here")
    rows = [(5, a), (3, a), (5, b), (5, b), (9, c), (None, c)]
    docs = documents([t for _, t in rows], ids=[i for i, _ in rows])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.class_id or -1, r.n_links) for r in nj.similar_documents(docs).collect())
    assert got == [(-1, -1, -1, 0), (3, 3, 3, 1), (5, 3, 3, 1), (5, 5, 5, 1), (5, 5, 5, 1), (9, 9, 9, 0)]


def test_far_apart_sizes_below_half(documents):
    rng = random.Random(3)
    words = [f"x{k}" for k in range(400)]
    texts = [" ".join(words[: k + 2]) for k in (63, 64, 100, 128, 129, 200, 257)] + [" ".join(rng.sample(words, 90))]
    for percent in (30, 45, 50):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in nj.similar_documents(documents(texts), percent=percent).collect()}
        assert got == dict(enumerate(brute(texts, 3, percent)))
    with pytest.raises(ValueError):
        nj.similar_documents(documents(texts), percent=0)


def test_components_of_many_sets_are_cut(documents, monkeypatch):
    """Several blocks of one component, by the number of sets."""
    monkeypatch.setattr(nj, "WHOLE_SETS", 8)
    monkeypatch.setattr(nj, "BLOCK_SHARE", 2)
    rng = random.Random(12)
    base, texts = [f"b{k}" for k in range(120)], []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in nj.similar_documents(documents(texts), percent=80).collect()}
    assert got == dict(enumerate(brute(texts, 3, 80)))


def test_large_lists_span_all_that_passes(monkeypatch):
    """Lists beyond the limits for comparing pairs stay connected."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 4, dtype=np.int64)

    def batch(n):
        import pyarrow as pa

        maps = np.tile(base, (n, 1))
        cols = [np.zeros(n, np.int64), np.arange(n), np.full(n, 200), np.zeros(n, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(4))], names=nj._INDEX)

    def parts(limit):
        monkeypatch.setattr(nj, "LARGE_LIST", limit)
        parent = list(range(500))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        whole = batch(500)
        for out in nj._edges(90)(iter([whole.slice(0, 200), whole.slice(200, 300)])):
            for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
                parent[root(a)] = root(b)
        return len({root(x) for x in range(500)})

    assert parts(100_000) == 1
    assert parts(100) == 1


def test_chained_lists_are_chained_to_their_end(monkeypatch):
    """A list that has once passed the limit links what follows as well, whatever the parity maps of the row between."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    maps = rng.integers(0, 1 << 62, (257, 4), dtype=np.int64)
    maps[230] = maps[10]
    key = np.array([0] * 250 + [1] * 3 + [2] * 4)
    size = np.array([200] * 240 + [300] * 10 + [200] * 7)
    maps[251] = maps[250]
    cols = [pa.array(key), pa.array(np.arange(257)), pa.array(size, pa.int32()), pa.array(np.zeros(257), pa.int32()), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(4))]
    whole = pa.RecordBatch.from_arrays(cols, names=nj._INDEX)
    monkeypatch.setattr(nj, "LARGE_LIST", 100)
    for cuts in ([0, 200, 257], [0, 200, 250, 257], [0, 101, 201, 202, 251, 257], [0, 257]):
        parent = list(range(257))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for out in nj._edges(90)(iter([whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])):
            for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
                parent[root(a)] = root(b)
        parts = {}
        for x in range(257):
            parts.setdefault(root(x), []).append(x)
        # one chain for each size, then lists that are compared: one pair of equal maps
        assert sorted(parts.values()) == [list(range(240)), list(range(240, 250)), [250, 251], *([x] for x in range(252, 257))]


def test_keys_of_several_sets_across_batches():
    """Whatever the batches, each set is given out once for each key that another set has."""
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(60):
        rows = sorted((rng.randrange(12), rng.randrange(4)) for _ in range(rng.randint(1, 40)))
        key, node = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(node << 32 | 7 << 16 | 3)], names=["key", "node", "place"])
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(6))})
        out = [r for b in nj._shared_keys(iter([whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])) for r in b.to_pylist()]
        sets = {}
        for k, n in rows:
            sets.setdefault(k, set()).add(n)
        want = sorted((k, n, n, 7, 3) for k, ns in sets.items() if len(ns) > 1 for n in ns)
        assert sorted(tuple(r.values()) for r in out) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
