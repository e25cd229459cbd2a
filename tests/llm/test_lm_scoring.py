from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest

from aerolith.llm import lm_scoring as lm
from aerolith.llm import recurrent as rn
from aerolith.llm.toxicity import remainder


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


@pytest.mark.parametrize("sure", [lm.SURE, 3])
def test_base_score(documents, odd_texts, sure):
    texts = odd_texts + [f"the cat sat on mat {k % 7} and the dog {k}" for k in range(60)]
    rows = lm.score_documents(documents(texts), remainder("doc_id", 5) != 1, rounds=1, sure=sure).collect()
    counts = collections.Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and math.isfinite(r.score) and r.score < 0


def test_learns_from_every_training_text(documents, odd_texts, monkeypatch):
    """As the query calls it: each token of each training text reaches the trainer once."""
    texts = odd_texts + [f"the cat sat on mat {k % 7} and the dog {k}" for k in range(60)]
    learnt, unpacked = [], lm._unpacked

    def held(v):
        learnt.append(unpacked(v))
        return learnt[-1]

    monkeypatch.setattr(lm, "_unpacked", held)
    rows = lm.score_documents(documents(texts), remainder("doc_id", 5) != 1).collect()
    assert len(learnt) == lm.ROUNDS and all(x[-1] > 0 for x in learnt)
    assert sum(x[-1] for x in learnt) == rows[0].train_tokens


def test_scores_do_not_depend_on_the_split(documents, monkeypatch):
    """Several shards and sums in a tree; ids null and repeated, rows in other partitions."""
    texts = [f"one cat {k % 5} sat on mat {k % 7} {'and on ' * (k % 9)}the dog {k}" for k in range(300)] + ["again and again"] * 30
    ids = [*range(300), *[None] * 15, *[7] * 15]
    found = []
    weights, trained = [], lm._trained

    def kept(*a):
        weights.append(trained(*a))
        return weights[-1]

    monkeypatch.setattr(lm, "_trained", kept)
    for parts in (1, 7):
        docs = documents(texts, ids=ids).repartition(parts, "text")
        rows = lm.score_documents(docs, remainder("doc_id", 5) != 1, shard_tokens=100).collect()
        assert len(rows) == len(texts) and rows[0].train_tokens > 100 * lm.ROUNDS * lm._FAN
        found.append(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in rows))
    assert (weights[0] == weights[1]).all()
    assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
    assert [x[2] for x in found[0]] == pytest.approx([x[2] for x in found[1]], rel=1e-5)


def test_unseen_texts_score_better_than_by_counts_alone(documents):
    texts = [" ".join(f"w{(k + j) % 40}" for j in range(60)) for k in range(400)]
    rows = [r for r in lm.score_documents(documents(texts), remainder("doc_id", 5) != 1).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_empty_table(documents):
    assert lm.score_documents(documents(["a"]).limit(0), remainder("doc_id", 5) != 1).count() == 0


def one_by_one(shape, flat, ids):
    """Log-probability of one document, token by token."""
    p, h, before, total = shape.views(flat.astype(float)), np.zeros(rn.HIDDEN), shape.start, 0.0
    n = rn.HIDDEN
    for i in ids:
        x, u = p["enter"][before], h @ p["state"]
        z, r = 1 / (1 + np.exp(-(x[:n] + u[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + u[n : 2 * n])))
        h = (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h
        logits = h @ p["to_class"] + p["class_bias"]
        k = i // rn.CLASS if i < shape.head else i - shape.head + shape.groups
        total += logits[k] - np.log(np.exp(logits).sum())
        if i < shape.head:
            inner = p["to_word"][k * rn.CLASS : (k + 1) * rn.CLASS] @ h + p["word_bias"][k * rn.CLASS : (k + 1) * rn.CLASS]
            total += inner[i % rn.CLASS] - np.log(np.exp(inner).sum())
        before = i
    return total


def model(seed=0):
    rng = np.random.default_rng(seed)
    shape = rn.Shape(70)
    flat = rn.initial(shape, rng.integers(1, 50, 70), rng.uniform(1, 20, rn.TAIL))
    return shape, flat, rng


def test_scores_do_not_depend_on_the_batch():
    shape, flat, rng = model()
    documents = [rng.integers(0, shape.start, k) for k in (1, 40, 3, 0, 200, 17)]
    got = rn.log_probability(shape, flat, documents, block=64)
    assert got == pytest.approx([one_by_one(shape, flat, d) for d in documents], rel=1e-4)


def test_gradient():
    shape, flat, rng = model(1)
    steps, lanes = 5, 3
    target, before = rng.integers(0, shape.start, (steps, lanes)), rng.integers(0, shape.start, (steps, lanes))
    begins, real = rng.random((steps, lanes)) < 0.2, rng.random((steps, lanes)) < 0.9
    h0 = rng.normal(0, 0.3, (lanes, rn.HIDDEN)).astype(np.float32)

    def loss(x):
        p, h, out = shape.views(x), h0.astype(float), 0.0
        for t in range(steps):
            h = rn._step(p, before[t], h * ~begins[t][:, None])[0]
            out -= (rn._token_log(shape, p, h, target[t]) * real[t]).sum()
        return out

    trainer = rn.Trainer(shape, flat.astype(np.float64), rate=0.0)
    trainer.seen = np.zeros(len(flat))
    # the step adds the squared gradient over lanes to ``seen``; signs come from differences
    with np.errstate(divide="ignore", invalid="ignore"):
        trainer.window(before, target, begins, real, h0.astype(float))
    magnitude = np.sqrt(trainer.seen) * lanes
    x = flat.astype(np.float64)
    for k in rng.choice(len(x), 60, replace=False):
        e = np.zeros(len(x))
        e[k] = 1e-5
        assert abs((loss(x + e) - loss(x - e)) / 2e-5) == pytest.approx(magnitude[k], abs=2e-4, rel=2e-3)


def test_training_helps():
    shape, flat, rng = model(2)
    documents = [np.tile([1, 2, 3, 4, 65], 12) for _ in range(30)]
    trainer = rn.Trainer(shape, flat)
    for _ in range(8):
        trainer.lanes(documents)
    assert rn.log_probability(shape, trainer.flat, documents[:1])[0] > rn.log_probability(shape, flat, documents[:1])[0] + 20
