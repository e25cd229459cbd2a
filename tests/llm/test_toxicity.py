from __future__ import annotations

import random

import numpy as np
import pytest

from aerolith.llm import textscan as ts
from aerolith.llm import toxicity as tx


def corpus(n=600):
    rng = random.Random(1)
    plain = "the of and to in is that it was for on are with as his they at be this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()
    bad = ["idiot", "moron", "stupid", "worthless"]
    texts, labels = [], []
    for _ in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def fitted(spark, documents):
    texts, labels = corpus()
    docs = documents(texts)
    model = tx.learn(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    return model, texts, labels


def test_learns_and_finds_disguised_words(documents, fitted):
    model, texts, labels = fitted
    scores = {r.doc_id: r.toxicity for r in tx.score(documents(texts), model).collect()}
    assert np.mean([(scores[k] >= 0.5) == bool(y) for k, y in enumerate(labels)]) > 0.97
    said = ["you are an 1d10t and more", "what a m0r0n he was", "they said s t u p i d to all", "so stuuuupid was it", "w.o.r.t.h.l.e.s.s it is", "we use each word at 3 or 4", "all was up on the 1st of it"]
    got = [r.toxicity for r in tx.score(documents(said), model).orderBy("doc_id").collect()]
    assert [x >= 0.5 for x in got] == [True] * 5 + [False] * 2


def test_odd_texts_have_scores(documents, odd_texts, fitted):
    model, *_ = fitted
    rows = tx.score(documents(odd_texts), model).orderBy("doc_id").collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.toxicity <= 1 for r in rows)
    assert rows[0].toxicity == rows[1].toxicity and rows[8].toxicity == rows[9].toxicity


def test_without_labels(spark, documents):
    docs = documents(["a b", None])
    for labels in ([], [(0, 0)], [(0, None)], [(99, 1)]):
        model = tx.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.toxicity for r in tx.score(docs, model).collect()] == [0.0, 0.0]
    assert tx.score(docs.limit(0), model).count() == 0


def test_places():
    chunk = ts.of_texts(["an 1d10t here", "l o u d", "looooong", "plain words, 12 of 3", "a b", "i.d.i.o.t"])
    assert [(r, chunk.data[a:b].tobytes().decode()) for r, a, b in sorted(tx.disguised(chunk))] == [(0, "1d10t"), (1, "l o u d"), (2, "looooong"), (5, "i.d.i.o.t")]


def test_places_of_all_disguises():
    """Substitutions at the end and in runs, three spaced letters, wide gaps, letters of two bytes; an empty text after them."""
    said = ["a$$", "a55", "p1$$", "s#!+", "hat3", "di3", "d i e", "f - u - c - k", "b\u00f6\u00f6\u00f6se", "b \u00f6 s e", ""]
    chunk = ts.of_texts(said)
    assert [(r, chunk.data[a:b].tobytes().decode()) for r, a, b in sorted(tx.disguised(chunk))] == list(enumerate(said[:-1]))
    plain = ts.of_texts(["12 of 34", "a b", "\u00f6", "\u00f6", "\u00f6", "a - be - c"])
    assert tx.disguised(plain) == []


def test_finds_words_disguised_at_the_end(documents, fitted):
    model, *_ = fitted
    said = ["you are an idi0+ and more", "so st*p1d was it", "they said s - t - u - p - i - d to all", "that m0r0n and w0rthl3$$ it is"]
    assert all(r.toxicity >= 0.5 for r in tx.score(documents(said), model).collect())


def test_restoring_is_exact():
    """The reading found is the likeliest of all, however many there are."""
    import itertools

    model = tx.CharacterModel(np.random.default_rng(3).integers(0, 9, tx.SYMBOLS**3) ** 6)

    def cost(out):
        state, total = (0, 0), 0.0
        for text, price in out:
            total -= price
            for c in text:
                k = 0 if c == " " else tx.code_of(c)
                total += float(model.log[state[0], state[1], k])
                state = (state[1], k) if k else (0, 0)
        return total + float(model.log[state[0], state[1], 0])

    for place in ("x***", "*1*", "**|*", "1*+*a", "****q", "x***z", "***b"):
        best = max(itertools.product(*tx._lattice(place)), key=cost)
        assert model.restore(place) == "".join(t for t, _ in best)


def test_texts_do_not_touch(odd_texts):
    """What a text gives does not depend on its neighbours in the chunk."""
    texts = [*odd_texts, "3", "ab", "aa", "a", "$", "x", "t 1", "diot", "i d", "i o"]
    together = ts.of_texts(texts)
    alone = [ts.of_texts([t]) for t in texts]
    assert sorted(np.concatenate([tx._trigrams(c) for c in alone]).tolist()) == sorted(tx._trigrams(together).tolist())
    places = [(k, c.data[a:b].tobytes()) for k, c in enumerate(alone) for _, a, b in tx.disguised(c)]
    assert sorted((r, together.data[a:b].tobytes()) for r, a, b in tx.disguised(together)) == sorted(places)


def test_clashing_columns_and_null_ids(spark, documents, fitted):
    model, *_ = fitted
    docs = documents(["you idiot", None], ids=[None, None]).selectExpr("*", "1 as Toxicity", "2 as `a.b`", "3 as label")
    out = tx.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "label", "toxicity"]
    assert sorted(r.toxicity >= 0.5 for r in out.collect()) == [False, True]
    model = tx.learn(docs, spark.createDataFrame([(None, 1), (3, 0)], "doc_id long, toxic int"))
    assert [r.toxicity for r in tx.score(docs, model).collect()] == [0.0, 0.0]


def test_a_very_long_place_is_decoded_whole():
    rng = np.random.default_rng(1)
    model = tx.CharacterModel(rng.integers(0, 50, tx.SYMBOLS**3))
    place = "".join(rng.choice(list("abcdefghij0123456789+/"), 30_000))
    assert len(model.restore(place)) >= 15_000
