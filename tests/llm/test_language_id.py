from __future__ import annotations

import itertools
import random

import numpy as np

from aerolith.llm import language_id as li

WORDS = {"en": "the of and that with this from have which their would about there".split(), "de": "der die und nicht eine sich auch werden einen wurde zwischen über größe".split(), "ru": "это что как для при или если только можно после".split()}


def corpus():
    rng = random.Random(2)
    texts, langs = [], []
    for la in itertools.islice(itertools.cycle(WORDS), 240):
        texts.append(" ".join(rng.choice(WORDS[la]) for _ in range(30)))
        langs.append(la)
    return texts, langs


def test_learns_and_labels_spans(documents):
    texts, langs = corpus()
    model = li.learn(documents(texts, langs))
    assert model.languages == ["de", "en", "ru"]
    rows = li.identify(documents(texts), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == langs and all(0 <= r.score <= 1 for r in rows)
    mixed = "the of and that with. Der und nicht eine sich auch; это что как для при"
    row = li.identify(documents([mixed]), model, spans=True).first()
    assert [(mixed[s.start : s.stop], s.lang) for s in row.lang_spans] == [("the of and that with", "en"), ("Der und nicht eine sich auch", "de"), ("это что как для при", "ru")]


def test_undetermined(documents, odd_texts):
    texts, langs = corpus()
    model = li.learn(documents(texts, langs))
    got = [(r.lang_pred, r.score) for r in li.identify(documents([*odd_texts, "12 … 34 –", "٣٤"]), model).orderBy("doc_id").collect()]
    assert [x for x in got[:3]] == [("und", 0.0)] * 3 and got[-2:] == [("und", 0.0)] * 2
    assert got[6][0] == "ru" and got[8] == got[9]
    nothing = li.learn(documents(["a", "b"], [None, None]))
    assert [r.lang_pred for r in li.identify(documents(["a"]), nothing).collect()] == ["und"]
    assert li.identify(documents(["a"]).limit(0), model).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 4, 0, 6, 2]
    of = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(of[-1], 3)) * 3
    got = li.viterbi(scores, of, 2.0)
    for a, b in zip(of, of[1:], strict=False):
        best = max(itertools.product(range(3), repeat=b - a), key=lambda p: sum(scores[a + k, x] for k, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False)))
        assert tuple(got[a:b]) == best


def test_word_scores_against_a_plain_reading(documents):
    """Each word's score is the sum of the logarithms of its hashed 4-grams' shares, counted by hand."""
    texts, langs = corpus()
    model = li.learn(documents(texts, langs))

    def grams(word):
        raw = bytes(li.ts.LOWER[list(word.encode())].tolist()) + b"\0"
        for k in range(len(raw)):
            code = 0
            for j in range(4):
                if k >= j:
                    code |= raw[k - j] << 8 * j
            code = code * 0x9E3779B1 & 0xFFFFFFFF
            code = (code ^ code >> 15) * 0x85EBCA77 & 0xFFFFFFFF
            yield code >> 32 - li.GRAM_BITS

    counts = np.zeros((1 << li.GRAM_BITS, 3))
    for t, la in zip(texts, langs, strict=True):
        for w in t.split():
            for g in grams(w):
                counts[g, model.languages.index(la)] += 1
    mean = (counts.sum(axis=1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * len(counts))
    log = np.log((counts + 50 * mean) / (counts.sum(axis=0) + 50))
    chunk = li.ts.of_texts(["Which zwischen можно the"])
    words = chunk.words(li.ts.LETTER)
    got = model.word_scores(chunk, words)
    for k, (w, uses) in enumerate(zip("Which zwischen можно the".split(), ([1, 1, 0], [1, 1, 0], [0, 0, 1], [1, 1, 0]), strict=True)):
        want = sum(log[g] for g in grams(w)) - 50.0 * (1 - np.array(uses))
        assert np.allclose(got[k], want, atol=1e-3)


def test_scores_of_long_texts_and_clashing_columns(documents):
    texts, langs = corpus()
    model = li.learn(documents(texts, langs))
    long = " ".join(texts[0].split() * 400 + texts[1].split() * 350)
    docs = documents([long, None, "the of"], ids=[None, None, 2]).selectExpr("*", "1 as Score", "2 as lang_pred", "3 as `a.b`")
    with np.errstate(over="raise"):
        rows = {r.text: r for r in li.identify(docs, model).collect()}
    assert rows[long].lang_pred == "en" and 0 < rows[long].score <= 1 and rows[None].lang_pred == "und"
    assert li.identify(docs, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "lang_pred", "score", "n_spans"]
