"""The grammar of clauses against its rules, read word by word."""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.llm import toxicity
from murmura.llm.toxicity import EVENTS, HINT, INSULT, NEGATION, OTHER, REPORT, SYMBOLS, TARGET, THREAT

WORD = {OTHER: "stone", INSULT: "fool", THREAT: "kill", TARGET: "you", NEGATION: "not", REPORT: "said", HINT: "scoundrel"}
WEIGHTS = np.array([-3.0, 1.5, 2.0, 0.5, 4.0, -0.25, -1.0, 0.75, 1.25, -0.5, -20.0])


@pytest.fixture(scope="module")
def model():
    return toxicity.Model(frozenset({"fool"}), frozenset(), frozenset({"scoun"}), WEIGHTS)


def events(symbols):
    """What each insult, threat and hint of a clause is, by what stands before it."""
    kinds = {INSULT: "insult", THREAT: "threat", HINT: "hint"}
    for place, symbol in enumerate(symbols):
        before = symbols[:place]
        if symbol not in kinds:
            continue
        if REPORT in before:
            yield "hint_denied" if symbol == HINT else "reported"
        elif NEGATION in before[-3:]:
            yield "hint_denied" if symbol == HINT else "negated"
        else:
            yield kinds[symbol] + ("_at" if TARGET in before else "")


def compare(model, clauses):
    text, want = "", []
    for symbols in clauses:
        start = len(text)
        text += " ".join(WORD[x] for x in symbols)
        if found := Counter(events(symbols)):
            score = sum(WEIGHTS[1 + EVENTS.index(x)] * n for x, n in found.items())
            want.append((start, len(text), found, score))
        text += "."
    got = list(model.paths(text))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want])
    return want


def test_all_short_clauses(model):
    for n in range(1, 6):
        compare(model, list(product(SYMBOLS, repeat=n)))


def test_long_clauses(model):
    draw = np.random.Generator(np.random.PCG64(5))
    compare(model, [tuple(draw.integers(0, len(SYMBOLS), draw.integers(6, 40)).tolist()) for _ in range(500)])


def test_a_document_scores_by_the_weights_of_its_clauses(spark, model):
    texts = ["you fool. not a fool. stone", "you fool. you kill", "stone", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert [[c.score for c in got[k].clauses] for k in range(5)] == [[2.0, -0.25], [2.0, 4.0], [], [], []]
    for row in got.values():
        assert row.score == pytest.approx(1 / (1 + np.exp(3.0 - sum(c.score for c in row.clauses))))


def test_words_weigh_against_hints_only(spark, model):
    texts = ["scoundrel a b c", "scoundrel. " + "a " * 49, "fool " + "a " * 49]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for doc_id, logit in enumerate([-3.0 + 0.75 - 20 * 0.04, -3.0 + 0.75 - 20 * 0.5, -3.0 + 1.5]):
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-logit)))


def _marked(draw, n, toxic, length):
    """``n`` texts of syllables; toxic ones say a word of the stem "zorgru" in every ten, others by chance in 500."""
    syllables = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti"]
    texts = []
    for _ in range(n):
        words = ["".join(draw.choice(syllables, 3)) for _ in range(length)]
        for k in np.flatnonzero(draw.random(length) < (0.1 if toxic else 0.002)):
            words[k] = "zorgru" + draw.choice(syllables)
        texts.append(" ".join(words))
    return texts


def test_a_stem_that_clean_texts_have_too_is_a_hint(spark):
    draw = np.random.Generator(np.random.PCG64(11))
    texts = [(t, y) for y, n in ((1, 60), (0, 300)) for k in (20, 200) for t in _marked(draw, n, y, k)]
    rows = [(k, t, y) for k, (t, y) in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.hints == {"zorgru"} and not model.stems and not model.words
    assert model.weights[-1] < 0
    held = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    # A short text can be toxic without having the stem at all.
    by_id = dict((k, t) for k, t, _ in rows)
    wrong = [r for r in held if (r.score >= 0.7) != (r.toxic == 1) and ("zorgru" in by_id[r.doc_id] or r.toxic == 0)]
    assert len(wrong) <= 0.05 * len(held)


def test_a_few_wrong_labels_leave_the_weights():
    kinds = np.array([[1.0, 0.0]] * 900 + [[1.0, 1.0]] * 60 + [[1.0, 30.0]] * 40)
    right = (kinds[:, 1] > 0).astype(float)
    said = right.copy()
    said[[0, 300, 600, 999, 998]] = 1 - said[[0, 300, 600, 999, 998]]
    weights = toxicity._logistic(kinds, said)
    assert weights[0] < -3 and weights[0] + weights[1] > 1


def test_offsets_are_those_of_the_text(model):
    text = "İİ says hello. İ you FOOL, İ"
    ((start, end, found, _),) = model.paths(text)
    assert text[start:end] == " İ you FOOL, İ" and found == {"insult_at": 1}
