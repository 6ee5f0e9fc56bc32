"""Spelling variants against all pairs of words, with tries of a few words."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from murmura.llm import oracles, registered, spelling

FOLDER = "/root/testdata/sf0.001"
NAME = "op12_spelling_variants"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart(a, b):
    """Edit distance one, by all single edits of the shorter word's prefix and suffix."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, at_least):
    total = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= at_least}


def expected(rows, at_least):
    n = counted(rows, at_least)
    near = {w: [v for v in n if apart(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    found = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return found


def awkward():
    draw = random.Random(12)
    stems = ["separate", "definitely", "tomorrow", "éclairs", "ÉCLAIRS", "aaaaaaaa", "x" * 300, "Straße" * 9]
    rows = []
    for k in range(120):
        words = []
        for _ in range(30):
            word = draw.choice(stems)
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                at = draw.randrange(len(word))
                word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("aeé") + word[at:], word[:at] + "z" + word[at + 1 :]])
            words.append(word)
        rows.append((k % 90, draw.choice([" ", "-", "\n", "9"]).join(words)))
    # Anagrams are all in one leaf, and none is near another.
    rows += [(1, " ".join("".join(draw.sample("abcdefgh", 8)) for _ in range(500)))] * 2
    return rows + [(None, "separate seperate"), (5, None), (6, ""), (7, " 12 ×÷×÷×÷ ")]


def run(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("mine"), "n": F.lit(1)})
    found = spelling.variants(docs.repartition(3), **sizes).collect()
    assert len(found) == len({r["word"] for r in found})
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


def test_sql(spark):
    found = registered.queries()[NAME](spark, FOLDER)
    assert difference(found, connect(FOLDER), oracles.statements()[NAME]) is None


@pytest.mark.parametrize("size,searches", [(1 << 15, 1 << 16), (7, 50), (1, 5)])
def test_all_pairs_by_brute_force(spark, size, searches):
    rows = awkward()
    assert run(spark, rows, at_least=2, size=size, searches=searches) == expected(rows, 2)


def test_forms_lead_to_roots_over_several_steps(spark):
    counts = {"separate": 1000, "seperate": 100, "seperat": 20, "sperat": 4, "sprata": 1}
    rows = [(None, " ".join([w] * n)) for w, n in counts.items()]
    assert run(spark, rows, at_least=1) == expected(rows, 1)


def test_empty_tables(spark):
    assert run(spark, [(1, None)]) == set()
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(docs).collect() == []


def test_trie_finds_every_word_that_is_one_edit_away(monkeypatch):
    draw = np.random.default_rng(3)
    words = sorted({"".join(draw.choice(list("abcdeé"), draw.integers(1, 9))) for _ in range(3000)})
    queries, there = spelling.Letters(words[::7]), spelling.Letters(words)
    for together in (1 << 13, 64):
        monkeypatch.setattr(spelling, "TOGETHER", together)
        found = [(words[::7][a], words[b]) for x in spelling.Trie(there).search(queries) for a, b in zip(*x)]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in words[::7] for b in words if apart(a, b)}
