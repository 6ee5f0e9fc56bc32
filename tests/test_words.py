from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import words as W

DIRTY = [
    "a b  ", " a b", "a  b", "", "   ", "\n \t", "a\nb a", "  x  \n", " ", "a b a a",
    "ab ab  ab", "\x00", "end\n ", " ", "é 𝒳 é", "b",
]


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(list(enumerate(DIRTY)), "doc_id bigint, text string")


def visible(text):
    return any(c > " " for c in text)


def tokens_of(text):
    return text.rstrip(" ").split(" ") if visible(text) else []


def as_dict(df):
    rows = df.collect()
    counts = {row.word: row.n for row in rows}
    assert len(counts) == len(rows)
    return counts


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a b  ", ["a", "b"]),
        (" a b", ["", "a", "b"]),
        ("a  b", ["a", "", "b"]),
        ("", []),
        ("   ", []),
        ("a\n", ["a\n"]),
    ],
)
def test_tokens(spark, text, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r.word for r in W.words(docs).collect()] == expected


def test_terms_per_document(spark, dirty):
    got = {(r.doc_id, r.word): r.n for r in W.doc_term_counts(dirty).collect()}
    expected = {
        (doc_id, word): n
        for doc_id, text in enumerate(DIRTY)
        for word, n in Counter(tokens_of(text)).items()
    }
    assert got == expected


def test_terms_per_document_need_no_shuffle(dirty):
    plan = W.doc_term_counts(dirty)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("method", [m for m in W.METHODS if m != "merged"])
@pytest.mark.parametrize("parts", [1, 3])
def test_methods_agree_on_dirty_texts(dirty, method, parts):
    expected = Counter(token for text in DIRTY for token in tokens_of(text))
    assert as_dict(W.word_count(dirty.repartition(3), method, parts)) == expected


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 40])
def test_merged_counts_equal_those_of_joined_texts(dirty, parts):
    joined = defaultdict(list)
    for doc_id, text in enumerate(DIRTY):
        joined[doc_id % parts].append(text)
    blanks = "".join(map(chr, range(33)))
    expected = Counter()
    for texts in joined.values():
        expected.update(tokens_of(" ".join(texts).strip(blanks)))
    assert as_dict(W.word_count(dirty.repartition(3), "merged", parts)) == expected


def test_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(" ab\n\t", k=rng.randrange(12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = Counter(token for text in texts for token in tokens_of(text))
    for method in W.METHODS:
        if method != "merged":
            assert as_dict(W.word_count(docs, method)) == expected
    joined = [" ".join(texts[part::7]).strip("".join(map(chr, range(33)))) for part in range(7)]
    expected = Counter(token for text in joined for token in tokens_of(text))
    assert as_dict(W.word_count(docs, "merged", 7)) == expected


def test_unknown_method_and_parts(dirty):
    with pytest.raises(ValueError):
        W.word_count(dirty, "other")
    with pytest.raises(ValueError):
        W.word_count(dirty, "salted", 0)


def test_lengths_count_utf16_units(spark):
    rows = spark.createDataFrame([("a",), ("é",), ("𝒳",), ("",)], "word string")
    lengths = rows.select(T.utf16_length(F.col("word")).cast("int").alias("n"))
    assert [r.n for r in lengths.collect()] == [1, 1, 2, 0]


def test_golden_lengths(spark):
    counts = spark.createDataFrame(
        [("d", 210), ("test", 3), ("bbb", 3), ("prova", 2), ("ddd", 2), ("aaa", 1), ("ccc", 1),
         ("final", 1), ("asdfas", 1)],
        "word string, n bigint",
    )
    row = W.average_lengths(counts).first()
    assert row.avg_all == pytest.approx(1.178571428, abs=1e-9)
    assert row.avg_distinct == pytest.approx(33 / 9)
    assert W.average_length_truncated(counts).first().avg_length == 3


def test_empty_input(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    counts = W.word_count(none)
    assert counts.collect() == []
    assert tuple(W.average_lengths(counts).first()) == (None, None)
    assert W.average_length_truncated(counts).first().avg_length is None
    assert tuple(W.corpus_size(none).first()) == (0, 0)


def test_one_word_may_fill_a_third_of_the_text(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("w"), F.col("id")))
        .alias("text"),
    )
    for method in W.METHODS:
        counts = as_dict(W.word_count(docs, method))
        assert counts["hot"] == 1000 and len(counts) == 2001


@pytest.mark.parametrize("parts", [1, 3])
def test_documents_without_an_id_count_in_every_method(spark, parts):
    rows = [(0, "a b"), (1, "c"), (None, "d a"), (None, "d a"), (None, "e"), (None, None), (None, " "), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = Counter(w for _, text in rows for w in tokens_of(text or ""))
    for method in W.METHODS:
        assert as_dict(W.word_count(docs, method, parts)) == expected


def test_a_document_without_an_id_is_merged_with_none(spark):
    rows = [(None, " a  b "), (None, " a  b "), (0, " c "), (1, " c ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # Each of the first two is trimmed by itself, the others as one text.
    assert as_dict(W.word_count(docs, "merged", 1)) == {"a": 2, "b": 2, "": 2 + 2, "c": 2}
