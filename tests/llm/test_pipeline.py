"""The stages of the pipeline one after the other by brute force, and on awkward columns."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmura.llm import storage

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text)


def good(text):
    found = words(text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    many = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    n, chars = len(found), sum(map(len, found))
    return not (
        n < 50
        or 2 * len(repeated) > n
        or (len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines))
        or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * n
        or chars < 2 * n
        or chars > 25 * n
    )


def without_lines(texts):
    """By id, in their order."""
    owner, found = {}, {}
    for doc_id in sorted(texts):
        kept = []
        for line in texts[doc_id].split("\n"):
            key = line.strip(WHITE).translate(LOW)
            if len(key) < 10 or owner.setdefault(key, doc_id) == doc_id:
                kept.append(line)
        found[doc_id] = "\n".join(kept)
    return found


def shingles(found):
    return [tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))] if found else []


def one_of_each(texts):
    sets = {d: set(shingles(words(t.translate(LOW)))) for d, t in texts.items()}
    group = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return {d: t for d, t in texts.items() if group[d] == d}


def clean(text, items):
    found = words(text.translate(LOW))
    whole = shingles(found) if len(found) >= 5 else []
    for item in items:
        own = words(item.translate(LOW))
        wanted = collections.Counter(shingles(own))
        length = min(len(own), len(found))
        if not length:
            continue
        if length < 5:
            windows = [found[i : i + length] for i in range(len(found) - length + 1)]
            parts = [collections.Counter(shingles(w)) for w in windows]
        else:
            if not set(whole) & set(wanted):
                continue
            parts = [collections.Counter(whole[i : i + length - 4]) for i in range(len(found) - length + 1)]
        for part in parts:
            shared = sum((part & wanted).values())
            if 4 * shared >= 3 * (sum(part.values()) + sum(wanted.values()) - shared):
                return False
    return True


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    # Documents of own words around an item, whole or with a changed word, and near copies of one.
    own = lambda k: [f"w{k}x{i}" for i in range(60)]
    planted = [" ".join(own(k)[:30] + [item] + own(k)[30:]) for k, item in enumerate(items[:6])]
    planted += [" ".join(own(k) + words(item)[:-1] + ["else"]) for k, item in enumerate(items[6:12], 6)]
    planted += [" ".join(own(99)[:55] + [f"tail{k}"]) for k in range(3)]
    rows = [(10_000 + k, text, "en", "mine", len(text)) for k, text in enumerate(planted)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(texts) == docs.count()
    expected = [{d: t for d, t in texts.items() if good(t)}]
    expected.append(without_lines(expected[0]))
    expected.append(one_of_each(expected[1]))
    expected.append({d: t for d, t in expected[2].items() if clean(t, items)})
    assert len(expected[3]) < len(expected[2]) < len(expected[1]) < len(texts)
    columns = docs.columns
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, expected):
        docs = storage.written(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == wanted
    packed = corpus_pipeline.best_fit_packing(spark, docs, FOLDER).where("piece = 0")
    assert collections.Counter(r.doc_id for r in packed.collect()) == dict.fromkeys(expected[3], 1)


CLASHING = ["n_words", "failed", "kept", "base_failed", "n_lines", "n_dropped", "_doc", "_text", "_lines", "_drop",
            "_q_x", "_staying", "_row", "given", "component_id", "_component", "odd.name", "n_shingles", "h1"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_columns_of_the_input_are_left_alone(spark, stage):
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 80").drop("n_chars")
    docs = plain
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), "doc_id"))
    found = stage(spark, docs, FOLDER)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    rows = [r.asDict() for r in found.collect()]
    assert rows and all(r[c] == f"{k}:{r['doc_id']}" for r in rows for k, c in enumerate(CLASHING))
    kept = {(r.doc_id, r.text) for r in stage(spark, plain, FOLDER).collect()}
    assert kept == {(r["doc_id"], r["text"]) for r in rows}


def test_rows_without_an_id_go_with_their_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (None, text, 2), (None, "", 3), (None, None, 4), (6, text.upper(), 5), (7, "", 6), (None, "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k int")
    assert sorted(r.k for r in corpus_pipeline.near_deduplication(spark, docs, FOLDER).collect()) == [1, 3, 4, 6, 7]


def test_only_id_and_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id bigint, text string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert [tuple(r) for r in stage(spark, docs, FOLDER).collect()] == [tuple(r) for r in docs.collect()]
