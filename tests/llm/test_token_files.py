"""The layout of token files, and reads of a part of them."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest

from murmura.llm import registered, storage, token_files

FOLDER = "/root/testdata/sf0.01"
#: Row groups and pages small enough for several of each in a shard.
SMALL = {"parquet.block.size": str(64 << 10), "parquet.page.size": str(4 << 10), "parquet.page.row.count.limit": "20"}


@pytest.fixture(scope="module")
def files(spark):
    folder = storage.shared_folder(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    token_files.write_tokens(docs, folder, registered.tokenizer(), shards=3, layout=SMALL)
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    return folder, rows


def test_encodings_row_groups_and_page_indexes(files):
    folder, rows = files
    paths = glob.glob(f"{folder.removeprefix('file:')}/part-*.parquet")
    assert len(paths) == 3
    bounds = []
    for path in paths:
        meta = pq.ParquetFile(path).metadata
        assert meta.num_row_groups > 1
        for k in range(meta.num_row_groups):
            group = meta.row_group(k)
            chunks = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
            assert group.total_byte_size < 16 * (64 << 10)
            assert all(chunks[x].has_offset_index and chunks[x].has_column_index for x in ("doc_id", "local_start", "ids"))
            assert all("DELTA_BINARY_PACKED" in chunks[x].encodings for x in ("doc_id", "local_start"))
            assert any("DICTIONARY" in x for x in chunks["ids"].encodings)
            bounds.append((chunks["doc_id"].statistics.min, chunks["doc_id"].statistics.max))
    # Row groups are disjoint ranges of ids, so a range of documents lies in few of them.
    bounds.sort()
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert sum(len(r.ids) for r in rows) == rows[-1].start + rows[-1].n_tokens


def test_documents_of_a_range(spark, files):
    folder, rows = files
    ids = [r.doc_id for r in rows]
    for first, last in ((ids[10], ids[40]), (ids[300], ids[700]), (ids[-1], ids[-1] + 9), (-5, ids[0]), (9, 3)):
        got = token_files.read_documents(spark, folder, first, last).orderBy("start").collect()
        assert got == [r for r in rows if first <= r.doc_id <= last]
    plan = token_files.read_documents(spark, folder, 3, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "LessThanOrEqual(doc_id,9)" in plan


def test_counts_leave_the_ids_unread(spark, files):
    folder, _ = files
    plan = token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def test_ids_are_not_shuffled_to_find_their_starts(spark, files):
    folder, rows = files
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = token_files.read_tokens(spark, folder)
        assert "SortMergeJoin" not in read._jdf.queryExecution().executedPlan().toString()
        assert read.orderBy("start").collect() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ids_of_a_span(spark, files):
    folder, rows = files
    flat = [(r.doc_id, x) for r in rows for x in r.ids]
    shard = token_files._bases(token_files._stored(spark, folder)).orderBy("shard").collect()[1]._base
    spans = [(0, 1), (0, 700), (5, 6), (rows[7].start, rows[8].start), (rows[7].start + 1, rows[9].start + 2)]
    spans += [(shard - 3, shard + 3), (shard, shard + 1), (3, len(flat) + 5), (len(flat), len(flat) + 1), (9, 9), (-4, 2)]
    for start, end in spans:
        got = token_files.read_span(spark, folder, start, end).orderBy("start").collect()
        assert [(r.doc_id, x) for r in got for x in r.ids] == flat[max(0, start) : max(0, end)], (start, end)
        assert all(flat[r.start] == (r.doc_id, r.ids[0]) for r in got)


def test_parts_of_nothing_and_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, None), (4, ""), (4, "x")], "doc_id bigint, text string")
    for rows in (docs, docs.where("false")):
        folder = storage.shared_folder(spark)
        token_files.write_tokens(rows, folder, registered.tokenizer(), shards=2)
        flat = [x for r in token_files.read_tokens(spark, folder).orderBy("start").collect() for x in r.ids]
        got = token_files.read_span(spark, folder, 0, 99).orderBy("start").collect()
        assert [x for r in got for x in r.ids] == flat
        assert token_files.read_documents(spark, folder, 0, 9).count() == rows.where("doc_id = 4").count()
