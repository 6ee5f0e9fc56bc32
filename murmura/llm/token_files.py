"""Token ids in Parquet files made for selective reads.

A row is a document; rows lie in ascending ``doc_id`` order (NULL first, equal
ids by text) within and across files.  ``ids`` is a list column, dictionary-encoded (a
vocabulary fits a dictionary page); the metadata columns are small sorted integers,
delta-encoded.  Row groups and pages are bounded in bytes, and pages carry
min/max indexes, so a reader of a range of documents, or of counts alone,
fetches only those pages: ``read_documents`` for a range of ids, ``read_span`` for a
range of positions in the whole sequence of ids.

NULL texts count as empty: only the end id is written for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from murmura.llm import tokens

END_ID = 2
#: The writer's settings: bounded row groups and pages, version 2 encodings (delta where no dictionary is).
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "compression": "zstd",
}

SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("local_start", LongType()),
        StructField("n_tokens", LongType()),
        StructField("ids", ArrayType(IntegerType())),
    ]
)


def _encoded(path: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = tokens.encoder(path), 0
        for batch in batches:
            for part in tokens.parts(batch):
                encoded = encoder.encode(part["text"])
                counts = np.array([len(x) // 4 + 1 for x in encoded], np.int64)
                end = np.array([end_id], "<u4").tobytes()
                flat = np.frombuffer(b"".join(x + end for x in encoded), "<i4")
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].cast(pa.int64()),
                        pa.array(start + offsets[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                    ],
                    names=SCHEMA.names,
                )
                start += int(offsets[-1])
        tokens.released()

    return rows


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    shards: int | None = None,
    layout: dict[str, str] | None = None,
) -> None:
    """Writes the ids of ``docs`` below ``folder``, in one shard per range of ``doc_id``.

    Shards are numbered in ``doc_id`` order; ``local_start`` counts the ids
    before a document within its shard, so no task waits for another's total.
    ``layout`` overrides settings of ``LAYOUT``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    encoded = ranged.mapInArrow(_encoded(tokenizer, end_id), SCHEMA)
    encoded.withColumn("shard", F.spark_partition_id()).write.options(**LAYOUT | (layout or {})).parquet(folder)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(StructType(SCHEMA.fields + [StructField("shard", IntegerType())])).parquet(folder)


def _bases(stored: DataFrame) -> DataFrame:
    """``(shard, _base)``: the ids before each shard, from two small columns; one row per shard."""
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))


def _placed(rows: DataFrame, bases: DataFrame) -> DataFrame:
    # One row per shard goes to the ids, which stay where they are.
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the files; ``start`` counts the ids of all documents before.

    The totals per shard come from two small columns; there are as many as
    shards.
    """
    stored = _stored(spark, folder)
    return _placed(stored, _bases(stored))


def read_documents(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """``read_tokens`` of the documents with ``first <= doc_id <= last``, from their row groups and pages only."""
    stored = _stored(spark, folder)
    return _placed(stored.where(F.col("doc_id").between(first, last)), _bases(stored))


def read_span(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """``(doc_id, start, ids)``: the ids at positions ``start`` to ``end`` (exclusive) of the whole sequence.

    One row per document with ids there; ``ids`` are cut to the span and ``start`` is
    the position of their first.  Row groups and pages outside the span are not
    read.  Positions that are not there give no rows.
    """
    stored, start = _stored(spark, folder), max(0, start)
    bases = _bases(stored)
    # The shards in which the span begins and ends.
    low = bases.where(F.col("_base") <= start).orderBy(F.desc("_base")).first()
    high = bases.where(F.col("_base") < end).orderBy(F.desc("_base")).first()
    shard, place = F.col("shard"), F.col("local_start")
    if low is None or high is None or end <= start:
        return _placed(stored.where("false"), bases).select("doc_id", "start", "ids")
    opening = stored.where((shard == low["shard"]) & (place <= start - low["_base"])).agg(F.max(place)).first()[0]
    within = (
        shard.between(low["shard"], high["shard"])
        & ((shard > low["shard"]) | (place >= opening))
        & ((shard < high["shard"]) | (place < end - high["_base"]))
    )
    first, after = F.greatest(F.col("start"), F.lit(start)), F.col("start") + F.col("n_tokens")
    return (
        _placed(stored.where(within), bases)
        .where(after > start)
        .select(
            "doc_id",
            first.alias("start"),
            F.slice("ids", (first - F.col("start") + 1).cast("int"), (F.least(after, F.lit(end)) - first).cast("int")).alias("ids"),
        )
    )


def checksums(stored: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: unsigned CRC-32 of the ids as little-endian 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            flat = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            ends = (ids.offsets.to_numpy() * 4).tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return stored.mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
