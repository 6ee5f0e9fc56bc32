"""Web archives: pages written as WARC records and read back as one nested row per capture.

A capture has three records, tied by ``WARC-Concurrent-To``: the request, the
response (or a revisit of an equal payload captured elsewhere), and metadata.
Archives are written by Spark's text writer, a record per row with the two
line ends that close a record as separator, and gzipped as a whole; they can be read
wherever Spark reads.  Reading cuts at the version line, so a task holds one record
at a time; a payload that contains a version line is put together again by its
``Content-Length``.

Of captures with equal payloads of at least ``LEAST_REVISIT`` bytes the one
with the largest ``page_id`` is the response, the others revisit it; repeated
rows with that id are all responses.  NULL payloads are empty, NULL ids stay
NULL and never are what others refer to.  White space and control characters in a URL
become ``%20``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import storage

LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
VERSION, CLOSE = "WARC/1.1\r\n", "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(name: Column) -> Column:
    """A record id made from ``name``; equal names give equal ids."""
    x = F.md5(name)
    cuts = [F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(block: Column, **fields: Column | str | None) -> Column:
    """The record without the line ends that close it; NULL fields are left out."""
    headers = [
        F.when(value.isNotNull(), F.concat(F.lit(name.replace("_", "-") + ": "), value, F.lit("\r\n"))).otherwise("")
        for name, value in ((n, v if isinstance(v, Column) else F.lit(v)) for n, v in fields.items())
    ]
    length = F.octet_length(block).cast("string")
    return F.concat(F.lit(VERSION), *headers, F.lit("Content-Length: "), length, F.lit("\r\n\r\n"), block)


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(page_id, url, payload, digest, payload_bytes, content, original)``.

    ``original`` is the page a revisit refers to, NULL for responses.
    ``content`` tells payloads apart; groups of one need no partner.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "digest": F.sha1("payload"),
            "content": F.sha2("payload", 256),
        }
    )
    groups = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("content")
        .agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n"))
        .where("_n > 1 AND _largest IS NOT NULL")
        .select("content", "_largest")
    )
    return rows.join(groups.hint("shuffle_hash"), "content", "left").select(
        *rows.columns,
        F.when(
            F.col("page_id").isNull() | (F.col("page_id") < F.col("_largest")), F.col("_largest")
        ).alias("original"),
    )


def records(pages: DataFrame, date: str = DATE, least: int = LEAST_REVISIT) -> DataFrame:
    """``(value)``: three records per page."""
    rows = deduplicated(pages, least).withColumns(
        {
            "uri": F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F\x85]", "%20"),
            # The request's id ties the capture.  It may be drawn anew when a task
            # is run again, as all three records come from the same row.
            "request": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")),
        }
    )
    revisit = F.col("original").isNotNull()
    name = lambda page: F.concat_ws("/", F.lit("response"), page.cast("string"), "content")
    http = F.concat(F.lit(_HTTP), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = {"WARC_Date": date, "WARC_Target_URI": F.col("uri")}
    fields = F.concat(
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
        F.when(revisit, F.concat(F.lit("refersToPage: "), F.col("original").cast("string"), F.lit("\r\n"))).otherwise(""),
    )
    request = _record(
        F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")),
        WARC_Type="request",
        WARC_Record_ID=F.col("request"),
        Content_Type="application/http;msgtype=request",
        **common,
    )
    response = _record(
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
        WARC_Type=F.when(revisit, "revisit").otherwise("response"),
        WARC_Record_ID=F.when(revisit, _urn(F.concat(F.lit("revisit/"), F.col("request")))).otherwise(
            _urn(name(F.col("page_id")))
        ),
        WARC_Concurrent_To=F.col("request"),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
        WARC_Profile=F.when(revisit, _PROFILE),
        WARC_Refers_To=F.when(revisit, _urn(name(F.col("original")))),
        Content_Type="application/http;msgtype=response",
        **common,
    )
    metadata = _record(
        fields,
        WARC_Type="metadata",
        WARC_Record_ID=_urn(F.concat(F.lit("metadata/"), F.col("request"))),
        WARC_Concurrent_To=F.col("request"),
        Content_Type="application/warc-fields",
        **common,
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE, least: int = LEAST_REVISIT) -> None:
    records(pages, date, least).write.option("lineSep", CLOSE).option("compression", "gzip").text(folder)


_RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, digest string, block binary"
_NAMES = {
    b"warc-type": "type",
    b"warc-record-id": "record_id",
    b"warc-concurrent-to": "concurrent_to",
    b"warc-refers-to": "refers_to",
    b"warc-target-uri": "target_uri",
    b"warc-date": "date",
    b"warc-payload-digest": "digest",
}
_COLUMNS = [*_NAMES.values(), "block"]
_BATCH_BYTES = 8 << 20


def _parsed(record: bytes) -> dict | None:
    """The fields and block of a record, or None while bytes of its block are missing."""
    head, found, rest = record.partition(CLOSE.encode())
    if not found:
        return None
    fields: dict = dict.fromkeys(_COLUMNS) | {"concurrent_to": []}
    length = None
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            length = int(value)
        elif name.lower() == b"warc-concurrent-to":  # the one field that may be repeated
            fields["concurrent_to"].append(value.strip().decode())
        elif name.lower() in _NAMES:
            fields[_NAMES[name.lower()]] = value.strip().decode()
    if length is None:
        raise ValueError("a record without Content-Length")
    if len(rest) < length + len(CLOSE):
        return None
    fields["block"] = rest[:length]
    return fields


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives below ``folder``, in no order."""
    kinds = [pa.list_(pa.string()) if c == "concurrent_to" else pa.string() for c in _COLUMNS[:-1]] + [pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, file, open_ = [], 0, None, None

        def batch_of(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in out], k) for c, k in zip(_COLUMNS, kinds)], names=_COLUMNS
            )

        for batch in batches:
            for path, piece in zip(batch["file"].to_pylist(), batch["value"].to_pylist()):
                if path != file:
                    if open_ is not None:
                        raise ValueError(f"{file} ends within a record")
                    file, open_ = path, None
                    if piece == b"":  # what stands before the first version line
                        continue
                # A version line inside a block has cut it; the list is joined once it is long enough.
                open_ = [piece] if open_ is None else [*open_, piece]
                record = _parsed(VERSION.encode().join(open_))
                if record is not None:
                    open_ = None
                    out.append(record)
                    size += len(record["block"])
                    if size > _BATCH_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
        if open_ is not None:
            raise ValueError(f"{file} ends within a record")
        yield batch_of(out)

    pieces = spark.read.option("lineSep", VERSION).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")
    )
    return pieces.mapInArrow(rows, _RECORD)


def _ids(capture: str) -> list[Column]:
    """A row for each id that a record has or names, beside ``capture``."""
    return [F.explode(F.array_distinct(F.concat(F.array("record_id"), "concurrent_to"))).alias("id"), F.col(capture)]


def _first(ties: DataFrame) -> DataFrame:
    """``(id, capture)``: one capture for each id, of several the least."""
    return ties.where("id IS NOT NULL AND capture IS NOT NULL").groupBy("id").agg(F.min("capture").alias("capture"))


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``(capture, page_id, refers_to_page, request, response, metadata)``, one row per response or revisit.

    Concurrent-to may stand in either record and be repeated.  A capture has the id that
    its response names first, or else the response's own.  Requests belong to it that the response
    names or that name it; metadata likewise, or through such a request.  Of several
    requests that with the least id is taken, ``metadata`` is a list by ids, and the page ids are the first
    that it gives.  What is missing is NULL or an empty list.  ``response`` is a struct with the record's type, ids, digest, the payload
    (NULL for revisits) and the payload's size.
    """
    stored = storage.written(read_records(spark, folder), compression="zstd")
    of = lambda *kinds: stored.where(F.col("type").isin(*kinds))
    text = F.col("block").cast("string")
    body = F.expr("substring(block, position(X'0D0A0D0A' IN block) + 4)")
    said = F.regexp_extract(F.substring_index(text, CLOSE, 1), r"(?i)\r\ncontent-length: *(\d+)", 1)
    own = F.coalesce(F.get("concurrent_to", 0), "record_id").alias("capture")
    named = of("response", "revisit").select("record_id", "concurrent_to", own)
    responses = of("response", "revisit").select(
        own,
        F.struct(
            "type",
            "record_id",
            "refers_to",
            F.substring_index("digest", ":", -1).alias("digest"),
            F.when(F.col("type") == "response", body).alias("payload"),
            said.try_cast("long").alias("payload_bytes"),
        ).alias("response"),
    )
    known = storage.written(_first(named.select(*_ids("capture"))))
    asked = of("request").select(
        F.struct("record_id", "target_uri", "date").alias("request"), "record_id", "concurrent_to"
    )
    tied = storage.written(asked.select(*_ids("request"), "record_id", "concurrent_to").join(known, "id"))
    requests = tied.groupBy("capture").agg(F.min("request").alias("request"))
    through = _first(known.unionAll(tied.select(*_ids("capture"))))
    field = lambda name: F.regexp_extract(text, rf"(?:^|\n){name}: *(-?\d+)", 1)
    number = lambda name: F.when(field(name) != "", field(name)).cast("long")
    described = of("metadata").select(
        F.struct(
            "record_id", text.alias("fields"), number("pageId").alias("page"), number("refersToPage").alias("refers")
        ).alias("said"),
        "record_id",
        "concurrent_to",
    )
    metadata = (
        described.select(*_ids("said"))
        .join(through, "id")
        .groupBy("capture")
        .agg(F.sort_array(F.collect_set("said")).alias("_said"))
    )
    given = lambda name: F.get(
        F.filter(F.transform("_said", lambda x: x[name]), lambda x: x.isNotNull()), F.lit(0)
    )
    listed = F.transform("_said", lambda x: F.struct(x["record_id"].alias("record_id"), x["fields"].alias("fields")))
    none = F.array().cast("array<struct<record_id:string,fields:string>>")
    return responses.join(requests, "capture", "left").join(metadata, "capture", "left").select(
        "capture",
        given("page").alias("page_id"),
        given("refers").alias("refers_to_page"),
        "request",
        "response",
        F.coalesce(listed, none).alias("metadata"),
    )
