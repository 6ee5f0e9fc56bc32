"""Archives by other writers: concurrent-to in either record, repeated, or missing."""

from __future__ import annotations

import pytest

from murmura.llm import storage, warc


def record(kind, id_, *concurrent, block="", **fields):
    heads = {"WARC-Type": kind, "WARC-Record-ID": id_, **fields}
    lines = [f"{k}: {v}" for k, v in heads.items() if v is not None]
    lines += [f"WARC-Concurrent-To: {x}" for x in concurrent]
    return "WARC/1.1\r\n" + "".join(f"{x}\r\n" for x in lines) + f"Content-Length: {len(block.encode())}\r\n\r\n{block}"


def http(body):
    return f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n{body}"


def read(spark, records, files=2):
    folder = storage.shared_folder(spark)
    frame = spark.createDataFrame([(r,) for r in records], "value string").repartition(files)
    frame.write.option("lineSep", warc.CLOSE).text(folder)
    return {bytes(r.response.payload or b"").decode() if r.response.payload is not None else r.response.record_id: r for r in warc.read_captures(spark, folder).collect()}


@pytest.mark.parametrize("files", [1, 4])
def test_captures_of_other_archives(spark, files):
    records = [
        # The response names its request, metadata names the request.
        record("request", "q1"), record("response", "r1", "q1", block=http("one")), record("metadata", "m1", "q1", block="pageId: 1\r\n"),
        # The request and metadata name the response; two metadata records.
        record("request", "q2", "r2"), record("response", "r2", block=http("two")),
        record("metadata", "m2", "r2", block="x: y\r\n"), record("metadata", "m3", "r2", block="pageId: 2\r\nrefersToPage: 9\r\n"),
        # No request; no metadata; neither.
        record("response", "r3", block=http("three")), record("metadata", "m4", "r3", block="pageId: 3\r\n"),
        record("request", "q4", "r4"), record("response", "r4", block=http("four")),
        record("response", "r5", block=http("five")),
        # Everything is named by the response, in repeated fields.
        record("response", "r6", "m6", "q6", block=http("six")), record("request", "q6"), record("metadata", "m6", block="pageId: 6\r\n"),
        # Metadata through a request that names the response, and named by a request.
        record("request", "q7", "r7"), record("response", "r7", block=http("seven")), record("metadata", "m7", "q7", block="pageId: 7\r\n"),
        record("request", "q8", "r8", "m8"), record("response", "r8", block=http("eight")), record("metadata", "m8", block="pageId: 8\r\n"),
        # A revisit, records that belong to none, a response without an id.
        record("revisit", "r9", "q9", block=http("")), record("request", "q9"), record("warcinfo", "w"), record("metadata", "lost", "nowhere", block="pageId: 5\r\n"),
        record("response", None, block=http("ten")),
    ]
    got = read(spark, records, files)
    rows = {
        name: (r.page_id, r.refers_to_page, r.request and r.request.record_id, [m.record_id for m in r.metadata]) for name, r in got.items()
    }
    assert rows == {
        "one": (1, None, "q1", ["m1"]),
        "two": (2, 9, "q2", ["m2", "m3"]),
        "three": (3, None, None, ["m4"]),
        "four": (None, None, "q4", []),
        "five": (None, None, None, []),
        "six": (6, None, "q6", ["m6"]),
        "seven": (7, None, "q7", ["m7"]),
        "eight": (8, None, "q8", ["m8"]),
        "r9": (None, None, "q9", []),
        "ten": (None, None, None, []),
    }


def test_one_row_for_each_response(spark):
    """Responses of one id, and two that name one request, are rows of their own."""
    records = [record("response", "r", "q", block=http("a")), record("response", "r", "q", block=http("b")), record("request", "q"), record("metadata", "m", "q", block="pageId: 4\r\n")]
    assert {k: (r.page_id, r.request.record_id) for k, r in read(spark, records).items()} == {"a": (4, "q"), "b": (4, "q")}
