"""Removal of lines that an earlier document has already, with levelled sorted runs of line hashes.

The hashes of all lines seen so far lie in sorted runs.  A new batch of
documents is merge-anti-joined with the runs: keys it shares with them belong
to earlier documents, the others become a run of level 0.  When a level has
``FANOUT`` runs they are merged into one run of the next, so a batch meets a
number of runs that grows with the logarithm of the batches.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of fewer than ``LEAST`` code points never count.  Documents are ordered
by ``doc_id``; rows without one count as one document after all others, and
rows with the same id as one document.  NULL texts are one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import storage
from murmura.llm.quality import WHITE

LEAST = 10
FANOUT = 3
BATCHES = 4

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Texts in which lower() changes nothing but A-Z.
_PLAIN = r"^[\x00-\x7F\p{Ll}\p{Lo}\p{Mn}\p{Nd}\p{P}\p{Z}]*$"
_HASHES = ("_h1", "_h2")


def line_key(line: Column) -> Column:
    """``line`` stripped, A-Z in lower case and no other letter changed."""
    stripped = F.btrim(line, F.lit(WHITE))
    return F.when(stripped.rlike(_PLAIN), F.lower(stripped)).otherwise(
        F.translate(stripped, _UPPER, _SMALL)
    )


def _order() -> Column:
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long")


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with what tells its rows apart: the document's place and a hash of the text."""
    return docs.withColumns({"_doc": _order(), "_text": F.xxhash64("text")})


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(_doc, _text, _place, _h1, _h2)`` per line that counts; the two hashes make 128 bits."""
    lines = _identified(docs).select(
        "_doc", "_text", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_place", "_line")
    )
    # A key is never longer than its line, so short lines need no key.
    keys = lines.where(F.length("_line") >= LEAST).select("_doc", "_text", "_place", line_key(F.col("_line")).alias("_key"))
    return keys.where(F.length("_key") >= LEAST).select(
        "_doc",
        "_text",
        "_place",
        F.xxhash64("_key").alias("_h1"),
        F.xxhash64(F.lit(7), "_key").alias("_h2"),
    )


class LineRuns:
    """Hashes of the lines of all batches added so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark = spark
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def _run(self, hashes: DataFrame) -> DataFrame:
        # Sorted within its partitions, for the merges that read it.
        return storage.written(hashes.repartition(*_HASHES).sortWithinPartitions(*_HASHES))

    def seen(self) -> DataFrame | None:
        """``(_h1, _h2)`` of every run; no hash is in two."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        found = runs[0]
        for run in runs[1:]:
            found = found.unionAll(run)
        return found

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the batch ``lines`` of ``line_hashes``; returns its owners ``(_h1, _h2, _owner)``.

        The owner is the batch's smallest document with that line, and NULL
        where an earlier batch has it.
        """
        owners = lines.groupBy(*_HASHES).agg(F.min("_doc").alias("_owner"))
        seen = self.seen()
        if seen is None:
            owners = storage.written(owners)
            fresh = owners
        else:
            known = seen.withColumn("_known", F.lit(True))
            owners = storage.written(
                owners.join(known, [*_HASHES], "left").select(
                    *_HASHES, F.when(F.col("_known").isNull(), F.col("_owner")).alias("_owner")
                )
            )
            fresh = owners.where(F.col("_owner").isNotNull())
        self._place(fresh.select(*_HASHES), 0)
        return owners

    def _place(self, hashes: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._run(hashes) if level or len(self.levels[0]) + 1 < self.fanout else hashes)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = runs[0]
            for run in runs[1:]:
                merged = merged.unionAll(run)
            self._place(merged, level + 1)


def dropped_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``(_doc, _text, _drop)``: per document that loses lines the places of those lines."""
    spark = docs.sparkSession
    shares = [k / batches for k in range(1, batches)]
    lines = line_hashes(docs)
    bounds = docs.select(F.percentile_approx(_order(), shares, 10_000)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    number = F.lit(0)
    for bound in bounds:
        number = number + (F.col("_doc") > bound).cast("int")
    lines = storage.written(lines.withColumn("_batch", number))
    runs = LineRuns(spark, fanout)
    drops = None
    for batch in range(len(bounds) + 1):
        own = lines.where(F.col("_batch") == batch).drop("_batch")
        owners = runs.add(own)
        lost = own.join(owners, [*_HASHES]).where(
            F.col("_owner").isNull() | (F.col("_doc") > F.col("_owner"))
        )
        lost = lost.select("_doc", "_text", "_place")
        drops = lost if drops is None else drops.unionAll(lost)
    return drops.groupBy("_doc", "_text").agg(F.collect_set("_place").alias("_drop"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, ``n_lines`` before dropping and ``n_dropped``.

    A document that loses every line keeps an empty text.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = _identified(docs.select(*rest, "text"))
    drops = dropped_lines(docs, batches, fanout).hint("shuffle_hash")
    joined = rows.join(drops, ["_doc", "_text"], "left").withColumn(
        "_lines", F.split(F.coalesce("text", F.lit("")), "\n")
    )
    kept = F.expr(
        "array_join(transform(array_except(sequence(0, size(_lines) - 1), _drop), p -> _lines[p]), '\n')"
    )
    return joined.select(
        *rest,
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
