"""Word counts over documents ``(doc_id, text)``, and word-length statistics.

All counting methods give the same ``(word, n)`` on documents without blanks
at their edges; they differ in how the work is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.functions.uniform import salt


def words(docs: DataFrame) -> DataFrame:
    """``(doc_id, word)``, one row per occurrence; blank documents have none."""
    visible = docs.where(T.has_visible(F.col("text")))
    return visible.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word"))


def doc_term_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, word, n)``: how often each word occurs in each document.

    A document's tokens are sorted within its row; a run of equal ones ends
    where the next differs.  Nothing is shuffled.
    """
    ordered, ends = F.col("ordered"), F.col("ends")

    def mark(word: Column, at: Column) -> Column:
        """Position after a run's last token, 0 inside the run."""
        return F.when(word.eqNullSafe(F.get(ordered, at + 1)), F.lit(0)).otherwise(at + 1)

    runs = (
        docs.where(T.has_visible(F.col("text")))
        .select("doc_id", F.sort_array(T.tokens(F.col("text"))).alias("ordered"))
        .withColumn("marks", F.transform(ordered, mark))
        .withColumn("ends", F.filter("marks", lambda at: at > 0))
    )
    counted = F.transform(
        ends,
        lambda end, at: F.struct(
            F.get(ordered, end - 1).alias("word"),
            (end - F.coalesce(F.get(ends, at - 1), F.lit(0))).cast("bigint").alias("n"),
        ),
    )
    return runs.select("doc_id", F.inline(counted))


def _count(occurrences: DataFrame, first_by: Column | None = None) -> DataFrame:
    """Counts by word; with ``first_by``, in two rounds, first per (``first_by``, word)."""
    if first_by is None:
        return occurrences.groupBy("word").agg(F.count("*").alias("n"))
    first = occurrences.groupBy(first_by.alias("part"), "word").agg(F.count("*").alias("n"))
    return first.groupBy("word").agg(F.sum("n").alias("n"))


def _plain(docs: DataFrame, parts: int) -> DataFrame:
    """Partial counts before the only shuffle: a frequent word arrives once per task."""
    return _count(words(docs))


def _salted(docs: DataFrame, parts: int) -> DataFrame:
    """Two rounds: a word's input partitions are dealt to ``parts`` keys, then added up.

    An input partition has one key, so a word leaves a task once, as in the plain count.
    """
    return _count(words(docs), salt(parts, F.spark_partition_id()))


def _partitioned(docs: DataFrame, parts: int) -> DataFrame:
    """Per input partition, then per word; what is shuffled is one row per word and partition."""
    return _count(words(docs), F.spark_partition_id())


def _partition_salted(docs: DataFrame, parts: int) -> DataFrame:
    """Per input partition, then dealt to ``parts`` keys, then per word.

    An input partition gives a word one key, so the partial aggregation of the
    first round is the count per partition and needs no shuffle of its own.
    """
    return _count(words(docs), salt(parts, F.spark_partition_id(), F.col("word")))


def merged_words(docs: DataFrame, parts: int) -> DataFrame:
    """``(doc_id, word)`` as if each part's documents were one text.

    Part ``doc_id mod parts`` joins its documents with a space in the order of
    their ids and trims the ends of the result.  So only the outer blanks of
    its first and last visible documents vanish, and every other empty piece
    counts.  Knowing those two ids per part gives the tokens of the joined
    text without building it in any task.

    Documents without an id have no place in a part's order, so each of them is a
    text of its own.
    """
    text, blanks = F.col("text"), F.lit(T.BLANKS)
    alone = docs.where(F.col("doc_id").isNull() & T.has_visible(text)).select("doc_id", F.trim(text, blanks).alias("text"))
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod("doc_id", F.lit(parts)).alias("part"))
    ends = (
        docs.where(T.has_visible(F.col("text")))
        .groupBy("part")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    )
    text = F.when(F.col("doc_id") == F.col("first"), F.ltrim(text, blanks)).otherwise(text)
    text = F.when(F.col("doc_id") == F.col("last"), F.rtrim(text, blanks)).otherwise(text)
    # ``ends`` has at most ``parts`` rows: small enough to broadcast up to here.
    placed = docs.join(F.broadcast(ends) if parts <= 100_000 else ends, "part")
    inside = placed.where(F.col("doc_id").between(F.col("first"), F.col("last"))).select("doc_id", text.alias("text"))
    return inside.unionByName(alone).select("doc_id", F.explode(T.split_keeping_empty(F.col("text"))).alias("word"))


def _merged(docs: DataFrame, parts: int) -> DataFrame:
    """Counts of ``merged_words``, in two rounds."""
    return _count(merged_words(docs, parts), salt(parts, F.spark_partition_id()))


METHODS = {
    "plain": _plain,
    "salted": _salted,
    "partitioned": _partitioned,
    "partition_salted": _partition_salted,
    "merged": _merged,
}


def word_count(docs: DataFrame, method: str = "plain", parts: int = 16) -> DataFrame:
    """``(word, n)`` by one of ``METHODS``; ``parts`` is the number of random keys."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}, not {method!r}")
    if parts < 1:
        raise ValueError("parts must be at least 1")
    return METHODS[method](docs, parts)


def corpus_size(docs: DataFrame) -> DataFrame:
    """``(documents, distinct_words)``; each distinct word is one row of the count."""
    n_docs = docs.agg(F.count("*").alias("documents")).scalar()
    return word_count(docs).agg(
        n_docs.alias("documents"), F.count("*").alias("distinct_words")
    )


def statistics(counts: DataFrame) -> DataFrame:
    """``(distinct_words, avg_length, avg_all, avg_distinct)`` of a word count, in one pass.

    ``avg_length`` is ``avg_distinct``, the mean length of the distinct words,
    cut to an integer; ``avg_all`` is the mean over all occurrences.
    """
    length = T.utf16_length(F.col("word")).cast("bigint")
    sums = counts.agg(
        F.count("*").alias("distinct_words"),
        F.sum(length).alias("chars"),
        F.sum(length * F.col("n")).alias("all_chars"),
        F.sum("n").alias("occurrences"),
    )
    return sums.select(
        "distinct_words",
        F.expr("CASE WHEN distinct_words > 0 THEN chars div distinct_words END").alias(
            "avg_length"
        ),
        F.try_divide("all_chars", "occurrences").alias("avg_all"),
        F.try_divide("chars", "distinct_words").alias("avg_distinct"),
    )


def average_length_truncated(counts: DataFrame) -> DataFrame:
    """``(avg_length)``: average length of the distinct words, cut to an integer."""
    return statistics(counts).select("avg_length")


def average_lengths(counts: DataFrame) -> DataFrame:
    """``(avg_all, avg_distinct)``: over all occurrences, and over distinct words."""
    return statistics(counts).select("avg_all", "avg_distinct")
