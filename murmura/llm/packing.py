"""Packing of documents' tokens into sequences of bounded length, by configurations.

Only the histogram of piece lengths, at most ``capacity`` numbers, decides how
sequences are composed: a configuration is a multiset of lengths that fits
one.  The linear program "fewest configurations covering the histogram" is
solved by multiplicative weights: lengths still badly covered weigh more, a
knapsack by dynamic programming finds the configurations worth most, steps are as
wide as their scarcest length allows, and so on until every length is covered to
``1 - TOLERANCE``.  The solution is rounded, and the program solved again for what is
left, until that is at most ``REST`` of the tokens.  The rest is packed best fit,
longest first, on the histogram too.  Pieces then find their sequence by their rank
among pieces of the same length, without meeting each other.

NULL texts count as empty; a document always has its end id, so it has a
piece.  Repeated rows are packed one by one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.llm import storage, tokens

CAPACITY = 2048
END_ID = 0
#: Steps in which a length is covered, times lengths: the fewer lengths, the smaller the steps.
STEPS = 5_000
FEWEST, MOST = 5, 200
#: Every length is covered by the program but for this part.
TOLERANCE = 0.02
#: At most this part of the tokens is left to best fit.
REST = 0.03

Pattern = tuple[tuple[int, int], ...]
"""``(length, how many)`` of a sequence, longest first."""


def knapsacks(
    worth: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int
) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For each room up to ``capacity``, what a filling can be worth and one such filling.

    A filling lists places in ``lengths`` (ascending) and how many of each, a place
    possibly several times, at most ``most`` in all.
    """
    chunks = []
    for k in np.flatnonzero(worth > 0)[::-1].tolist():
        left, count = min(int(most[k]), capacity // int(lengths[k])), 1
        while left:
            count = min(count, left)
            chunks.append((k, count))
            left, count = left - count, 2 * count
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(chunks), capacity + 1), bool)
    for row, (k, count) in zip(taken, chunks):
        size = int(lengths[k]) * count
        more = best[:-size] + worth[k] * count
        np.greater(more, best[size:] * (1 + 1e-12), out=row[size:])
        np.copyto(best[size:], more, where=row[size:])
    room = np.arange(capacity + 1)
    found: list[list[tuple[int, int]]] = [[] for _ in room]
    for row, (k, count) in zip(taken[::-1], chunks[::-1]):
        those = np.flatnonzero(row[room])
        room[those] -= int(lengths[k]) * count
        for place in those.tolist():
            found[place].append((k, count))
    return best, found


def fractional(histogram: dict[int, int], capacity: int, steps: int | None = None) -> dict[Pattern, float]:
    """Configurations with amounts that cover each length of ``histogram`` to ``1 - TOLERANCE`` at least, none beyond 1.

    Every round takes up its best configuration, which covers ``1 / steps`` of a
    length or all that it lacks: there are at most ``steps + 1`` rounds per length.
    """
    lengths = np.array(sorted(histogram))
    steps = steps or min(MOST, max(FEWEST, STEPS // len(lengths)))
    # Smaller steps go with weights that tell more, and with configurations nearer to the best.
    rate = math.sqrt(steps / FEWEST)
    slack = 1 / math.sqrt(steps * FEWEST)
    sizes, needed = lengths.tolist(), [float(histogram[x]) for x in lengths.tolist()]
    covered = np.zeros(len(lengths))
    amounts: dict[Pattern, float] = {}
    while (covered < 1 - TOLERANCE).any():
        # Worth per token, so that weights steer and lengths do not.
        worth = np.where(covered < 1, np.exp(-rate * covered), 0.0) * lengths
        best, fillings = knapsacks(worth, lengths, np.array(needed), capacity)
        enough, worths, shares = (1 - slack) * best[-1], worth.tolist(), covered.tolist()
        # The best configuration, then the best with each length, as long as they
        # are still worth enough: worths only fall, so ``best`` bounds them from above.
        with_one = worth + best[capacity - lengths]
        places = np.argsort(-with_one, kind="stable")
        places = places[(covered < 1)[places] & (with_one[places] >= enough)].tolist()
        for place in (None, *places):
            found: Counter = Counter() if place is None else Counter({place: 1})
            for k, count in fillings[capacity if place is None else capacity - sizes[place]]:
                found[k] += count
            if sum(worths[k] * n for k, n in found.items()) < enough:
                continue
            if any(n > needed[k] or not worths[k] for k, n in found.items()):
                continue
            share = min(min(1 / steps, 1 - shares[k]) * needed[k] / n for k, n in found.items())
            pattern = tuple((sizes[k], found[k]) for k in sorted(found, reverse=True))
            amounts[pattern] = amounts.get(pattern, 0.0) + share
            for k, n in found.items():
                shares[k] += share * n / needed[k]
                if shares[k] > 1 - 1e-9:
                    shares[k] = 1.0
                worths[k] = sizes[k] * math.exp(-rate * shares[k]) if shares[k] < 1 else 0.0
        covered = np.array(shares)
    return amounts


def rounded(amounts: dict[Pattern, float], histogram: dict[int, int]) -> tuple[Counter, dict[int, int]]:
    """Whole configurations, as far as pieces suffice, and the pieces left over.

    Amounts are rounded down, then up where the pieces of all lengths allow it,
    largest fractions first.
    """
    left, chosen = dict(histogram), Counter()
    down = [(p, int(x)) for p, x in sorted(amounts.items(), key=lambda x: (-x[1], x[0]))]
    up = [(p, 1) for p, _ in sorted(amounts.items(), key=lambda x: (-(x[1] % 1), x[0]))]
    for pattern, amount in down + up:
        times = min([amount, *(left[length] // count for length, count in pattern)])
        if times:
            chosen[pattern] += times
            for length, count in pattern:
                left[length] -= times * count
    return chosen, {length: n for length, n in left.items() if n}


def program(histogram: dict[int, int], capacity: int, steps: int | None = None) -> tuple[Counter, dict[int, int]]:
    """Whole configurations by the program, solved again for what rounding leaves, and at most ``REST`` of the tokens left over."""
    tokens_ = lambda x: sum(length * n for length, n in x.items())
    chosen, left, most = Counter(), histogram, REST * tokens_(histogram)
    while left and tokens_(left) > most:
        # The first configuration rounded up always fits, as none asks for more than there is.
        found, left = rounded(fractional(left, capacity, steps), left)
        chosen += found
    return chosen, left


def best_fit(histogram: dict[int, int], capacity: int, begun: Counter = Counter()) -> Counter:
    """``begun`` and what else it takes, filled by best fit, longest first; equal sequences are filled together."""
    open_: dict[int, dict[Pattern, int]] = {}  # by room left
    for pattern, times in begun.items():
        open_.setdefault(capacity - sum(a * n for a, n in pattern), {})[pattern] = times
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((x for x in open_ if x >= length), default=None)
            if room is None:
                fill = capacity // length
                whole, rest = divmod(left, fill)
                for times, count in ((whole, fill), (1, rest)):
                    if times and count:
                        group = open_.setdefault(capacity - count * length, {})
                        key = ((length, count),)
                        group[key] = group.get(key, 0) + times
                break
            pattern, times = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            fill = min(room // length, left)
            used = min(times, left // fill)
            if used < times:
                open_.setdefault(room, {})[pattern] = times - used
            group = open_.setdefault(room - fill * length, {})
            key = (*pattern, (length, fill))
            group[key] = group.get(key, 0) + used
            left -= fill * used
    return Counter({p: n for group in open_.values() for p, n in group.items()})


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int | None = None) -> Counter:
    """Whole configurations that hold exactly the pieces of ``histogram``."""
    histogram = {length: n for length, n in histogram.items() if n}
    if not histogram:
        return Counter()
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError(f"a piece must have 1 to {capacity} tokens")
    chosen, left = program(histogram, capacity, steps)
    return best_fit(left, capacity, chosen)


def slots(patterns: Counter) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: arrays sorted by length and first rank.

    A sequence has at most ``sqrt(2 capacity)`` different lengths and patterns
    are few, so the arrays do not grow with the pieces.
    """
    rows, first, rank = [], 0, Counter()
    for pattern, times in sorted(patterns.items(), reverse=True):
        offset = 0
        for length, count in pattern:
            rows.append((length, rank[length], count, first, offset))
            rank[length] += times * count
            offset += length * count
        first += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "count", "sequence", "offset"), columns))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids, local_rank)``: documents cut where they are too long.

    ``ids`` are little-endian unsigned 32-bit integers.  ``local_rank`` counts
    earlier pieces of the same length in the same partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in tokens.parts(batch):
                out: list[tuple] = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"])):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        out.append((doc_id, piece, a, b - a, ids[4 * a : 4 * b], ranks[b - a]))
                        ranks[b - a] += 1
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids", "local_rank"],
                )
        tokens.released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id bigint, piece int, start bigint, length bigint, ids binary, local_rank bigint"
    )


def placed(ranked: DataFrame, patterns: Counter) -> DataFrame:
    """``ranked`` with ``sequence_id`` and ``offset`` for its columns ``length`` and ``rank``."""
    table = slots(patterns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One number per slot: its length, then its first rank.
        keys = (table["length"] << 48) | table["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            slot = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            copy, nth = np.divmod(rank - table["rank"][slot], table["count"][slot])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(table["sequence"][slot] + copy),
                    pa.array(table["offset"][slot] + nth * length),
                ],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in ranked.dtypes)
    return ranked.mapInArrow(rows, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``, one row per piece."""
    cut = pieces(docs, tokenizer, capacity, end_id).withColumn("shard", F.spark_partition_id())
    cut = storage.written(cut, compression="zstd")
    counts = cut.groupBy("shard", "length").agg(F.count("*").alias("n"))
    counts = storage.written(counts)
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    # One row per shard in each window.
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["shard", "length"]).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("base") + F.col("local_rank")).alias("rank"),
    )
    return placed(ranked, plan(histogram, capacity)).drop("rank")
