"""Spelling variants: words that differ by one letter, grouped around the frequent ones, by a frequency-vector trie.

A word's vector counts its letters by group.  Words are the leaves of a trie whose levels are
the groups in a fixed order and whose branches are counts.  One inserted, deleted or
replaced letter adds one to at most one count and takes one from at most one, so a word's
neighbours are found by a depth-first search that may leave the word's own counts by one
up and one down, once each; the words of the leaves it reaches are verified letter by letter.

The upper levels of the trie are rows of Spark tables: words are counted by the first
``BLOCK`` counts, in nodes that have more than ``SHARD`` words by twice as many, and so on; searches
walk down the same steps, by joins with the nodes there are.  Each node that is small enough is then searched as a
trie of its own in one task, with its searches in groups of about ``SEARCHES``.  A leaf with more words than ``SHARD``
is dealt into several by hash.  So tasks are bounded whatever words are alike.

A word's form is its most frequent neighbour (ties: the least in code-point order) if that is
``RATIO`` times as frequent at least.  Its root is where forms lead; frequencies grow along
them, so there are no circles and few steps.  Rows without text have no words, and rows without ``doc_id``
an empty id.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import storage

LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One in so many occurrences by checksum loses a letter.
DAMAGE = 199
RUN = r"[A-Za-zÀ-ÿ]+"

#: Letters of a group, the groups in the order of the trie's levels; letters beyond a-z fall in by code.
GROUPS = ("e", "a", "i", "n", "r", "s", "t", "o", "l", "u", "dj", "ck", "mq", "hx", "pwg", "bfvyz")
LEVELS = len(GROUPS)
#: Counts above are equal; the difference of two counts does not grow by that.
MOST = 60
#: Levels of the upper trie that a step goes down.
BLOCK = 4
#: Words of a node that is searched in one task, and searches in a task.
SHARD, SEARCHES = 1 << 15, 1 << 16
#: Searches that go down a trie together.
TOGETHER = 1 << 13
#: Words counted before they leave a task.
HELD = 200_000
#: Longer words are compared one by one, so that no table is as wide as the longest word.
WIDE = 48

_GROUP = np.arange(256) % LEVELS
for _k, _letters in enumerate(GROUPS):
    _GROUP[[ord(x) for x in _letters]] = _k


def occurrences(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all runs of letters, A-Z in lower case, after the damage by checksum."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(RUN).findall, Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                runs: Counter = Counter()
                for run, n in Counter(find(text.as_py() or "")).items():
                    # In Latin-1 every letter is one byte, and lower() knows A-Z alone.
                    runs[run.encode("latin-1").lower()] += n
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % DAMAGE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= LETTERS:
                        total[run] += n
                if len(total) >= HELD:
                    yield out(total)
                    total.clear()
        yield out(total)

    def out(total: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(rows, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Words as bytes one after the other."""

    def __init__(self, words: list[str]) -> None:
        self.words = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self._table: np.ndarray | None = None

    def vectors(self) -> np.ndarray:
        """Letters by group and word, at most ``MOST``."""
        owner = np.repeat(np.arange(len(self.words)), self.size)
        group = _GROUP[np.frombuffer(b"".join(self.words), np.uint8)]
        counts = np.bincount(owner * LEVELS + group, minlength=len(self.words) * LEVELS)
        return np.minimum(counts, MOST).astype(np.int8).reshape(-1, LEVELS)

    def table(self) -> np.ndarray:
        """The first ``WIDE`` bytes of each word, a row each."""
        if self._table is None:
            padded = b"".join(w[:WIDE].ljust(WIDE, b"\0") for w in self.words)
            self._table = np.frombuffer(padded, np.uint8).reshape(-1, WIDE)
        return self._table


def one_edit(short: bytes, long: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter turns one into the other, ``short`` not being longer."""
    n, same = len(short), 0
    while same < n and short[same] == long[same]:
        same += 1
    if len(long) == n:
        return same < n and short[same + 1 :] == long[same + 1 :]
    return len(long) == n + 1 and short[same:] == long[same + 1 :]


def verified(one: Letters, a: np.ndarray, two: Letters, b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``one[a]``, ``two[b]`` are one edit apart."""
    n, m = one.size[a], two.size[b]
    fits = np.zeros(len(a), dtype=bool)
    wide = np.maximum(n, m) > WIDE
    for k in np.flatnonzero(wide & (abs(n - m) <= 1)).tolist():
        fits[k] = one_edit(*sorted((one.words[a[k]], two.words[b[k]]), key=len))
    equal = np.flatnonzero(~wide & (n == m))
    fits[equal] = (one.table()[a[equal]] != two.table()[b[equal]]).sum(1) == 1
    for step, (x, i, y, j) in ((1, (one, a, two, b)), (-1, (two, b, one, a))):
        at = np.flatnonzero(~wide & (m - n == step))
        short, long = x.table()[i[at]], y.table()[j[at]]
        alike = np.logical_and.accumulate(short == long, 1).sum(1)
        # Behind the inserted letter all are moved by one.
        moved = np.logical_and.accumulate((short[:, :-1] == long[:, 1:])[:, ::-1], 1).sum(1)
        fits[at] = alike + moved + 1 >= WIDE
    return fits


class Trie:
    """Words by successive counts, searched by many words at once."""

    def __init__(self, words: Letters) -> None:
        vectors = words.vectors()
        self.words, self.order = words, np.lexsort(vectors.T[::-1])
        self.vectors = vectors[self.order]
        change = np.ones((len(self.order), LEVELS), dtype=bool)
        change[1:] = np.logical_or.accumulate(self.vectors[1:] != self.vectors[:-1], 1)
        self.change = change

    def _children(self, low: int, high: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of the node ``[low, high)`` start, and where they end."""
        starts = low + np.flatnonzero(self.change[low:high, level])
        if not len(starts) or starts[0] != low:
            starts = np.concatenate([[low], starts])
        return starts, np.append(starts[1:], high)

    def search(self, queries: Letters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query and a word that are one edit apart, some at a time."""
        vectors = queries.vectors()
        for first in range(0, len(vectors), TOGETHER):
            alive = np.arange(first, min(first + TOGETHER, len(vectors)))
            yield from self._below(queries, vectors, alive)

    def _below(self, queries: Letters, vectors: np.ndarray, alive: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.ones(len(alive), dtype=bool)
        # Depth first; a node's searches with what they may still go up and down.
        todo = [(0, len(self.order), 0, alive, left, left)]
        while todo:
            low, high, level, alive, up, down = todo.pop()
            if level == LEVELS or len(alive) * (high - low) <= TOGETHER:
                pairs = self._leaves(vectors, low, high, level, alive, up, down)
                a, b = pairs[0], self.order[pairs[1]]
                fits = verified(queries, a, self.words, b)
                if fits.any():
                    yield a[fits], b[fits]
                continue
            for start, end in zip(*(x.tolist() for x in self._children(low, high, level))):
                more = self.vectors[start, level] - vectors[alive, level]
                here = np.flatnonzero((more == 0) | (more == 1) & up | (more == -1) & down)
                if len(here):
                    todo.append((start, end, level + 1, alive[here], up[here] & (more[here] != 1), down[here] & (more[here] != -1)))

    def _leaves(
        self, vectors: np.ndarray, low: int, high: int, level: int, alive: np.ndarray, up: np.ndarray, down: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of searches and words of a small node that stay within what may be spent on the levels left."""
        a, b = np.repeat(np.arange(len(alive)), high - low), np.tile(np.arange(low, high), len(alive))
        if level < LEVELS:
            more = self.vectors[b, level:] - vectors[alive[a], level:]
            fits = (np.maximum(more, 0).sum(1) <= up[a]) & (np.maximum(-more, 0).sum(1) <= down[a])
            a, b = a[fits], b[fits]
        return alive[a], b


def vectors_column(words: DataFrame) -> DataFrame:
    """``words`` with ``vector``: the counts by group as a string of one character each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Letters(batch["word"].to_pylist()).vectors() + ord("0")).astype(np.uint8).tobytes().decode()
            vectors = [counts[k : k + LEVELS] for k in range(0, len(counts), LEVELS)]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(vectors, pa.string())], names=["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(rows, "word string, n bigint, vector string")


def _ways() -> list[tuple[str, int, int]]:
    """Changes of ``BLOCK`` counts that go up once and down once at most: as digits from 0 (one down) to 2, ups, downs."""
    found = []
    for up in range(-1, BLOCK):
        for down in range(-1, BLOCK):
            if up != down or up == -1:
                digits = ["1"] * BLOCK
                if up >= 0:
                    digits[up] = "2"
                if down >= 0:
                    digits[down] = "0"
                found.append(("".join(digits), int(up >= 0), int(down >= 0)))
    return found


def _moved(depth: int) -> str:
    """SQL of the next ``BLOCK`` counts of ``vector`` below ``depth``, changed by ``way.digits``."""
    counts = (
        f"char(ascii(substring(vector, {depth + k + 1}, 1)) + ascii(substring(way.digits, {k + 1}, 1)) - 49)"
        for k in range(BLOCK)
    )
    return f"concat({', '.join(counts)})"


def shards(words: DataFrame, size: int = SHARD, searches: int = SEARCHES) -> tuple[DataFrame, DataFrame]:
    """``(node, part, group, word, n)`` and ``(node, part, group, word)``: what each task searches, and for what.

    ``part`` tells the words of a divided leaf apart, ``group`` the searches of a node.
    """
    ways = ", ".join(f"named_struct('digits', '{d}', 'up', {u}, 'down', {n})" for d, u, n in _ways())
    rest = words
    probes = words.select("word", "vector", F.lit("").alias("node"), F.lit(1).alias("up"), F.lit(1).alias("down"))
    kept, sought = [], []
    for depth in range(0, LEVELS, BLOCK):
        last = depth + BLOCK >= LEVELS
        node = F.substring("vector", 1, depth + BLOCK)
        nodes = storage.written(rest.groupBy(node.alias("node")).agg(F.count("*").alias("size")))
        small = nodes if last else nodes.where(F.col("size") <= size)
        parts = F.ceil(F.col("size") / size).cast("int")
        named = rest.withColumn("node", node)
        kept.append(named.join(small.select("node", parts.alias("parts")), "node").select("node", "parts", "word", "n"))
        probes = (
            probes.withColumn("way", F.explode(F.expr(f"array({ways})")))
            .where("way.up <= up AND way.down <= down")
            .select(
                "word",
                "vector",
                F.concat("node", F.expr(_moved(depth))).alias("node"),
                (F.col("up") - F.col("way.up")).alias("up"),
                (F.col("down") - F.col("way.down")).alias("down"),
            )
            .join(nodes.select("node", (F.lit(last) | (F.col("size") <= size)).alias("small"), parts.alias("parts")), "node")
        )
        probes = storage.written(probes)
        sought.append(probes.where("small").select("node", "parts", "word"))
        large = nodes.where(F.col("size") > size)
        if last or large.isEmpty():
            break
        rest = storage.written(named.join(large.select("node"), "node", "left_semi").select("word", "n", "vector"))
        probes = probes.where("NOT small").drop("small", "parts")
    held, asked = kept[0], sought[0]
    for more in kept[1:]:
        held = held.unionAll(more)
    for more in sought[1:]:
        asked = asked.unionAll(more)
    groups = asked.groupBy("node").agg(F.ceil(F.count("*") / searches).cast("int").alias("groups"))
    dealt = lambda c: F.pmod(F.xxhash64("word"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = held.withColumn("part", dealt("parts")).join(groups, "node").withColumn("group", every("groups"))
    asked = asked.join(groups, "node").withColumn("group", dealt("groups")).withColumn("part", every("parts"))
    return held.select("node", "part", "group", "word", "n"), asked.select("node", "part", "group", "word")


def neighbours(words: DataFrame, size: int = SHARD, searches: int = SEARCHES) -> DataFrame:
    """``(word, n_near, near_n, near)``: how many words are one edit away, and the most frequent of them."""
    held, asked = shards(storage.written(vectors_column(words)), size, searches)
    both = held.withColumn("sought", F.lit(False)).unionAll(
        asked.select("node", "part", "group", "word", F.lit(0).cast("long").alias("n"), F.lit(True).alias("sought"))
    )

    names = ["word", "n_near", "near_n", "near"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def search(rows: pa.Table) -> pa.Table:
        asks = rows["sought"].to_numpy()
        word, n = np.array(rows["word"].to_pylist(), object), rows["n"].to_numpy()[~asks]
        there, queries = word[~asks], word[asks]
        found = []
        if len(there) and len(queries):
            found = list(Trie(Letters(there.tolist())).search(Letters(queries.tolist())))
        if not found:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        a, b = (np.concatenate(x) for x in zip(*found))
        # For each query its words, the most frequent first, ties in code-point order.
        place = np.argsort(np.argsort(there, kind="stable"), kind="stable")
        order = np.lexsort((place[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        columns = queries[a[first]], np.diff(np.append(first, len(a))), n[b[first]], there[b[first]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    each = both.groupBy("node", "part", "group").applyInArrow(search, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.less")).alias("near_n"), F.col("_best.near").alias("near")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: where the forms of each word lead, by doubling steps."""
    state = storage.written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = storage.written(state.join(further, "root", "left").select("word", "root", "_further"))
        if moved.where("_further IS NOT NULL").isEmpty():
            return state
        state = moved.select("word", F.coalesce("_further", "root").alias("root"))


def variants(
    docs: DataFrame, at_least: int = OCCURRENCES, size: int = SHARD, searches: int = SEARCHES
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words of ``docs`` with ``at_least`` occurrences."""
    words = storage.written(occurrences(docs).where(F.col("n") >= at_least))
    near = storage.written(
        words.join(neighbours(words, size, searches), "word", "left").withColumn(
            "form", F.when(F.col("near_n") >= RATIO * F.col("n"), F.col("near"))
        )
    )
    found = roots(near.where("form IS NOT NULL"))
    return near.join(found, "word", "left").select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"),
    )
