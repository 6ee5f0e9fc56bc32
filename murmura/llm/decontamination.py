"""Passages of benchmark items in documents.

For each item size there are windows of that many words over every document.
A window's SimHash (64 bits over its words) is looked up in an index of the
items' fingerprints: cut into one block more than the radius, two fingerprints within
the radius agree in a block, so the index finds all of them.  The radius follows from the
sizes of window and item (``radius``), so that a passage at the threshold is missed about
once in ``1 / MISSED``.  Candidates are
verified by the weighted Jaccard similarity of their five-word shingles, each
weighing as often as it occurs.  A document shorter than an item is one window.

Windows that cannot reach the similarity are not fingerprinted: at least
``PERCENT`` of their shingles must be an item's, hence as many of their word pairs.

NULL and empty texts and items match nothing.  Repeated documents and items are
matched one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm import storage, wordhash

PERCENT = 75
#: Share of passages at the threshold whose fingerprint may lie beyond the radius.
MISSED = 1e-4
#: A fingerprint may differ by so many bits whatever the sizes.
LEAST_RADIUS = 15
#: Characters of items that go to the tasks at once; more take several passes over the documents.
PASS_CHARS = 16 << 20
#: Pairs of windows and items that are compared at once.
PAIRS = 1 << 20



@lru_cache(1 << 14)
def radius(length: int, size: int, percent: int = PERCENT) -> int:
    """Bits in which fingerprints of a window and an item of so many words may differ.

    What is alike has at least ``percent`` in a hundred and percent of the shingles of both, and
    most words differ where those lie together.  A bit is a majority of random signs; two of
    correlation r differ with probability ``acos(r) / pi``.
    """
    if min(length, size) < wordhash.WIDTH:
        return LEAST_RADIUS
    less = wordhash.WIDTH - 1
    shared = math.ceil(percent * (length + size - 2 * less) / (100 + percent)) + less
    differs = math.acos(min(1.0, shared / math.sqrt(length * size))) / math.pi
    beyond, bits = 1.0, -1
    while beyond > MISSED and bits < 63:
        bits += 1
        beyond -= math.comb(64, bits) * differs**bits * (1 - differs) ** (64 - bits)
    return max(bits, LEAST_RADIUS)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The bits that a majority of the ``length`` words from each start sets."""
    found = []
    for first in range(0, len(starts), 1024):
        words = hashes[starts[first : first + 1024, None] + np.arange(length)]
        bits = np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")
        majority = 2 * bits.sum(1, dtype=np.int32) > length
        found.append(np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate([np.zeros(0, np.uint64), *found])


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    a, n = np.unique(one, return_counts=True)
    b, m = np.unique(two, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(one) + len(two) - shared)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wordhash.mixed(hashes[:-1] * np.uint64(3) + hashes[1:])


def _running(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running counts of the ``values`` that are in the sorted array ``among``, from none on."""
    if not len(among):
        return np.zeros(len(values) + 1, np.int32)
    # Most values are not there; their upper bits show that cheaply.
    seen = np.zeros(1 << 20, bool)
    seen[among >> np.uint64(44)] = True
    maybe = np.flatnonzero(seen[values >> np.uint64(44)])
    place = np.minimum(np.searchsorted(among, values[maybe]), len(among) - 1)
    known = np.zeros(len(values), np.int32)
    known[maybe] = among[place] == values[maybe]
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(known, dtype=np.int32)])


class Blocks:
    """Fingerprints of items of one size, sorted by each of ``radius + 1`` blocks of their bits."""

    def __init__(self, prints: np.ndarray, places: np.ndarray, radius: int) -> None:
        self.prints, self.places, self.radius = prints, places, radius
        self.bounds = np.linspace(0, 64, radius + 2).astype(int)
        self.sorted = []
        for low, high in zip(self.bounds, self.bounds[1:]):
            block = self._block(prints, low, high)
            order = np.argsort(block, kind="stable")
            self.sorted.append((block[order], order))

    @staticmethod
    def _block(prints: np.ndarray, low: int, high: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(which of prints, item)`` for all pairs within the radius."""
        step = max(1, PAIRS // max(1, len(self.prints)))
        for first in range(0, len(prints), step):
            found = self._near(prints[first : first + step])
            yield from ((first + int(x) // len(self.places), int(self.places[x % len(self.places)])) for x in found)

    def _near(self, prints: np.ndarray) -> np.ndarray:
        found = []
        for (values, order), low, high in zip(self.sorted, self.bounds, self.bounds[1:]):
            block = self._block(prints, low, high)
            first, end = (np.searchsorted(values, block, side) for side in ("left", "right"))
            counts = end - first
            which = np.repeat(np.arange(len(prints)), counts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            item = order[first[which] + nth]
            close = np.bitwise_count(prints[which] ^ self.prints[item]) <= self.radius
            found.append(which[close] * len(self.places) + item[close])
        return np.unique(np.concatenate(found))


class Index:
    """Items by size and by the blocks of their fingerprints."""

    def __init__(self, ids: list, texts: list[str], percent: int = PERCENT) -> None:
        self.percent = percent
        self.ids, self.shingles, prints, words, pairs = [], [], [], [], [np.zeros(0, np.uint64)]
        for first, end, data, offsets in wordhash.slices(pa.array(texts, pa.string())):
            hashes, _, bounds = wordhash.words(data, offsets)
            for k in range(end - first):
                own = hashes[bounds[k] : bounds[k + 1]]
                if len(own):
                    self.ids.append(ids[first + k])
                    self.shingles.append(wordhash.shingles(own))
                    words.append(len(own))
                    prints.append(fingerprints(own, np.zeros(1, int), len(own))[0])
                    pairs.append(_pairs(own))
        self.pairs = np.unique(np.concatenate(pairs))
        self.all_shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
        sizes, prints = np.array(words, int), np.array(prints, np.uint64)
        self.sizes = {int(size): (prints[sizes == size], np.flatnonzero(sizes == size)) for size in np.unique(sizes)}
        self._blocks: dict[tuple[int, int], Blocks] = {}

    def blocks(self, length: int, size: int) -> Blocks:
        """The items of ``size`` words for windows of ``length``."""
        key = size, radius(length, size, self.percent)
        if key not in self._blocks:
            self._blocks[key] = Blocks(*self.sizes[size], key[1])
        return self._blocks[key]

    def _enough(self, length: int) -> int:
        """Shingles of a window that must be the item's, where ``length`` words have several."""
        return -(-self.percent * max(0, length - wordhash.WIDTH + 1) // 100)

    def _windows(
        self, bounds: np.ndarray, counts: np.ndarray, shared: np.ndarray, room: np.ndarray, size: int
    ) -> list[tuple[np.ndarray, int]]:
        """``(starts, length)`` of windows of ``size`` words, or of whole shorter texts, with enough known pairs and shingles.

        ``counts`` and ``shared`` are running sums of these, ``room`` the words from each on to the end of its text.
        """
        # The pairs that an item's shingles begin with are the item's.
        found = []
        if (n := len(room) - size + 1) > 0:
            known = counts[size - 1 : size - 1 + n] - counts[:n]
            found.append((np.flatnonzero((known >= self._enough(size)) & (room[:n] >= size)), size))
        lengths = np.diff(bounds)
        short = (lengths > 0) & (lengths < size) & (100 * lengths >= self.percent * size - 500)
        for length in np.unique(lengths[short]).tolist():
            starts = bounds[:-1][short & (lengths == length)]
            known = counts[starts + length - 1] - counts[starts]
            found.append((starts[known >= self._enough(length)], length))
        enough = []
        for starts, length in found:
            if length >= wordhash.WIDTH:
                known = shared[starts + length - wordhash.WIDTH + 1] - shared[starts]
                starts = starts[known >= self._enough(length)]
            if len(starts):
                enough.append((starts, length))
        return enough

    def of_column(self, column: pa.Array) -> Iterator[dict[int, tuple[float, int, int]]]:
        """For each text, by item: similarity, first word and words of its best window, the first of equals."""
        for first, end, data, offsets in wordhash.slices(column):
            hashes, _, bounds = wordhash.words(data, offsets)
            best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(end - first)]
            if len(hashes) and self.sizes:
                counts = _running(self.pairs, _pairs(hashes))
                whole = wordhash.shingles(hashes)
                shared = _running(self.all_shingles, whole)
                texts = np.repeat(np.arange(end - first), np.diff(bounds))
                room = bounds[texts + 1] - np.arange(len(hashes))
                for size in self.sizes:
                    for starts, length in self._windows(bounds, counts, shared, room, size):
                        for which, item in self.blocks(length, size).near(fingerprints(hashes, starts, length)):
                            start = int(starts[which])
                            if length < wordhash.WIDTH:
                                own = wordhash.shingles(hashes[start : start + length])
                            else:
                                own = whole[start : start + length - wordhash.WIDTH + 1]
                            alike = similarity(own, self.shingles[item])
                            found = best[texts[start]]
                            if 100 * alike >= self.percent and alike > found.get(item, (0,))[0]:
                                found[item] = (alike, start - int(bounds[texts[start]]), length)
            yield from best


def indexes(items: DataFrame, percent: int = PERCENT) -> Iterator[tuple[Index, bool]]:
    """The items in parts of bounded size, each as an index to send to the tasks, and whether it is the last.

    A pass is to be written before the next index is asked for, so that the driver holds one.
    """
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = total // PASS_CHARS + 1
    for number in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        part.sort(key=lambda x: (x["item_id"] is None, x["item_id"], x["text"]))
        yield Index([x["item_id"] for x in part], [x["text"] for x in part], percent), number == passes - 1


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: the best window per document and item found in it."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for index, last in indexes(items, percent):

        def rows(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    (doc_id, index.ids[place], *match)
                    for doc_id, matches in zip(batch["doc_id"].to_pylist(), index.of_column(batch["text"]))
                    for place, match in sorted(matches.items())
                ]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = list(zip(*out)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        part = named.mapInArrow(
            rows, "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"
        )
        part = part if last else storage.written(part)
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    for index, last in indexes(items, percent):

        def rows(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in index.of_column(batch["text"])], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
        docs = docs if last else storage.written(docs)
    return docs
