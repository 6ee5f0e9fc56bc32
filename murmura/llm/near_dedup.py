"""Groups of near-duplicate texts by HyperMinHash, with exact verification.

A text is the set of its runs of five words (A-Z in lower case).  Each register of its
signature keeps the smallest hash of the set under one function, compressed to
the number of leading zeros and ten mantissa bits.  Registers are banded; texts
sharing a band are compared with the band's pivot only, the member that shares most
bands, and a pair goes on if its Jaccard estimate, corrected for accidental
collisions of compressed registers, is not clearly too low.  Links are
confirmed on the full sets.

In bands whose members are not connected yet, the largest component is settled,
and further pivots drawn from it meet the members outside, a row each in every
round.  Those still outside are then compared, with each other and with the settled ones, in blocks of bounded size by longer sketches, so that
no band's pairs are ever listed.  What is copied into blocks grows with the
band times the number of blocks of members outside; a group whose members are
all alike but mostly below the threshold has many.

Texts with equal sets take part once.  A text without words is linked with
nothing.  Rows of one ``doc_id`` are one document; rows without ``doc_id`` join the
group of an equal set, and link nothing.  A pair at the threshold is missed by all
bands with a probability of about 1e-5, less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmura.llm import storage, wordhash
from murmura.llm.components import components

PERCENT = 75
REGISTERS = 128
ROWS, BANDS = 5, 60
MANTISSA = 10
#: An estimate this many standard deviations below the threshold is given up.
DEVIATIONS = 5.5
#: Registers of the longer sketches in blocks, of which the low byte is kept.
SKETCH = 1024
#: Members of a band in a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Settled members in a block; each of them meets few.
SETTLED_BLOCK = 2048
#: Further pivots at most for bands that are not connected.
PIVOT_ROUNDS = 3
#: Up to so many ids (16 MB) are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_random = np.random.Generator(np.random.PCG64(8))
_TURN = _random.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.array([_random.choice(REGISTERS, ROWS, replace=False) for _ in range(BANDS)])
_BAND_TURN = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """Leading zeros (6 bits) and mantissa (10 bits) of the smallest hash under each function."""
    turns, least = _TURN[:count], np.full(count, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 19) // count)
    with np.errstate(over="ignore"):
        for first in range(0, len(shingles), step):
            np.minimum(least, (shingles[first : first + step, None] * turns).min(0), out=least)
        # 53 bits fit a float exactly; fewer than 53 zeros lead in practice, 53 stand for more.
        zeros = (53 - np.frexp((least >> np.uint64(11)).astype(float))[1]).astype(np.uint64)
        mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def accidental(n: np.ndarray, m: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Probability that registers of disjoint sets of ``n`` and ``m`` elements agree.

    The smallest hashes are about exponential; within an octave of width
    ``2**-z`` a register covers ``2**-(z + mantissa)``.
    """
    total, octaves = n + m, 2.0 ** -np.arange(0, 54)[:, None]
    inside = np.exp(-total * octaves / 2) - np.exp(-total * octaves)
    return (n * m / total * inside * octaves / 2).sum(0) * 2.0**-mantissa


def estimate(agreeing: np.ndarray, n: np.ndarray, m: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, less accidental collisions."""
    by_chance = accidental(n, m, mantissa)
    return (agreeing - by_chance) / (1 - by_chance)


def lowest(count: int, percent: int = PERCENT) -> float:
    """The least estimate from ``count`` registers that still speaks for a link."""
    t = percent / 100
    return t - DEVIATIONS * (t * (1 - t) / count) ** 0.5


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in wordhash.slices(column):
        hashes, _, bounds = wordhash.words(data, offsets)
        for k in range(end - first):
            yield np.unique(wordhash.shingles(hashes[bounds[k] : bounds[k + 1]]))


def _text_hash() -> Column:
    return F.md5(F.coalesce("text", F.lit(""))).alias("_text")


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, _text, n_shingles, h1, h2, registers)``; the two hashes stand for the set, ``_text`` for the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in _sets(batch["text"]):
                with np.errstate(over="ignore"):
                    sums = s.sum(dtype=np.uint64), wordhash.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                h1, h2 = np.array(sums, np.uint64).view(np.int64).tolist()
                out.append((len(s), h1, h2, registers(s).tobytes() if len(s) else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    batch["_text"],
                    *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)),
                ],
                names=["doc_id", "_text", "n_shingles", "h1", "h2", "registers"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash()).mapInArrow(
        rows, "doc_id bigint, _text string, n_shingles bigint, h1 bigint, h2 bigint, registers binary"
    )


def bands(signatures: DataFrame) -> DataFrame:
    """``(key, id)``: the bands of each signature, hashed to 64 bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                own = np.frombuffer(b"".join(part["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
                with np.errstate(over="ignore"):
                    keys = ((own[:, _BAND].astype(np.uint64) + np.uint64(1)) * _BAND_TURN).sum(2, dtype=np.uint64)
                ids = np.repeat(part["id"].to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wordhash.mixed(keys).view(np.int64).ravel()), pa.array(ids)], names=["key", "id"]
                )

    return signatures.select("id", "registers").mapInArrow(rows, "key bigint, id bigint")


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``id`` is among the distinct ``ids``."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, set)`` of the documents in ``ids``: sorted 64-bit hashes of their shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s.tobytes() for s in _sets(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.binary())], names=["id", "set"])

    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return _picked(named, ids).mapInArrow(rows, "id bigint, set binary")


def likely(pairs: DataFrame, signatures: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` whose corrected estimate does not speak against a link."""
    least = lowest(REGISTERS, percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r1", "r2"))
            n, m = (batch[c].to_numpy().astype(float) for c in ("n1", "n2"))
            fits = estimate((one == two).mean(1), n, m) >= least
            # A set must have three quarters of the other's elements at least.
            fits &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    side = lambda id_, n: signatures.select(
        F.col("id").alias(id_), F.col("registers").alias(f"r{n}"), F.col("n_shingles").alias(f"n{n}")
    )
    return pairs.join(side("a", 1), "a").join(side("b", 2), "b").mapInArrow(rows, "a bigint, b bigint")


def linked(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    short, long_ = sorted((one, two), key=len)
    place = np.minimum(np.searchsorted(long_, short), len(long_) - 1)
    shared = int((long_[place] == short).sum())
    return 100 * shared >= percent * (len(short) + len(long_) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` that the full sets confirm."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [
                linked(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64), percent)
                for one, two in zip(batch["s1"].to_pylist(), batch["s2"].to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    side = lambda id_, n: sets.select(F.col("id").alias(id_), F.col("set").alias(f"s{n}"))
    return pairs.join(side("a", 1), "a").join(side("b", 2), "b").mapInArrow(rows, "a bigint, b bigint")


def _pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    return rows.where(F.col(one) != F.col(two)).select(
        F.least(one, two).alias("a"), F.greatest(one, two).alias("b")
    ).distinct()


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Each member of a band with the band's pivot, the member whose bands are largest."""
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    top = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", -F.col("id"))).alias("top"))
    pivots = top.select("key", (-F.col("top")["col2"]).alias("pivot"))
    return _pairs(members.join(pivots, "key"), "id", "pivot")


def open_bands(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``(key, id, component, settled)`` of bands whose members ``joined`` does not connect; written.

    Members of a band's largest component are settled: they need not meet each other.
    """
    labelled = _labelled(members, joined)
    several = _largest(labelled)
    return storage.written(
        labelled.join(several, "key").select("key", "id", "component", (F.col("component") == F.col("largest")).alias("settled"))
    )


def _labelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``(key, id, component)`` of bands of more than two."""
    return members.where("size > 2").join(joined, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )


def _largest(labelled: DataFrame, *more: Column | str) -> DataFrame:
    """``(key, largest)``, the largest component of each band that has several, of equal ones the least.

    ``more`` may be an aggregate over the component's members, and its name.
    """
    own, names = more[:1], more[1:]
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), *own)
    tops = parts.groupBy("key").agg(
        F.max(F.struct("n", (-F.col("component")).alias("less"), *names)).alias("top"), F.count("*").alias("parts")
    )
    return tops.where("parts > 1").select("key", (-F.col("top.less")).alias("largest"), *[F.col(f"top.{x}") for x in names])


def pivot_rounds(
    members: DataFrame, joined: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """``joined`` after further pivots: in each open band a settled member, drawn anew, meets those that are not.

    A round has one row for each of them, and they meet as many pivots as they have bands.
    """
    for turn in range(PIVOT_ROUNDS):
        labelled = _labelled(members, joined)
        drawn = F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("draw"), "id"))
        tops = _largest(labelled, drawn.alias("drawn"), "drawn").select("key", "largest", F.col("drawn.id").alias("pivot"))
        outside = labelled.join(tops, (labelled["key"] == tops["key"]) & (F.col("component") != F.col("largest")))
        pairs = _pairs(outside.select("id", "pivot"), "id", "pivot")
        found = storage.written(confirmed(likely(pairs, signatures, percent), sets, percent))
        if found.isEmpty():
            break
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(found))
    return joined


def tiles(members: DataFrame, joined: DataFrame, sets: DataFrame) -> DataFrame:
    """``(key, id, component, settled, block, tile)``: in which tiles of an open band each of its members meets others.

    Members that are not settled are dealt into blocks by hash, which all meet each
    other, and meet the settled ones in larger blocks.  So what is copied grows with the
    band times the blocks of those that are not settled.
    """
    opened = open_bands(members, joined)
    sizes = sets.select("id", (F.octet_length("set") / 8).cast("long").alias("n"))
    loose = ~F.col("settled")
    # Bands with the same members need one look.
    bands = (
        opened.join(sizes, "id")
        .groupBy("key")
        .agg(
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"),
            F.count("*").alias("size"),
            F.sum("n").alias("elements"),
            F.count_if(loose).alias("others"),
            F.sum(F.when(loose, F.col("n")).otherwise(0)).alias("other_elements"),
        )
        .groupBy("who", "size", "elements")
        .agg(F.min(F.struct("key", "others", "other_elements")).alias("band"))
    )
    blocks = bands.select(
        "band.key",
        F.expr(
            f"CAST(greatest(ceil(band.others / {BLOCK}), ceil(band.other_elements * 8 / {BLOCK_BYTES})) AS int)"
        ).alias("blocks"),
        F.expr(
            f"""CAST(greatest(ceil((size - band.others) / {SETTLED_BLOCK}),
                              ceil((elements - band.other_elements) * 8 / {BLOCK_BYTES})) AS int)"""
        ).alias("settled_blocks"),
    )
    rest = opened.join(blocks, "key").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(F.col("settled"), F.col("settled_blocks")).otherwise(F.col("blocks"))).cast("int")
    )
    where = F.expr(
        """CASE WHEN settled THEN transform(sequence(0, blocks - 1), o -> struct(true AS settled, o AS i, block AS j))
           ELSE concat(transform(sequence(0, blocks - 1), o -> struct(false AS settled, least(block, o) AS i, greatest(block, o) AS j)),
                       transform(sequence(0, settled_blocks - 1), s -> struct(true AS settled, block AS i, s AS j))) END"""
    )
    return rest.select("key", "id", "component", "settled", "block", F.explode(where).alias("tile"))


def block_links(members: DataFrame, joined: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``(a, b)`` between members of a band that ``joined`` does not connect yet.

    Each of the ``tiles`` is one row, of bounded size, compared there: by sketches first,
    then by the full sets.  Pairs that the row has connected meanwhile are passed over.
    """
    dealt = storage.written(tiles(members, joined, sets))
    gathered = (
        dealt.join(_picked(sets, dealt.select("id").distinct()), "id")
        .groupBy("key", "tile")
        .agg(F.collect_list(F.struct("id", "component", "settled", "block", "set")).alias("members"))
        .select("tile.settled", "tile.i", "tile.j", "members")
    )
    least = lowest(SKETCH, percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            for across, i, j, members in zip(*(batch[c].to_pylist() for c in ("settled", "i", "j")), batch["members"]):
                members = members.values
                ids, component, block = (members.field(c).to_numpy() for c in ("id", "component", "block"))
                settled = members.field("settled").to_numpy(zero_copy_only=False)
                full = [np.frombuffer(x, np.uint64) for x in members.field("set").to_pylist()]
                n, component = np.array([len(x) for x in full]), component.copy()
                if len(drawn) > 50_000:
                    drawn.clear()
                for id_, x in zip(ids.tolist(), full):
                    if id_ not in drawn:
                        drawn[id_] = (registers(x, SKETCH) & 0xFF).astype(np.uint8)
                sketch = np.array([drawn[x] for x in ids.tolist()])
                a, b = [], []
                # Settled ones meet the others; two blocks of others each other; a block itself.
                one = ~settled if across else block == i
                two = settled if across else block == j
                for k in np.flatnonzero(one).tolist():
                    with_ = two & (component != component[k])
                    if not across and i == j:
                        with_ &= ids > ids[k]
                    with_ &= 100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])
                    with_ = np.flatnonzero(with_)
                    alike = (sketch[with_] == sketch[k]).mean(1) if len(with_) else np.zeros(0)
                    # Bytes of different hashes agree once in 256.
                    for other in with_[(alike - 1 / 256) / (1 - 1 / 256) >= least].tolist():
                        if component[other] != component[k] and linked(full[k], full[other], percent):
                            a.append(int(ids[k]))
                            b.append(int(ids[other]))
                            component[component == component[other]] = component[k]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return gathered.mapInArrow(rows, "a bigint, b bigint")


def _marked(docs: DataFrame, percent: int) -> DataFrame:
    """``(doc_id, _text, n_shingles, component_id, kept)``; see ``near_duplicates``."""
    signed = storage.written(signatures(docs))
    same = ["h1", "h2", "n_shingles"]
    equal = storage.written(signed.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("id")))
    standing = equal.where("id IS NOT NULL")
    own = storage.written(
        signed.withColumn("id", F.col("doc_id")).join(standing, ["id", *same], "left_semi").dropDuplicates(["id", *same])
    )
    banded = bands(own)
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = storage.written(banded.join(shared.hint("shuffle_hash"), "key"))
    sets = storage.written(full_sets(docs, members.select("id").distinct()))
    first = storage.written(confirmed(likely(pivot_pairs(members), own, percent), sets, percent))
    joined = pivot_rounds(members, components(first), own, sets, percent)
    later = block_links(members, joined, sets, percent)
    # A document with several texts connects what they are linked with.
    placed = signed.where("doc_id IS NOT NULL").join(equal, same).select("doc_id", "id")
    several = placed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_b")).where("a <> _b")
    tied = placed.join(several, "doc_id").select("a", F.col("id").alias("b"))
    stars = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
    groups = components(stars.unionAll(later).unionAll(tied))
    named = equal.join(groups, "id", "left").select(*same, F.coalesce("component", "id").alias("_component"))
    return signed.join(named, same, "left").select(
        "doc_id",
        "_text",
        "n_shingles",
        F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("_component", "doc_id"), F.col("_component").isNull()).alias("kept"),
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links; ``kept``
    tells the one document of each group that stays.
    """
    return _marked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, by id and text.

    Rows without an id go where a document with an id has an equal set, and stay elsewhere.
    """
    kept = _marked(docs, percent).where("kept").select(F.col("doc_id").alias("_staying"), F.col("_text").alias("_same")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("_doc"), _text_hash())
    same = F.col("_doc").eqNullSafe(F.col("_staying")) & (F.col("_text") == F.col("_same"))
    return rows.join(kept.hint("shuffle_hash"), same, "left_semi").select("_row.*")
