"""Numpy on Arrow batches: the arithmetic inside the clustering tasks.

Each kernel sees one partition as a stream of record batches and keeps only
the centers and one running result per run, so its memory does not depend on
the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks receive these functions by value, so executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]

# Rows compared at once, and cells of the matrix of their distances, so that
# intermediate results stay in the cache and bounded for any number of centers.
TILE_ROWS = 4096
# Clusters that a silhouette passes over together.
TOGETHER = 8
TILE_CELLS = 2_000_000

# Increment and multipliers of the splitmix64 generator.
INCREMENT = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(states: np.ndarray, steps: int) -> np.ndarray:
    """The generator's output ``steps`` increments after each state."""
    z = states + np.uint64(steps * INCREMENT % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MULTIPLIERS[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MULTIPLIERS[1])
    return z ^ (z >> np.uint64(31))


def draws(states: np.ndarray, seed: int) -> Callable[[int], np.ndarray]:
    """One number in (0, 1] per row for any turn, fixed by row state, seed and turn."""
    own = _mixed(states, seed)
    return lambda turn: ((_mixed(own, turn + 1) >> np.uint64(12)) + np.float64(1)) / 2.0**52


def _states(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("state").to_numpy(zero_copy_only=False).astype(np.uint64)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as the rows of a matrix of doubles; all must have ``width`` coordinates.

    Without a width that of the first vector counts.
    """
    if len(column) == 0:
        return np.empty((0, width or 0))
    lengths = pc.min_max(column.value_lengths()).as_py()
    width = lengths["min"] if width is None else width
    if column.null_count or not lengths["min"] == lengths["max"] == width:
        raise ValueError("a vector is missing or of another length")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a coordinate is missing")
    flat = flat.to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), width)


def vectors(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    width = rows.shape[1] if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(rows, dtype=np.float64).ravel())


def square_distance(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.einsum("ij,ij->i", gap, gap)


def _nearest_one_by_one(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    which = np.zeros(len(points), dtype=np.int32)
    best = np.full(len(points), np.inf)
    for index, center in enumerate(centers):
        distance = np.sqrt(square_distance(points, center))
        closer = distance < best
        which[closer] = index
        best[closer] = distance[closer]
    return which


def _nearest_in_tile(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """As one by one, through a matrix product.

    The product gives squared distances up to ``slack``.  A row with a single
    center that close to its minimum is settled; others are compared exactly.
    """
    middle = centers.mean(axis=0)
    moved, targets = points - middle, centers - middle
    own = np.einsum("ij,ij->i", moved, moved)
    theirs = np.einsum("ij,ij->i", targets, targets)
    squares = own[:, None] - 2.0 * (moved @ targets.T) + theirs
    which = squares.argmin(axis=1).astype(np.int32)
    reach = (np.sqrt(own) + np.sqrt(theirs.max())) ** 2
    slack = 8.0 * (points.shape[1] + 8) * np.finfo(np.float64).eps * reach
    least = squares[np.arange(len(points)), which]
    open_rows = np.flatnonzero((squares <= (least + slack)[:, None]).sum(axis=1) != 1)
    if len(open_rows):
        which[open_rows] = _nearest_one_by_one(points[open_rows], centers)
    return which


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the closest center, the first of equal ones, and the distance to it."""
    which = np.zeros(len(points), dtype=np.int32)
    if len(centers) > 1:
        pick = _nearest_in_tile if len(centers) > 2 else _nearest_one_by_one
        rows = max(1, min(TILE_ROWS, TILE_CELLS // len(centers)))
        for start in range(0, len(points), rows):
            which[start : start + rows] = pick(points[start : start + rows], centers)
    gap = points - (centers[0] if len(centers) == 1 else centers[which])
    return which, np.sqrt(np.einsum("ij,ij->i", gap, gap))


def chances(
    points: np.ndarray, weights: np.ndarray, chosen: np.ndarray, power: int = 1
) -> np.ndarray | None:
    """Weight times a power of the distance to the nearest chosen center; None with nothing chosen."""
    return weights * nearest(points, chosen)[1] ** power if len(chosen) else None


def arrivals(draws: np.ndarray, chance: np.ndarray | None) -> np.ndarray:
    """Exponential arrival times; the least of them is a pick by ``chance``.

    Without chances every row is as likely; rows with chance 0 never arrive.
    """
    times = -np.log(draws)
    if chance is None:
        return times
    return np.divide(times, chance, out=np.full(len(times), np.inf), where=chance > 0)


def weighted_means(
    points: np.ndarray, weights: np.ndarray, which: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per center: sum of the weights, and weighted mean of its points."""
    total = np.bincount(which, weights=weights, minlength=k)
    order = np.argsort(which, kind="stable")
    reached, starts = np.unique(which[order], return_index=True)
    sums = np.zeros((k, points.shape[1]))
    sums[reached] = np.add.reduceat(points[order] * weights[order, None], starts, axis=0)
    means = np.divide(sums, total[:, None], out=np.zeros_like(sums), where=total[:, None] > 0)
    return total, means


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("w").to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _of_run(batch: pa.RecordBatch, number: int) -> np.ndarray:
    """Places of the rows of a run: all of them, unless rows name their run in ``_run``."""
    if "_run" not in batch.schema.names:
        return np.arange(len(batch))
    return np.flatnonzero(batch.column("_run").to_numpy(zero_copy_only=False) == number)


def _least_rows(keys: np.ndarray, points: np.ndarray, limit: float, count: int) -> np.ndarray:
    """``count`` rows of least key, at most ``limit``; of equal keys the smallest vectors."""
    rows = np.flatnonzero((keys <= limit) & np.isfinite(keys))
    if len(rows) <= count:
        return rows
    edge = np.partition(keys[rows], count - 1)[count - 1]
    below, equal = rows[keys[rows] < edge], rows[keys[rows] == edge]
    if len(below) + len(equal) > count:
        equal = equal[np.lexsort(points[equal].T[::-1])[: count - len(below)]]
    return np.concatenate([below, equal])


def race(
    chosen_of_run: list[np.ndarray],
    numbers: list[int],
    seeds: list[int],
    turns_of_run: list[int],
    kept: int,
    id_type: pa.DataType,
    power: int = 1,
) -> Callable[[Batches], Batches]:
    """Rows ``(id, x, w, state)`` to the candidates for each run's next picks.

    Turn 0 is the pick after those chosen.  Per run and turn the ``kept`` rows
    of least arrival time come out as ``(run, turn, id, x, w, draw, bound,
    beyond)``: ``bound`` is the time with the centers chosen so far, and
    ``beyond`` the least bound of the rows left out.  Rows that bring ``d``, the
    distance to the nearest of those chosen, are compared with none; an entry of
    ``chosen_of_run`` may then be how many there are.
    """

    def chance_of(points: np.ndarray, weights: np.ndarray, known: np.ndarray | None, chosen: object) -> np.ndarray | None:
        return chances(points, weights, chosen, power) if known is None else weights * known**power

    def run_race(batches: Batches) -> Batches:
        least: dict[tuple[int, int], list[tuple]] = {}
        width = next((c.shape[1] for c in chosen_of_run if not isinstance(c, int) and len(c)), None)
        for batch in batches:
            if len(batch) == 0:
                continue
            points, states = matrix(batch.column("x"), width), _states(batch)
            width = points.shape[1]
            weights, ids = _weights(batch), batch.column("id")
            known = batch.column("d").to_numpy(zero_copy_only=False) if "d" in batch.schema.names else None
            for run, (chosen, turns) in enumerate(zip(chosen_of_run, turns_of_run)):
                own = _of_run(batch, numbers[run])
                if len(own) == 0:
                    continue
                theirs = points[own]
                chance = chance_of(theirs, weights[own], None if known is None else known[own], chosen)
                draw_of = draws(states[own], seeds[run])
                count = chosen if isinstance(chosen, int) else len(chosen)
                for turn in range(turns):
                    draw = draw_of(count + turn)
                    keys = arrivals(draw, chance)
                    held = least.setdefault((run, turn), [])
                    limit = held[-1][0] if len(held) > kept else np.inf
                    held += [
                        (keys[r], ids[int(own[r])].as_py(), theirs[r].tolist(), weights[own[r]], draw[r])
                        for r in _least_rows(keys, theirs, limit, kept + 1)
                    ]
                    held.sort(key=lambda candidate: candidate[:3])
                    del held[kept + 1 :]
        out = [
            (*place, *candidate, held[kept][0] if len(held) > kept else np.inf)
            for place, held in least.items()
            for candidate in held[:kept]
        ]
        if out:
            run, turn, bound, row_id, x, w, draw, beyond = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(run, pa.int32()),
                    pa.array(turn, pa.int32()),
                    pa.array(row_id, id_type),
                    pa.array(x, pa.list_(pa.float64())),
                    *(pa.array(column, pa.float64()) for column in (w, draw, bound, beyond)),
                ],
                names=["run", "turn", "id", "x", "w", "draw", "bound", "beyond"],
            )

    return run_race


def refine(
    previous_of_run: list[np.ndarray | None],
    current_of_run: list[np.ndarray],
    numbers: list[int],
) -> Callable[[Batches], Batches]:
    """Rows ``(x, w)`` to ``(run, cid, w, x, cost)``, a row per run and center with points.

    ``x`` is the weighted mean of the partition's points nearest to the
    current center ``cid``.  The costs of a run add up to the weighted
    distances from all points to the current center that replaced the
    previous one they were nearest to: the old assignment, the new places.
    """

    def run_refine(batches: Batches) -> Batches:
        total = [np.zeros(len(c)) for c in current_of_run]
        mean = [np.zeros_like(c) for c in current_of_run]
        cost = [0.0 for _ in current_of_run]
        for batch in batches:
            every = matrix(batch.column("x"), current_of_run[0].shape[1])
            every_weight = _weights(batch)
            for run, (previous, current) in enumerate(zip(previous_of_run, current_of_run)):
                own = _of_run(batch, numbers[run])
                if len(own) == 0:
                    continue
                points, weights = every[own], every_weight[own]
                which, _ = nearest(points, current)
                added, added_mean = weighted_means(points, weights, which, len(current))
                merged = total[run] + added
                share = np.divide(added, merged, out=np.zeros_like(added), where=merged > 0)
                mean[run] += share[:, None] * (added_mean - mean[run])
                total[run] = merged
                if previous is not None:
                    moved = current[nearest(points, previous)[0]]
                    gap = points - moved
                    cost[run] += float(weights @ np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        for run, totals in enumerate(total):
            reached = np.flatnonzero(totals > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(reached), run, dtype=np.int32)),
                    pa.array(reached.astype(np.int32)),
                    pa.array(totals[reached]),
                    vectors(mean[run][reached]),
                    pa.array(np.where(np.arange(len(reached)) == 0, cost[run], 0.0)),
                ],
                names=["run", "cid", "w", "x", "cost"],
            )

    return run_refine


def mean_distances(centers_of_run: list[np.ndarray]) -> Callable[[Batches], Batches]:
    """Rows ``(x)`` to ``(run, n, mean)``: a partition's mean distance per run."""

    def run_mean(batches: Batches) -> Batches:
        count, mean = 0, [0.0 for _ in centers_of_run]
        for batch in batches:
            points = matrix(batch.column("x"), centers_of_run[0].shape[1])
            if len(points) == 0:
                continue
            count += len(points)
            for run, centers in enumerate(centers_of_run):
                added = float(nearest(points, centers)[1].mean())
                mean[run] += (added - mean[run]) * len(points) / count
        runs = len(centers_of_run)
        if count:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(runs, dtype=np.int32)),
                    pa.array(np.full(runs, count, dtype=np.int64)),
                    pa.array(mean, pa.float64()),
                ],
                names=["run", "n", "mean"],
            )

    return run_mean


def place_of(labels: pa.Array, clusters: list) -> np.ndarray:
    """Where each label stands among ``clusters``, NULL being a label too; -1 for those that do not."""
    known = pa.array(clusters, labels.type)
    return pc.fill_null(pc.index_in(labels, value_set=known), -1).to_numpy(zero_copy_only=False)


class Balls(NamedTuple):
    """Clusters in groups by their means: a center and a radius each, and the least values that bound a score."""

    members: list[np.ndarray]
    centers: np.ndarray
    radii: np.ndarray
    spreads: np.ndarray
    ratios: np.ndarray


def balls(means: np.ndarray, spreads: np.ndarray, ratios: np.ndarray) -> Balls:
    """Groups of about ``TOGETHER`` clusters with means close to each other."""
    many = max(1, len(means) // TOGETHER)
    centers = means[np.linspace(0, len(means) - 1, many).astype(int)]
    which, _ = nearest(means, centers)
    for _ in range(2):
        _, moved = weighted_means(means, np.ones(len(means)), which, len(centers))
        centers = moved[np.unique(which)]
        which, _ = nearest(means, centers)
    members = [m for m in (np.flatnonzero(which == g) for g in range(len(centers))) if len(m)]
    centers = np.array([means[m].mean(axis=0) for m in members])
    radii = np.array([np.sqrt(square_distance(means[m], c).max()) for m, c in zip(members, centers)])
    least = lambda values: np.array([values[m].min() for m in members])
    return Balls(members, centers, radii, least(spreads), least(ratios))


def silhouette_parts(
    points: np.ndarray,
    own: np.ndarray,
    means: np.ndarray,
    spreads: np.ndarray,
    ratios: np.ndarray,
    groups: Balls,
) -> tuple[np.ndarray, np.ndarray]:
    """Average square distance to the own cluster, and the least one to another.

    The squares from a point to ``n`` sampled points add up to ``n`` times its
    square distance to their mean plus their spread (mean square distance from
    the mean); ``ratios`` holds ``n`` over the divisor.  NaN where the block
    of clusters has no answer.

    A point is at least as far from a mean as from its group's center less the
    group's radius.  It meets the group for which that bounds its value least, and
    then only groups whose bound is not above its least value so far.
    """
    a = np.full(len(points), np.nan)
    b = np.full(len(points), np.inf)
    rows = max(1, TILE_CELLS // len(groups.members))
    for first in range(0, len(points), rows):
        tile = slice(first, first + rows)
        _silhouette_tile(points[tile], own[tile], means, spreads, ratios, groups, a[tile], b[tile])
    b[np.isinf(b)] = np.nan
    return a, b


def _silhouette_tile(
    points: np.ndarray,
    own: np.ndarray,
    means: np.ndarray,
    spreads: np.ndarray,
    ratios: np.ndarray,
    groups: Balls,
    a: np.ndarray,
    b: np.ndarray,
) -> None:
    inside = np.flatnonzero(own >= 0)
    gap = points[inside] - means[own[inside]]
    a[inside] = ratios[own[inside]] * (np.einsum("ij,ij->i", gap, gap) + spreads[own[inside]])
    bounds = np.empty((len(points), len(groups.members)))
    for g, center in enumerate(groups.centers):
        clear = np.maximum(np.sqrt(square_distance(points, center)) - groups.radii[g], 0.0)
        # A little less, so that rounding loses no cluster.
        bounds[:, g] = (1 - 1e-9) * groups.ratios[g] * (clear * clear * (1 - 1e-9) + groups.spreads[g])
    first = bounds.argmin(axis=1)

    def meet(there: np.ndarray, group: int) -> None:
        for cluster in groups.members[group].tolist():
            others = there[own[there] != cluster]
            value = ratios[cluster] * (square_distance(points[others], means[cluster]) + spreads[cluster])
            b[others] = np.fmin(b[others], value)

    for group in np.unique(first).tolist():
        meet(np.flatnonzero(first == group), group)
    for group in range(len(groups.members)):
        there = np.flatnonzero((bounds[:, group] <= b) & (first != group))
        if len(there):
            meet(there, group)


def seed_in_memory(points: np.ndarray, states: np.ndarray, seed: int, k: int) -> np.ndarray:
    """Seeding of one bounded block of points of equal weight."""
    draw_of = draws(states, seed)
    distance: np.ndarray | None = None
    picked: list[int] = []
    for turn in range(k):
        keys = arrivals(draw_of(turn), distance)
        least = _least_rows(keys, points, np.inf, 1)
        if len(least) == 0:
            break
        row = int(least[0])
        picked.append(row)
        added = np.sqrt(square_distance(points, points[row]))
        distance = added if distance is None else np.minimum(distance, added)
    return points[picked]


def refine_in_memory(points: np.ndarray, centers: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd rounds on one bounded block, kept while they lower the cost."""
    ones, best = np.ones(len(points)), np.inf
    for _ in range(rounds):
        which, _ = nearest(points, centers)
        total, means = weighted_means(points, ones, which, len(centers))
        proposal = np.where(total[:, None] > 0, means, centers)
        gap = points - proposal[which]
        cost = float(np.sqrt(np.einsum("ij,ij->i", gap, gap)).sum())
        if not cost < best:
            break
        best, centers = cost, proposal
    return centers


def summarize_part(part: str, batches: Batches, k: int, rounds: int, seed: int) -> Batches:
    """A part's rows ``(x, state)`` to its weighted centers ``(id, x, w)``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    width = None
    for batch in batches:
        if len(batch):
            held.append((matrix(batch.column("x"), width), _states(batch)))
            width = held[-1][0].shape[1]
    if held:
        points, states = map(np.concatenate, zip(*held))
        centers = refine_in_memory(points, seed_in_memory(points, states, seed, k), rounds)
        which, _ = nearest(points, centers)
        weights = np.bincount(which, minlength=len(centers)).astype(np.float64)
        names = [f"{part}:0:{index}" for index in range(len(centers))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), vectors(centers), pa.array(weights)], names=["id", "x", "w"]
        )
