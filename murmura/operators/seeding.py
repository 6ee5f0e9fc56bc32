"""Weighted seeding: points drawn as first centers, far ones more likely.

The first center is uniform; each next one is drawn with probability
proportional to weight times distance to the nearest center so far, squared
only where asked for (``power`` 2, for k-means).  A draw is a race: every row
arrives at ``-ln(u) / (w d)`` and the first to arrive is picked.

Distances only shrink as centers are added, so a row's time with today's
centers is a lower bound of its time in any later turn.  One pass therefore
gathers, for several turns ahead, the few rows with the least bounds.  The
driver replays those turns on them: if the winner's true time is below every
bound that was left out, no other row can have won; if not, the next pass
starts at that turn.  The picks are those of one pass per turn.  The more
centers there are, the less a new one changes, so a pass looks as many turns
ahead as there are centers, within limits.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from murmura.functions import kernels as K
from murmura.functions.uniform import row_state
from murmura.operators.centers import blocks, fit_a_pass
from murmura.session import Chain

# Turns prepared by one pass at least and at most, candidates for each from a partition, and from all.
AHEAD = 8
MOST_AHEAD = 128
KEPT = 8
SENT = 32
GROUPS = 64

Picks = list[tuple[object, list[float]]]


def weighted(points: DataFrame) -> DataFrame:
    """``(id, x, w)``; points without weights get 1.  A column ``_run`` stays."""
    w = F.col("w") if "w" in points.columns else F.lit(1.0)
    run = [c for c in points.columns if c == "_run"]
    return points.select("id", "x", w.cast("double").alias("w"), *run)


def coordinates(picks: Picks) -> np.ndarray:
    return np.array([x for _, x in picks], dtype=np.float64)


def _least(candidates: DataFrame) -> dict[tuple[int, int], list[Row]]:
    """The rows of least bound per run and turn, at most ``SENT + 1``, in order.

    Each partition brings few rows, but partitions may be many: groups of
    them are thinned out first.
    """
    candidates = candidates.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for keys in (["run", "turn", "group"], ["run", "turn"]):
        order = Window.partitionBy(*keys).orderBy("bound", "id", "x")
        candidates = candidates.withColumn("nth", F.row_number().over(order)).where(
            F.col("nth") <= SENT + 1
        )
    found = defaultdict(list)
    for row in sorted(candidates.collect(), key=lambda row: row.nth):
        found[row.run, row.turn].append(row)
    return found


def _winner(
    rows: list[Row], chosen: np.ndarray, first: bool, power: int
) -> tuple[Row | None, bool]:
    """The pick among the candidates of one turn, and whether it is certain.

    In the ``first`` turn of a pass the bounds are the times themselves.
    """
    if not rows:
        return None, True
    keys = K.arrivals(
        np.array([row.draw for row in rows]),
        K.chances(
            np.array([row.x for row in rows]), np.array([row.w for row in rows]), chosen, power
        ),
    )
    key, _, _, best = min((key, row.id, list(row.x), at) for at, (key, row) in enumerate(zip(keys, rows)))
    left_out = min(row.beyond for row in rows)
    if len(rows) > SENT:
        left_out = min(left_out, rows[-1].bound)
    winner = rows[best] if np.isfinite(key) else None
    return winner, first or key < left_out or not np.isfinite(left_out)


def _ahead(chosen: int, k: int) -> int:
    """Turns that a pass looks ahead; with no center there is no bound, so the first looks at one."""
    return min(max(AHEAD, min(chosen, MOST_AHEAD)), k - chosen) if chosen else 1


def vectors_held(k: int) -> int:
    """Vectors of a run on the driver: its centers, and the candidates of a pass."""
    return max(min(max(AHEAD, k), MOST_AHEAD) * SENT, k)


def _closer(block: np.ndarray, x: Column, d: Column) -> Column:
    """The distance to the nearest of the block, or ``d`` if that is less."""
    nearest, matrix = K.nearest, K.matrix

    @F.arrow_udf("double")
    def closer(column: pa.Array, known: pa.Array) -> pa.Array:
        found = nearest(matrix(column, block.shape[1]), block)[1]
        return pa.array(np.minimum(found, known.to_numpy(zero_copy_only=False)))

    return closer(x, d)


class _Distances:
    """A run's points with the distance ``d`` to the nearest center so far, when there are too many for a pass.

    New centers are compared in blocks with the distances kept from those before.
    """

    def __init__(self, points: DataFrame, run: int) -> None:
        own = points.where(F.col("_run") == run) if "_run" in points.columns else points
        self._points, self._met, self._chain = own.withColumn("d", F.lit(np.inf)), 0, Chain()

    def upto(self, chosen: np.ndarray) -> DataFrame:
        for _, block in blocks(chosen[self._met :]) if len(chosen) > self._met else ():
            self._points = self._chain.cut(self._points.withColumn("d", _closer(block, F.col("x"), F.col("d"))))
        self._met = len(chosen)
        return self._points

    def close(self) -> None:
        self._chain.close()


def seed_runs(
    points: DataFrame, ks: list[int], seeds: list[int], power: int = 1
) -> list[Picks]:
    """Independent seedings that share every pass: ``ks[i]`` centers by ``seeds[i]``.

    The i-th result lists ``(id, x)`` in the order of picking, and is shorter
    than ``ks[i]`` when every point lies on a center.  Rows with a number in
    ``_run`` take part in that run only, others in all.  Distances are computed
    anew from the few centers in each pass: nothing is kept per point, unless the centers
    are too many for a task.
    """
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    points = weighted(points).withColumn("state", row_state(F.col("id")))
    id_type = points.schema["id"].dataType
    picks: list[Picks] = [[] for _ in ks]
    running = list(range(len(ks)))
    candidate = (
        f"run int, turn int, id {id_type.simpleString()}, x array<double>, w double, "
        "draw double, bound double, beyond double"
    )
    far: dict[int, _Distances] = {}
    while running:
        turns = [_ahead(len(picks[r]), ks[r]) for r in running]
        chosen = [coordinates(picks[r]) for r in running]
        if fit_a_pass(chosen):
            race = K.race(
                chosen, running, [seeds[r] for r in running], turns, KEPT, to_arrow_type(id_type), power
            )
            found = _least(points.mapInArrow(race, candidate))
        else:
            found = {}
            for at, run in enumerate(running):
                ready = far.setdefault(run, _Distances(points, run)).upto(chosen[at])
                race = K.race(
                    [len(chosen[at])], [run], [seeds[run]], [turns[at]], KEPT, to_arrow_type(id_type), power
                )
                found |= {(at, turn): rows for (_, turn), rows in _least(ready.mapInArrow(race, candidate)).items()}
        going = []
        for at, (run, count) in enumerate(zip(running, turns)):
            exhausted = False
            for turn in range(count):
                winner, certain = _winner(found[at, turn], coordinates(picks[run]), turn == 0, power)
                if not certain:
                    break
                if winner is None:
                    exhausted = True
                    break
                picks[run].append((winner.id, list(winner.x)))
            if not exhausted and len(picks[run]) < ks[run]:
                going.append(run)
        for run in set(running) - set(going):
            if run in far:
                far.pop(run).close()
        running = going
    return picks


def seed_centers(points: DataFrame, k: int, seed: int = 42, power: int = 1) -> Picks:
    """At most ``k`` picks ``(id, x)`` in order."""
    return seed_runs(points, [k], [seed], power)[0]
