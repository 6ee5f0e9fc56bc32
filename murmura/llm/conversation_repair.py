"""Repair of a conversation's structure at the least cost, by Hirschberg's divide and conquer.

The repaired roles must read ``(s?(ua)+)?`` by their initials: an optional system turn,
then user and assistant in turn, or nothing.  Edits are Keep (0), Rerole to user or
assistant (1), Delete (2; required for blank and duplicate rows) and Insert of an empty
user or assistant turn (5); a truncated row that stays adds 5.  Among the cheapest
edits those whose initials are least in ASCII are taken.

Four states tell what was written last: nothing, system, user, assistant.  A row is a
table from state to state of costs and initials.  For a run of rows, costs are carried
forward from its first state to its middle and backward from its last state; the state
in the middle where they add up to least is a crossing of cheapest edits, and where
several do, that with the least initials before it, whose order is carried along with the
costs.  Both halves are then runs of their own.  Besides the answer, one state per row,
only a few vectors of four are in memory.

Conversations are rows in the order of a range partitioning, so a large one spans
several partitions.  A run of it in one partition is a table from state to state like a
row; the same procedure over these tables, two per partition at most, finds the states
at the borders, and each run is then repaired by itself.  Nothing is gathered per
conversation but its audit, a row of the result, and its hash, computed from a stream of
sorted rows, since a hash needs them one after the other.

Rows are ordered by turn (NULL first), then role, then text; repeated rows count once
with their number.  NULL roles and texts are one space; rows without ``conv_id`` are a
conversation.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from murmura.llm import storage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of adjacent initials that may stand.
LEGAL = ("su", "ua", "au")
#: Where a user or an assistant turn leads; elsewhere it may not stand.
_AFTER = {(NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: A row is coded as its initial (3: any other), plus 4 where it is truncated; 8: it must go.
MUST, END = 8, 9
_SPAN = 200

Step = Sequence[dict[int, tuple[int, object]]]
_FAR = 1 << 60


def _inserted(state: int) -> Iterator[tuple[int, str, int]]:
    """``(cost, initials, state)`` after no, one or two inserted turns; more would repeat a state."""
    cost, written = 0, ""
    while True:
        yield cost, written, state
        if len(written) == 2:
            return
        state = _AFTER[state, "a" if state == USER else "u"]
        cost, written = cost + INSERT, written + "I"


def _step(code: int) -> Step:
    """For each state, the states a row leads to with the least cost and, for that, the least initials."""
    table: list[dict[int, tuple[int, object]]] = []
    for state in range(4):
        found: list[tuple[int, int, str]] = []
        if code == END:
            found = [(NOTHING, c, w) for c, w, s in _inserted(state) if s in (NOTHING, ASSISTANT)]
        else:
            found.append((state, DELETE, "D"))
        for cost, before, s in _inserted(state) if code < MUST else ():
            cost += TRUNCATED if code & 4 else 0
            initial = (*INITIALS, "")[code & 3]
            kept = SYSTEM if initial == "s" and s == NOTHING else _AFTER.get((s, initial))
            if kept is not None:
                found.append((kept, cost + KEEP, before + "K"))
            found.append((_AFTER[s, "a" if s == USER else "u"], cost + REROLE, before + "R"))
        table.append({})
        for to, cost, letters in found:
            table[state][to] = min(table[state].get(to, (cost, letters)), (cost, letters))
    return table


#: By code: rows, rows that must go, and the end of a conversation (whose state 0 is its acceptance).
STEPS: list[Step] = [_step(code) for code in range(END + 1)]


def forward(steps: Sequence[Step], state: int) -> list[tuple[int, int]]:
    """From ``state`` over ``steps`` to each state: least cost, and the place of its least initials among the four."""
    vector = [(0 if s == state else _FAR, 0) for s in range(4)]
    for step in steps:
        best: dict[int, tuple] = {}
        for s, (cost, rank) in enumerate(vector):
            if cost < _FAR:
                for to, (more, letters) in step[s].items():
                    way = (cost + more, rank, letters)
                    if to not in best or way < best[to]:
                        best[to] = way
        order = sorted((way[1:], to) for to, way in best.items())
        vector = [(_FAR, 0)] * 4
        for rank, (_, to) in enumerate(order):
            vector[to] = (best[to][0], rank)
    return vector


def backward(steps: Sequence[Step], state: int) -> list[int]:
    """Least cost from each state over ``steps`` to ``state``."""
    vector = [0 if s == state else _FAR for s in range(4)]
    for step in reversed(steps):
        vector = [min((cost + vector[to] for to, (cost, _) in step[s].items()), default=_FAR) for s in range(4)]
    return vector


def crossings(steps: Sequence[Step], first: int, last: int) -> bytearray:
    """The state after each of ``steps`` on the cheapest way from ``first`` to ``last`` with the least initials."""
    states = bytearray(len(steps))
    todo = [(0, len(steps), first, last)] if steps else []
    while todo:
        low, high, start, goal = todo.pop()
        if high - low == 1:
            states[low] = goal
            continue
        middle = (low + high) // 2
        before, after = forward(steps[low:middle], start), backward(steps[middle:high], goal)
        state = min(range(4), key=lambda s: (before[s][0] + after[s], before[s][1]))
        todo += [(low, middle, start, state), (middle, high, state, goal)]
    return states


def matrix(codes: bytes) -> Step:
    """A run of rows as one step; in place of initials the places of their order."""
    steps = [STEPS[c] for c in codes]
    return [{to: way for to, way in enumerate(forward(steps, s)) if way[0] < _FAR} for s in range(4)]


@lru_cache(1 << 14)
def _short(codes: bytes, first: int, last: int) -> tuple[bytes, tuple[str, ...], int]:
    return _edits(codes, first, last)


def _edits(codes: bytes, first: int, last: int) -> tuple[bytes, tuple[str, ...], int]:
    steps = [STEPS[c] for c in codes]
    states = bytes(crossings(steps, first, last))
    ways = [step[s][to] for step, s, to in zip(steps, bytes([first]) + states, states)]
    return states, tuple(str(letters) for _, letters in ways), sum(cost for cost, _ in ways)


def edits(codes: bytes, first: int = NOTHING, last: int = NOTHING) -> tuple[bytes, tuple[str, ...], int]:
    """``(states, initials, cost)`` of a run: state and initials after each row, and what they cost together."""
    return (_short if len(codes) <= 64 else _edits)(codes, first, last)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (NULLs one space) with faults by checksum of ``conv_id:turn``, and ``copies`` of each row.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats it and 4 makes its role ``user``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return turns.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _turn_order(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull().alias("some"), F.col(turn).alias("turn"))


def faulted(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n`` and faults, in order by ``_at``, whose bits above 33 are the partition.

    ``duplicate`` tells whether the row's first copy is one; the others always are.
    """
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    counted = storage.written(
        rows.groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("n"))
        .withColumn("_key", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    )
    seen = counted.groupBy(F.col("conv_id").alias("_conv"), F.col("_key").alias("_seen")).agg(F.min(_turn_order()).alias("_first"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    blank = trimmed == ""
    found = counted.join(seen, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_seen") == F.col("_key"))).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n",
        blank.alias("blank"),
        (~blank & (_turn_order() != F.col("_first"))).alias("duplicate"),
        (~blank & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    order = ["conv_id", "turn", "role"]
    return storage.written(
        found.repartitionByRange(*order, F.substring("text", 1, _SPAN))
        .sortWithinPartitions(*order, "text")
        .withColumn("_at", F.monotonically_increasing_id())
    )


def _coded(rows: DataFrame) -> DataFrame:
    """``(conv_id, _at, code, initial, n)`` in the order of the rows, whole partitions of ``faulted`` in one task."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("blank") | F.col("duplicate"), MUST).otherwise(kind + F.when(F.col("truncated"), 4).otherwise(0))
    light = rows.select("conv_id", "_at", code.cast("int").alias("code"), kind.cast("int").alias("initial"), "n")
    return light.repartition(F.shiftright("_at", 33)).sortWithinPartitions("_at")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, bool, bool]]:
    """``(conv_id, its rows as (at, code, initial, n), whether first, whether last)`` of the partition, in order."""
    conv, part, rows, opens = None, None, [], True

    def close(last: bool) -> tuple[object, np.ndarray, bool, bool]:
        return conv, np.concatenate(rows), opens, last

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["conv_id"].to_pylist()
        values = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("_at", "code", "initial", "n")], 1)
        parts = values[:, 0] >> 33
        k = 0
        while k < len(ids):
            end = k + 1
            while end < len(ids) and ids[end] == ids[k] and parts[end] == parts[k]:
                end += 1
            if rows and (ids[k] != conv or parts[k] != part):
                yield close(parts[k] != part)
                opens, rows = parts[k] != part, []
            conv, part = ids[k], parts[k]
            rows.append(values[k:end])
            k = end
    if rows:
        yield close(True)


def _borders(coded: DataFrame) -> dict[int, tuple[int, bool, int, bool, int]]:
    """By the place of its first row, of runs at a border: state before, whether begun before, initial before,
    whether it goes on, state after.

    Only the first and the last run of a partition can belong to a conversation of several.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, run, first, last in _runs(batches):
            if first or last:
                table = matrix(run[:, 1].astype(np.uint8).tobytes())
                flat = [table[s].get(to, (_FAR, 0)) for s in range(4) for to in range(4)]
                out.append((conv, int(run[0, 0]), [x for way in flat for x in way], int(run[-1, 2])))
        fields = [pa.int64(), pa.list_(pa.int64()), pa.int32()]
        columns = list(zip(*out)) if out else [[]] * 4
        arrays = [pa.array(columns[0], ids)] + [pa.array(c, k) for c, k in zip(columns[1:], fields)]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "at", "flat", "initial"])

    ids = to_arrow_type(coded.schema["conv_id"].dataType)
    kind = coded.schema["conv_id"].dataType.simpleString()
    runs = sorted(
        coded.mapInArrow(rows, f"conv_id {kind}, at bigint, flat array<bigint>, initial int").collect(),
        key=lambda r: r["at"],
    )
    found, k = {}, 0
    while k < len(runs):
        end = k + 1
        while end < len(runs) and runs[end]["conv_id"] == runs[k]["conv_id"]:
            end += 1
        steps: list[Step] = [
            [
                {to: tuple(r["flat"][8 * s + 2 * to : 8 * s + 2 * to + 2]) for to in range(4) if r["flat"][8 * s + 2 * to] < _FAR}
                for s in range(4)
            ]
            for r in runs[k:end]
        ]
        states = bytes([NOTHING]) + bytes(crossings([*steps, STEPS[END]], NOTHING, NOTHING))
        for i, r in enumerate(runs[k:end]):
            before = runs[k + i - 1]["initial"] if i else 3
            found[r["at"]] = (states[i], i > 0, before, k + i + 1 < end, states[i + 1])
        k = end
    return found


def edited(rows: DataFrame) -> DataFrame:
    """The edits of ``faulted`` rows: ``(conv_id, at, edit, before, role, audit, cost, illegal)``.

    A row for each of ``rows`` (``at`` twice its place): initials, initials of the roles inserted before it, and
    the initial it is made, NULL where it goes or stays as it is.  A row for turns inserted at the end of a conversation (``at``
    odd).  And a row for each run, with ``audit``, ``cost`` and illegal pairs, ``edit`` NULL.
    """
    coded = _coded(rows)
    borders = _borders(coded)
    ids = to_arrow_type(coded.schema["conv_id"].dataType)
    legal = np.zeros((4, 4), dtype=bool)
    for one, two in LEGAL:
        legal[INITIALS.index(one), INITIALS.index(two)] = True
    names = ["conv_id", "at", "edit", "before", "role", "audit", "cost", "illegal"]
    kinds = [ids, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for conv, run, _, _ in _runs(batches):
            at, codes, initial, n = run.T
            start, begun, before, goes_on, goal = borders.get(int(at[0]), (NOTHING, False, 3, False, NOTHING))
            tail = b"" if goes_on else bytes([END])
            states, letters, cost = edits(codes.astype(np.uint8).tobytes() + tail, start, NOTHING if tail else goal)
            audit, state = [], start
            for k, (place, number) in enumerate(zip(at.tolist(), n.tolist())):
                audit.append(letters[k] + "D" * (number - 1))
                added, own = _written(state, letters[k])
                state = states[k]
                found.append((conv, 2 * place, audit[-1], added, own, None, None, None))
            if tail:
                audit.append(letters[-1])
                if letters[-1]:
                    found.append((conv, 2 * int(at[-1]) + 1, letters[-1], _written(state, letters[-1])[0], None, None, None, None))
            pairs = int((~legal[initial[:-1], initial[1:]]).sum()) + int((n - 1).sum())
            pairs += int(begun and not legal[before, initial[0]])
            cost += DELETE * int((n - 1).sum())
            found.append((conv, 2 * int(at[0]), None, None, None, "".join(audit), cost, pairs))
            if len(found) >= 10_000:
                yield out(found)
                found = []
        yield out(found)

    kind = coded.schema["conv_id"].dataType.simpleString()
    return storage.written(
        coded.mapInArrow(
            work, f"conv_id {kind}, at bigint, edit string, before string, role string, audit string, cost bigint, illegal bigint"
        )
    )


def _written(state: int, letters: str) -> tuple[str, str | None]:
    """Initials of the roles that ``letters`` insert from ``state`` on, and of a row they make another role."""
    added, own = "", None
    for letter in letters:
        role = "a" if state == USER else "u"
        if letter == "I":
            added += role
        elif letter == "R":
            own = role
        if letter in "IR":
            state = _AFTER[state, role]
    return added, own


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``(conv_id, at, place, role, text)`` of the repaired conversations, in order by ``at`` and ``place``."""
    initial = lambda x: F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"])
    changes = edits.where("edit IS NOT NULL").select(F.col("conv_id").alias("_conv"), "at", "edit", "before", F.col("role").alias("_role"))
    texts = rows.select((F.col("_at") * 2).alias("at"), "role", "text")
    both = changes.join(texts, "at", "left")
    # What a row leaves: the inserted turns before it, and itself if it stays.
    added = F.transform(
        F.filter(F.split("before", ""), lambda x: x != ""),
        lambda x: F.struct(initial(x).alias("role"), F.lit("").alias("text")),
    )
    role = F.when(F.col("_role").isNull(), F.col("role")).otherwise(initial(F.col("_role")))
    own = F.when(
        F.col("edit").rlike("[KR]"), F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
    ).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return both.select(
        F.col("_conv").alias("conv_id"), "at", F.posexplode(F.concat(added, own)).alias("place", "_turn")
    ).select("conv_id", "at", "place", "_turn.role", "_turn.text")


def hashed(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: of ``role:text`` of the turns in order, joined by line feeds.

    A task reads its conversations as a stream, whatever their length.
    """
    ids = to_arrow_type(turns.schema["conv_id"].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hash_ = None, None
        for batch in batches:
            done = []
            for of, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist()):
                if hash_ is None or of != conv:
                    if hash_ is not None:
                        done.append((conv, hash_.hexdigest()))
                    conv, hash_ = of, hashlib.sha256()
                    hash_.update(line.encode())
                else:
                    hash_.update(b"\n" + line.encode())
            if done:
                yield out(done)
        if hash_ is not None:
            yield out([(conv, hash_.hexdigest())])

    def out(done: list[tuple]) -> pa.RecordBatch:
        convs, hashes = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(convs, ids), pa.array(hashes)], names=["conv_id", "repaired_sha256"])

    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return lines.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(
        rows, f"conv_id {kind}, repaired_sha256 string"
    )


def repair_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``, with faults, cost, audit and hash of its repaired ``turns``.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``; a conversation without
    ``turns`` has zeros, no audit and the hash of nothing.
    """
    rows = faulted(turns)
    found = edited(rows)
    numbered = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    fresh = ~F.col("blank") & ~F.col("duplicate")
    faults = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - fresh.cast("int"))).alias("duplicate"),
        F.sum((fresh & F.col("truncated")).cast("long")).alias("truncated"),
    )
    runs = found.where("edit IS NULL").groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit"),
    )
    report = conversations.select("conv_id").distinct()
    for k, part in enumerate((numbered, faults, runs, hashed(repaired_turns(rows, found)))):
        named = part.withColumnRenamed("conv_id", f"_conv{k}")
        report = report.join(named, F.col("conv_id").eqNullSafe(F.col(f"_conv{k}")), "left").drop(f"_conv{k}")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return report.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
