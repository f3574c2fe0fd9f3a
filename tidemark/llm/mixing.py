"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in hashed order, are cut into blocks of ``block`` documents. With target weights
w that sum to 1 (exact fractions: floats and counts are taken as they are, nothing is rounded), turn k of a
source is released at ``floor((k-1) / w)`` and due at ``ceil(k / w)``; at each slot the released turn due first
is taken. A turn is half a block, and the schedule is made at two levels, so that it needs no period and can be
made in parallel:

1. *Frames* of ``frame`` slots. Each frame takes what is due in it, and of the turns released in it those due first
   until it is full (:func:`frames`): EDF with unit turns, so no source is ever one turn off at a frame's end.
2. *Slots* of a frame, from its whole numbers of turns (:func:`schedule`): EDF again, less than one turn off.

So after any number of slots each source is less than two turns, one block, from its target. A frame's schedule
depends on its turns only, so frames are scheduled by tasks; the driver makes one row per frame and source.

When sources have run out that held ``EMPTY`` of a phase's weight, a new phase begins, in which the weights of the
sources left are made whole again. Until then their slots stay empty, and the others go on in proportion. So every
document of a weighed source has a place.

``slot`` is the document's slot, ``position`` its place in the mix (unique, with gaps), ``phase`` its phase and ``target``
the weight of its source in it. ``in_mix`` tells whether all sources still had turns (before the first slot whose
source has run out, shares are the targets of all sources); it says nothing about being kept: :func:`mixed` keeps
all that have a position. Nothing is repeated to reach a weight.

Defined results: a null source is a source of its own; repeated rows take places of their own; a null
``doc_id`` takes a place like any other, by a hash of its row; an empty table gives no rows; a source without a
target weight isn't in the mix (slot null, in_mix false). :func:`mixed` returns all columns as they were, whatever
their names; :func:`mix` drops columns that have the name of one of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import ceil, floor, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scale, store

BLOCK, TEMPER = 16, 0.9
FRAME = 1 << 16  # slots that a task schedules at once; more where sources are many
EMPTY = Fraction(1, 8)  # share of a phase's weight that may have run out before a new phase begins
PLACED = ["slot", "position", "in_mix", "target", "block_no", "phase"]


def tempered(counts: Mapping[str, int], power: float = TEMPER) -> dict[str, float]:
    """Target weights in proportion to a power of the sources' sizes (1: as they are, 0: equal)."""
    total = sum(n**power for n in counts.values())
    return {k: n**power / total for k, n in counts.items()}


def whole_weights(weights: Mapping[str, float | int | Fraction]) -> dict[str, int]:
    """Integers in exactly the proportions of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale_ = lcm(*(w.denominator for w in exact.values())) if exact else 1
    return {k: int(w * scale_) for k, w in exact.items()}


def schedule(weights: Mapping[str, int]) -> list[str]:
    """Source of each slot of one period: earliest deadline first among released turns."""
    period = sum(weights.values())
    out: list[str] = []
    waiting = [(0, k, 1) for k in sorted(weights) if weights[k]]  # release, source, number of the turn
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            due = -(-i * period // weights[k])
            heapq.heappush(ready, (due, -int(i * period % weights[k] != 0), k, i))
        _, _, k, i = heapq.heappop(ready)
        out.append(k)
        if i < weights[k]:
            heapq.heappush(waiting, (i * period // weights[k], k, i + 1))
    return out


def frames(weights: Mapping[str, int], slots: int, frame: int) -> Iterator[tuple[int, dict[str, tuple[int, int]]]]:
    """(first slot, {source: (turns before, turns in it)}) of each frame of the first ``slots`` slots.

    At a frame's end a source has had all turns due by then, and may have had the one that is released and not due;
    of those the ones due first fill the frame.
    """
    total = sum(weights.values())
    had = dict.fromkeys(weights, 0)
    for start in range(0, slots, frame):
        end = min(slots, start + frame)
        now = {k: max(had[k], end * w // total) for k, w in weights.items()}
        free = end - sum(now.values())
        some = [k for k, w in weights.items() if now[k] == end * w // total and end * w % total]
        for k in sorted(some, key=lambda k: (Fraction((now[k] + 1) * total, weights[k]), k))[:free] if free else ():
            now[k] += 1
        yield start, {k: (had[k], now[k] - had[k]) for k in weights if now[k] > had[k]}
        had = now


def phases(weights: Mapping[str, float | int | Fraction], turns: Mapping[str, int], frame: int = FRAME) -> Iterator[tuple[int, int, dict[str, Fraction], int, dict[str, tuple[int, int]]]]:
    """(phase, first slot of a frame, weights of the phase, slots, {source: (turns before, turns in it)}) of all frames of all phases.

    Together they place all ``turns`` of each source. A phase ends where the sources that have run out held ``EMPTY`` of
    its weight, so there are at most some six times as many as the weights have powers of two between them.
    """
    whole = whole_weights(weights)
    left, before, start, phase = dict(turns), dict.fromkeys(turns, 0), 0, 0
    while left:
        own = {k: whole[k] for k in left}
        total = sum(own.values())
        gone, end = 0, 0
        for out, k in sorted((ceil(Fraction(left[k] * total, own[k])), k) for k in left):
            gone, end = gone + own[k], max(end, out)
            if Fraction(gone, total) >= EMPTY:
                break
        used = dict.fromkeys(left, 0)
        for at, got in frames(own, end, max(frame, 8 * len(own))):
            size = sum(n for _, n in got.values())
            yield phase, start + at, {k: Fraction(w, total) for k, w in own.items()}, size, {k: (before[k] + had, n) for k, (had, n) in got.items()}
            for k, (had, n) in got.items():
                used[k] = had + n
        before = {k: before[k] + used[k] for k in left}
        left = {k: n - used[k] for k, n in left.items() if n > used[k]}
        start, phase = start + end, phase + 1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames (phase, start, sources with first turn, turns and weight) to one row per turn."""
    for batch in batches:
        for r in batch.to_pylist():
            first = {x["k"]: x["first"] for x in r["own"]}
            of = {x["k"]: x["target"] for x in r["own"]}
            order = schedule({x["k"]: x["n"] for x in r["own"]})
            seen = dict.fromkeys(first, 0)
            turn = []
            for k in order:
                turn.append(first[k] + seen[k])
                seen[k] += 1
            n = len(order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(order, pa.string()), pa.array(turn, pa.int64()), pa.array(range(r["start"], r["start"] + n), pa.int64()), pa.array([r["phase"]] * n, pa.int32()), pa.array([of[k] for k in order], pa.float64())],
                names=["_key", "_turn", "slot", "phase", "target"])


def _content(docs: DataFrame) -> list[str]:
    """Columns that can be hashed: rows that differ nowhere in them may take each other's places."""
    return [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def _scheduled(docs: DataFrame, weights: Mapping[str, float] | None, block: int, frame: int) -> DataFrame:
    """``_row`` (the row as it was) and the columns ``PLACED`` of each row."""
    spark = docs.sparkSession
    half = max(1, block // 2)
    own = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    counts = {r.k: r["count"] for r in docs.groupBy(own.alias("k")).count().collect()}  # a row per source: a mix has a table of weights
    chosen = tempered(counts) if weights is None else {f"={k}" if k is not None else "null": w for k, w in weights.items() if w > 0}
    chosen = {k: w for k, w in chosen.items() if k in counts}
    turns = {k: -(-counts[k] // half) for k in chosen}
    table = []
    for phase, start, of, _, got in phases(chosen, turns, frame):
        table.append((phase, start, [(k, first, n, float(of[k])) for k, (first, n) in got.items()]))
    rows = sum(counts.values())
    plan = spark.createDataFrame(table, "phase int, start long, own array<struct<k:string,first:long,n:long,target:double>>").repartition(max(1, min(len(table), 4096)), "start")
    places = store.table(plan.mapInArrow(_places, "_key string, _turn long, slot long, phase int, target double"), "places")
    ends = spark.createDataFrame(list(turns.items()), "_key string, _end long")  # a row per source
    full = places.join(ends, "_key").filter("_turn >= _end").agg(F.min("slot")).first()[0]  # the first slot whose source has run out
    # hashed order: by the row's content, so that a task that runs again, or a third of all rows without doc_id, makes no difference
    cut = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), own.alias("_key"), F.xxhash64(*(F.col(f"`{c}`") for c in _content(docs))).alias("_hash")).withColumn("_bucket", scale.bucket(F.col("_hash"), rows))
    ranked = scale.before(cut, ["_key"], ["_bucket"], [F.col("_hash")], F.lit(1), "_rank").withColumn("_turn", F.expr(f"_rank div {half}"))
    out = ranked.join(places, ["_key", "_turn"], "left")
    out = out.withColumn("position", F.col("slot") * half + F.col("_rank") % half).withColumn("in_mix", F.coalesce(F.col("slot") < (full if full is not None else 1 << 62), F.lit(False)))
    return out.withColumn("block_no", F.when(F.col("slot").isNotNull(), F.expr(f"_rank div {max(1, block)}"))).select("_row", *PLACED)


def mix(docs: DataFrame, weights: Mapping[str, float | int | Fraction] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """``docs`` with slot, position, in_mix, target (weight), block number and phase of each row."""
    own = [c for c in docs.columns if c not in PLACED]
    return _scheduled(docs, weights, block, frame).select(*(F.col("_row").getField(c).alias(c) for c in own), *PLACED)


def mixed(docs: DataFrame, weights: Mapping[str, float | int | Fraction] | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """All documents of weighed sources with their own columns, written in mixed order."""
    out = _scheduled(docs, weights, block, frame).filter("position is not null")
    return out.repartitionByRange("position").sortWithinPartitions("position").select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
