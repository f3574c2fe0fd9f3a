"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked; the shard is the label. Linked documents start with hashed labels.
Then, round by round,

1. the labels of a document's neighbours are counted: those of its group, by shard;
2. documents that aren't where most of their neighbours are ask to move there;
3. quotas admit moves: of what asks to go from shard i to shard j so much is admitted that no shard
   exceeds its quota when all admitted moves are made at once (:func:`admitted`, exchanges between full shards
   included), larger groups first;
4. the documents that were admitted change their labels, and the next round counts the new ones.

Where nothing can be exchanged, whole groups move to a shard with room for them.
It ends when no link is cut, or nothing moves any more. A round's cut links are reported to ``report``. Documents of a
group that have the same label see the same neighbours, so they are held as one row with a count: a
round costs rows by (group, shard), however many copies there are, and only groups that are still cut take
part in it. A group larger than a quota starts out on as few shards as hold it and stays there. Rows without
links cut nothing; they fill what is left.

Law ``rows``: the counts of shards are at most one apart, for any group sizes. All steps are joins and
aggregates over a slim table (identity, hash, size), written to the shared folder after each round;
texts are read once and never shuffled; ranks come from bucketed running sums, so neither a hot group
nor a shard meets in one task. Only DataFrame functions are used.

Defined results: a null text has size 8, CRC 0 and no links; empty texts are linked with each other;
repeated rows are linked like any equal texts and keep one row each; a null ``doc_id`` is kept as null;
an empty table gives no rows. Other columns are not read.

Given ``kind``, the order in which the rows were written (:func:`tidemark.llm.store.place`) counts, as it does for a mix:
rows without links are dealt to the shards kind by kind, in that order, so each shard gets of any stretch of the rows its
share of each kind, and slots follow that order. Without it, shards and slots of such rows are hashed. Linked rows go where
their group goes, in either case.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import mixing, scale, store

SHARDS = 24
PERIOD = 4096  # rows after which the dealing of rows to shards is repeated
ROUNDS = 24  # each cuts fewer links than the one before; most graphs need three or four
KEY = ["group", "text_crc32", "size"]


# as SQL text, which reaches the planner in one call however many shards there are
def _at(values: list[int], index: str) -> Column:
    return F.expr(f"element_at(array({', '.join(f'{v}L' for v in values)}), {index} + 1)")


def _pick(ends: list[int], at: str) -> Column:
    """The first shard whose end lies behind ``at``."""
    return F.expr("case " + " ".join(f"when {at} < {e}L then {b}" for b, e in enumerate(ends[:-1])) + f" else {len(ends) - 1} end") if len(ends) > 1 else F.lit(0)


def _dealt(room: list[int], at: str) -> str:
    """The shard of row ``at`` of a line that is dealt evenly along it: in turn, if all have the same room, and to each as many as it has."""
    times = max(1, sum(room) // max(PERIOD, 8 * len(room)))
    each = [r // times for r in room]
    turns = mixing.schedule(dict(enumerate(each)))
    if not turns:
        return "0"
    then, n = [r - times * e for r, e in zip(room, each, strict=True)], times * len(turns)
    here = f"element_at(array({', '.join(map(str, turns))}), cast({at} % {len(turns)} as int) + 1)"
    return f"case when {at} < {n}L then {here} else {_dealt(then, f'({at} - {n}L)')} end" if any(then) else here


def _in_turn(rest: DataFrame, room: list[int], rows: int) -> DataFrame:
    """``rest`` with ``shard``: rows of a kind, in the order of their places, are dealt in turn, and those of the next kind go on from there."""
    ranked = scale.before(rest.withColumn("_bucket", scale.stretch("place", rows)), ["kind"], ["_bucket"], [F.col("place.row")], F.lit(1), "_rank")
    sizes = rest.groupBy("kind").count().orderBy("kind").collect()  # a row per kind, as a mix has a table of its sources
    first = list(zip((r.kind for r in sizes), accumulate((r["count"] for r in sizes), initial=0), strict=False))
    line = ranked.join(rest.sparkSession.createDataFrame(first, "kind long, _first long"), "kind").withColumn("_rank", F.col("_first") + F.col("_rank"))
    return line.withColumn("shard", F.expr(_dealt(room, "_rank")))


def _ends(room: list[int]) -> list[int]:
    return [sum(room[: b + 1]) for b in range(len(room))]


def admitted(want: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the documents that ask to go from one shard to another may, so that none gets more than its room.

    Along each shortest chain of asked moves that comes back to its first shard, or ends where there is room, as
    many documents move as its least link has: shards on the way give as many as they get. It ends when there is
    no such chain; each one uses up a link or a room, so they are fewer than pairs of shards and shards.
    """
    room, left, flow = list(room), dict(want), dict.fromkeys(want, 0)

    def chain(first: int) -> list[tuple[int, int]]:
        came, line = {}, [first]
        for i in line:
            for j in range(len(room)):
                if left.get((i, j)) and (j not in came):
                    came[j] = i
                    if j == first or room[j] > 0:
                        out = [(i, j)]
                        while out[0][0] != first:
                            out.insert(0, (came[out[0][0]], out[0][0]))
                        return out
                    line.append(j)
        return []

    todo = list(range(len(room)))
    while todo:
        if not (way := chain(todo[-1])):
            todo.pop()
            continue
        first, last = way[0][0], way[-1][1]
        n = min(*(left[k] for k in way), *([room[last]] if last != first else [left[way[0]]]))
        for k in way:
            left[k] -= n
            flow[k] += n
        if last != first:
            room[first] += n
            room[last] -= n
            todo = list(range(len(room)))
    return {k: n for k, n in flow.items() if n}


def _links(cells: DataFrame) -> int:
    """Pairs of linked documents with the same label."""
    return int(cells.agg(F.coalesce(F.sum((F.col("here") * (F.col("here") - 1) / 2).cast("decimal(38,0)")), F.lit(0))).first()[0])


def _whole(groups: list, quota: list[int], room: list[int]) -> list[tuple]:
    """(key, first and last rank, shard) of groups that no shard holds: whole shards, then a part of one."""
    spans = []
    for g in groups:
        at = 0
        while at < g.n:
            fit = [b for b in range(len(room)) if room[b] >= g.n - at]
            b = min(fit, key=lambda b: (room[b], b)) if fit else max(range(len(room)), key=lambda b: (room[b], -b))
            take = min(room[b], g.n - at)
            spans.append((g.group, g.text_crc32, g.size, b, take))
            room[b] -= take
            at += take
    return spans


def _ranked(cells: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``cells`` with ``_ahead``: documents of those before, larger groups first."""
    cells = cells.withColumn("_class", -F.floor(F.log2("n")).cast("int")).withColumn("_bucket", scale.bucket(F.col("group"), rows))
    return scale.before(cells, by, ["_class", "_bucket"], [F.col("group"), F.col("text_crc32"), F.col("size")], F.col("here"), "_ahead").drop("_class", "_bucket")


def _fitted(cells: DataFrame, room: list[int], rows: int) -> DataFrame:
    """Start labels within the quotas: what is too many in a shard goes to shards with room. Only where links leave no slack."""
    over = [max(0, -r) for r in room]
    line = _ranked(cells, ["shard"], rows).withColumn("held", F.greatest(F.lit(0), F.least(F.col("here"), F.col("_cap") - F.col("_ahead"))))
    stay = line.withColumn("here", F.col("held")).filter("here > 0")
    # all that is too many, as one line cut at the ends of the rooms
    spare = [max(0, r) for r in room]
    before = [e - o for e, o in zip(_ends(over), over, strict=True)]
    lo = _at(before, "shard") + F.greatest(F.lit(0), F.col("_ahead") - F.col("_cap"))
    gone = line.filter("here > held").withColumn("_lo", lo).withColumn("_hi", F.col("_lo") + F.col("here") - F.col("held"))
    rooms = ", ".join(f"named_struct('b', {b}, 'lo', {e - spare[b]}L, 'hi', {e}L)" for b, e in enumerate(_ends(spare)) if spare[b])
    parts = F.expr(f"filter(transform(array({rooms}), p -> named_struct('b', p.b, 'm', least(_hi, p.hi) - greatest(_lo, p.lo))), p -> p.m > 0)")
    gone = gone.withColumn("_part", F.explode(parts)).withColumn("shard", F.col("_part.b")).withColumn("here", F.col("_part.m"))
    cols = [*KEY, "n", "shard", "here"]
    return stay.select(*cols).unionByName(gone.select(*cols)).groupBy(*KEY, "n", "shard").agg(F.sum("here").alias("here"))


CELL = [*KEY, "n", "shard", "here"]


def _asked(cells: DataFrame, seed: int) -> DataFrame:
    """``cells`` of cut groups with ``to``, the label that most neighbours have.

    After the first round counts are weighed by a hash of the round, so that a round in which full shards have
    nothing to exchange isn't repeated. Documents go only to shards with as many neighbours as where they are
    or more, so each move saves links.
    """
    weighed = F.expr(f"here * (1 + pmod(xxhash64(`group`, shard, {seed}), 1024) / 1024D)") if seed else F.col("here")
    votes = cells.groupBy(*KEY).agg(F.max_by(F.struct(F.col("shard").alias("label"), F.col("here").alias("there")), F.struct(weighed, F.xxhash64("shard", "group"))).alias("best"))
    return cells.join(votes.select(*KEY, "best.*"), KEY).withColumn("to", F.expr("if(there >= here, label, shard)")).drop("label", "there")


def _exchanged(cells: DataFrame, room: list[int], rows: int, seed: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """New labels after one round of admitted moves, and how many documents went from which shard to which."""
    asked = _asked(cells, seed)
    want = {(r.shard, r.to): r.m for r in asked.filter("shard <> to").groupBy("shard", "to").agg(F.sum("here").alias("m")).collect()}  # a row per pair of shards
    flow = admitted(want, room)
    table = asked.sparkSession.createDataFrame([(*k, n) for k, n in flow.items()], "shard int, to int, _flow long")  # a row per pair of shards
    line = _ranked(asked.filter("shard <> to"), ["shard", "to"], rows).join(F.broadcast(table), ["shard", "to"], "left")
    moved = F.greatest(F.lit(0), F.least(F.col("here"), F.coalesce("_flow", F.lit(0)) - F.col("_ahead")))
    line = line.withColumn("_part", F.explode(F.array(F.struct(F.col("to").alias("b"), moved.alias("m")), F.struct(F.col("shard").alias("b"), (F.col("here") - moved).alias("m")))))
    both = line.select(*KEY, "n", F.col("_part.b").alias("shard"), F.col("_part.m").alias("here")).filter("here > 0").unionByName(asked.filter("shard = to").select(*CELL))
    return both.groupBy(*KEY, "n", "shard").agg(F.sum("here").alias("here")), flow


def _gathered(cells: DataFrame, room: list[int], rows: int, seed: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The same, where nothing can be exchanged: whole groups move to a shard that has room for what they lack there, larger ones first."""
    rooms = ", ".join(f"named_struct('b', {b}, 'r', {r}L)" for b, r in enumerate(room))
    groups = cells.groupBy(*KEY, "n").agg(F.map_from_entries(F.collect_list(F.struct("shard", "here"))).alias("has"))  # ``shards`` entries at most
    fits = F.expr(f"transform(filter(array({rooms}), s -> s.r >= n - coalesce(try_element_at(has, s.b), 0L)), s -> s.b)")
    groups = groups.withColumn("fits", fits).withColumn("to", F.expr(f"get(fits, cast(pmod(xxhash64(`group`, {seed}), greatest(size(fits), 1)) as int))")).filter("to is not null")
    groups = groups.withColumn("here", F.expr("n - coalesce(try_element_at(has, to), 0L)"))
    got = store.table(_ranked(groups.select(*KEY, "n", "to", "here"), ["to"], rows).filter(F.col("_ahead") + F.col("here") <= _at(room, "to")).select(*KEY, "to"), "gathered")
    asked = cells.join(got, KEY, "left").withColumn("to", F.coalesce("to", "shard"))
    flow = {(r.shard, r.to): r.m for r in asked.filter("shard <> to").groupBy("shard", "to").agg(F.sum("here").alias("m")).collect()}  # a row per pair of shards
    return asked.groupBy(*KEY, "n", F.col("to").alias("shard")).agg(F.sum("here").alias("here")), flow


def propagate(cells: DataFrame, room: list[int], rows: int, rounds: int = ROUNDS, report: Callable[[int, int], None] | None = None) -> tuple[list[DataFrame], list[int]]:
    """Final labels of ``cells`` (key, n, shard, here: documents of a group with that label), in parts, and the room left.

    ``report`` gets each round's number and the links that are cut after it (0: at the start).
    """
    done: list[DataFrame] = []
    links, uncut, stuck, k = _links(cells.select(*KEY, F.col("n").alias("here")).distinct()) if report else 0, 0, False, 0
    while True:
        # groups that lie in one shard are done and leave; the others go on
        cells = store.table(cells, "labels")
        done.append(cells.filter("here = n"))
        open_ = cells.filter("here < n")
        pairs = (F.col("here") * (F.col("here") - 1) / 2).cast("decimal(38,0)")
        now = cells.agg(F.sum(F.when(F.col("here") == F.col("n"), pairs)).alias("whole"), F.sum(F.when(F.col("here") < F.col("n"), pairs)).alias("cut"), F.count_if(F.col("here") < F.col("n")).alias("open")).first()
        uncut += int(now.whole or 0)
        if report:
            report(k, links - uncut - int(now.cut or 0))
        if k == rounds or not now.open:
            break
        k += 1
        cells, flow = (_gathered if stuck else _exchanged)(open_, room, rows, k - 1)
        few = sum(flow.values()) * 50 < now.open
        if not flow or few and not stuck:  # next to nothing left to exchange: groups are gathered once, then labels exchanged again
            if stuck:
                break
            cells, flow = _gathered(open_, room, rows, k)
            if not flow:
                break
        stuck = few
        for (i, j), n in flow.items():
            room[i] += n
            room[j] -= n
    return [*done, open_], room


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, report: Callable[[int, int], None] | None = None, kind: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group (hash of linked texts) of each row.

    ``kind`` names a column of ``docs``: shards then hold its values in even shares, and slots are in the order of the rows.
    """
    text = F.col("text")
    along = [F.xxhash64(F.col(f"`{kind}`").isNull(), f"`{kind}`").alias("kind"), store.place(docs).alias("place")] if kind else []
    slim = store.table(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("group"),
            F.monotonically_increasing_id().alias("rid"),
            *along,
        ), "slim")
    total = slim.count()
    quota = [total // shards + (b < total % shards) for b in range(shards)]
    room = list(quota)
    linked = slim.filter("group is not null").groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")
    sizes = store.table(linked, "sizes")
    # at most one a shard, so they are few
    giants = sizes.filter(F.col("n") > max(quota)).orderBy(F.desc("n"), *KEY).collect() if total else []
    whole = [(*s[:3], g.n, *s[3:]) for g in giants for s in _whole([g], quota, room)]
    pinned = docs.sparkSession.createDataFrame(whole, "`group` long, text_crc32 long, size long, n long, shard int, here long")  # 2 * shards rows at most

    # start labels: hashed, by the room that the others leave; at most ``shards`` rows a group, however many copies
    small = sizes.filter(F.col("n") <= max(quota, default=0))
    start = _pick(_ends(room), f"pmod(xxhash64(rid, 1), {max(1, sum(room))}L)")
    cells = slim.filter("group is not null").groupBy(*KEY, start.cast("int").alias("shard")).agg(F.count("*").alias("here"))
    cells = store.table(cells.join(small, KEY).select(*KEY, "n", "shard", "here"), "labels")
    load = {r.shard: r.m for r in cells.groupBy("shard").agg(F.sum("here").alias("m")).collect()}  # a row per shard
    left = [r - load.get(b, 0) for b, r in enumerate(room)]
    if min(left, default=0) < 0:
        cells = store.table(_fitted(cells.withColumn("_cap", _at(room, "shard")), left, total), "labels")
        load = {r.shard: r.m for r in cells.groupBy("shard").agg(F.sum("here").alias("m")).collect()}
        left = [r - load.get(b, 0) for b, r in enumerate(room)]
    parts, room = propagate(cells, left, total, rounds, report)

    # rows take the labels of their group: one row a group, so that a hot group can be split
    final = pinned
    for part in parts:
        final = final.unionByName(part.select(*pinned.columns))
    labels = F.array_sort(F.collect_list(F.struct("shard", "here")))  # ``shards`` entries at most
    where = store.table(final.groupBy(*KEY).agg(labels.alias("labels")), "where")
    placed = store.table(slim.join(where, KEY, "left"), "placed")
    one = placed.filter(F.size("labels") == 1).withColumn("shard", F.col("labels")[0]["shard"])
    cut = placed.filter(F.size("labels") > 1).withColumn("_part", scale.bucket(F.col("rid"), total))
    cut = scale.before(cut, KEY, ["_part"], [F.col("rid")], F.lit(1), "_rank")
    upto = lambda x: F.aggregate(F.filter("labels", lambda y: y.shard <= x.shard), F.lit(0).cast("long"), lambda s, y: s + y.here)
    cut = cut.withColumn("shard", F.filter("labels", lambda x: upto(x) > F.col("_rank"))[0]["shard"])
    rest = placed.filter("labels is null")
    if kind:
        rest = _in_turn(rest, room, total)
    else:
        rest = rest.withColumn("_all", F.lit(0)).withColumn("_bucket", scale.bucket(F.col("rid"), total))
        rest = scale.before(rest, ["_all"], ["_bucket"], [F.col("rid")], F.lit(1), "_rank").withColumn("shard", _pick(_ends(room), "_rank"))
    cols = ["doc_id", "size", "text_crc32", "group", "rid", "shard", *(["place"] if kind else [])]
    both = one.select(*cols).unionByName(cut.select(*cols)).unionByName(rest.select(*cols))
    # other buckets than those that chose the shards
    both = both.withColumn("_bucket", scale.stretch("place", total) if kind else scale.bucket(F.struct(F.lit(1), "rid"), total))
    out = scale.before(store.table(both, "sharded"), ["shard"], ["_bucket"], [F.col("place.row" if kind else "rid")], F.lit(1), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group")
