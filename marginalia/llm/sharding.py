"""Sharding by balanced label propagation, for documents that are linked by groups (here: equal texts).

Every document starts in a shard by the rank of its hash, so that shards are even. In each round, a group's members are
counted by shard; each linked document wants the shard that holds most of its group (itself included), among those with
room and its own, or in every other round among all. Between two shards, as many documents move as want to move back,
plus what the target has room for; whole groups come first in line. Rounds go on as long as they join members of groups.

What capacities leave cut is then finished on groups: those that are still in several shards, and fit into one, are moved
whole into the room that the other groups leave: large ones one by one, small ones laid along that room. At most one
small group for each border between two shards does not fit there; these take what room is left, and only a group that
finds no room anywhere stays cut.

Documents without links fill the shards afterwards, so they never stand in the way; shards then differ by at most one
document (law ``rows``). Links are never listed: a group is its key, and a round joins documents with one row for each
group (and salt, so that a frequent text is no single task).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.cluster import Scratch, row_order

SHARDS = 16
#: Parts of a group in joins.
SALTS = 8
#: A group with this part of a shard at least is placed by itself.
LARGE = 64


def _bits(value: Column) -> Column:
    return F.shiftrightunsigned(value, 4)


def _capacity(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _interval(rank: Column, widths: list[int]) -> Column:
    """The shard whose interval of ranks holds ``rank``."""
    ends, at = [], 0
    for width in widths:
        at += width
        ends.append(at)
    return F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= rank))


def _round(state: DataFrame, capacity: list[int], shards: int, turn: int) -> tuple[DataFrame, list[int]]:
    """(row, group, shard, wants): where each linked document would go in this round; and the room of each shard."""
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number for each shard
    room = [capacity[i] - load.get(i, 0) for i in range(shards)]
    counts = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    per_group = counts.groupBy(F.col("group").alias("_group")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.xxhash64("group", "shard").alias("turn"), F.col("shard").alias("at")))).alias("held"))
    open_shards = F.array(*(F.lit(i) for i in range(shards) if room[i] > 0)).cast("array<int>")
    salted = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = state.withColumn("_own", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, (F.col("group") == F.col("_group")) & (F.col("_own") == F.col("_salt")))
    largest = F.element_at("held", 1)["at"]
    # in every second round: the largest among those with room and the own, if the largest of all is full
    within = F.element_at(F.filter("held", lambda h: F.array_contains(open_shards, h["at"]) | (h["at"] == F.col("shard"))), 1)["at"]
    wants = within if turn % 2 else largest
    return joined.select("row", "group", "shard", F.coalesce(wants, F.col("shard")).alias("wants")), room


def _allowed(flows: dict[tuple[int, int], int], room: list[int], shards: int) -> dict[tuple[int, int], int]:
    """How many documents may move between each two shards: exchanges, then what the target has room for."""
    allowed = {(s, t): min(n, flows.get((t, s), 0)) for (s, t), n in flows.items()}
    for t in range(shards):
        free = room[t]
        for s in sorted(range(shards), key=lambda s: (-flows.get((s, t), 0), s)):
            more = min(max(0, free), flows.get((s, t), 0) - allowed.get((s, t), 0))
            if more > 0:
                allowed[s, t] += more
                free -= more
    return {k: n for k, n in allowed.items() if n > 0}


def _joined(state: DataFrame) -> int:
    """How many documents are in the shard that holds most of their group."""
    counts = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0


def propagate(linked: DataFrame, capacity: list[int], scratch: Scratch) -> DataFrame:
    """(row, group, shard) after label propagation over ``linked`` (row, group), which must fit into ``capacity``.

    Rounds end when two in a row, one of each kind, join no more documents with most of their group. That number grows
    otherwise and is at most that of the documents, so they do end.
    """
    shards = len(capacity)
    total = linked.count()
    even = _capacity(total, shards)
    start = row_order(linked, [], ["row"], _bits(F.xxhash64(F.lit("start"), "row")), total=total)
    state = scratch.table(start.select("row", "group", _interval(F.col("rank"), even).cast("int").alias("shard")), "round0")
    best, still, turn = _joined(state) if total else 0, 0, 0
    while total and still < 2 and best < total:
        wanted, room = _round(state, capacity, shards, turn)
        wanted = scratch.table(wanted, f"wanted{turn}")
        # at most shards**2 numbers
        flows = {(r["shard"], r["wants"]): r["n"] for r in wanted.filter("shard <> wants").groupBy("shard", "wants").agg(F.count(F.lit(1)).alias("n")).collect()}
        allowed = _allowed(flows, room, shards)
        turn += 1
        if not allowed:
            still += 1
            scratch.drop(f"wanted{turn - 1}")
            continue
        limits = F.create_map(*(F.lit(x) for (s, t), n in allowed.items() for x in (s * shards + t, n)))
        movers = row_order(wanted.filter("shard <> wants"), ["shard", "wants"], ["group", "row"], _bits(F.xxhash64("group")), total=sum(flows.values()))
        goes = movers.filter(F.col("rank") < F.coalesce(F.try_element_at(limits, F.col("shard") * shards + F.col("wants")), F.lit(0)))
        moved = wanted.join(goes.select("row", F.col("wants").alias("to")), "row", "left").select("row", "group", F.coalesce("to", "shard").alias("shard"))
        after = scratch.table(moved, f"round{turn}")
        now = _joined(after)
        if now > best:
            best, still, state = now, 0, after
        else:  # a round that joins nothing is not kept
            still += 1
    return _finished(state, capacity, scratch) if best < total else state


def _finished(state: DataFrame, capacity: list[int], scratch: Scratch) -> DataFrame:
    """Groups that are cut, moved whole into the room that the others leave; those larger than a shard fill the emptiest.

    Large groups, a LARGE part of a shard at least, are few (no more than shards * LARGE) and placed one by one, the
    largest first, where they leave the least room. The others are laid along the room that remains.
    """
    shards, most = len(capacity), max(capacity)
    groups = state.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    cut = scratch.table(groups.filter("low < high").select("group", "n"), "cut")
    if cut.isEmpty():
        return state
    stays = state.join(cut.select("group"), "group", "left_anti")
    load = {r["shard"]: r["n"] for r in stays.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number for each shard
    free = [capacity[i] - load.get(i, 0) for i in range(shards)]
    parts: dict[int, list[tuple[int, int]]] = {}  # group -> (members, shard)

    def put(group: int, n: int, split: bool) -> bool:
        fits = [i for i in range(shards) if free[i] >= n]
        places = [min(fits, key=lambda i: (free[i], i))] if fits else sorted(range(shards), key=lambda i: (-free[i], i)) if split else []
        for i in places:
            part = min(n, free[i])
            if part:
                parts.setdefault(group, []).append((part, i))
                free[i], n = free[i] - part, n - part
        return bool(places)

    large = cut.filter(F.col("n") * LARGE >= most).collect()
    homeless = [r for r in sorted(large, key=lambda r: (-r["n"], r["group"])) if not put(r["group"], r["n"], r["n"] > most)]
    small = cut.filter(F.col("n") * LARGE < most)
    room = list(free)
    laid = row_order(small, [], ["group"], _bits(F.xxhash64("group")), sums={"before": "n"})
    laid = scratch.table(laid.select("group", "n", "before", _interval(F.col("before"), room).alias("at"), _interval(F.col("before") + F.col("n") - 1, room).alias("stop")), "laid")
    for r in laid.filter("at = stop AND at < " + str(shards)).groupBy("at").agg(F.sum("n").alias("n")).collect():
        free[r["at"]] -= r["n"]
    # at most one for each border; and what the room of unplaced large groups does not hold
    homeless += laid.filter("at <> stop OR at >= " + str(shards)).collect()
    for r in sorted(homeless, key=lambda r: (-r["n"], r["group"])):
        put(r["group"], r["n"], True)
    members = state.join(cut.select("group"), "group", "left_semi").select("row", "group")
    whole = laid.filter("at = stop AND at < " + str(shards)).select("group", F.col("at").cast("int").alias("to"))
    out = stays.select("row", "group", "shard").unionByName(members.join(whole, "group").select("row", "group", F.col("to").alias("shard")))
    if parts:
        placed = state.sparkSession.createDataFrame([(g, [i for _, i in p], np.cumsum([n for n, _ in p]).tolist()) for g, p in parts.items()], "group long, to array<int>, ends array<long>")
        ranked = row_order(members.join(F.broadcast(placed), "group"), ["group"], ["row"], _bits(F.xxhash64("row")))
        out = out.unionByName(ranked.select("row", "group", F.element_at("to", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1).alias("shard")))
    return scratch.table(out, "finished")


def shard_documents(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``documents``; the law is ``rows``.

    ``size`` is the UTF-8 bytes of the text plus 1. Documents with equal texts are linked; each such group ends in one
    shard unless it fits nowhere (see the module). Texts are read whole, however long. ``slot`` counts from 0 in each shard without gaps, copies next to each other. Null
    texts have size 1, a null checksum and no links. Repeated rows are documents of their own, null ids are kept, an
    empty table gives an empty result, and other columns play no part.
    """
    scratch = Scratch(documents.sparkSession, "shards")
    text = F.col(text_column).cast("string")
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.length(text)).alias("content"), text.isNull().alias("none"))
    # equal rows differ by their number only, so it does not matter which gets which
    rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "content", "none").orderBy("size")))
    rows = scratch.table(rows.withColumn("row", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("content"), F.col("none").cast("string"), F.col("twin").cast("string"))).withColumn("group", F.when(~F.col("none"), F.xxhash64("content", "text_crc32", "size"))), "rows")
    groups = rows.filter("group IS NOT NULL").groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    linked = scratch.table(rows.join(groups, "group", "left_semi").select("row", "group"), "linked")
    total = rows.count()
    capacity = _capacity(total, shards)
    state = propagate(linked, capacity, scratch)
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = rows.join(state.select("row"), "row", "left_anti").select("row")
    rest = [capacity[i] - load.get(i, 0) for i in range(shards)]
    filled = row_order(single, [], ["row"], _bits(F.xxhash64(F.lit("fill"), "row")), total=sum(rest))
    placed = state.select("row", "shard").unionByName(filled.select("row", _interval(F.col("rank"), rest).cast("int").alias("shard")))
    located = rows.join(placed, "row").select("doc_id", "size", "text_crc32", "row", "group", "shard")
    slotted = row_order(located, ["shard"], ["group", "doc_id", "row"], _bits(F.when(F.col("group").isNotNull(), F.xxhash64("group")).otherwise(F.xxhash64("row"))), total=total)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
