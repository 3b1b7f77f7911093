"""Mixing sources to target weights, with DataFrame and SQL functions only.

Texts are cut into blocks of ``BLOCK_WORDS`` words. A source's blocks are permuted by a hash; its target in words says
how many blocks of the permutation the mix needs: its quota. A source whose target is above its size needs all of its
blocks once and goes on with a second permutation, so no block is taken more than twice. A (source, pass) is a stratum.

Quotas are dealt to output shards by a splitting tree: a node's quotas, one for each stratum, are split between its
halves by a multivariate hypergeometric draw, until each leaf, a shard, has its exact quotas. Shards thus get the
composition that a shuffle of all blocks would give them. Each shard then draws its quota of every stratum: the next
blocks of the permutation, after those of the shards before it. Shards are disjoint and need no global shuffle; inside
a shard, blocks are ordered by another hash. What a document contributes is the sum of what shards drew of it; only the
last block of a stratum is cut, to the words still missing.

Strata are many where sources are hosts. They are dealt in groups of at most ``FANOUT``: the tree first deals the totals
of groups of groups, then each group deals its own share among its members, each level in parallel. What a row must know of all this is a few cuts for
its source, so that texts and blocks need no join by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.cluster import Scratch, row_order

#: A word, and the number of words in a block.
WORD, BLOCK_WORDS = r"[^\x20\x09-\x0D]+", 256
WEIGHTS, SHARE, MOST_TIMES, SHARDS = (3, 1, 2), 1.5, 2, 16
#: Strata, or groups of them, that are dealt in one row.
FANOUT = 256


def _hash(*parts: Column | str) -> Column:
    """32 hexadecimal digits that both Spark and other engines compute alike."""
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"))


def _bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch | None = None, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh ``weights`` in turn. Together the targets are ``share`` times all sizes; no
    target exceeds ``most`` times its source's size, and the excess is shared again by weight. That is a common level L
    with target = min(L * weight, most * size). L rises from the level without bounds, each time by what the sources
    that it fills leave over, until it fills no more; each step is one sum over the sources, wherever they lie. Sizes
    are whole numbers below 2**53, so the sums are exact in any order.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "targets")
    per_source = scratch.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    weighed = _places(per_source, scratch).withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    weighed = scratch.table(weighed.drop("place"), "weighed")
    everything, heavy = weighed.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, before = None, -1
    while heavy:
        reached = F.lit(False) if level is None else F.col("bound") / F.col("weight") < level
        filled, full, rest = weighed.agg(F.count_if(reached), F.coalesce(F.sum(F.when(reached, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~reached, F.col("weight"))), F.lit(0.0))).first()
        if filled == before or not rest:  # with no source left open, all targets are bounds
            level = level if rest else None
            break
        level, before = (everything * share - full) / rest, filled
    target = F.col("bound") if level is None else F.when(F.col("bound") / F.col("weight") <= level, F.col("bound")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", target.alias("target"))


def _places(per_source: DataFrame, scratch: Scratch) -> DataFrame:
    """``place``: the rank of each source by code point from 0, null last; by ranges, so that no task ranks them all."""
    ranged = per_source.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranged")  # written once: a range keeps its number
    counts = ranged.groupBy(F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return ranged.join(counts, F.col("part") == F.col("_part")).withColumn("place", F.col("_base") + inside - 1).drop("part", "_part", "_base")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_factorials(*numbers: Column) -> Column:
    """An array of ln n! by Stirling's series at n + 10, to about 1e-12."""

    def one(n: Column) -> Column:
        x = n + 11.0
        down = n + 1.0
        for k in range(2, 11):
            down = down * (n + float(k))
        return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) - F.log(down)

    return F.transform(F.array(*numbers), one)


def _hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """A draw by inversion: how many of ``good`` among ``total`` are in ``draws`` without replacement.

    The distribution is summed from its mode outwards, alternating between both sides, until it exceeds ``uniform``.
    """

    def with_mode(v: Column) -> Column:
        g, t, d, low, high, mode = (v[k] for k in ("g", "t", "d", "low", "high", "mode"))
        logs = _log_factorials(g, mode, g - mode, t - g, d - mode, t - g - d + mode, t, d, t - d)
        signs = (1, -1, -1, 1, -1, -1, -1, 1, 1)
        at_mode = F.exp(_let(logs, lambda f: sum((F.element_at(f, i + 1) * float(sign) for i, sign in enumerate(signs)), F.lit(0.0))))
        share = g / F.greatest(t, F.lit(1.0))
        steps = F.least(high - low, F.ceil(12 * F.sqrt(d * share * (1 - share) + 1)).cast("double") + 8).cast("int")
        start = _let(at_mode, lambda p: F.struct(p.alias("up"), p.alias("down"), p.alias("sum"), F.when(v["u"] <= p, mode).alias("found")))

        def step(state: Column, i: Column) -> Column:
            x, y = mode + i, mode - i
            up = F.when(x <= high, state["up"] * (g - x + 1) * (d - x + 1) / (x * (t - g - d + x))).otherwise(0.0)
            down = F.when(y >= low, state["down"] * (y + 1) * (t - g - d + y + 1) / ((g - y) * (d - y))).otherwise(0.0)

            def settle(s: Column) -> Column:
                found = F.coalesce(state["found"], F.when((s["up"] > 0) & (v["u"] <= state["sum"] + s["up"]), x), F.when((s["down"] > 0) & (v["u"] <= state["sum"] + s["up"] + s["down"]), y))
                return F.struct(s["up"].alias("up"), s["down"].alias("down"), (state["sum"] + s["up"] + s["down"]).alias("sum"), found.alias("found"))

            moved = _let(F.struct(up.alias("up"), down.alias("down")), settle)
            return F.when(state["found"].isNotNull(), state).otherwise(moved)

        each = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
        return F.coalesce(F.aggregate(each, start, step)["found"], mode).cast("long")

    def with_bounds(v: Column) -> Column:
        mode = F.least(v["high"], F.greatest(v["low"], F.floor((v["d"] + 1) * (v["g"] + 1) / (v["t"] + 2)).cast("double")))
        return _let(F.struct(*(v[k].alias(k) for k in ("g", "t", "d", "u", "low", "high")), mode.alias("mode")), with_mode)

    g, t, d = good.cast("double"), total.cast("double"), draws.cast("double")
    return _let(F.struct(g.alias("g"), t.alias("t"), d.alias("d"), uniform.alias("u"), F.greatest(F.lit(0.0), d + g - t).alias("low"), F.least(g, d).alias("high")), with_bounds)


def _deal(groups: DataFrame, shards: int, seed: str, draw: Callable = _hypergeometric) -> DataFrame:
    """(group, key, n, shares): each member's number for each shard.

    ``groups`` has (group, members: array of (key, n), ends: what the group has in the shards up to each, from 0). The
    splitting tree: a node holds the members' numbers in the shards [first, last) and splits them between its halves.
    """
    nodes = groups.select("group", "members", "ends", F.lit(0).alias("first"), F.lit(shards).alias("last"), F.transform("members", lambda m: m["n"]).alias("counts"))
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        single = F.col("last") - F.col("first") < 2
        nodes = nodes.withColumn("middle", F.when(single, F.col("last")).otherwise(F.floor((F.col("first") + F.col("last")) / 2).cast("int")))
        draws = F.element_at("ends", F.col("middle") + 1) - F.element_at("ends", F.col("first") + 1)
        whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
        start = F.struct(whole.alias("total"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))

        def take(state: Column, item: Column) -> Column:
            taken = F.when(state["draws"] >= state["total"], item["n"]).when(item["n"] == state["total"], state["draws"]).otherwise(draw(item["n"], state["total"], state["draws"], item["u"]))
            return _let(taken, lambda n: F.struct((state["total"] - item["n"]).alias("total"), (state["draws"] - n).alias("draws"), F.concat(state["out"], F.array(n)).alias("out")))

        uniform = lambda i: (F.conv(F.substring(_hash(F.lit(seed), F.col("group"), F.col("first").cast("string"), F.col("last").cast("string"), i.cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
        items = F.transform("counts", lambda n, i: F.struct(n.alias("n"), uniform(i).alias("u")))
        nodes = nodes.withColumn("left", F.aggregate(items, start, take)["out"])
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        children = F.array(F.struct(F.col("first").alias("a"), F.col("middle").alias("b"), F.col("left").alias("c")), F.struct(F.col("middle").alias("a"), F.col("last").alias("b"), right.alias("c")))
        nodes = nodes.select("group", "members", "ends", F.explode(children).alias("n")).filter("n.a < n.b").select("group", "members", "ends", F.col("n.a").alias("first"), F.col("n.b").alias("last"), F.col("n.c").alias("counts"))
    leaves = nodes.select("group", "first", F.explode(F.arrays_zip("members", "counts")).alias("z")).select("group", "first", F.col("z.members.key").alias("key"), F.col("z.members.n").alias("n"), F.col("z.counts").alias("share"))
    return leaves.groupBy("group", "key", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "share"))), lambda x: x["share"]).alias("shares"))


def _ends(shares: Column) -> Column:
    """Running sums of an array, from 0."""
    return F.aggregate(shares, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def shard_quotas(quotas: DataFrame, *, shards: int = SHARDS, seed: str = "mix", fanout: int = FANOUT, draw: Callable = _hypergeometric) -> DataFrame:
    """(source, pass, starts): where each shard's interval of a stratum's permutation starts; the last entry ends it.

    ``quotas`` has (source, pass, quota). The sums over strata are the shards' sizes, equal up to one block.
    """
    key = _hash(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")), F.col("pass").cast("string"))
    level = quotas.select("source", "pass", key.alias("key"), F.col("quota").cast("long").alias("n"))
    counted = quotas.agg(F.count(F.lit(1)).alias("n"), F.sum("quota").alias("all")).first()
    strata, total = counted["n"], counted["all"] or 0
    # groups by leading digits of the key, as many as hold at most half of fanout on average; the top is one group
    depth = 0
    while strata > fanout // 2 * 16**depth:
        depth += 1
    levels = [level.select(F.substring("key", 1, depth).alias("group"), "key", "n")]
    for digits in range(depth, 0, -1):
        above = levels[-1].groupBy(F.col("group").alias("key")).agg(F.sum("n").alias("n"))
        levels.append(above.select(F.substring("key", 1, digits - 1).alias("group"), "key", "n"))
    top = F.array(*(F.lit(total * j // shards).cast("long") for j in range(shards + 1)))
    dealt = None
    for members in reversed(levels):
        groups = members.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("members"))
        if dealt is None:
            groups = groups.withColumn("ends", top)
        else:
            groups = groups.join(dealt.select(F.col("key").alias("group"), _ends(F.col("shares")).alias("ends")), "group")
        dealt = _deal(groups, shards, seed, draw)
    named = level.select("source", "pass", "key")
    return named.join(dealt.select("key", "shares"), "key").select("source", "pass", _ends(F.col("shares")).alias("starts"))


def _numbered(frame: DataFrame, keys: list[str], tie: Column) -> DataFrame:
    """``twin``: 1, or the place among rows of equal ``keys``, which must not be null where they differ. Only rows that
    repeat are ranked."""
    several = frame.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if several.isEmpty():
        return frame.withColumn("twin", F.lit(1))
    ranked = frame.join(several, match, "left_semi").withColumn("twin", F.row_number().over(Window.partitionBy(*keys).orderBy(tie)))
    return frame.join(several, match, "left_anti").withColumn("twin", F.lit(1)).unionByName(ranked)


def _identified(documents: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = F.col(f"`{text_column}`").cast("string")
    return documents.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("content"), F.struct(F.col("*")).alias("_row"))


def sized(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size, content, twin): the number of words of each row; ``twin`` numbers rows with equal id, source and text."""
    return _numbered(_identified(documents, id_column, text_column, source_column).drop("_row"), ["doc_id", "source", "content"], F.col("size"))


#: Sources whose cuts may be broadcast: about 40 MB; with more, the join is salted.
BROADCAST_SOURCES = 10_000
#: Words of a chunk of a shard: what one task sorts.
CHUNK_WORDS = 4_000_000


def _name(seed: str, number: Column, block: Column) -> Column:
    """The digest that a block of a row (doc_id, twin) has in a pass."""
    return _hash(F.lit(seed), number.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("twin").cast("string"), block.cast("string"))


def _block_words(block: Column) -> Column:
    return F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("size") - block * BLOCK_WORDS)


def draw_quotas(rows: DataFrame, scratch: Scratch, *, shards: int = SHARDS, seed: str = "mix", fanout: int = FANOUT, draw: Callable = _hypergeometric, **shares) -> DataFrame:
    """(source, source_size, target, passes): for each source, what the shards draw in each pass.

    An entry of ``passes`` holds the pass, ``starts`` (where in the permutation, by digest and content, each shard's
    interval starts), ``last`` (the last block that any shard draws) and ``last_words`` (what it gives). These are all
    that a row needs to know the fate of its blocks.
    """
    targets = scratch.table(source_targets(rows, scratch, **shares), "targets")
    goal = targets.select(F.col("source").alias("_source"), "source_size", F.floor("target").cast("long").alias("goal"))
    blocks = rows.filter("size > 0").join(goal, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    passes = F.filter(F.array(*(F.struct(F.lit(p).alias("pass"), F.least("source_size", F.greatest(F.lit(0), F.col("goal") - F.lit(p) * F.col("source_size"))).alias("wanted")) for p in range(shares.get("most", MOST_TIMES)))), lambda p: p["wanted"] > 0)
    blocks = blocks.select("doc_id", "source", "content", "twin", "size", F.explode(passes).alias("p"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK_WORDS)).alias("each"))
    blocks = blocks.select("doc_id", "source", "content", "twin", "size", "p.pass", "p.wanted", F.explode("each").alias("block"))
    blocks = blocks.withColumn("words", _block_words(F.col("block"))).withColumn("digest", _name(seed, F.col("pass"), F.col("block")))
    total = rows.agg(F.sum(F.ceil(F.col("size") / BLOCK_WORDS)) * 2).first()[0] or 0
    ranked = row_order(blocks.select("source", "pass", "wanted", "digest", "content", "words"), ["source", "pass"], ["digest", "content"], _bits(F.col("digest")), sums={"before": "words"}, total=int(total), per_task=4_000)
    needed = scratch.table(ranked.filter(F.col("before") < F.col("wanted")).select("source", "pass", "digest", "content", F.least("words", F.col("wanted") - F.col("before")).alias("words"), "rank"), "permuted")
    # the blocks that the target needs are the quota; which of them a shard draws, the tree decides
    quotas = scratch.table(needed.groupBy("source", "pass").agg(F.count(F.lit(1)).alias("quota")), "quotas")
    starts = scratch.table(shard_quotas(quotas, shards=shards, seed=seed, fanout=fanout, draw=draw).select(F.col("source").alias("_source"), F.col("pass").alias("_pass"), "starts"), "starts")
    edges = needed.join(starts, needed["source"].eqNullSafe(F.col("_source")) & (needed["pass"] == F.col("_pass")))
    edges = edges.filter(F.array_contains("starts", F.col("rank")) | (F.col("rank") == F.element_at("starts", -1) - 1))  # at most one more than shards
    found = edges.groupBy("source", "pass", "starts").agg(F.collect_list(F.struct("rank", F.struct("digest", "content").alias("at"), "words")).alias("e"))
    of = lambda rank: F.element_at(F.filter("e", lambda x: x["rank"] == rank), 1)
    beyond = F.struct(F.lit("g").alias("digest"), F.lit(0).cast("long").alias("content"))  # after all hexadecimal digits: an empty interval at the end
    cut = F.transform(F.slice("starts", 1, shards), lambda s: F.when(s < F.element_at("starts", -1), F.get(F.filter("e", lambda x: x["rank"] == s), F.lit(0))["at"]).otherwise(beyond))
    last = of(F.element_at("starts", -1) - 1)
    per_pass = found.select("source", F.struct("pass", cut.alias("starts"), last["at"].alias("last"), last["words"].alias("last_words")).alias("p"))
    per_source = per_pass.groupBy(F.col("source").alias("_source")).agg(F.array_sort(F.collect_list("p")).alias("passes"))
    return scratch.table(targets.join(per_source, targets["source"].eqNullSafe(F.col("_source")), "left").drop("_source"), "cuts")


def _drawn(seed: str) -> Column:
    """What shards draw of a row (doc_id, content, twin, size, passes): an array of (pass, block, shard, words)."""

    def of_pass(p: Column) -> Column:
        def of_block(block: Column) -> Column:
            def placed(at: Column) -> Column:
                shard = F.size(F.filter(p["starts"], lambda s: s <= at)) - 1  # of equal starts the last: an empty interval starts where the next one does
                return F.struct(p["pass"].alias("pass"), block.alias("block"), F.when(at <= p["last"], shard).otherwise(-1).alias("shard"), F.when(at == p["last"], p["last_words"]).otherwise(_block_words(block)).alias("words"))

            return _let(F.struct(_name(seed, p["pass"], block).alias("digest"), F.col("content").alias("content")), placed)

        return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK_WORDS)), of_block)

    found = F.filter(F.flatten(F.transform("passes", of_pass)), lambda x: x["shard"] >= 0)
    return F.when((F.col("size") > 0) & F.col("passes").isNotNull(), found).otherwise(F.array().cast("array<struct<pass:int,block:bigint,shard:int,words:bigint>>"))


def _beside(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each row with the cuts of its source; a frequent source is spread over salts where cuts are too many to broadcast."""
    cuts = cuts.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if cuts.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(cuts), same, "left").drop("_source")
    salts = 64
    spread = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_own", F.pmod(F.xxhash64("doc_id", "content"), F.lit(salts)).cast("int")).join(spread, same & (F.col("_own") == F.col("_salt")), "left").drop("_source", "_own", "_salt")


def take_blocks(rows: DataFrame, scratch: Scratch, *, seed: str = "mix", **options) -> tuple[DataFrame, DataFrame]:
    """(cuts, drawn): ``drawn`` has a row for each block that a shard draws.

    Its columns: doc_id, source, content, twin, pass, block, words (taken of it), shard, place (the order in the shard).
    """
    cuts = draw_quotas(rows, scratch, seed=seed, **options)
    drawn = _beside(rows, cuts).select("doc_id", "source", "content", "twin", F.explode(_drawn(seed)).alias("d"))
    return cuts, drawn.select("doc_id", "source", "content", "twin", "d.pass", "d.block", "d.words", "d.shard", _name(f"{seed}-place", F.col("d.pass"), F.col("d.block")).alias("place"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def mix_sources(documents: DataFrame, *, with_shards: bool = False, seed: str = "mix", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``documents``; see the module for how words are drawn.

    ``size`` counts words (null text: 0), ``target`` and ``source_size`` are those of the row's source, ``taken`` counts
    the words that the shards draw of the row, at most twice its size; ``with_shards`` adds ``shards``, an array of
    (shard, words). A source gives exactly its target, rounded down. A null source is a source of its own, the last in
    order. Repeated rows are documents of their own. Null ids are kept. Texts are counted whole, however long. Sources
    without words have target 0; an empty table gives an empty result; other columns play no part, whatever their names.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    rows = scratch.table(sized(documents), "rows")
    cuts = draw_quotas(rows, scratch, seed=seed, **options)
    scratch.drop("permuted", "ranged", "sources", "weighed", "quotas", "starts")
    found = _beside(rows, cuts).withColumn("_drawn", _drawn(seed))
    own = F.array_sort(F.array_distinct(F.transform("_drawn", lambda d: d["shard"])))
    shards = F.transform(own, lambda s: F.struct(s.alias("shard"), _sum(F.transform(F.filter("_drawn", lambda d: d["shard"] == s), lambda d: d["words"])).alias("words")))
    found = found.select("doc_id", "size", "source_size", "target", shards.alias("shards"))
    return found.select("doc_id", "size", "source_size", "target", _sum(F.transform("shards", lambda x: x["words"])).alias("taken"), *["shards"] * with_shards)


def mixed_documents(documents: DataFrame, *, text_column: str = "text", seed: str = "mix", **options) -> DataFrame:
    """The mix as rows of ``documents``, shard after shard: a row for each pass and shard that draws words of a document.

    A document of which one shard draws all words in a pass keeps its text as it is; else the blocks that the shard drew
    follow each other, words joined by one space. Shards are written in chunks, a partition each, whose rows follow the
    hash of their first block; a text moves once, to its chunk. All other columns stay as they are (``n_chars`` is
    counted anew). Documents of which nothing is drawn are not in the mix; an empty table gives an empty mix.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    shards = options.get("shards", SHARDS)
    rows = scratch.table(sized(documents, text_column=text_column), "rows")
    cuts = draw_quotas(rows, scratch, seed=seed, **options)
    scratch.drop("rows", "permuted", "ranged", "sources", "weighed", "quotas", "starts")
    words = cuts.agg(F.sum(F.floor("target"))).first()[0] or 0
    chunks = max(1, math.ceil(words / shards / CHUNK_WORDS))
    packed = _numbered(_identified(documents, "doc_id", text_column, "source"), ["doc_id", "source", "content"], F.xxhash64(*(F.col(f"_row.`{c}`") for c in _hashable(documents))))
    found = _beside(packed, cuts).withColumn("_drawn", _drawn(seed)).filter(F.size("_drawn") > 0)
    owners = F.array_distinct(F.transform("_drawn", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))))
    parts = F.transform(owners, lambda o: F.struct(o["pass"].alias("pass"), o["shard"].alias("shard"), F.filter("_drawn", lambda d: (d["pass"] == o["pass"]) & (d["shard"] == o["shard"])).alias("blocks")))
    found = found.withColumn("_parts", parts)
    whole = F.col(f"_row.`{text_column}`").cast("string")
    all_of = lambda p: _sum(F.transform(p["blocks"], lambda d: d["words"])) == F.col("size")
    found = found.withColumn("_words", F.when(F.exists("_parts", lambda p: ~all_of(p)), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))))
    cut = lambda p: F.array_join(F.flatten(F.transform(p["blocks"], lambda d: F.slice("_words", (d["block"] * BLOCK_WORDS + 1).cast("int"), d["words"].cast("int")))), " ")
    texts = F.transform("_parts", lambda p: F.struct(p["shard"].alias("shard"), p["pass"].alias("pass"), _name(f"{seed}-place", p["pass"], F.element_at(p["blocks"], 1)["block"]).alias("place"), F.when(all_of(p), whole).otherwise(cut(p)).alias("text")))
    dealt = found.select("_row", F.explode(texts).alias("p"))
    columns = []
    for i, c in enumerate(documents.columns):
        value = F.col("p.text") if c == text_column else F.length("p.text").cast(documents.schema[c].dataType) if c == "n_chars" else F.col(f"_row.`{c}`")
        columns.append(value.alias(f"_c{i}"))
    chunk = F.col("p.shard") * chunks + F.shiftright(F.conv(F.substring("p.place", 1, 8), 16, 10).cast("long") * chunks, 32).cast("int")
    out = dealt.select(chunk.alias("_chunk"), F.col("p.place").alias("_place"), *columns)
    out = out.repartitionById(shards * chunks, F.col("_chunk")).sortWithinPartitions("_chunk", "_place")
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(documents.columns)))


def _hashable(frame: DataFrame) -> list[str]:
    """The columns that a hash can take."""
    return [name for name, kind in frame.dtypes if "map<" not in kind and "variant" not in kind]


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight
    FROM d GROUP BY source
), b AS (
    SELECT *, 2.0::DOUBLE * source_size AS bound FROM s
), l AS (
    SELECT *, ((SELECT sum(source_size) FROM b)::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(bound) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / ((SELECT sum(weight) FROM b)
                 - coalesce(sum(weight) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM b
), v AS (
    SELECT max(level) AS level FROM l WHERE level <= bound / weight
), t AS (
    SELECT source, source_size, CASE WHEN bound / weight <= v.level THEN bound ELSE coalesce(v.level * weight, bound) END AS target FROM l, v
), k AS (
    SELECT d.doc_id, d.source, p.p, x.x AS block, least(256, d.size - 256 * x.x) AS words,
           least(t.source_size, greatest(0, floor(t.target)::BIGINT - p.p * t.source_size)) AS wanted
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(p), unnest(range((d.size + 255) // 256)) x(x)
), r AS (
    SELECT *, sum(words) OVER (PARTITION BY source, p ORDER BY md5('mix|' || p || '|' || doc_id || '|1|' || block)) - words AS before FROM k WHERE wanted > 0
), g AS (
    SELECT doc_id, sum(least(words, wanted - before))::BIGINT AS taken FROM r WHERE before < wanted GROUP BY doc_id
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON d.doc_id = g.doc_id
"""
