"""Shards against a brute-force optimum of cut links on small graphs."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.cluster import Scratch
from marginalia.llm import sharding


def cut_links(sizes, places):
    """Links between documents of one group in different shards; ``places`` has a Counter of shards for each group."""
    return sum((n * n - sum(c * c for c in own.values())) // 2 for n, own in zip(sizes, places, strict=True))


def fewest_cut(sizes, capacity):
    """The optimum over all ways to deal groups of up to three members to two shards."""
    best = None
    for split in itertools.product(*(range(n + 1) for n in sizes)):
        if sum(split) <= capacity[0] and sum(sizes) - sum(split) <= capacity[1]:
            cost = sum(k * (n - k) for n, k in zip(sizes, split, strict=True))
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("sizes", [[2, 2, 2, 2], [3, 3, 2], [4, 3, 3, 2], [5, 4, 3], [2] * 7, [6, 2, 2, 2]])
def test_links_cut_are_the_fewest(spark, sizes):
    rows = [(f"{g}/{i}", g) for g, n in enumerate(sizes) for i in range(n)]
    total = sum(sizes)
    capacity = [total - total // 2, total // 2]
    got = sharding.propagate(spark.createDataFrame(rows, "row string, group long"), capacity, Scratch(spark, "t")).collect()
    load, places = Counter(r["shard"] for r in got), defaultdict(Counter)
    for r in got:
        places[r["group"]][r["shard"]] += 1
    assert len(got) == total and all(load[i] <= capacity[i] for i in load)
    least = fewest_cut(sizes, capacity)
    assert cut_links(sizes, [places[g] for g in range(len(sizes))]) <= 2 * least


def test_every_group_that_fits_is_whole(spark):
    rnd = random.Random(4)
    sizes = [400, 150] + [rnd.randrange(2, 12) for _ in range(120)]
    rows = [(1000 * g + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
    rows += [(10**6 + i, f"single {i}") for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards, loads = defaultdict(set), Counter(r["shard"] for r in got)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    most = -(-len(rows) // 16)
    whole = [len(shards[zlib.crc32(f"group {g}".encode())]) for g in range(len(sizes))]
    assert max(loads.values()) - min(loads.values()) <= 1
    assert all(n == 1 for n, size in zip(whole, sizes, strict=True) if size <= most) and whole[0] >= -(-400 // most)


def test_very_long_and_repeated_texts(spark):
    long = "x " * 600_000
    rows = [(1, long), (2, long), (1, long), (3, None), (None, None), (4, ""), (5, ""), (6, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "group": F.lit("x"), "size": F.lit("clash")})
    got = sharding.shard_documents(frame).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got if r["text_crc32"] is not None) == sorted((k or 0, len(t) + 1, zlib.crc32(t.encode())) for k, t in rows if t is not None)
    assert [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)] == [[0]] * 8 + [[]] * 8
    assert sorted(tuple(r) for r in got if r["text_crc32"] is not None) == sorted(tuple(r) for r in sharding.shard_documents(frame).collect() if r["text_crc32"] is not None)
