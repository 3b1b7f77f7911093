from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.cluster import Scratch
from marginalia.llm import mixing


def level_by_steps(sizes, share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 10, "d": 7, None: 400}, {"a": 0, "b": 30}, {"a": 1}, {"a": 0}])
def test_targets_agree_with_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(level_by_steps(sizes))


def test_mix_takes_exactly_the_targets(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i * 37 % 900)), None if i % 7 == 0 else f"s{i % 5}") for i in range(80)]
    texts += [(500, None, "s1"), (501, "", None), (502, " \n ", "s2"), (3, texts[3][1], texts[3][2]), (None, "x y z", "s0"), (None, "x y z", "s0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts)
    taken, goal = defaultdict(int), {}
    source_of = {i: s for i, _, s in texts if i is not None} | {None: "s0"}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
        goal[source_of[r["doc_id"]]] = r["target"]
    assert {s: n for s, n in taken.items()} == {s: int(t) for s, t in goal.items()}
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_shards_are_disjoint_and_even(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (60 + i * 13 % 500), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    rows = mixing.sized(docs)
    _, taken = mixing.take_blocks(rows, Scratch(spark, "t"), shards=5)
    got = taken.collect()
    assert len({(r["doc_id"], r["pass"], r["block"]) for r in got}) == len(got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["shard"]] += 1
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_draws_have_the_right_mean_and_bounds(spark):
    got = spark.range(4000).select(mixing._hypergeometric(F.lit(40), F.lit(100), F.lit(50), F.rand(3)).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 20) < 0.2 and got[1] >= 0 and got[2] <= 40


def test_mixed_documents_hold_the_words(spark):
    docs = spark.createDataFrame([(i, f"t{i}  " + "a b\tc d " * (100 + i * 29 % 400), f"s{i % 4}", 1) for i in range(30)], "doc_id long, text string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, goal = defaultdict(int), {}
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for r in mixing.source_targets(mixing.sized(docs)).collect():
        goal[r["source"]] = int(r["target"])
    assert words == goal


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).collect() == []
    assert mixing.mixed_documents(docs).collect() == []
