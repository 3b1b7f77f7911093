import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.cluster import Scratch
from marginalia.llm import dedup
from marginalia.llm.shingles import shingle_rows

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(docs, words, percent=80):
    """doc -> smallest id reachable, from sets of tuples of words."""
    sets = {}
    for key, text in docs:
        w = WORD.findall((text or "").encode().lower())
        sets[key] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in sets}


def family(rnd, n):
    """Copies of a text with words replaced: a chain of links around the threshold."""
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(0, 6)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_classes_agree_with_brute_force(spark, words):
    rnd = random.Random(words)
    texts = family(rnd, 60) + family(rnd, 30) + [" ".join(f"v{rnd.randrange(80)}" for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    texts += ["Same TEXT here", "same text\there ", "Ähnlich ÄHNLICH", "ähnlich ähnlich", "a", "A", "", " \n", "b c d e", "b c d e f"]
    docs = list(enumerate(texts, 10))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r["doc_id"]: r for r in dedup.near_duplicates(frame, shingle=words).collect()}
    want = brute(docs, words)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_nulls_and_repeated_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z u v w"), (2, "x y z u v w"), (None, "a b c d e f"), (3, None), (None, None)]
    got = sorted(map(tuple, dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (3, 0, 3, True), (None, 0, None, True)], key=str)


def test_empty_table(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_are_cut_between_words_only():
    rnd = random.Random(5)
    text = b" ".join(bytes(rnd.choices(b"abc", k=rnd.randrange(1, 9))) for _ in range(400_000))
    whole = np.concatenate([s for s, _ in shingle_rows([text], 3)])
    pieces = [text[: len(text) // 2].rsplit(b" ", 1)[0]]
    pieces.append(text[len(pieces[0]) + 1 :])
    parts = np.concatenate([s for s, _ in shingle_rows(pieces, 3)])
    assert len(whole) == 399_998 and np.isin(parts, whole).all()
    assert len(next(shingle_rows([b"z" * 3_000_000], 4))[0]) == 1


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in dedup.components(links, Scratch(spark, "t"), "r").collect()}
    assert got == {i: 1 for i in range(2, 41)} | {101: 100}


def test_large_keys_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    docs = list(enumerate(family(random.Random(9), 80)))
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == {k: c for k, (_, c) in brute(docs, 4).items()}
