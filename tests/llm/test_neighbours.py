"""The index against brute force: recall, ties, repeated ids, and how much of a table is visited."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ann


def vectors(spark, x, first=0):
    flat = pa.array(x.astype(np.float32).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(first, first + len(x))), "embedding": lists}))


def recall(found, x, every, k=10):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits, queries = 0, np.arange(0, len(x), every)
    y = x.astype(np.float32).astype(np.float64)
    for q in queries:
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argpartition(d, k)[:k].tolist()))
    return hits / (k * len(queries))


@pytest.fixture
def visits(monkeypatch):
    seen, own = [], ann._budget

    def budget(*a):
        seen.append(own(*a))
        return seen[-1]

    monkeypatch.setattr(ann, "_budget", budget)
    return seen


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_recall_on_a_sphere_without_clusters(spark, visits, n):
    x = np.random.default_rng(1).normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(ann.nearest_neighbours(vectors(spark, x)).collect(), x, 100) >= 0.9
    print(f"{n} vectors without clusters: {visits[-1] / n:.2f} of the rows visited")


@pytest.mark.parametrize("n", [10_000, 50_000])
def test_clustered_vectors_need_few_rows(spark, visits, n):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, n)] + 0.15 * rng.normal(size=(n, 32))
    assert recall(ann.nearest_neighbours(vectors(spark, x)).collect(), x, 100) >= 0.9 and visits[-1] < 0.1 * n
    print(f"{n} clustered vectors: {visits[-1] / n:.3f} of the rows visited")


def test_ties_repeated_ids_and_one_huge_cell(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000 + i, [0.0, 1.0 + i]) for i in range(20)] + [(0, [1.0, 0.0]), (7, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit("clash"), "block": F.lit(2), "score": F.lit(0)})
    got = {}
    for r in ann.nearest_neighbours(frame, every=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(i, 0.0) for i in (1, 2, 3, 4, 5, 6, 7, 7, 8, 9)]  # equal distances: smaller ids; a repeated row counts twice
    assert got[1000] == [(i, 0.0) for i in (0, 0, 1, 2, 3, 4, 5, 6, 7, 7)] and got[5000][0] == (5001, 1.0)
