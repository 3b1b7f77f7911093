"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each with its own k-means centroids, fitted on a bounded sample; their number grows with
the table. A row's cell is the pair of its nearest centroids. A query visits cells in the order of the summed distance
of their centroids, by the multi-sequence algorithm with a heap over the two sorted lists, until the cells hold its
budget of rows. All entries of the visited cells are reranked by their exact distance.

The budget is learned, not set: for PROBES queries the true neighbours are found by a scan, and the budget is the number
of rows after which TARGET of these neighbours have been met. Clustered vectors need few rows, vectors that fill a sphere
evenly a large part of the table, as no cell tells much about them; either way the recall is what was measured.

Cells are laid out in blocks of at most BLOCK rows (a larger cell is spread over several blocks). Every row is shuffled
once, to its block. A query is sent to each block that holds a cell it visits, with the summed distance at which it
stopped, which tells the block which of its cells are meant. In a block, rows come first and are held; queries stream
past them, and each query's best rows leave. No pair is emitted, and neither rows nor queries are copied otherwise.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.cluster import Scratch, ship, then_give_back

#: The fewest and most centroids of each half; vectors in the sample they are fitted on; rounds of k-means.
CENTROIDS, SAMPLE, ROUNDS = (16, 1024), 20_000, 12
#: Queries whose true neighbours set the budget, the share of these that it must meet, and what is added to be safe.
PROBES, TARGET, SPARE = 64, 0.96, 1.05
BLOCK, QUERIES_AT_ONCE = 1_024, 256


def _fit_half(half: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(half, axis=0)
    if len(distinct) <= count:
        return distinct
    centres = distinct[rng.choice(len(distinct), count, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = np.argmin((centres**2).sum(1) - 2 * half @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, half)
        sizes = np.bincount(nearest, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest_first(first: np.ndarray, second: np.ndarray, weight: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs (i, j) by rising first[i] + second[j], until their weights sum to ``enough``: the multi-sequence algorithm.

    The heap holds the front of the pairs seen so far; (i, j) enters when its neighbours below have left.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    heap, reached, out, held = [(fa[0] + sb[0], 0, 0)], [-1] * len(fa), [], 0
    while heap and held < enough:
        _, x, y = heapq.heappop(heap)
        reached[x] = y
        cell = (int(a[x]), int(b[y]))
        if weight[cell]:
            out.append(cell)
            held += int(weight[cell])
        if x + 1 < len(fa) and (y == 0 or reached[x + 1] == y - 1):
            heapq.heappush(heap, (fa[x + 1] + sb[y], x + 1, y))
        if y + 1 < len(sb) and (x == 0 or reached[x - 1] > y):
            heapq.heappush(heap, (fa[x] + sb[y + 1], x, y + 1))
    return out


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    lists = batch.column("v")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _distances(codes: np.ndarray, half: np.ndarray) -> np.ndarray:
    return ((codes - half) ** 2).sum(1)


def _best(x: np.ndarray, ids: np.ndarray, query: np.ndarray, about: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest allowed rows, ties to the smaller id; ``about`` orders rows up to rounding."""
    open_ = np.flatnonzero(allowed)
    if len(open_) > k:
        edge = np.partition(about[open_], k - 1)[k - 1]
        open_ = open_[about[open_] <= edge + 1e-9 * (1 + abs(edge) + (query**2).sum())]
    exact = np.sqrt(((x[open_] - query) ** 2).sum(1))
    order = np.lexsort((ids[open_], exact))[:k]
    return open_[order], exact[order]


def _budget(index: DataFrame, asked: DataFrame, left: np.ndarray, right: np.ndarray, weight: np.ndarray, dim: int, k: int, target: float) -> int:
    """Rows to visit so that ``target`` of the true neighbours of the probes are met: their cells, by a scan, and their turn."""
    half, across = left.shape[1], len(right)
    probes = asked.orderBy(F.xxhash64(F.lit("probe"), "id"), "id").limit(PROBES).collect()
    names, queries = np.array([r["id"] for r in probes]), np.array([r["v"] for r in probes]).reshape(len(probes), dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, cells = _vectors(batch, dim), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            about = (x**2).sum(1) - 2 * queries @ x.T
            for q in range(len(queries)):
                at, exact = _best(x, ids, queries[q], about[q], ids != names[q], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(ids[at]), pa.array(exact), pa.array(cells[at])], ["q", "id", "d", "cell"])

    order = Window.partitionBy("q").orderBy("d", "id")
    found = index.mapInArrow(then_give_back(scan), "q long, id long, d double, cell int").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("q", "cell").collect()  # PROBES * k rows
    need, total = [], int(weight.sum())
    wanted: dict[int, list[int]] = {}
    for row in found:
        wanted.setdefault(row["q"], []).append(row["cell"])
    for q, cells in wanted.items():
        held = 0
        turn = {}
        for i, j in nearest_first(_distances(left, queries[q, :half]), _distances(right, queries[q, half:]), weight, total):
            held += int(weight[i, j])
            turn[i * across + j] = held
        need += [turn[c] for c in cells]
    return min(total, math.ceil(SPARE * float(np.quantile(need, target, method="higher")))) if need else total


def nearest_neighbours(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 100, k: int = 10, visit: float | None = None, target: float = TARGET, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query: ids divisible by ``every``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Every row but those with the
    query's id is a candidate; with fewer than ``k`` found, all are returned. Null ids and vectors that are null, empty,
    zero, hold null or non-finite components or have another length than most take no part. A query id that repeats is
    asked once (its smallest vector); repeated candidate rows each count. An empty table gives an empty result. Other
    columns play no part, whatever their names. ``visit`` sets the share of all rows that is visited, ``centroids`` their
    number in each half; both are learned from the table if not given.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    schema = "query_id long, rank int, vec_id long, score double"
    sound = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = sound.filter(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    lengths = sound.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, total = lengths[0]["dim"], lengths[0]["n"]
    half = (dim + 1) // 2
    sound = sound.filter(F.size("v") == dim)
    # The sample is bounded: SAMPLE vectors, chosen by a hash of the id.
    sample = np.array([r["v"] for r in sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])
    count = centroids or min(CENTROIDS[1], max(CENTROIDS[0], math.ceil(math.sqrt(total) / 2)))
    rng = np.random.default_rng(11)
    left, right = _fit_half(sample[:, :half], count, rng), _fit_half(sample[:, half:], count, rng) if dim > 1 else np.zeros((1, 0))
    across = len(right)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = _vectors(part, dim)
                i = np.argmin((left**2).sum(1) - 2 * x[:, :half] @ left.T, axis=1)
                j = np.argmin((right**2).sum(1) - 2 * x[:, half:] @ right.T, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((i * across + j).astype(np.int32))], ["id", "v", "cell"])

    index = scratch.table(sound.mapInArrow(then_give_back(place), "id long, v array<double>, cell int"), "index")
    # At most CENTROIDS**2 numbers, whatever the table holds.
    sizes = np.zeros(len(left) * across, np.int64)
    for row in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[row["cell"]] = row["n"]
    weight = sizes.reshape(len(left), across)
    asked = index.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    enough = math.ceil(visit * total) if visit is not None else _budget(index, asked, left, right, weight, dim, k, target)
    enough = max(enough, min(total, k + 1))

    # cell -> first block and number of blocks: whole cells share a block until it is full, large cells have several
    first, spread, block, filled = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for cell in np.flatnonzero(sizes):
        if sizes[cell] > BLOCK:
            block += filled > 0
            first[cell], spread[cell], filled = block, -(-sizes[cell] // BLOCK), 0
            block += int(spread[cell])
            continue
        if filled + sizes[cell] > BLOCK:
            block, filled = block + 1, 0
        first[cell] = block
        filled += int(sizes[cell])

    names = ["block", "kind", "id", "v", "cell", "reach"]
    met = "block long, kind int, id long, v array<double>, cell int, reach double"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            turn = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % spread[cells]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(first[cells] + turn), pa.array(np.zeros(n, np.int32)), *batch.columns, pa.array(np.zeros(n))], names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, dim)
            for q in range(len(x)):
                one, two = _distances(left, x[q, :half]), _distances(right, x[q, half:])
                near = np.array(nearest_first(one, two, weight, enough))
                cells = near[:, 0] * across + near[:, 1]
                blocks = np.unique(np.concatenate([first[cells], *(np.arange(first[c], first[c] + spread[c]) for c in cells[spread[cells] > 1])]))
                n, rows = len(blocks), pa.array(np.full(len(blocks), q))
                reach = one[near[-1, 0]] + two[near[-1, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.ones(n, np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, reach))], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of one block
        at, ready = None, None
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(keys)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if keys[start] != at:
                    at, held, ready = keys[start], [], None
                if kinds[start] == 0:
                    held.append(batch.slice(start, stop - start))
                    continue
                if ready is None:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    x, ids = _vectors(rows, dim), rows.column("id").to_numpy()
                    ready = (x, ids, *np.divmod(rows.column("cell").to_numpy(), across), (x**2).sum(1))
                for low in range(start, stop, QUERIES_AT_ONCE):
                    yield _answers(batch.slice(low, min(QUERIES_AT_ONCE, stop - low)), *ready)

    def _answers(asked: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
        y, own, reach = _vectors(asked, dim), asked.column("id").to_numpy(), asked.column("reach").to_numpy()
        about, out = norms - 2 * y @ x.T, ([], [], [])
        for q in range(len(y)):
            visited = _distances(left, y[q, :half])[i] + _distances(right, y[q, half:])[j] <= reach[q]
            places, exact = _best(x, ids, y[q], about[q], visited & (ids != own[q]), k)
            for column, value in zip(out, (np.full(len(places), own[q]), ids[places], exact), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]), pa.float64())], ["query_id", "vec_id", "score"])

    queries = asked.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(then_give_back(route), met)
    both = index.mapInArrow(then_give_back(settle), met).unionByName(queries)
    pairs = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(then_give_back(search), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
