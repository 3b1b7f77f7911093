"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

Every distinct shingle set has a signature of ``POSITIONS`` minima of 16 bits each. The first ``CHUNKS * WIDTH`` of them
form ``CHUNKS`` chunks of ``WIDTH`` positions. If two signatures differ in at most ``CHUNKS * (ERRORS + 1) - 1`` of
these positions, some chunk differs in at most ``ERRORS`` = 1 (pigeonhole). Each chunk is indexed once for each
position that may differ, so all pairs within that distance meet under a common key, and many beyond it.

Pairs that meet are confirmed on their full shingle sets, in an order that never lists the pairs of a group of copies:

1. Equal sets become one representative (their smallest id).
2. *Stars*: each member of a key is confirmed against the key's smallest representative. Confirmed links are joined to
   components.
3. *Rest*: only keys whose members lie in different components remain. Their members are dealt in blocks of a bounded
   number of members and shingles, so that each two blocks meet in one task; a pair is treated at the first key it shares. A signature estimate over all positions
   selects the members of possible links, and their full sets are compared block by block with a matrix product.
   Only links that join components leave the task.

Confirmed links of both steps give the classes. No pair is skipped for the size of its key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.cluster import Scratch, ship, small_batches, then_give_back
from marginalia.llm.shingles import shingle_rows
from marginalia.llm.worker import forget

#: b-bit positions in a signature, and the chunks among the first of them.
POSITIONS, CHUNKS, WIDTH, ERRORS = 128, 8, 5, 1
#: Members of a key in a block, and their shingles; two blocks of a key meet in one task.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Ids that may be broadcast: 16 MB at most; with more, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Pairs of numbers that may be broadcast to leave rows out: 30 MB at most in an executor.
BROADCAST_PAIRS = 250_000
_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 2**32 - 1, POSITIONS, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32 - 1, POSITIONS, dtype=np.uint32)
_SIGNED = "id long, key long, n_shingles long, node long, signature binary"


def _texts(batch: pa.RecordBatch, column: int = 2) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _node(own: np.ndarray) -> int:
    """A number for a set of shingles, the same for equal sets: 64 bits over its sorted members."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signer(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for shingles, offsets in shingle_rows(_texts(batch), words):
                low = (shingles >> np.uint64(32)).astype(np.uint32)
                used = np.flatnonzero(np.diff(offsets))
                minima = np.zeros((len(offsets) - 1, POSITIONS), np.uint16)
                for k in range(POSITIONS if len(used) else 0):
                    minima[used, k] = (np.minimum.reduceat(low * _A[k] + _B[k], offsets[:-1][used]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                for i in range(len(offsets) - 1):
                    own = np.unique(shingles[offsets[i] : offsets[i + 1]])
                    sizes.append(len(own))
                    nodes.append(_node(own) if len(own) else None)
                    signatures.append(minima[i].tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())], ["id", "key", "n_shingles", "node", "signature"])

    return sign


def _set_maker(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shingles, offsets in shingle_rows(_texts(batch), words):
                own = [x for a, b in zip(offsets[:-1], offsets[1:], strict=True) if len(x := np.unique(shingles[a:b]))]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                values = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])

    return sets


def _sets_of(texts: DataFrame, nodes: DataFrame, representatives: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes, and perhaps a few more; keys are broadcast if their number has been checked to be small."""
    keys = representatives.join(nodes, "node", "left_semi").select("key").distinct()
    wanted = texts.join(F.broadcast(keys) if nodes.count() <= BROADCAST_IDS else keys, "key", "left_semi").select("id", "key", "text")
    return wanted.mapInArrow(then_give_back(_set_maker(words)), "node long, shingles array<long>").dropDuplicates(["node"])


def _chunk_keys() -> Column:
    """The keys of a signature: for each chunk and each position that may differ, the other positions hashed."""
    keys = []
    for chunk in range(CHUNKS):
        for gap in range(WIDTH):
            at = 2 * chunk * WIDTH + 1
            rest = F.concat(F.substring("signature", at, 2 * gap), F.substring("signature", at + 2 * gap + 2, 2 * (WIDTH - 1 - gap)))
            keys.append(F.xxhash64(F.lit(chunk * WIDTH + gap), rest))
    return F.array(*keys)


def _linked(shared: Column, of: Column, against: Column, percent: int) -> Column:
    return shared * 100 >= (of + against - shared) * percent


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b). Neither roots nor nodes without links are listed.

    Every round, each node's neighbourhood is linked to its smallest member: first the larger neighbours, then the
    smaller ones. The distances shrink at least by half, so the rounds grow with the logarithm of the longest path.
    """
    edges = scratch.table(links.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), f"{label}0")
    last, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("node", "other")
        nearest = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        large = both.filter("other > node").join(nearest, "node").select(F.col("root").alias("low"), F.col("other").alias("high")).filter("low <> high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("root"))
        small = large.join(down, "high").select(F.col("root").alias("low"), F.when(F.col("low") == F.col("root"), F.col("high")).otherwise(F.col("low")).alias("high")).filter("low <> high").distinct()
        turn += 1
        edges = scratch.table(small, f"{label}{turn}")
        scratch.drop(f"{label}{turn - 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
        last = now


_CANDIDATE = "key_group long, node long, component long"


def _candidates(most: int):
    """Members of possible links in each (key, block pair); rows arrive sorted by it."""

    def of_group(group: np.ndarray, place: int, ids: np.ndarray, comps: np.ndarray, halves: np.ndarray, signs: np.ndarray, both: bool) -> np.ndarray:
        n, hit = len(ids), np.zeros(len(ids), bool)
        chunk, gap = divmod(place, WIDTH)
        head = signs[:, : (chunk + 1) * WIDTH]
        for i in range(n - 1):
            rest = np.arange(i + 1, n)
            rest = rest[(comps[rest] != comps[i]) & ((halves[rest] != halves[i]) if both else True)]
            if not len(rest):
                continue
            wrong = (head[rest] != head[i]).reshape(len(rest), chunk + 1, WIDTH).sum(2)
            first = (wrong[:, chunk] == 1) | (gap == 0)
            if chunk:
                first &= (wrong[:, :chunk] > ERRORS).all(1)
            rest = rest[first]
            rest = rest[(signs[rest] != signs[i]).sum(1) <= most]
            if len(rest):
                hit[i] = True
                hit[rest] = True
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _by_group(batches):
            ids, comps = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            halves, place = rows.column(4).to_numpy(), rows.column(1)[0].as_py()
            both = rows.column(5)[0].as_py()
            signs = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint16).reshape(len(ids), POSITIONS)
            hit = of_group(group, place, ids, comps, halves, signs, both)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hit.sum()), group)), pa.array(ids[hit]), pa.array(comps[hit])], ["key_group", "node", "component"])

    return run


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the first column, of rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def _confirm(percent: int):
    """Links between components in each group of candidates: exact sizes of intersections, by a matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches):
            ids, comps = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            lists = rows.column(3).combine_chunks()
            values, ends = lists.values.to_numpy()[lists.offsets[0].as_py() :], np.asarray(lists.offsets) - lists.offsets[0].as_py()
            owner = np.repeat(np.arange(len(ids)), np.diff(ends))
            values, code = np.unique(values[: ends[-1]], return_inverse=True)
            seen = np.bincount(code, minlength=len(values))
            kept = seen[code] > 1  # what only one member has is in no intersection
            owner, code, sizes = owner[kept], code[kept], np.diff(ends)
            shared = np.zeros((len(ids), len(ids)), np.float32)
            order = np.argsort(code, kind="stable")
            owner, code = owner[order], np.unique(code[order], return_inverse=True)[1]
            step = max(1, 2_000_000 // max(1, len(ids)))
            for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
                part = slice(*np.searchsorted(code, [low, low + step]))
                matrix = np.zeros((len(ids), step), np.float32)
                matrix[owner[part], code[part] - low] = 1
                shared += matrix @ matrix.T
            pairs = []
            for i in range(len(ids) - 1):
                both = shared[i, i + 1 :].astype(np.int64)  # exact: float32 holds integers to 2**24
                good = (both * 100 >= (sizes[i] + sizes[i + 1 :] - both) * percent) & (comps[i + 1 :] != comps[i])
                pairs += [(i, i + 1 + j) for j in np.flatnonzero(good).tolist()]
            root = {int(c): int(c) for c in comps}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            out = []
            for x, y in pairs:
                p, q = find(int(comps[x])), find(int(comps[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(ids[x]), int(ids[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def near_duplicates(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents``.

    Two documents are linked if their sets of word shingles share at least ``percent`` hundredths of their union.
    ``component_id`` is the smallest id reachable over links, ``kept`` says whether it is the document's own.

    Null, empty and blank texts have no shingles and are linked with nothing. Texts are read whole, however long. Every
    row is a document of its own, also where an id repeats. Rows with a null id take no part: their component is null
    and they are kept. An empty table gives an empty result. Other columns play no part, whatever their names.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-duplicates")
    identified, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    signed, roots = _classes(documents, identified, F.xxhash64(identified, text), text, shingle, percent, scratch, null_ids=False)
    smallest = signed.filter("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("least_id"))
    rooted = smallest.join(roots, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("least"))
    named = rooted.join(least, "root", "left").select(F.col("node").alias("_node"), F.coalesce("least", "least_id").alias("component_id"))
    out = signed.join(named, signed["node"] == named["_node"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``documents``, all columns as they are, with one row of each class of near-duplicates: that with the smallest id
    (null last), of equal ids that with the smallest hash of all columns.

    Rows are told apart by their id and that hash, so a null id is a row like others, the texts of a repeated id are
    documents of their own, and of rows that are equal in all columns one stays. Rows without shingles are alike to
    nothing and stay. Verdicts are numbers; texts are moved only if the rows to be left out are too many to broadcast.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-duplicates")
    identified, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    whole = F.xxhash64(*(F.col(f"`{name}`") for name, kind in documents.dtypes if "map<" not in kind and "variant" not in kind))
    signed, roots = _classes(documents, identified, whole, text, shingle, percent, scratch, null_ids=True)
    classed = signed.filter("node IS NOT NULL").join(roots, "node", "left").select("id", "key", F.coalesce("component", "node").alias("root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    rows = classed.groupBy("root", "id", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = scratch.table(rows, "rows")
    # compared by id and hash, not by class: one class may hold a third of all rows
    first = rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.id").alias("_i"), F.col("first.key").alias("_k"), F.lit(True).alias("stays"))
    judged = rows.join(first, F.col("id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")), "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    judged = scratch.table(judged.filter("NOT stays OR n > 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "stays"), "judged")
    counts = judged.groupBy().agg(F.count(F.lit(1)).alias("all"), F.count_if("stays").alias("repeated")).first()
    narrow = (lambda frame: F.broadcast(frame)) if counts["all"] <= BROADCAST_PAIRS else lambda frame: frame
    same = [identified.eqNullSafe(F.col("_id")), whole == F.col("_key")]
    out = documents.join(narrow(judged.drop("stays")), same, "left_anti")
    if counts["repeated"]:
        again = documents.join(narrow(judged.filter("stays").drop("stays")), same, "left_semi").select(F.struct("*").alias("row"), identified.alias("_id"), whole.alias("_key"))
        out = out.unionByName(again.dropDuplicates(["_id", "_key"]).select("row.*"))
    return out


def _classes(documents: DataFrame, identified: Column, key: Column, text: Column, shingle: int, percent: int, scratch: Scratch, *, null_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(signed, roots): ``signed`` has (id, key, n_shingles, node) for each row, ``roots`` (node, component) for each node
    that has links, but for the roots themselves."""
    with small_batches(documents.sparkSession):  # every step that runs Python ends in a written table here
        texts = documents.select(identified.alias("id"), key.alias("key"), text.alias("text"))
        signed = scratch.table(texts.mapInArrow(then_give_back(_signer(shingle)), _SIGNED), "signed")
        part = "true" if null_ids else "id IS NOT NULL"
        roots = _linked_classes(texts.filter(part), signed.filter(part), shingle, percent, scratch)
    return signed.drop("signature"), roots


def _linked_classes(chosen: DataFrame, signed: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    full = signed.filter("node IS NOT NULL")
    smallest = full.groupBy("node").agg(F.min("key").alias("key"))
    representatives = scratch.table(smallest.join(full.select("node", "key", "n_shingles", "signature"), ["node", "key"]).dropDuplicates(["node"]), "representatives")

    places = representatives.select("node", F.posexplode(_chunk_keys()).alias("place", "key"))
    ends_of = places.groupBy("place", "key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    shared = scratch.table(places.join(ends_of.select("place", "key", "first"), ["place", "key"]), "shared")

    stars = scratch.table(shared.filter("node <> first").select("node", "first").distinct(), "stars")
    ends = scratch.table(stars.select("node").union(stars.select("first")).distinct(), "ends")
    sets = scratch.table(_sets_of(chosen, ends, representatives, shingle), "sets")
    met = stars.join(sets.toDF("first", "left_set"), "first").join(sets.toDF("node", "right_set"), "node")
    common = F.size(F.array_intersect("left_set", "right_set"))
    star_links = scratch.table(met.filter(_linked(common, F.size("left_set"), F.size("right_set"), percent)).select(F.col("node").alias("a"), F.col("first").alias("b")), "star_links")
    scratch.drop("sets", "stars", "ends")
    star_classes = components(star_links, scratch, "star_rounds")

    classed = shared.select("place", "key", "node").join(star_classes, "node", "left").select("place", "key", "node", F.coalesce("component", "node").alias("component"))
    mixed = classed.groupBy("place", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    members = classed.join(mixed.select("place", "key"), ["place", "key"]).join(representatives.select("node", "n_shingles", "signature"), "node")
    members = scratch.table(members, "members")
    sizes = members.groupBy("place", "key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, ["place", "key"]).withColumn("half", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least(t, F.col("half")).alias("i"), F.greatest(t, F.col("half")).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(met_blocks))
    dealt = dealt.select(F.xxhash64("place", "key", "pair.i", "pair.j").alias("key_group"), "place", "node", "component", "half", (F.col("pair.i") != F.col("pair.j")).alias("both"), "signature")
    # A pair at the threshold differs in a share of 1 - J of the positions; 4.7 standard deviations more are let through.
    share = 1 - percent / 100
    most = int(POSITIONS * share + 4.7 * (POSITIONS * share * (1 - share)) ** 0.5)
    possible = scratch.table(dealt.repartition("key_group").sortWithinPartitions("key_group").mapInArrow(then_give_back(_candidates(most)), _CANDIDATE), "possible")
    more = _sets_of(chosen, possible.select("node").distinct(), representatives, shingle)
    grouped = possible.join(more, "node").select("key_group", "node", "component", "shingles").repartition("key_group").sortWithinPartitions("key_group")
    links = scratch.table(star_links.unionByName(grouped.mapInArrow(then_give_back(_confirm(percent)), "a long, b long")), "links")
    scratch.drop("possible", "shared", "members")
    roots = components(links, scratch, "rounds")
    scratch.drop("representatives", "star_links")
    return roots
