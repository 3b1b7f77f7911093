"""The registered queries of the subpackage over the smallest tables, against SQL or plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from marginalia.cluster import Scratch
from marginalia.llm import mixing, queries
from marginalia.llm.bpe import read_ranks

from tests.llm.test_dedup import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").collect()


def rows(spark, name):
    return queries.QUERIES[name](spark, DIR).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    answer = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted((plain(r[c] for c in names) for r in got.collect()), key=str) == sorted(map(plain, answer.fetchall()), key=str)


def test_near_duplicates(spark, docs):
    want = brute([(d["doc_id"], d["text"]) for d in docs], 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op1_minhash_near_dedup")} == want


def test_neighbours(spark):
    vectors = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    found, hits, all_ = defaultdict(dict), 0, 0
    for r in rows(spark, "op2_inverted_multi_index"):
        found[r["query_id"]][r["vec_id"]] = r["score"]
    for q, x in vectors:
        if q % 100 == 0:
            exact = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in vectors if i != q)[:10]
            hits, all_ = hits + sum(i in found[q] for _, i in exact), all_ + len(exact)
            assert all(found[q][i] == pytest.approx(d, rel=1e-12) for d, i in exact if i in found[q])
    assert hits >= 0.9 * all_


def test_shards(spark, docs):
    got = rows(spark, "op4_balanced_shards")
    counts, shards = Counter(r["shard"] for r in got), defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    sizes = Counter(zlib.crc32(d["text"].encode()) for d in docs)
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs) and max(counts.values()) - min(counts.values()) <= 1
    assert all(len(shards[c]) == 1 for c, n in sizes.items() if n <= len(docs) // 16)


def test_media(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op5_avi_media")}
    for d in docs:
        raw = d["text"].encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_tokens(spark, docs):
    import tiktoken
    from tokenizers import Tokenizer

    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoded, counted = ({r["doc_id"]: r for r in rows(spark, n)} for n in ("op8_byte_bpe", "op10_token_counts"))
    for d in docs:
        ids, r, c = coder.encode_ordinary(d["text"]), encoded[d["doc_id"]], counted[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest())
        n = len(library.encode(d["text"], add_special_tokens=False).ids)
        assert (c["n_bytes"], c["n_tokens"], c["over_limit"]) == (len(d["text"].encode()), n, n > 1024)


def test_languages_and_pages(spark, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    got = rows(spark, "op9_language_id")
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got) and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.9
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    for r in rows(spark, "op7_html_main_text"):
        heading = re.search(r"<article><h1>(.*?)</h1>", pages[r["page_id"]]["html"], re.S)[1].split()[0]
        assert r["n_chars"] == len(r["text"]) and r["text"].startswith(heading) and "&copy;" not in r["text"]


def test_a_changed_draw_changes_what_shards_get(spark):
    texts = [(i, "a b c d " * (60 + i * 13 % 500), f"s{i % 3}") for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")

    def shards(**options):
        return {r["doc_id"]: (r["taken"], [tuple(s) for s in r["shards"]]) for r in mixing.mix_sources(frame, with_shards=True, shards=4, **options).collect()}

    drawn, other = shards(), shards(draw=lambda good, total, draws, uniform: F.least(good, draws).cast("long"))
    assert drawn != other and {k: t for k, (t, _) in drawn.items()} == {k: t for k, (t, _) in other.items()}
    assert all(t == sum(w for _, w in s) for t, s in drawn.values())
    lost = shards(draw=lambda good, total, draws, uniform: F.lit(0).cast("long"))  # a tree that deals wrongly is seen in the result
    assert lost != drawn


def test_quotas_of_many_strata_add_up(spark):
    quotas = [(f"host{i}", p, (i * 31 + p) % 19) for i in range(300) for p in (0, 1)] + [(None, 0, 40)]
    frame = spark.createDataFrame([q for q in quotas if q[2]], "source string, pass int, quota long")
    got = mixing.shard_quotas(frame, shards=6, fanout=16).collect()
    total = sum(q[2] for q in quotas)
    assert {(r["source"], r["pass"]): r["starts"][-1] for r in got} == {(s, p): n for s, p, n in quotas if n}
    loads = [sum(r["starts"][j + 1] - r["starts"][j] for r in got) for j in range(6)]
    assert loads == [total * (j + 1) // 6 - total * j // 6 for j in range(6)] and all(a <= b for r in got for a, b in zip(r["starts"], r["starts"][1:], strict=False))
    spread = [r["starts"][1] for r in got if r["source"] is None][0]
    assert 0 < spread < 40


def test_mixed_rows_follow_shard_by_shard(spark):
    frame = spark.createDataFrame([(i, f"d{i} " + "w " * (100 + i * 29 % 900), f"s{i % 3}", 0) for i in range(40)], "doc_id long, text string, source string, n_chars long")
    got = mixing.mixed_documents(frame, shards=4).withColumn("part", F.spark_partition_id()).collect()
    cuts = mixing.draw_quotas(mixing.sized(frame), Scratch(spark, "t"), shards=4)
    assert cuts.count() == 3 and len({r["part"] for r in got}) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    words = Counter(r["part"] for r in got for _ in r["text"].split())
    assert max(words.values()) < 2 * min(words.values())


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, DIR)
    again = corpus_pipeline.run(spark, DIR)
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))
    kept = {k for k, (_, c) in brute([(d["doc_id"], d["text"]) for d in docs if any(map(str.isalpha, d["text"]))], 5).items() if k == c}
    assert {r["doc_id"] for r in out.collect()} <= kept and out.filter("n_tokens <> size(token_ids)").count() == 0
