"""Queries that compare inside blocks, against brute force with the reference's blocks only."""

import itertools

import duckdb
from marginalia.functions import similarity as S
from marginalia.functions import text as T
from marginalia.plans import corpus
from pyspark.sql import functions as F

from tests.test_text import _variant

DIR = "/root/testdata/sf0.01"


def compatible(a, b):
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    wa, wb = ([w for w in k.split() if w not in S.MINOR and not w.isdigit()] for k in (a, b))
    if not wa or not wb:
        return False
    ra, rb = [w for w in wa if w not in wb], [w for w in wb if w not in wa]
    return "".join(wa) == "".join(wb) if len(ra) != len(rb) else all(any(_variant(x, y) for y in rb) for x in ra)


def pairs_of(name, spark):
    return sorted((r["a"], r["b"]) for r in corpus.QUERIES[name](spark, DIR).collect())


def test_compatible_titles_of_a_brand_whatever_the_size(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_brand", T.title_key(F.col("p_name"))).collect())
    want = [(a, b) for (a, x, ka), (b, y, kb) in itertools.combinations(rows, 2) if x == y and compatible(ka, kb)]
    assert pairs_of("compatible_titles", spark) == sorted(want) and len(want) >= 1239


def test_variants_that_differ_at_the_second_letter(spark):
    words = sorted(r["name"] for r in corpus._names(spark, DIR).select("name").distinct().collect())
    want = [(a, b) for a, b in itertools.combinations(words, 2) if a[0] == b[0] and _variant(a, b)]
    got = pairs_of("variant_pairs", spark)
    assert got == sorted(want) and {("anble", "atble"), ("eaieau", "eeaieau")} <= set(got)


def test_missing_titles_have_no_pairs(spark, tmp_path):
    names = [None, None, "", "The", "x (y)", "x", "(y)", "honor rose", "honour rose"]
    rows = [(k, "B", 1, name) for k, name in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r["a"], r["b"]) for r in corpus.QUERIES["compatible_titles"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(duck.execute(corpus.ORACLE_SQL["compatible_titles"]).fetchall()) == [(2, 6), (4, 5), (7, 8)]
