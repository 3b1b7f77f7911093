"""Reports and selection beyond their queries."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.operators import ordered as O
from marginalia.operators import reports as R
from marginalia.operators import selection as X


def by_rounds(available, k):
    """The rule of even shares, told item by item: in each turn, every group that has more gets one."""
    order = sorted((g for g, n in available.items() if n > 0), key=lambda g: (-available[g], g))
    got, left = dict.fromkeys(order, 0), min(k, sum(available.values()))
    while left:
        for g in order:
            if left and got[g] < available[g]:
                got[g], left = got[g] + 1, left - 1
    return got


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1), st.integers(0, 50), max_size=9), st.integers(0, 150))
def test_even_gives_one_after_another(available, k):
    assert X.even(available, k) == by_rounds(available, k)


def test_even_within_agrees(spark):
    cells = [(f"k{i % 7}", f"g{i}", (i * 37) % 41) for i in range(90)]
    got = {(r["k"], r["g"]): r["share"] for r in X.even_within(spark.createDataFrame(cells, "k string, g string, n int"), "g", "n", F.lit(100), ("k",)).collect()}
    want = {}
    for key in {c[0] for c in cells}:
        want |= {(key, g): n for g, n in by_rounds({g: n for k, g, n in cells if k == key}, 100).items()}
    assert got == want


def test_bins(spark):
    values = [0.0, 0.02, 0.019999, 0.8799, 0.88, 0.885, 1.0, 0.7, -0.1, 1.1, None, 0.58]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(R.histogram(F.col("v"), 50)).collect()]
    edges = [i * 0.02 for i in range(51)]
    assert got == [None if v is None or not 0 <= v <= 1 else min(49, max(i for i in range(51) if edges[i] <= v)) for v in values]
    assert got[3] == 43 and got[6] == 49


def test_p_value(spark):
    data = [(v % 17 + 3 * g, g) for v, g in zip(range(60), [0, 1, 1] * 20, strict=True)]
    got = R.rank_sum(spark.createDataFrame(data, "v int, g int"), "v", F.col("g") == 1).first()
    a, b = [v for v, g in data if g], [v for v, g in data if not g]
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    n, ties = len(data), sum((c := sum(w == v for w, _ in data)) ** 3 - c for v in {v for v, _ in data})
    sigma = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    want = math.erfc((abs(u - len(a) * len(b) / 2) - 0.5) / sigma / math.sqrt(2))
    assert got["u"] == u and got["p"] == pytest.approx(want, abs=2e-7)


def test_small_filters(spark):
    books = spark.createDataFrame([("1", "True"), ("2", "false"), ("3", None)], "book_id string, is_companion string")
    assert {r["book_id"] for r in R.corpus_only(books).collect()} == {"2", "3"}
    records = spark.createDataFrame([("Julia ; 12", "x"), ("Juliana", "x"), (None, "JULIA Band 2"), ("y", "z")], "series string, translated_title string")
    assert R.issues_of_series(records, "Julia").count() == 2
    steps = spark.createDataFrame([("a", 3), ("b", 5), ("c", 2)], "g string, n int")
    assert [(r["g"], r["share"]) for r in O.cumulative_share(steps, "n", "g").orderBy("share").collect()] == [("b", 0.5), ("a", 0.8), ("c", 1.0)]
    assert [r["x"] for r in spark.createDataFrame([(["Mills & Boon"],), (["Other"],), ([],)], "p array<string>").select(S.listed_publisher(F.col("p"), ["mills", "mira"]).alias("x")).collect()] == [True, False, False]
    marks = spark.createDataFrame([(" Ja",), ("x",), ("no",), (None,)], "m string")
    assert [r["x"] for r in marks.select(S.is_yes(F.col("m")).alias("x")).collect()] == [True, True, False, False]
    points = spark.createDataFrame([("k", 1, 10), ("k", 2, 20), ("k", 3, 30)], "k string, n int, v int")
    assert [(r["lo"], r["hi"]) for r in O.neighbours(points, ["k"], "n", "v").orderBy("n").collect()] == [(None, (2, 20)), ((1, 10), (3, 30)), ((2, 20), None)]


def test_same_story(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"], ["doe"], ["doe", "x"]), (["a"], ["b"], ["doe"], ["doe"]), (["a"], ["a"], ["doe"], ["roe"])], "wa array<string>, wb array<string>, ka array<string>, kb array<string>")
    assert [r["x"] for r in row.select(S.same_story(F.col("wa"), F.col("wb"), F.col("ka"), F.col("kb")).alias("x")).collect()] == [True, False, False]


def test_sample_of_editions(spark):
    editions = spark.createDataFrame([
        ("b1", "F", "f1", "1995", True, False), ("b1", "F", "f2", "1985", False, True), ("b1", "P", "p1", "1999", True, False), ("b2", "F", "f3", "1999", True, False), ("b2", "G", "g1", "1998", False, False), ("b2", "P", "p2", "2000", True, False)],
        "book_id string, language_letter string, translation_id string, pub_year string, strict_ok boolean, early_ed boolean").withColumns({"year": F.col("pub_year").cast("int"), "single": F.lit(True), "has_translator": F.lit(True), "exact": F.lit(True), "translators": F.lit("X"), "isbn": F.lit(""), "series": F.lit("s"), "edition_type": F.lit("single"), "translated_title": F.concat(F.lit("T "), "translation_id")})
    sample = spark.createDataFrame([("b1", "early", "F", True), ("b2", "late", "FGP", False)], "book_id string, period string, languages string, has_P boolean").withColumns({"title": F.lit("t"), "authors": F.lit("a"), "line": F.lit("L"), "pub_date": F.lit("1980"), "decade": F.lit("1980s"), "all_tr": F.lit(True)})
    got = {r["book_id"]: r for r in X.sample_table(sample, editions, early_polish=True).collect()}
    # of an early book only editions before the split count, strict or not; Polish ones always
    assert (got["b1"]["F_id"], got["b1"]["P_id"], got["b1"]["G_id"], got["b1"]["languages"]) == ("f2", "p1", "", "FP")
    assert (got["b2"]["F_id"], got["b2"]["G_id"], got["b2"]["P_id"], got["b2"]["F_title"]) == ("f3", "g1", "p2", "T f3")
    assert X.sample_table(sample, editions).filter("book_id = 'b1'").first()["languages"] == "F"
    report = {(r["kind"], r["key"]): r["n"] for r in X.sample_report(X.sample_table(sample, editions, early_polish=True)).collect()}
    assert report["books", "all"] == 2 and report["volumes", "all"] == 7 and report["line", "L"] == 2
