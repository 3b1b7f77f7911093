import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.cluster import row_order
from marginalia.operators import linkage as L
from marginalia.operators import names as N
from marginalia.operators import ordered as O
from marginalia.operators import reports as R
from marginalia.operators import selection as X


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_edition_letters(spark):
    e = spark.createDataFrame([("b", "G", "2003", "r1"), ("b", "G", "1999", "r2"), ("b", "G", "", "r3"), ("b", "F", "1990", "r4")], "book_id string, language_letter string, pub_year string, source_record_id string")
    assert {r["source_record_id"]: r["translation_id"] for r in O.edition_ids(e).collect()} == {"r2": "b_Ga", "r1": "b_Gb", "r3": "b_Gc", "r4": "b_F"}


def test_greedy_dedup_depends_on_what_was_kept(spark):
    e = spark.createDataFrame([(1, "k", "r1", "1"), (2, "k", "r2", "1"), (3, "k", "r2", "2"), (4, "k", "r3", ""), (5, "k", "r4", ""), (6, "k", "r3", "9")], "o int, k string, r string, i string")
    kept = O.greedy_editions(e, ["k"], "o", "r", "i")
    assert [r["o"] for r in kept.orderBy("o").collect()] == [1, 3, 4, 5]
    assert rows(O.greedy_editions(kept, ["k"], "o", "r", "i")) == rows(kept)
    assert [r["o"] for r in O.greedy_editions(e, ["k"], "o", "r", "i", by_isbn=False).orderBy("o").collect()] == [1, 2, 4, 5]


def test_bracket_is_strict_below(spark):
    anchors = spark.createDataFrame([("c", 433, 2610), ("c", 441, 2625)], "c string, n int, v int")
    records = spark.createDataFrame([("c", 437, "x"), ("c", 441, "y"), ("c", 433, "z"), ("d", 437, "w")], "c string, n int, id string")
    got = O.bracket(records, anchors, ["c"], "n", "v")
    assert {r["id"]: (r["lo_value"], r["hi_value"]) for r in got.collect()} == {"x": (2610, 2625), "y": (2610, 2625)}
    e = got.filter("id = 'x'").select(O.interpolated(F.col("n"), *(F.col(c) for c in ("lo_number", "lo_value", "hi_number", "hi_value"))).alias("e")).first()["e"]
    assert e == 2617.5


@pytest.mark.parametrize(("available", "k", "want"), [({"a": 5, "b": 1, "c": 9}, 9, {"a": 4, "b": 1, "c": 4}), ({"a": 3}, 9, {"a": 3}), ({}, 4, {}), ({"a": 0, "b": 2}, 1, {"b": 1})])
def test_even(available, k, want):
    assert X.even(available, k) == want


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1), st.integers(0, 50), max_size=9), st.integers(0, 120))
def test_even_gives_what_there_is(available, k):
    got = X.even(available, k)
    assert sum(got.values()) == min(k, sum(available.values())) and all(got[g] <= available[g] for g in got)


def test_proportional(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 0)], "g string, n int")
    assert {r["g"]: r["share"] for r in X.proportional(sizes, "g", "n", F.lit(4)).collect()} == {"a": 2, "b": 1, "c": 1}
    assert {r["share"] for r in X.proportional(sizes, "g", "n", F.lit(0)).collect()} == {0}


BOOKS = "book_id string, title string, authors string, pub_date string, position long"
EDITIONS = "record int, position int, authors array<string>, original_titles array<string>, language_letter string, pub_year string, isbn string, source_record_id string, publisher string, series string"


def fixture(spark):
    books = spark.createDataFrame([("b1", "The Quiet Harbor", "Jane Doe", "Mar 1990", 0), ("b2", "Storm Quadruplets", "Jane Doe", "1991", 1), ("b3", "Volume One: Hidden Valley", "Max Roe", "1992", 2)], BOOKS)
    editions = spark.createDataFrame([
        (1, 1, ["Jane Doe"], ["The Quiet Harbor"], "G", "2003", "1", "r1", "Cora", ""),
        (2, 2, ["Jane Doe"], ["Quiet Harbour, 1999"], "G", "1999", "2", "r2", "Cora", ""),
        (3, 3, ["Jane Doe"], ["The Quiet Harbor"], "G", "2005", "1", "r3", "Cora", ""),
        (4, 4, ["Jane Doe"], [], "F", "1993", "", "r4", "Harlequin", ""),
        (5, 5, ["Jane Doee"], ["Storm Triplets"], "P", "2001", "", "r5", "", ""),
        (6, 6, ["Nobody Known"], ["Lost Book"], "F", "1998", "", "r6", "", ""),
        (7, 7, ["Nobody Known", "Max Roe"], ["Hidden Valley"], "F", "1998", "", "r7", "", ""),
    ], EDITIONS)
    return books, editions


def test_linkage(spark):
    books, editions = fixture(spark)
    got = L.link_editions(editions, books)
    links = {r["source_record_id"]: (r["book_id"], r["translation_id"]) for r in got["links"].collect()}
    assert links == {"r1": ("b1", "b1_Gb"), "r2": ("b1", "b1_Ga"), "r7": ("b3", "b3_F")}
    score = {r["source_record_id"]: r["score"] for r in got["links"].collect()}
    assert score["r1"] == 1.0 and score["r2"] == 0.96
    assert {r["source_record_id"]: r["reason"] for r in got["unmatched"].collect()} == {"r4": "no original title in record", "r5": "title mismatch"}
    assert {r["source_record_id"] for r in got["to_resolve"].collect()} == {"r5", "r6"}


def test_suggestions_and_marks(spark):
    books, editions = fixture(spark)
    new = L.suggestions(L.link_editions(editions, books)["unmatched"], L.title_index(books))
    by = {(r["source_record_id"], r["suggested_book_id"]): (r["candidate_score"], r["confidence"]) for r in new.collect()}
    assert by[("r4", "b1")] == (0.62, "medium") and by[("r4", "b2")] == (0.63, "medium") and not any(k[0] == "r5" for k in by)
    old = new.filter("suggested_book_id = 'b2'").withColumn("confirm", F.lit("Y ")).unionByName(new.limit(1).withColumns({"source_record_id": F.lit("gone"), "confirm": F.lit("ja")}))
    marked = {(r["source_record_id"], r["suggested_book_id"]): r["confirm"] for r in L.carry_marks(new, old).collect()}
    assert marked[("r4", "b2")] == "Y " and marked[("r4", "b1")] == "" and any(k[0] == "gone" for k in marked)
    assert all(k[0] != "gone" for k in {(r["source_record_id"], 0) for r in L.carry_marks(new, old, keep_confirmed=False).collect()})


def test_candidate_scores(spark):
    one = lambda *a: spark.range(1).select(L.candidate_scores(*a).alias("s")).first()["s"]
    assert round(one(F.lit(False), F.lit(0.0), F.lit(2), F.lit(True), F.lit(True)), 4) == 0.67
    assert round(one(F.lit(False), F.lit(0.0), F.lit(0), F.lit(True), F.lit(True)), 4) == 0.69
    assert one(F.lit(True), F.lit(1.0), F.lit(None).cast("int"), F.lit(False), F.lit(False)) == 1.0


def test_title_index_order(spark):
    books = spark.createDataFrame([("b1", "Same", "A", "", 0), ("b2", "Other Name", "A", "", 1), ("b3", "The Same", "A", "", 2), ("b4", "Start: Other Name", "A", "", 3), ("b5", "X: Fresh Part", "A", "", 4), ("b6", "Y: Fresh Part", "A", "", 5)], BOOKS)
    index = {r["key"]: (r["book_id"], r["position"]) for r in L.title_index(books).collect()}
    assert index["same"] == ("b3", 0) and index["other name"] == ("b2", 1) and index["fresh part"] == ("b5", 4)


def test_name_match(spark):
    names = spark.createDataFrame([(1, "anna"), (1, "karl"), (2, "anna"), (3, "eva")], "book_id long, name string")
    segments = spark.createDataFrame([("s", "", ["anna", "karl", "none"]), ("t", "roe", ["anna", "karl"]), ("u", "unknown", ["eva"])], "segment string, akey string, tokens array<string>")
    authors = spark.createDataFrame([("roe", 2)], "akey string, book_id long")
    got = {r["segment"]: (r["book_id"], r["shared"], r["author_filter"]) for r in N.predictions(segments, names, authors).collect()}
    assert got == {"s": (1, ["anna", "karl"], False), "t": (2, ["anna"], True), "u": (3, ["eva"], False)}
    tested = spark.createDataFrame([(12.0, 6.0, True), (9.0, 1.0, False), (16.0, 11.0, True), (6.0, 3.0, False)], "score double, margin double, correct boolean")
    assert N.chosen_limits(N.sweep(tested))["n"] == 2


def test_rank_sum(spark):
    data = [(1, 0), (2, 0), (2, 1), (3, 1), (5, 1), (5, 0), (9, 1)]
    got = R.rank_sum(spark.createDataFrame(data, "v int, g int"), "v", F.col("g") == 1).first()
    u = sum((a > b) + (a == b) / 2 for a, ga in data if ga for b, gb in data if not gb)
    assert got["u"] == u and 0 < got["p"] <= 1


def test_row_order_by_ranges(spark):
    frame = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("w"))
    got = row_order(frame, ["g"], ["id"], F.shiftrightunsigned(F.xxhash64("id"), 4), sums={"before": "w"}, per_task=100)
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["rank"], r["before"], r["w"]))
    for ranks in by.values():
        ranks.sort()
        assert [r for r, _, _ in ranks] == list(range(len(ranks)))
        assert all(b[1] == a[1] + a[2] for a, b in zip(ranks, ranks[1:], strict=False))


def test_merged_and_resolved(spark):
    books, editions = fixture(spark)
    merged = L.merged_table(books, L.link_editions(editions, books)["links"].select("book_id", "translation_id"))
    assert sorted(r["tr_translation_id"] or "" for r in merged.collect()) == ["", "b1_Ga", "b1_Gb", "b3_F"]
    wanted = spark.createDataFrame([("k1", "Jane Doe", "Quiet Harbor"), ("k2", "Jane Doe", "Nothing"), ("k3", "Jane Doe", "The Quiet Harbor")], "key string, author string, title string")
    docs = [("Other", ["Jane Doe"], ["Mills & Boon"], "w0"), ("Quiet Harbour", ["Doe Jane", "Jane Doe"], ["Mills & Boon"], "w1")]
    hits = spark.createDataFrame([("k1", docs), ("k3", docs)], "key string, docs array<struct<title:string,authors:array<string>,publishers:array<string>,work_id:string>>")
    got = {r["key"]: r["outcome"] for r in L.resolve_titles(wanted, hits, houses=["mills"]).collect()}
    assert got == {"k1": "found", "k2": "not found"}


def test_selection(spark):
    editions = spark.createDataFrame([("b", "F", "1.0", "single", "X", "1985", "1980", "DNB"), ("b", "G", "manual", "anthology", "", "1990", "", "name match")], "book_id string, language_letter string, match_score string, edition_type string, translators string, pub_year string, first_edition_year string, source string")
    flags = X.edition_flags(editions.replace("", None, ["first_edition_year"]))
    got = {r["language_letter"]: (r["year"], r["strict_ok"], r["has_translator"], r["early_ed"]) for r in flags.collect()}
    assert got == {"F": (1980, True, True, True), "G": (1990, False, False, True)}
    books = spark.createDataFrame([("b", 1979)], "book_id string, year int")
    out = X.eligible(books, X.availability(flags, "strict_ok")).first()
    assert (out["period"], out["ok"], out["ok_tr"], out["langs"], out["decade"]) == ("early", True, True, "F", "1970s")
