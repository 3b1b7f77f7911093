"""Series order: anchors, hidden anchors, the gate, and review, against a plain version."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from marginalia.cluster import ship
from marginalia.operators import series as P


def plain_window(points, coll, line, num, hidden=None, most=200):
    own = sorted((n, e) for c, line_, n, e, r in points if (c, line_) == (coll, line) and r != hidden)
    at = bisect_left([n for n, _ in own], num)
    if not 0 < at < len(own):
        return None
    lo, hi = own[at - 1], own[at]
    return (lo, hi) if lo[1] <= hi[1] and hi[0] - lo[0] <= most else None


@pytest.mark.parametrize("hide", [False, True])
def test_windows(spark, hide):
    rnd = random.Random(8)
    points, records = [], []
    for r in range(120):
        coll, num = rnd.choice("ab"), rnd.randrange(60)
        records.append((f"r{r}", "k", coll, num))
        if rnd.random() < 0.6:
            points += [(coll, line, num, num // 2 + rnd.randrange(4), f"r{r}") for line in rnd.sample("LM", rnd.randrange(1, 3))]
    frame = spark.createDataFrame(points, "coll string, line string, num int, number int, source_record_id string")
    asked = spark.createDataFrame(records, "source_record_id string, author_key string, coll string, num int")
    got = {(r["source_record_id"], r["line"]): (tuple(r["lo"]), tuple(r["hi"])) for r in P.windows(asked, frame, hide_own=hide, most_span=20).collect()}
    want = {(r, line): w for r, _, coll, num in records for line in "LM" if (w := plain_window(points, coll, line, num, r if hide else None, 20))}
    assert got == want and len(got) > 40


def test_review_and_gate(spark):
    ship(spark)
    books = [(f"b{i}", "Quiet", str(i), f"Quiet #{i}", "Jane Doe" if i % 2 else "Max Roe", f"Title {i}") for i in range(1, 60)]
    table = spark.createDataFrame(books, "book_id string, line string, series_number string, all_lines string, authors string, title string").withColumns({"position": F.col("series_number").cast("int"), "pub_date": F.lit("1990")})
    records = [(i, f"r{i}", f"Collection Bleue n° {100 + i}", "Doe, Jane" if i % 2 else "Roe, Max", "F") for i in range(1, 60)] + [(99, "r1", "Other 5", "Doe, Jane", "F"), (100, "r99", "no number", "Doe, Jane", "F")]
    rows = spark.createDataFrame(records, "position int, source_record_id string, series string, authors string, language_letter string").withColumns({c: F.lit("x") for c in ("translated_title", "pub_date", "publisher", "translators", "source")})
    links = spark.createDataFrame([(1, f"r{i}", f"b{i}", "F", "1.0") for i in range(1, 60) if i % 10] + [(2, "r3", "b4", "F", "0.9"), (3, "r3", "b3", "F", "0.9"), (4, "r20", "b20", "F", "manual"), (5, "r40", "b40", "G", "1.0")], "position int, source_record_id string, book_id string, language_letter string, match_score string")
    members = P.line_members(table)
    owned = P.author_members(table, members)
    numbered = P.numbered_records(rows, table)
    assert {r["source_record_id"]: (r["coll"], r["num"], r["author_key"]) for r in numbered.collect()}["r1"] == ("collection bleue", 101, "jane doe")
    known = P.known_links(links, "F")
    assert {r["source_record_id"]: r["book_id"] for r in known.collect()}["r3"] == "b3" and known.filter("source_record_id = 'r20'").count() == 0
    points = P.anchors(numbered, known, members)
    tested = P.self_test(numbered, known, points, owned)
    tallies = {r["bucket"]: (r["tested"], r["right"], r["unique"], r["unique_right"]) for r in P.bucket_tallies(tested).collect()}
    assert sum(t[0] for t in tallies.values()) == tested.count() > 40 and all(t[1] == t[0] for t in tallies.values())
    pairs = P.reliable_pairs(tested)
    r = pairs.first()
    assert (r["coll"], r["line"], r["reliable"]) == ("collection bleue", "Quiet", True) and P.reliable_pairs(tested, least_tests=10_000).filter("reliable").count() == 0
    previous = spark.createDataFrame([("r30", "b30", "n")], "source_record_id string, suggested_book_id string, confirm string")
    review = P.series_review(numbered, known, points, owned, pairs, previous=previous, auto=True)
    best = {r["source_record_id"]: (r["suggested_book_id"], r["confirm"], r["confidence"], r["predicted_number"], r["window"]) for r in review.collect()}
    assert best == {f"r{i}": (f"b{i}", "n" if i == 30 else "y", "unique", i, f"{i - 1}-{i + 1}") for i in (10, 20, 30, 40, 50)}
    extras = P.confirmed_extras(review, rows, table).collect()
    assert {r["source_record_id"] for r in extras} == {"r10", "r20", "r40", "r50"} and extras[0]["source"] == "x (series-anchored)"


def test_candidates_of_short_and_long_windows_without_comparing_all(spark, capsys):
    rnd = random.Random(4)
    around = [(f"r{i}", rnd.choice("xy"), "c", "L", 5, (1, lo := rnd.randrange(-50, 3000)), (9, lo + rnd.choice([0, 1, 2, 7, 64, 900])), 8) for i in range(150)]
    owned = [(rnd.choice("xy"), "L", rnd.randrange(-60, 4000), f"b{i // 2}") for i in range(1200)]
    windows = spark.createDataFrame(around, "source_record_id string, author_key string, coll string, line string, num int, lo struct<num:int,number:int>, hi struct<num:int,number:int>, span int")
    found = P.candidates(windows, spark.createDataFrame(owned, "author_key string, line string, number int, book_id string"))
    got = sorted((r["source_record_id"], r["book_id"], r["number"], r["candidates"]) for r in found.collect())
    inside = [(r, b, n) for r, a, _, _, _, lo, hi, _ in around for k, _, n, b in owned if k == a and lo[1] <= n <= hi[1]]
    books = {r: len({b for q, b, _ in inside if q == r}) for r, _, _ in inside}
    assert got == sorted((r, b, n, books[r]) for r, b, n in inside) and len(got) > 1000
    found.explain()
    assert "_cell" in capsys.readouterr().out.split("Join ")[1].split("]")[0]  # the range is one of the join's keys


def test_no_window_reads_the_rest_of_its_group_for_each_row(spark, capsys):
    points = spark.createDataFrame([("a", "L", 1, 1, "r1")], "coll string, line string, num int, number int, source_record_id string")
    asked = spark.createDataFrame([("r2", "k", "a", 2)], "source_record_id string, author_key string, coll string, num int")
    for hide in (False, True):
        P.windows(asked, points, hide_own=hide).explain()
        assert "unboundedfollowing" not in capsys.readouterr().out
