"""Predicting originals from the order of a series: linked records are anchors, records between them are interpolated.

A foreign collection that translates an English line keeps its order more or less. Around a record, the nearest anchors
of its collection give a window of the line's numbers; the books of the record's author in it are candidates. How well
that works is measured by hiding each anchor in turn, and only collections that pass are confirmed without a reviewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.functions import text as T
from marginalia.operators.linkage import authors_of, resolved_authors
from marginalia.operators.ordered import first_per_key, proximity

LEAST_ANCHORS, MOST_SPAN, LEAST_TESTS, LEAST_PRECISION, SUGGESTIONS = 5, 200, 20, 0.95, 3


def line_members(books: DataFrame) -> DataFrame:
    """(book_id, line, number): every line and number that a book has."""
    pairs = T.memberships(F.col("line"), F.col("series_number"), F.col("all_lines"))
    return books.select("book_id", F.explode(pairs).alias("m")).select("book_id", "m.line", "m.number").filter("number IS NOT NULL")


def author_members(books: DataFrame, members: DataFrame) -> DataFrame:
    """(author_key, line, number, book_id) by the folded name of each author."""
    keyed = authors_of(books).select("book_id", T.fold(F.col("author")).alias("author_key")).distinct()
    return members.join(keyed, "book_id").select("author_key", "line", "number", "book_id").distinct()


def numbered_records(records: DataFrame, books: DataFrame) -> DataFrame:
    """Translation records, one for each id, with ``coll`` and ``num`` of their series and the ``author_key`` of their first
    author: that of the table, equal or almost the same (names of any length)."""
    first = first_per_key(records, ["source_record_id"], ["position"])
    name = F.trim(F.element_at(F.split(T.text_or_empty(F.col("authors")), ";"), 1))
    rows = first.withColumn("_s", T.split_series(F.col("series"))).withColumns({"coll": F.col("_s.name"), "num": F.col("_s.number"), "_name": name}).drop("_s")
    known = authors_of(books).groupBy("author").agg(F.min("position").alias("position"))
    found = resolved_authors(rows.select(F.col("_name").alias("name")), known, shortest=1).select(F.col("name").alias("_name"), T.fold(F.col("author")).alias("author_key"))
    return rows.join(found, "_name", "left").drop("_name")


def known_links(links: DataFrame, letter: str) -> DataFrame:
    """(source_record_id, book_id): the last link of each record in a language, links made by hand left out."""
    rows = links.filter((F.col("language_letter") == letter) & (T.text_or_empty(F.col("match_score")) != "manual"))
    return first_per_key(rows, ["source_record_id"], ["position"], last=True).select("source_record_id", "book_id")


def anchors(records: DataFrame, links: DataFrame, members: DataFrame, *, least: int = LEAST_ANCHORS) -> DataFrame:
    """(coll, line, num, number, source_record_id): linked records with both numbers, of pairs with enough anchors."""
    rows = records.filter("num IS NOT NULL").select("source_record_id", "coll", "num").join(links, "source_record_id").join(members, "book_id").select("coll", "line", "num", "number", "source_record_id")
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("coll", "line"))).filter(F.col("_n") >= least).drop("_n")


def windows(records: DataFrame, points: DataFrame, *, most_span: int = MOST_SPAN, hide_own: bool = False) -> DataFrame:
    """The records between anchors of their collection, for each line: (..., lo, hi, span) with points (num, number).

    The lower anchor's number is smaller than the record's, the upper one's at least equal; of anchors with one number,
    the lower side takes that with the largest number of the line, the upper side the smallest. Numbers of the line must
    not fall, nor the anchors lie more than ``most_span`` apart. With ``hide_own``, anchors of the record itself do not
    count; these have the record's number, so only the upper side can meet them.
    """
    asked = records.filter("num IS NOT NULL").select("source_record_id", "author_key", "coll", "num").join(points.select("coll", "line").distinct(), "coll")
    marks = points.select("coll", "line", "num", "number").distinct().withColumn("p", F.struct("num", "number"))
    both = marks.unionByName(asked.withColumns({"number": F.lit(None).cast("int"), "p": F.lit(None).cast(marks.schema["p"].dataType)}), allowMissingColumns=True).withColumn("asks", F.col("p").isNull())
    group = Window.partitionBy("coll", "line")
    ahead = group.orderBy("num", F.col("asks").desc(), "number")  # records stand before the anchors of their number
    # the same order read from its end (or with records after the anchors of their number): a frame that ends with the
    # group would be read again for each row
    back = group.orderBy(F.col("num").desc(), F.col("asks").desc() if hide_own else F.col("asks"), F.col("number").desc())
    before = lambda order: F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lo, hi = before(ahead), before(back)
    found = both.withColumns({"lo": lo, "hi": hi}).filter("asks").drop("p", "asks", "number")
    if hide_own:
        others = asked.join(points.withColumnRenamed("source_record_id", "owner"), ["coll", "line", "num"]).filter("owner <> source_record_id")
        level = others.groupBy("source_record_id", "coll", "line").agg(F.min(F.struct("num", "number")).alias("level"))
        found = found.join(level, ["source_record_id", "coll", "line"], "left").withColumn("hi", F.coalesce("level", "hi")).drop("level")
    found = found.withColumn("span", F.col("hi.num") - F.col("lo.num"))
    return found.filter((F.col("hi.number") >= F.col("lo.number")) & (F.col("span") <= most_span)).select("source_record_id", "author_key", "coll", "line", "num", "lo", "hi", "span")


def _cell(number: Column, level: Column) -> Column:
    """The range of 2 ** level numbers that a number lies in."""
    return F.call_function("shiftright", number.cast("long"), level)


def candidates(around: DataFrame, owned: DataFrame) -> DataFrame:
    """(source_record_id, coll, line, book_id, number, predicted, lo, hi, span, score, candidates): the author's books of the
    line between the anchors' numbers.

    A range join: a window meets the two cells of the smallest power of two that is not below its length, a book stands in
    one cell of each length that occurs. So at most four times the books of a window are looked at."""
    length = F.col("hi.number").cast("long") - F.col("lo.number").cast("long")
    levelled = around.filter("hi.number >= lo.number").withColumn("_level", F.when(length == 0, 0).otherwise(F.length(F.bin(length))).cast("int"))
    cells = levelled.withColumn("_cell", F.explode(F.array_distinct(F.array(_cell(F.col("lo.number"), F.col("_level")), _cell(F.col("hi.number"), F.col("_level"))))))
    placed = owned.join(F.broadcast(levelled.select("_level").distinct()), how="cross")  # 64 lengths at most
    placed = placed.withColumn("_cell", _cell(F.col("number"), F.col("_level")))
    pairs = cells.join(placed, ["author_key", "line", "_level", "_cell"]).filter(F.col("number").between(F.col("lo.number"), F.col("hi.number")))
    expected = F.col("lo.number") + (F.col("num") - F.col("lo.num")) * (F.col("hi.number") - F.col("lo.number")) / F.greatest(F.col("span"), F.lit(1))
    scored = pairs.withColumn("predicted", expected).withColumn("score", proximity(F.col("number"), F.col("predicted"), F.col("lo.number"), F.col("hi.number")))
    record = Window.partitionBy("source_record_id")
    place = F.dense_rank().over(record.orderBy(F.col("book_id").asc_nulls_last()))
    counted = scored.withColumn("_n", F.when(F.col("book_id").isNotNull(), place)).withColumn("candidates", F.coalesce(F.max("_n").over(record), F.lit(0)).cast("long"))
    return counted.select("source_record_id", "coll", "line", "book_id", "number", "predicted", F.col("lo.number").alias("lo"), F.col("hi.number").alias("hi"), "span", "score", "candidates")


def _best() -> list:
    return [F.col("score").desc(), "line", "number", "book_id"]


def self_test(records: DataFrame, links: DataFrame, points: DataFrame, owned: DataFrame, *, most_span: int = MOST_SPAN) -> DataFrame:
    """Each anchored record predicted from the others: (source_record_id, coll, line, bucket, unique, right), the best guess of
    each record and anchored pair."""
    tested = records.join(links, "source_record_id", "left_semi").filter("author_key IS NOT NULL")
    pairs = points.select("source_record_id", F.col("coll").alias("_coll"), F.col("line").alias("_line"))  # a record is tested once for each of its anchors
    guesses = candidates(windows(tested, points, most_span=most_span, hide_own=True), owned)
    best = first_per_key(guesses, ["source_record_id"], _best())
    judged = best.join(links.withColumnRenamed("book_id", "true_book"), "source_record_id")
    return pairs.join(judged, "source_record_id").select("source_record_id", "coll", "line", T.distance_bucket(F.col("span")).alias("bucket"), (F.col("candidates") == 1).alias("unique"), (F.col("book_id") == F.col("true_book")).alias("right"))


def bucket_tallies(tested: DataFrame) -> DataFrame:
    """(bucket, tested, right, unique, unique_right) by the distance of the anchors."""
    return tested.groupBy("bucket").agg(F.count(F.lit(1)).alias("tested"), F.count_if("right").alias("right"), F.count_if("unique").alias("unique"), F.count_if(F.col("unique") & F.col("right")).alias("unique_right"))


def reliable_pairs(tested: DataFrame, *, least_tests: int = LEAST_TESTS, least_precision: float = LEAST_PRECISION) -> DataFrame:
    """(coll, line, tests, precision, reliable): how often unique predictions were right, and whether that suffices."""
    out = tested.filter("unique").groupBy("coll", "line").agg(F.count(F.lit(1)).alias("tests"), F.avg(F.col("right").cast("int")).alias("precision"))
    return out.withColumn("reliable", (F.col("tests") >= least_tests) & (F.col("precision") >= least_precision))


def series_review(records: DataFrame, links: DataFrame, points: DataFrame, owned: DataFrame, pairs: DataFrame, *, previous: DataFrame | None = None, auto: bool = False, top: int = SUGGESTIONS, most_span: int = MOST_SPAN) -> DataFrame:
    """At most ``top`` candidates for each record that is not linked, unique ones first, then by score.

    A mark of ``previous`` (source_record_id, suggested_book_id, confirm) wins; else, with ``auto``, unique predictions
    of reliable pairs are confirmed.
    """
    open_ = records.join(links, "source_record_id", "left_anti").filter("author_key IS NOT NULL")
    guesses = candidates(windows(open_, points, most_span=most_span), owned)
    ranked = guesses.withColumn("_n", F.row_number().over(Window.partitionBy("source_record_id").orderBy(*_best()))).filter(F.col("_n") <= top).drop("_n")
    rows = ranked.join(pairs, ["coll", "line"], "left").withColumn("confidence", F.when(F.col("candidates") == 1, "unique").otherwise("several")).withColumnRenamed("book_id", "suggested_book_id")
    good = F.lit(auto) & (F.col("confidence") == "unique") & F.coalesce("reliable", F.lit(False))
    made = F.when(good, "y").otherwise("")
    if previous is not None:
        marks = previous.select("source_record_id", "suggested_book_id", F.col("confirm").alias("_m"))
        rows = rows.join(marks, ["source_record_id", "suggested_book_id"], "left")
        made = T.first_filled(F.trim(F.coalesce("_m", F.lit(""))), made)
    out = rows.select(made.alias("confirm"), "confidence", F.round("score", 3).alias("score"), "suggested_book_id", "coll", F.col("line").alias("english_line"), F.col("number").alias("english_number"), F.round("predicted").cast("int").alias("predicted_number"), F.concat_ws("-", "lo", "hi").alias("window"), "candidates", F.col("span").alias("anchor_span"), F.col("precision").alias("collection_tested_precision"), "source_record_id")
    return out.orderBy(F.col("confidence") != "unique", F.desc("score"), "source_record_id", "suggested_book_id")


def confirmed_extras(review: DataFrame, records: DataFrame, books: DataFrame) -> DataFrame:
    """Confirmed predictions as rows of the interchange format."""
    ok = review.filter(S.is_yes(F.col("confirm"))).join(books.select(F.col("book_id").alias("suggested_book_id"), F.col("title").alias("original_title"), F.col("authors").alias("_a")), "suggested_book_id")
    rows = ok.join(records.drop("coll", "authors"), "source_record_id")
    note = F.concat(F.lit("series-anchored ("), "english_line", F.lit(" #"), F.col("english_number").cast("string"), F.lit(")"))
    empty = F.lit("")
    return rows.select("language_letter", F.col("_a").alias("authors"), "original_title", "translated_title", "pub_date", "publisher", empty.alias("place"), "translators", "series", empty.alias("isbn"), empty.alias("format"), note.alias("copyright"), F.concat("source", F.lit(" (series-anchored)")).alias("source"), "source_record_id", empty.alias("url"))
