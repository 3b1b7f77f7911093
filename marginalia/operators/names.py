"""Linking blurbs to books by shared names: inverse document frequency over names, calibrated on labelled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.functions import text as T
from marginalia.operators.ordered import runner_up

MOST_BOOKS = 300
#: Names that may be broadcast (10 MB at most), and the parts of a frequent one.
BROADCAST_NAMES, SALTS = 200_000, 8
SCORES, MARGINS = (5.0, 8.0, 10.0, 15.0), (2.0, 3.0, 5.0, 8.0, 10.0)


def name_weights(names: DataFrame, *, most_books: int = MOST_BOOKS) -> DataFrame:
    """(name, df, idf) from (book_id, name): ln(N / df) over N books; names of more than ``most_books`` are left out."""
    total = names.agg(F.count_distinct("book_id").alias("n"))
    df = names.groupBy("name").agg(F.count_distinct("book_id").alias("df")).filter(F.col("df") <= most_books)
    return df.crossJoin(F.broadcast(total)).select("name", "df", F.log(F.col("n") / F.col("df")).alias("idf"))  # one row


def predictions(segments: DataFrame, names: DataFrame, authors: DataFrame, *, most_books: int = MOST_BOOKS) -> DataFrame:
    """(segment, book_id, score, margin, shared, author_filter): the book with the largest sum of shared weights.

    ``segments`` has (segment, akey, tokens); ``names`` (book_id, name); ``authors`` (akey, book_id). A known author key
    restricts the books to the author's; an unknown or empty one does not. Scores are rounded to nine digits, as sums of
    doubles depend on their order; ties go to the smaller book id.
    """
    weights = name_weights(names, most_books=most_books)
    known = authors.select("akey").distinct().withColumn("author_filter", F.lit(True))
    marked = segments.join(known, "akey", "left").withColumn("author_filter", F.coalesce("author_filter", F.lit(False)))
    postings = names.distinct().join(weights, "name")
    tokens = marked.select("segment", "akey", "author_filter", F.explode(F.array_distinct("tokens")).alias("name"))
    # names that identify no book go before anything is shuffled; a frequent name is spread over salts
    tokens = tokens.join(F.broadcast(weights.select("name")) if weights.count() <= BROADCAST_NAMES else weights.select("name"), "name", "left_semi")
    salted = postings.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = tokens.withColumn("_salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(salted, ["name", "_salt"]).drop("_salt")
    free = pairs.filter("NOT author_filter")
    bound = pairs.filter("author_filter").join(authors.select("akey", "book_id").distinct(), ["akey", "book_id"], "left_semi")
    scored = free.unionByName(bound.select(*free.columns)).groupBy("segment", "book_id", "author_filter").agg(F.round(F.sum("idf"), 9).alias("score"), F.array_sort(F.collect_set("name")).alias("shared"))
    return runner_up(scored, ["segment"], "score", "book_id").select("segment", "book_id", "score", "margin", "shared", "author_filter")


def sweep(tested: DataFrame, *, scores: tuple[float, ...] = SCORES, margins: tuple[float, ...] = MARGINS) -> DataFrame:
    """(min_score, min_margin, n, correct, coverage, precision) of rows (score, margin, correct) for each pair of limits.

    The limits are one array on each row, so each row is aggregated where it is."""
    grid = F.array(*(F.struct(F.lit(s).alias("min_score"), F.lit(m).alias("min_margin")) for s in scores for m in margins))
    rows = tested.select("score", "margin", F.col("correct").cast("int").alias("correct"), F.explode(grid).alias("g"))
    passes = (F.col("score") >= F.col("g.min_score")) & (F.col("margin") >= F.col("g.min_margin"))
    out = rows.groupBy("g.min_score", "g.min_margin").agg(F.count_if(passes).alias("n"), F.coalesce(F.sum(F.when(passes, F.col("correct"))), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("all"))
    return out.select("min_score", "min_margin", "n", "correct", (F.col("n") / F.col("all")).alias("coverage"), (F.col("correct") / F.nullif(F.col("n"), F.lit(0))).alias("precision"))


def chosen_limits(table: DataFrame, *, target: float = 0.98) -> dict | None:
    """The limits with the largest coverage at ``target`` precision; then the better precision, then the lower limits."""
    row = table.filter(F.col("precision") >= target).orderBy(F.desc("coverage"), F.desc("precision"), "min_score", "min_margin").limit(1).collect()
    return row[0].asDict() if row else None


def accepted(scored: DataFrame, limits: dict) -> DataFrame:
    return scored.filter((F.col("score") >= limits["min_score"]) & (F.col("margin") >= limits["min_margin"]))


def surname_tokens(words: Column, common: list[str]) -> Column:
    return F.array_except(words, F.array(*map(F.lit, common)))


LEAST_DESCRIPTION = 40
#: Limits of the self-test's table.
TEST_SCORES, TEST_MARGINS = (0.0, 5.0, 10.0, 15.0), (0.0, 3.0, 5.0, 8.0, 10.0)


def described(books: DataFrame, *, least: int = LEAST_DESCRIPTION) -> DataFrame:
    """Books whose description has more than ``least`` characters."""
    return books.filter(F.length(T.text_or_empty(F.col("description"))) > least)


def author_books(books: DataFrame) -> DataFrame:
    """(akey, book_id) for each author of each book."""
    names = F.filter(F.transform(F.split(T.text_or_empty(F.col("authors")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return books.select("book_id", F.explode(names).alias("name")).select(T.author_key(F.col("name")).alias("akey"), "book_id").distinct()


def title_books(books: DataFrame) -> DataFrame:
    """(title_key, book_id); a volume "A // B" counts under both titles."""
    return books.select("book_id", F.explode(F.split(T.text_or_empty(F.col("title")), "//")).alias("part")).select(T.short_title_key(F.col("part")).alias("title_key"), "book_id").distinct()


def product_truth(products: DataFrame, books: DataFrame) -> DataFrame:
    """(handle, book_id): the books that a product's known originals name, by the whole title or by what follows a colon."""
    titles = products.select("handle", F.explode(F.split(T.text_or_empty(F.col("original_titles")), r" \| ")).alias("t"))
    after = F.when(F.contains("t", F.lit(":")), F.array(F.element_at(F.split("t", ":", 2), -1))).otherwise(F.array().cast("array<string>"))
    keys = titles.select("handle", F.explode(F.concat(F.array("t"), after)).alias("t")).select("handle", T.short_title_key(F.col("t")).alias("title_key")).distinct()
    return keys.join(title_books(books), "title_key").select("handle", "book_id").distinct()


def segment_truth(segments: DataFrame, truth: DataFrame, books: DataFrame) -> DataFrame:
    """(segment, book_id): a product's books that are by the segment's author, or by any of the product's if it names none.

    ``segments`` has segment, handle, akey and authors (the product's). Without any author, all of the product's books.
    """
    listed = F.array_distinct(F.transform(F.filter(F.split(T.text_or_empty(F.col("authors")), ";"), lambda a: F.trim(a) != ""), T.author_key))
    keys = segments.select("segment", "handle", F.when(F.coalesce("akey", F.lit("")) != "", F.array("akey")).otherwise(listed).alias("keys"))
    met = keys.join(truth, "handle")
    free = met.filter(F.size("keys") == 0).select("segment", "book_id")
    bound = met.filter(F.size("keys") > 0).select("segment", "book_id", F.explode("keys").alias("akey")).join(author_books(books), ["akey", "book_id"]).select("segment", "book_id")
    return free.unionByName(bound).distinct()


def testable_segments(segments: DataFrame, products: DataFrame) -> DataFrame:
    """Segments of products with known originals, but for products with more stories than originals: their truth has gaps."""
    known = products.select("handle", F.coalesce(F.col("n_stories_with_original").try_cast("int"), F.lit(0)).alias("_known")).filter("_known > 0")
    rows = segments.join(known, "handle").withColumn("_stories", F.count(F.lit(1)).over(Window.partitionBy("handle")))
    return rows.filter("_stories <= _known").drop("_stories", "_known")


def name_self_test(segments: DataFrame, products: DataFrame, books: DataFrame, names: DataFrame, *, most_books: int = MOST_BOOKS) -> DataFrame:
    """The prediction of each testable segment in both modes and whether it is right.

    Columns: segment, handle, mode, predicted_book_id, score, margin, shared, author_filter, correct. A prediction is
    right if it is one of the segment's books, or the same story as one of them under another title. ``segments`` has
    segment, handle, akey, authors, tokens.
    """
    tested = testable_segments(segments, products)
    truth = segment_truth(tested, product_truth(products, books), books)
    tested = tested.join(truth, "segment", "left_semi")
    index = author_books(books)
    modes = [("with author", tested), ("names only", tested.withColumn("akey", F.lit("")))]
    out = None
    for mode, rows in modes:
        guess = predictions(rows.select("segment", F.coalesce("akey", F.lit("")).alias("akey"), "tokens"), names, index, most_books=most_books).withColumnRenamed("book_id", "predicted_book_id")
        own = rows.select("segment", "handle").join(guess, "segment", "left").withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    about = books.select("book_id", F.array_distinct(F.filter(F.split(T.fold_joined(F.col("description")), " "), lambda w: w != "")).alias("words"), F.transform(F.filter(F.split(T.text_or_empty(F.col("authors")), ";"), lambda a: F.trim(a) != ""), T.author_key).alias("keys"))
    pairs = out.filter("predicted_book_id IS NOT NULL").select("segment", "predicted_book_id").distinct().join(truth, "segment")
    left, right = (about.select(F.col("book_id").alias(f"_{s}"), F.col("words").alias(f"words_{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab")
    distinct = pairs.select("predicted_book_id", "book_id").distinct()
    same = distinct.join(left, distinct["predicted_book_id"] == F.col("_a")).join(right, distinct["book_id"] == F.col("_b"))
    same = same.filter((F.col("_a") == F.col("_b")) | S.same_story(F.col("words_a"), F.col("words_b"), F.col("keys_a"), F.col("keys_b"))).select("predicted_book_id", "book_id")
    right_ones = pairs.join(same, ["predicted_book_id", "book_id"]).select("segment", "predicted_book_id", F.lit(True).alias("correct")).distinct()
    found = out.join(right_ones, ["segment", "predicted_book_id"], "left")
    return found.select("segment", "handle", "mode", "predicted_book_id", F.coalesce(F.round("score", 2), F.lit(0.0)).alias("score"), F.coalesce(F.round("margin", 2), F.lit(0.0)).alias("margin"), "shared", F.coalesce("author_filter", F.lit(False)).alias("author_filter"), F.coalesce("correct", F.lit(False)).alias("correct"))


def self_test_table(tested: DataFrame) -> DataFrame:
    """``sweep`` for each mode: (mode, min_score, min_margin, n, coverage, precision) of predictions; limits without any are left out."""
    grid = F.array(*(F.struct(F.lit(s).alias("min_score"), F.lit(m).alias("min_margin")) for s in TEST_SCORES for m in TEST_MARGINS))
    rows = tested.select("mode", "score", "margin", "predicted_book_id", F.col("correct").cast("int").alias("correct"), F.explode(grid).alias("g"))
    passes = (F.col("score") >= F.col("g.min_score")) & (F.col("margin") >= F.col("g.min_margin")) & F.col("predicted_book_id").isNotNull()
    out = rows.groupBy("mode", "g.min_score", "g.min_margin").agg(F.count_if(passes).alias("n"), (F.count_if(passes) / F.count(F.lit(1))).alias("coverage"), F.avg(F.when(passes, F.col("correct"))).alias("precision"))
    return out.filter("n > 0")


def applied(segments: DataFrame, books: DataFrame, names: DataFrame, table: DataFrame, *, target: float = 0.98, most_books: int = MOST_BOOKS) -> DataFrame:
    """(segment, book_id, mode, score, margin, shared): predictions of new segments that reach the limits of their mode.

    A segment whose author is known is predicted among the author's books. The limits of a mode are those with the
    largest coverage at ``target`` precision; a mode without any accepts nothing. They are joined as a table.
    """
    order = Window.partitionBy("mode").orderBy(F.desc("coverage"), F.desc("precision"), "min_score", "min_margin")
    chosen = table.filter(F.col("precision") >= target).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("mode", "min_score", "min_margin")
    found = predictions(segments.select("segment", F.coalesce("akey", F.lit("")).alias("akey"), "tokens"), names, author_books(books), most_books=most_books)
    moded = found.withColumn("mode", F.when(F.col("author_filter"), "with author").otherwise("names only")).join(chosen, "mode")
    return moded.filter("score >= min_score AND margin >= min_margin").select("segment", "book_id", "mode", F.round("score", 2).alias("score"), F.round("margin", 2).alias("margin"), "shared")
