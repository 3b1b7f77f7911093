"""Linking translated editions to original books.

Exact keys first, as an equi-join; what is left is compared inside the author's block only. An author's titles are dealt
in blocks of at most BLOCK keys, and each distinct title that is left meets each block once. Inside, a bound by counted
letters decides which candidates can still win, and the sequence ratio is computed for these only. A prolific author
thus has many small tasks, and no pair of titles is a row.

A run (``link_run``) joins two paths: library records, found under an author of the table, and rows of extra sources,
whose authors are resolved first. Its results are the tables that reviewers and later steps read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.cluster import Scratch, ship
from marginalia.functions import similarity as S
from marginalia.functions import text as T
from marginalia.operators.ordered import edition_ids, first_per_key, greedy_editions
from marginalia.sources.marc import works_in_edition

THRESHOLD, MOST_GAP, LEAST_SIMILARITY, SUGGESTIONS = 0.88, 15, 0.75, 3
#: Candidate keys of an author in a block, and titles that meet it in one place.
BLOCK, TITLES = 512, 1024
REVIEW_KEY = ["source_record_id", "suggested_book_id", "language_letter"]
# The columns of the output tables.
EDITION_COLUMNS = [
    "translation_id", "book_id", "language_letter", "language", "original_title", "author", "translated_title", "pub_date", "pub_year", "publisher", "place",
    "translators", "series", "isbn", "source", "source_record_id", "original_title_in_record", "match_score", "edition_type", "works_in_edition", "first_edition",
    "first_edition_year", "original_series",
]
UNMATCHED_COLUMNS = [
    "author", "language_letter", "source", "source_record_id", "translated_title", "pub_year", "publisher", "original_title_in_record", "reason", "closest_series_title",
    "closest_score", "responsibility",
]
CANDIDATE_COLUMNS = [
    "confirm", "confidence", "candidate_score", "reason", "language_letter", "language", "author", "suggested_book_id", "suggested_original_title", "original_pub_date",
    "translated_title", "pub_date", "pub_year", "years_after_original", "publisher", "place", "translators", "series", "isbn", "title_similarity", "romance_publisher",
    "candidates_for_this_record", "original_title_in_record", "responsibility", "source", "source_record_id",
]
#: Language codes of records by letter.
CODES = {"F": ["fre", "fra"], "G": ["ger", "deu"], "P": ["pol"]}


def combined_books(*tables: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Tables one after another, columns united; of equal ``book_id`` the first in order stays. Adds ``position``.

    Rows follow ``order`` (columns that all tables have), else their own ``position``, else the order in which Spark
    reads them, which is that of the file only for a table of one unsplit file.
    """
    every, out = [c for t in tables for c in t.columns if c != "position"], None
    for place, table in enumerate(tables):
        own = [F.col(c) for c in order] if order else [F.col("position")] if "position" in table.columns else [F.monotonically_increasing_id()]
        rows = table.withColumn("position", F.struct(F.lit(place).alias("table"), *(c.alias(f"o{i}") for i, c in enumerate(own))))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return first_per_key(out, ["book_id"], ["position"]).select(*dict.fromkeys(every), "position")


def authors_of(books: DataFrame) -> DataFrame:
    """A row for each author of each book: (author, book_id, title, pub_date, position)."""
    names = F.filter(F.transform(F.split(T.text_or_empty(F.col("authors")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return books.select(F.explode(F.array_distinct(names)).alias("author"), "book_id", T.text_or_empty(F.col("title")).alias("title"), "pub_date", "position")


def title_index(books: DataFrame) -> DataFrame:
    """(author, key, book_id, title, pub_date, position, slot): the keys of each author's books.

    Of equal full titles the later book wins. The two halves of an "A: B" title with at least two words are added where
    their key is not that of a full title; there the first book wins. A key stands where it was first
    met: at a book's position, as its full title (slot 0) or a half.
    """
    rows = authors_of(books)
    halves = F.when(F.contains("title", F.lit(":")), F.split("title", ":", 2)).otherwise(F.array().cast("array<string>"))
    each = rows.select("author", "book_id", "title", "pub_date", "position", F.posexplode(F.concat(F.array("title"), halves)).alias("slot", "part")).withColumn("key", F.explode(F.array(T.title_key(F.col("part")))))  # made once, not for each test
    each = each.filter((F.col("key") != "") & ((F.col("slot") == 0) | (F.size(F.split("key", " ")) >= 2)))
    book, met = F.struct("book_id", "title", "pub_date"), F.struct("position", "slot")
    full = F.max_by(F.when(F.col("slot") == 0, book), F.when(F.col("slot") == 0, F.col("position")))
    found = each.groupBy("author", "key").agg(F.coalesce(full, F.min_by(book, met)).alias("b"), F.min(met).alias("met"))
    return found.select("author", "key", "b.book_id", "b.title", "b.pub_date", "met.position", "met.slot")


def resolved_authors(names: DataFrame, authors: DataFrame, *, shortest: int = 8, least: float = 0.92) -> DataFrame:
    """(name, author): the first author in order with the same folded name, else the first that is almost the same.

    ``names`` has ``name``, "Last, First" or plain; ``authors`` has (author, position). Names are compared inside their
    first letter.
    """
    wanted = names.select("name").distinct().withColumn("folded", T.fold(T.person(F.col("name")))).filter("folded <> ''")
    known = authors.withColumn("known", T.fold(F.col("author"))).filter("known <> ''").groupBy("known").agg(F.min_by("author", "position").alias("author"), F.min("position").alias("position"))
    exact = wanted.join(known, wanted["folded"] == known["known"]).select("name", "author")
    rest = wanted.join(known.select(F.col("known").alias("folded")), "folded", "left_anti").withColumn("letter", F.substring("folded", 1, 1))
    near = rest.join(known.withColumn("letter", F.substring("known", 1, 1)), "letter").filter(S.may_be_same_name(F.col("folded"), F.col("known"), shortest=shortest))
    near = near.withColumn("ratio", S.sequence_ratio("folded", "known")).filter(F.col("ratio") >= least)
    return exact.unionByName(near.groupBy("name").agg(F.min_by("author", "position").alias("author")))


_SCORED = "author string, key string, block int, at int, score double"


def _matched_in_blocks(threshold: float):
    """For rows (author, block, salt, title or null, keys or null), sorted so that a block's keys come before its titles:
    the best candidate of each title in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for author, number, _, title, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if title is None:
                    block = S.TitleBlock(keys)
                    continue
                at, score = block.best(title, threshold)
                for column, value in zip(out, (author, title, number, at, score), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["author", "key", "block", "at", "score"])

    return run


def _pieces(word: Column) -> Column:
    """What a word shares with each of its spelling variants: the first half of a word of n letters or, with the first
    letter, the last half, for the lengths that the shorter of two variants can have."""
    n = F.length(word)
    half = lambda k: F.ceil((n - k) / 2).cast("int")
    heads = [F.when(n > k, F.concat_ws(":", F.lit("h"), (n - k).cast("string"), F.substr(word, F.lit(1), half(k)))) for k in range(3)]
    tails = [F.when(n >= 5 + k, F.concat_ws(":", F.lit("t"), (n - k).cast("string"), F.substring(word, 1, 1), F.right(word, n - k - half(k)))) for k in range(2)]
    return F.array_compact(F.array(*heads, *tails))


def word_variants(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(x, y): each word ``x`` of ``asked`` with itself and its spelling variants ``y`` among ``known``."""
    met = asked.select("x", F.explode(_pieces(F.col("x"))).alias("_p")).join(known.select("y", F.explode(_pieces(F.col("y"))).alias("_p")), "_p")
    return met.filter((F.col("x") == F.col("y")) | S.spelling_variant(F.col("x"), F.col("y"))).select("x", "y").distinct()


def _by_rarest_word(asked: DataFrame, known: DataFrame, *, variants: bool = False) -> DataFrame:
    """(author, a, b): all pairs where each word of ``a`` stands in ``b``, or one of its variants does; and others.

    ``asked`` has (author, a, words), ``known`` (author, b, words). Of each ``a`` only the word that the fewest keys of
    its author hold is looked up."""
    own = asked.select("author", "a", F.explode(F.array_distinct("words")).alias("x"))
    held = known.select("author", "b", F.explode(F.array_distinct("words")).alias("y"))
    often = held.groupBy("author", "y").agg(F.count(F.lit(1)).alias("n"))
    same = word_variants(own.select("x").distinct(), held.select("y").distinct()) if variants else held.select(F.col("y").alias("x"), "y").distinct()
    reach = own.select("author", "x").distinct().join(same, "x").join(often, ["author", "y"]).groupBy("author", "x").agg(F.sum("n").alias("n"))
    rarest = own.join(reach, ["author", "x"], "left").groupBy("author", "a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x")).alias("r")).filter("r.n > 0")
    return rarest.select("author", "a", F.col("r.x").alias("x")).join(same, "x").join(held, ["author", "y"]).select("author", "a", "b")


def compatible_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(author, a, b): the compatible ones among an author's title keys, for distinct (author, a) and (author, b).

    Keys with the same letters, keys whose content words have the same letters, and keys where each content word has an
    equal or a variant: these are looked up by letters and words, so that no author's keys are all compared."""
    left, right = asked.withColumn("words", S.content_words(F.col("a"))), known.withColumn("words", S.content_words(F.col("b")))
    joined = lambda frame, c: frame.withColumn("_j", F.replace(c, F.lit(" "), F.lit(""))).drop("words")
    content = lambda frame: frame.filter(F.size("words") > 0).withColumn("_j", F.array_join("words", "")).drop("words")
    met = joined(left, F.col("a")).join(joined(right, F.col("b")), ["author", "_j"]).select("author", "a", "b")
    met = met.unionByName(content(left).join(content(right), ["author", "_j"]).select("author", "a", "b"))
    met = met.unionByName(_by_rarest_word(left, right, variants=True)).distinct()
    return met.filter(S.compatible_keys("a", "b"))


def _contained_pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(author, a, b): the title keys of an author of which one stands in the other (``contained``)."""
    worded = lambda frame, c: frame.withColumn("words", F.split(c, " ")).filter(F.size("words") >= 3)
    left, right = worded(asked, F.col("a")), worded(known, F.col("b"))
    turned = _by_rarest_word(right.withColumnRenamed("b", "a"), left.withColumnRenamed("a", "b"))
    met = _by_rarest_word(left, right).unionByName(turned.select("author", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return met.filter(S.contained(F.col("a"), F.col("b")))


def linked_titles(titles: DataFrame, index: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``closest_titles`` where the score reaches ``threshold``, which only contained and compatible titles do."""
    scratch = Scratch(titles.sparkSession, "titles")  # keys are read many times below
    asked, known = scratch.table(titles.select("author", F.col("key").alias("a")).distinct(), "asked"), scratch.table(index.select("author", F.col("key").alias("b")), "known")
    pairs = compatible_pairs(asked, known).withColumn("inside", F.lit(False)).unionByName(_contained_pairs(asked, known).withColumn("inside", F.lit(True)))
    pairs = scratch.table(pairs.groupBy("author", "a", "b").agg(F.max("inside").alias("inside")).withColumn("ratio", S.sequence_ratio("a", "b")), "pairs")
    scored = pairs.withColumn("score", F.when(F.col("inside"), F.greatest("ratio", F.lit(0.95))).otherwise(F.col("ratio"))).filter(F.col("score") >= threshold)
    met = scored.join(index.select("author", F.col("key").alias("b"), "book_id", F.col("title").alias("guess"), "position", "slot"), ["author", "b"])
    best = met.groupBy("author", "a").agg(F.min_by(F.struct("score", "book_id", "guess"), F.struct((-F.col("score")).alias("less"), "position", "slot")).alias("b"))
    return best.select("author", F.col("a").alias("key"), "b.score", "b.book_id", "b.guess")


def closest_titles(titles: DataFrame, index: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(author, key, score, book_id, guess) for distinct (author, key): the first candidate in order with the largest score."""
    place = F.row_number().over(Window.partitionBy("author").orderBy("position", "slot")) - 1
    numbered = index.withColumn("n", place).select("author", F.floor(F.col("n") / BLOCK).cast("int").alias("block"), (F.col("n") % BLOCK).cast("int").alias("at"), F.col("key").alias("candidate"), "book_id", F.col("title").alias("guess"))
    asked = titles.select("author", "key").distinct()
    # an author's many titles are spread over salts, and each of them gets the author's blocks
    sizes = asked.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / TITLES).cast("int").alias("salts"))
    blocks = numbered.groupBy("author", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "candidate"))), lambda x: x["candidate"]).alias("keys")).join(sizes, "author")
    blocks = blocks.select("author", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("string").alias("title"), "keys")
    spread = sizes.join(numbered.groupBy("author").agg(F.max("block").alias("last")), "author")
    met = asked.join(spread, "author").select("author", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), F.col("key").alias("title"), F.lit(None).cast("array<string>").alias("keys"))
    both = blocks.unionByName(met).repartition("author", "block", "salt").sortWithinPartitions("author", "block", "salt", F.col("title").asc_nulls_first())
    scored = both.mapInArrow(_matched_in_blocks(threshold), _SCORED).filter("at >= 0")
    best = scored.groupBy("author", "key").agg(F.min(F.struct((-F.col("score")).alias("less"), "block", "at")).alias("b")).select("author", "key", (-F.col("b.less")).alias("score"), "b.block", "b.at")
    return best.join(numbered, ["author", "block", "at"]).select("author", "key", "score", "book_id", "guess")


def best_titles(titles: DataFrame, index: DataFrame, *, threshold: float = THRESHOLD, guesses: bool = True) -> DataFrame:
    """(record, author, book_id, score, guess): the best book of each record and author.

    ``titles`` has (record, author, title, place). The first title by place that is exact wins with score 1; where none
    is, the first strict maximum over titles and candidates in order. ``book_id`` is null below ``threshold``; ``guess``
    and ``score`` are there anyway, unless ``guesses`` is false: then such records have no row.
    """
    keyed = titles.withColumn("key", F.explode(F.array(T.title_key(F.col("title"))))).filter("key <> ''").select("record", "author", "place", "key")
    books = index.select("author", "key", "book_id", F.col("title").alias("guess"))
    exact = keyed.join(books, ["author", "key"]).groupBy("record", "author").agg(F.min_by(F.struct("book_id", "guess"), "place").alias("b")).select("record", "author", "b.book_id", F.lit(1.0).alias("score"), "b.guess")
    left = keyed.join(exact.select("record", "author"), ["record", "author"], "left_anti")
    near = left.join((closest_titles if guesses else linked_titles)(left, index, threshold=threshold), ["author", "key"])
    best = near.groupBy("record", "author").agg(F.min_by(F.struct("score", "book_id", "guess"), F.struct((-F.col("score")).alias("less"), "place")).alias("b"))
    fuzzy = best.select("record", "author", F.when(F.col("b.score") >= threshold, F.col("b.book_id")).alias("book_id"), F.round("b.score", 3).alias("score"), "b.guess")
    return exact.unionByName(fuzzy)


def link_editions(editions: DataFrame, books: DataFrame, *, threshold: float = THRESHOLD, mismatch: str = "title mismatch", scratch: Scratch | None = None, guesses: bool = True) -> dict[str, DataFrame]:
    """The tables of a linkage: ``matched``, ``links``, ``unmatched`` and ``to_resolve``.

    ``editions`` has record, position, authors (array of names), original_titles (array), language_letter, pub_year,
    isbn, source_record_id and more; ``books`` comes from ``combined_books``. Names are resolved, unless ``author``
    gives the table's author already; each is matched by itself, and the largest score wins, on a tie the first name.
    Links are de-duplicated in order of arrival (by record, and by ISBN unless ``library`` marks the row) and get
    letters. What was matched is written once; the other tables read it.

    Records without any author of the table are not "unmatched"; those that name a title and an author are "to resolve".
    Without ``guesses`` the links are the same, but records that have none get no closest title (and, of several authors,
    the first); an author's titles are then not all compared.
    """
    ship(editions.sparkSession)
    scratch = scratch or Scratch(editions.sparkSession, "linkage")
    index = scratch.table(title_index(books), "index")
    rows = editions if "author" in editions.columns else editions.withColumn("author", F.lit(None).cast("string"))
    rows = scratch.table(rows if "library" in rows.columns else rows.withColumn("library", F.lit(False)), "editions")
    names = rows.filter("author IS NULL").select("record", F.posexplode("authors").alias("at", "name"))
    known = authors_of(books).groupBy("author").agg(F.min("position").alias("position"))
    found = names.join(resolved_authors(names, known), "name").groupBy("record", "author").agg(F.min("at").alias("at"))
    found = scratch.table(found.select("record", "at", "author").unionByName(rows.filter("author IS NOT NULL").select("record", F.lit(0).alias("at"), "author")), "found")
    titles = rows.select("record", F.posexplode("original_titles").alias("place", "title"))
    matched = best_titles(found.join(titles, "record").select("record", "author", "title", "place"), index, threshold=threshold, guesses=guesses)
    ranked = found.withColumnRenamed("author", "resolved").join(matched.withColumnRenamed("author", "resolved"), ["record", "resolved"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    first = ranked.groupBy("record").agg(F.min("at").alias("at"), F.min_by(F.struct("resolved", "book_id", "score", "guess"), F.struct(F.col("book_id").isNull().alias("none"), (-F.col("score")).alias("less"), "at")).alias("b"), F.min_by("resolved", "at").alias("first_author"))
    out = rows.drop("author").join(first.select("record", F.col("b.resolved").alias("author"), "b.book_id", "b.score", F.coalesce("b.guess", F.lit("")).alias("guess"), "first_author"), "record", "left")
    out = scratch.table(out, "matched")
    titled = F.size("original_titles") > 0
    linked = greedy_editions(out.filter("book_id IS NOT NULL"), ["book_id", "language_letter"], "position", "source_record_id", "isbn", by_isbn=~F.col("library"))
    open_ = out.filter("book_id IS NULL")
    unmatched = open_.filter("author IS NOT NULL").withColumn("reason", F.when(titled, mismatch).otherwise("no original title in record"))
    named = open_.filter(titled & (F.col("first_author").isNotNull() | (F.size("authors") > 0)))
    resolve = named.withColumn("reason", F.when(F.col("first_author").isNotNull(), "title not in table").otherwise("author not in table")).withColumn("author", F.coalesce("first_author", F.get("authors", F.lit(0))))
    return {"index": index, "matched": out, "links": edition_ids(linked), "unmatched": unmatched, "to_resolve": resolve.withColumn("original_title", F.element_at("original_titles", 1))}


def library_records(records: DataFrame, langs: tuple[str, ...] = ("F", "G", "P")) -> DataFrame:
    """Parsed records found under (author, language_letter), as editions: of a wanted language, translated from English."""
    codes = F.coalesce(*(F.when(F.col("language_letter") == k, F.array(*map(F.lit, CODES[k]))) for k in langs))
    wanted = (F.size("langs") == 0) | F.coalesce(F.arrays_overlap("langs", codes), F.lit(False))
    english = (T.text_or_empty(F.col("orig_lang")) == "") | F.contains("orig_lang", F.lit("eng"))
    rows = records.filter(F.col("language_letter").isin(*langs) & wanted & english)
    return rows.withColumnRenamed("record_id", "source_record_id").withColumns({"authors": F.array("author"), "library": F.lit(True), "stories": F.lit(0)})


def extra_records(*tables: DataFrame, langs: tuple[str, ...] = ("F", "G", "P")) -> DataFrame:
    """Rows of the interchange format as editions, file by file. A file's rows follow its ``position``, else the order read.

    ``stories`` counts the rows of a record in its file, before languages are chosen.
    """
    out = None
    for place, table in enumerate(tables):
        filled = lambda c, t=table: T.text_or_empty(F.col(c)) if c in t.columns else F.lit("")
        own = F.col("position") if "position" in table.columns else F.monotonically_increasing_id()
        names = F.filter(F.transform(F.split(filled("authors"), ";"), lambda a: F.trim(a)), lambda a: a != "")
        title = T.clean(filled("original_title"))
        keep = "pub_date publisher place series isbn source original_series first_edition first_edition_year".split()
        rows = table.select(
            F.struct(F.lit(place).alias("table"), own.cast("long").alias("row")).alias("position"), F.upper(F.trim(filled("language_letter"))).alias("language_letter"), filled("source_record_id").alias("source_record_id"), names.alias("authors"),
            F.when(filled("original_title") != "", F.array(title)).otherwise(F.array().cast("array<string>")).alias("original_titles"), T.clean(filled("translated_title")).alias("translated_title"),
            T.translator_list(filled("translators")).alias("translators"), filled("copyright").alias("responsibility"), *(filled(c).alias(c) for c in keep), T.year_text(filled("pub_date")).alias("pub_year"),
        )
        rows = rows.withColumn("stories", F.count(F.lit(1)).over(Window.partitionBy("source_record_id")).cast("int")).filter(F.col("language_letter").isin(*langs))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({"library": F.lit(False), "author": F.lit(None).cast("string")})


def link_run(books: DataFrame, *, library: DataFrame | None = None, extras: tuple[DataFrame, ...] = (), previous: DataFrame | None = None, langs: tuple[str, ...] = ("F", "G", "P"), threshold: float = THRESHOLD, most_gap: int = MOST_GAP, least: float = LEAST_SIMILARITY, top: int = SUGGESTIONS) -> dict[str, DataFrame]:
    """A whole run: ``editions``, ``merged``, ``unmatched``, ``candidates``, ``to_resolve`` and ``tallies``.

    Library records come first, then the extra sources in order, then what reviewers confirmed in ``previous``
    candidates. Editions stand in the order of their books, then by language and id.
    """
    spark = books.sparkSession
    scratch = Scratch(spark, "linkage")
    books = scratch.table(books, "books")
    parts = []
    if library is not None:
        own = library_records(library, langs)
        parts.append(own.withColumn("position", F.struct(F.lit(-1).alias("table"), F.col("position").cast("long").alias("row"))))
    if extras:
        parts.append(extra_records(*extras, langs=langs))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    texts = "translated_title translators responsibility pub_date pub_year publisher place series isbn source original_series first_edition first_edition_year".split()
    rows = rows.withColumns({c: T.text_or_empty(F.col(c)) if c in rows.columns else F.lit("") for c in texts}).withColumn("record", F.struct("position", "source_record_id"))
    tables = link_editions(rows, books, threshold=threshold, mismatch="title did not match", scratch=scratch)
    in_record = F.array_join("original_titles", " | ")
    review = suggestions(tables["unmatched"], tables["index"], most_gap=most_gap, least=least, top=top, books=books)
    review = review.select(*(review_columns()[c].alias(c) for c in CANDIDATE_COLUMNS))
    if previous is not None:
        review = carry_marks(review, previous.select(*CANDIDATE_COLUMNS))
    review = scratch.table(review, "candidates")
    linked = tables["links"].drop("translation_id").withColumns({"match_score": F.col("score").cast("string"), "original_title": F.col("guess"), "original_title_in_record": in_record})
    human = confirmed_editions(review)
    human = human.withColumns({"position": F.struct(F.lit(1 << 30).alias("table"), F.monotonically_increasing_id().alias("row")), "stories": F.lit(0)})
    both = linked.unionByName(human.select(*human.columns), allowMissingColumns=True).withColumns({"library": F.lit(True), "_none": F.lit("")})
    kept = edition_ids(greedy_editions(both, ["book_id", "language_letter"], "position", "source_record_id", "_none"), letter_first=True)
    works = works_in_edition(F.col("original_titles"), F.coalesce("stories", F.lit(0)))
    kept = kept.withColumns({"language": T.language_name(F.col("language_letter")), "works_in_edition": works.cast("string"), "edition_type": F.when(works > 1, "anthology").otherwise("single")})
    editions = kept.select(*(T.text_or_empty(F.col(c)).alias(c) for c in EDITION_COLUMNS)).join(books.select("book_id", F.col("position").alias("_position")), "book_id", "left")
    editions = scratch.table(editions.select(*EDITION_COLUMNS, "_position"), "editions_out")
    unmatched = tables["unmatched"].select(*(c for c in UNMATCHED_COLUMNS if c not in ("original_title_in_record", "closest_series_title", "closest_score")), in_record.alias("original_title_in_record"), F.col("guess").alias("closest_series_title"), F.col("score").alias("closest_score")).select(*UNMATCHED_COLUMNS)
    return {
        "editions": editions.orderBy(F.col("_position").asc_nulls_last(), "language_letter", "translation_id").drop("_position"),
        "merged": merged_table(books.drop("position"), editions.drop("_position")),
        "unmatched": unmatched.orderBy("author", "language_letter", F.desc("closest_score")),
        "candidates": review.orderBy("author", "language_letter", F.desc("candidate_score")),
        "to_resolve": originals_to_resolve(tables["to_resolve"]),
        "tallies": run_tallies(tables["matched"], editions, review),
    }


def review_columns() -> dict[str, Column]:
    """The columns of a review table by name, from rows of ``suggestions``."""
    plain = {c: F.col(c) for c in CANDIDATE_COLUMNS}
    return plain | {
        "language": T.language_name(F.col("language_letter")), "years_after_original": F.coalesce(F.col("years_after_original").cast("string"), F.lit("")), "title_similarity": F.round("title_similarity", 3),
        "romance_publisher": F.when(F.col("romance_publisher"), "yes").otherwise(""), "original_title_in_record": F.array_join("original_titles", " | "),
    }


def confirmed_editions(review: DataFrame) -> DataFrame:
    """Rows that a reviewer confirmed, as editions with the score "manual"."""
    yes = review.filter(S.is_yes(F.col("confirm")))
    titles = F.filter(F.split(T.text_or_empty(F.col("original_title_in_record")), r" \| "), lambda t: t != "")
    keep = "language_letter author translated_title pub_date pub_year publisher place translators series isbn source source_record_id original_title_in_record".split()
    return yes.select(*keep, F.col("suggested_book_id").alias("book_id"), F.col("suggested_original_title").alias("original_title"), F.lit("manual").alias("match_score"), titles.alias("original_titles"))


def run_tallies(matched: DataFrame, editions: DataFrame, review: DataFrame) -> DataFrame:
    """(kind, key, n): what a run counted, by language, author, confidence and outcome."""
    tally = lambda frame, kind, key: frame.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    per_author = F.concat_ws(" ", "author", "language_letter")
    known = matched.filter("author IS NOT NULL")
    parts = [
        tally(editions, "editions by language", F.col("language")), tally(review, "candidates by confidence", F.col("confidence")), tally(known, "records by author", per_author),
        tally(known.filter(F.size("original_titles") > 0), "with original title by author", per_author), tally(known.filter("book_id IS NOT NULL"), "matched by author", per_author),
        tally(matched, "outcome", F.when(F.col("book_id").isNotNull(), "matched").when(F.col("author").isNull(), "author not in table").when(F.size("original_titles") > 0, "title did not match").otherwise("no original title in record")),
        tally(review.filter(S.is_yes(F.col("confirm"))), "outcome", F.lit("confirmed by hand")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def originals_to_resolve(rows: DataFrame) -> DataFrame:
    """One row for each (folded author, title key): first-seen attributes, languages, number of editions; blanks left out."""
    keyed = rows.withColumn("k_author", T.fold(F.col("author"))).withColumn("k_title", T.title_key(F.col("original_title"))).filter("k_title <> ''")
    first = F.min_by(F.struct("author", "original_title", "translated_title", "pub_year", "publisher", "reason"), "position")
    grouped = keyed.groupBy("k_author", "k_title").agg(first.alias("f"), F.array_join(F.array_sort(F.collect_set("language_letter")), "").alias("languages"), F.count(F.lit(1)).alias("n_editions"))
    return grouped.select("f.author", "f.original_title", "languages", "n_editions", "f.translated_title", "f.pub_year", "f.publisher", "f.reason").orderBy(F.desc("n_editions"), "author", "original_title")


def candidate_scores(titled: Column, similarity: Column, gap: Column, romance: Column, single: Column, *, most_gap: int = MOST_GAP) -> Column:
    """The score of a suggestion: by title if the record names one, else circumstantial and at most 0.69."""
    fit = F.when(gap.isNotNull(), 1 - gap / most_gap).otherwise(0.3)
    strong = romance & (single | F.coalesce(gap <= 3, F.lit(False)))
    hints = F.when(strong, 0.5).otherwise(0.2) + 0.15 * fit + F.when(single, 0.04).otherwise(0.0)
    return F.when(titled, 0.7 + 0.3 * similarity).otherwise(F.least(hints, F.lit(0.69)))


def suggestions(unmatched: DataFrame, index: DataFrame, *, most_gap: int = MOST_GAP, least: float = LEAST_SIMILARITY, top: int = SUGGESTIONS, books: DataFrame | None = None) -> DataFrame:
    """At most ``top`` scored books for each unmatched record, from its author's books.

    Titled records need a compatible title and a similarity of at least ``least``; these tests run on distinct keys, and
    the ratio only for books that pass the others. Of books that score alike, only the first ``top`` become rows. A known gap of years must lie between 0 and ``most_gap``; an unknown
    one passes. Confidence counts all candidates, before the cut.
    """
    rows = index if books is None else authors_of(books)
    own = first_per_key(rows, ["author", "book_id"], ["position"]).select("author", F.col("book_id").alias("suggested_book_id"), F.col("title").alias("suggested_original_title"), F.col("pub_date").alias("original_pub_date"), "position")
    own = own.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy("author")) == 1).withColumn("_b", T.title_key(F.col("suggested_original_title")))
    open_ = unmatched.drop("position", "book_id", "score", "guess")
    gap = F.col("pub_year").try_cast("int") - T.year_of(F.col("original_pub_date"))
    in_time = F.coalesce(gap.between(0, most_gap), F.lit(True))
    titled = F.size("original_titles") > 0
    years = open_.select("record", "author", "pub_year", "original_titles")
    # distinct keys of an author's titles and of its books: the compatible ones
    asked = years.filter(titled).select("record", "author", "pub_year", F.explode(F.array_distinct("original_titles")).alias("t")).withColumn("_a", T.title_key(F.col("t")))
    scratch = Scratch(unmatched.sparkSession, "suggestions")
    asked, own = scratch.table(asked, "asked"), scratch.table(own, "own")
    left, right = scratch.table(asked.select("author", F.col("_a").alias("a")).distinct(), "left"), scratch.table(own.select("author", F.col("_b").alias("b")).distinct(), "right")
    fits = scratch.table(compatible_pairs(left, right).withColumnsRenamed({"a": "_a", "b": "_b"}), "fits")
    pairs = asked.join(fits, ["author", "_a"]).join(own.select("author", "_b", "suggested_book_id", "original_pub_date"), ["author", "_b"]).filter(in_time).select("record", "author", "suggested_book_id", "_b").distinct()
    compared = pairs.join(asked.select("record", "_a").distinct(), "record").select("record", "suggested_book_id", "_a", "_b")
    ratios = compared.select("_a", "_b").distinct().withColumn("s", S.sequence_ratio("_a", "_b"))
    similar = compared.join(ratios, ["_a", "_b"]).groupBy("record", "suggested_book_id").agg(F.max("s").alias("title_similarity")).filter(F.col("title_similarity") >= least)
    pairs = open_.join(similar, "record").join(own, ["author", "suggested_book_id"]).withColumn("_stands_for", F.lit(1).cast("long"))
    # without a title, an author's books of one year all score the same: the first of each year stand for the others
    year = Window.partitionBy("author", T.year_of(F.col("original_pub_date")))
    shelf = own.withColumn("_place", F.row_number().over(year.orderBy("position", "suggested_book_id"))).withColumn("_of_year", F.count(F.lit(1)).over(year)).filter(F.col("_place") <= top)
    shelf = shelf.withColumn("_stands_for", F.when(F.col("_place") == 1, F.col("_of_year")).otherwise(0)).drop("_place", "_of_year")
    untitled = open_.filter(~titled).withColumn("title_similarity", F.lit(0.0)).join(shelf, "author").filter(in_time)
    pairs = pairs.unionByName(untitled).withColumn("years_after_original", gap)
    pairs = pairs.withColumn("romance_publisher", S.is_romance(F.col("publisher"), F.col("series")))
    score = candidate_scores(titled, F.col("title_similarity"), F.col("years_after_original"), F.col("romance_publisher"), F.col("_alone"), most_gap=most_gap)
    pairs = pairs.withColumn("candidate_score", F.round(score, 3)).withColumn("candidates_for_this_record", F.sum("_stands_for").over(Window.partitionBy("record")))
    confidence = F.when(F.col("candidate_score") >= 0.7, "high").when((F.col("candidate_score") >= 0.5) & (F.col("candidates_for_this_record") <= 2), "medium").otherwise("low")
    order = Window.partitionBy("record").orderBy(F.desc("candidate_score"), "position", "suggested_book_id")
    return pairs.withColumn("confidence", confidence).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top).drop("_n", "_alone", "_b", "position", "_stands_for").withColumn("confirm", F.lit(""))


def carry_marks(new: DataFrame, old: DataFrame, keys: list[str] | None = None, marks: tuple[str, ...] = ("confirm",), *, keep_confirmed: bool = True) -> DataFrame:
    """New review rows with the human marks of the old ones; confirmed old rows that were not made again stay too."""
    keys = keys or REVIEW_KEY
    human = old.select(*keys, *(F.col(m).alias(f"_{m}") for m in marks))
    out = new.join(human, keys, "left").select(*(F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) if c in marks else F.col(c) for c in new.columns))
    if not keep_confirmed:
        return out
    lost = old.filter(S.is_yes(F.col(marks[0]))).join(new, keys, "left_anti")
    return out.unionByName(lost, allowMissingColumns=True)


def merged_table(books: DataFrame, editions: DataFrame, *, prefix: str = "tr_") -> DataFrame:
    """Each book with each of its editions (columns prefixed); a book without editions once."""
    right = editions.select(F.col("book_id"), *(F.col(c).alias(prefix + c) for c in editions.columns if c != "book_id"))
    return books.join(right, "book_id", "left")


def resolve_titles(wanted: DataFrame, hits: DataFrame, *, houses: list[str], least: float = 0.85, any_publisher: bool = False) -> DataFrame:
    """The first search hit in rank order for each wanted title, and what became of it.

    ``wanted`` has (key, author, title); ``hits`` (key, docs: array of struct title, authors, publishers, work_id). A hit
    needs a compatible title and an author that is equal when folded or at least ``least`` similar. Its publisher decides
    between "found" and "other publisher", unless ``any_publisher`` will do; of equal works the first stays.
    """
    docs = wanted.join(hits, "key").select("key", "author", "title", F.posexplode("docs").alias("rank", "doc"))
    fits = docs.filter(S.compatible(T.title_key(F.col("doc.title")), T.title_key(F.col("title"))))
    names = fits.select("key", "rank", "author", "doc", F.explode("doc.authors").alias("name")).withColumn("a", T.fold(F.col("author"))).withColumn("b", T.fold(F.col("name")))
    agreed = names.filter((F.col("a") == F.col("b")) | (S.sequence_ratio("b", "a") >= least))
    first = agreed.groupBy("key").agg(F.min_by("doc", "rank").alias("doc"))
    out = wanted.join(first, "key", "left").withColumn("outcome", F.when(F.col("doc").isNull(), "not found").when(F.lit(any_publisher) | S.listed_publisher(F.col("doc.publishers"), houses), "found").otherwise("other publisher"))
    found = out.filter("outcome = 'found'").withColumn("_w", F.col("doc.work_id"))
    return first_per_key(found, ["_w"], ["key"]).drop("_w").unionByName(out.filter("outcome <> 'found'"))
