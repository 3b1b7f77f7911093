"""Delimited tables: all columns strings, tolerant of a byte-order mark, missing cells empty; and their writers."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marginalia.functions import text as T

BOM = "﻿"
#: The interchange format of extra sources.
EXTRA = (
    "language_letter STRING, authors STRING, original_title STRING, translated_title STRING, pub_date STRING, publisher STRING, place STRING, translators STRING, series STRING, isbn STRING, "
    "format STRING, copyright STRING, original_series STRING, first_edition STRING, first_edition_year STRING, source STRING, source_record_id STRING, url STRING, blurb STRING"
)


def read_table(spark: SparkSession, path: str, *, sep: str | None = None) -> DataFrame:
    """A delimited file with a header. Without ``sep``, the one of , ; tab | that the header holds most is taken."""
    if sep is None:
        head = spark.read.text(path).limit(1).collect()  # one line
        line = head[0][0] if head else ""
        sep = max(",;\t|", key=line.count)
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    named = rows.toDF(*(c.lstrip(BOM).strip() for c in rows.columns))
    return named.na.fill("")


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast where they can be; what cannot be read is null. Missing columns are added as nulls."""
    out = rows
    for name, kind in types.items():
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
        elif kind == "boolean":
            out = out.withColumn(name, F.lower(F.trim(F.col(name))) == "true")
        else:
            out = out.withColumn(name, F.nullif(F.trim(F.col(name)), F.lit("")).try_cast(kind))
    return out


def interchange(rows: DataFrame) -> DataFrame:
    """The interchange columns in their order, missing ones empty, others left out."""
    names = [part.split()[0] for part in EXTRA.split(", ")]
    return rows.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n in rows.columns else F.lit("").alias(n) for n in names))


def write_delimited(rows: DataFrame, path: str, columns: list[str], *, by: str | None = None) -> None:
    """Delimited files with a header, all text, missing cells empty, surplus columns left out; the first name follows a
    byte-order mark, as spreadsheets expect it. ``by`` gives each value a folder of its own."""
    cells = rows.select(*([F.col(by).alias("_by")] if by else []), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{BOM}{c}" if i == 0 else c) for i, c in enumerate(columns)))
    writer = cells.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy("_by") if by else writer).csv(path)


def human_columns(tracker: DataFrame, volumes: DataFrame, columns: list[str], key: str = "volume_id") -> DataFrame:
    """Volumes with what people entered in an older table: ``columns`` that it has, by ``key``; the rest stays empty.

    Entries of volumes that are gone are dropped. Dates stay what they are; missing entries are empty."""
    known = [c for c in columns if c in tracker.columns]
    old = tracker.select(F.col(key).cast("string").alias("_k"), *(F.col(c).alias(f"_{c}") for c in known))
    out = volumes.join(old, F.col(key).cast("string") == F.col("_k"), "left").drop("_k")
    return out.select(*(c for c in volumes.columns if c not in columns), *((F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")) if c in known else F.lit("")).alias(c) for c in columns))


def limited(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in order; all with 0."""
    return rows.orderBy(*order).limit(most) if most else rows


def write_table(rows: DataFrame, path: str, *columns: str, by: str | None = None) -> None:
    """Parquet with the named columns only; ``by`` partitions the output (one folder for each language)."""
    writer = rows.select(*columns).write.mode("overwrite") if columns else rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


@F.pandas_udf(StringType())
def _literal_as_json(cells):  # a cell is a Python literal, which no built-in reads
    def one(cell):
        try:
            return json.dumps(ast.literal_eval(cell))
        except (ValueError, SyntaxError, TypeError):
            return None

    return cells.map(one)


TRANSLATIONS = "array<struct<translated_title:string,translated_title_language:string,year:int,publisher_name:string,place:string,translator_name:string>>"


def works_exploded(works: DataFrame, column: str = "translations", schema: str = TRANSLATIONS) -> DataFrame:
    """A row for each entry of a cell that holds a literal list of mappings, with the work's columns copied."""
    rows = works.withColumn("_t", F.explode(F.from_json(_literal_as_json(F.col(column)), schema)))
    return rows.select(*(c for c in works.columns if c != column), "_t.*")


def cached_page_key(url: Column) -> Column:
    """The key of a landed page."""
    return F.sha1(url.cast("binary"))


def landed(requests: DataFrame, pages: DataFrame, *, fail_on_missing: bool = False, refresh: Column | None = None) -> DataFrame:
    """Requests with the text of their landed page, by the hash of the url, and ``wanted``: whether a fetch job should get it.

    Of several copies the one landed last counts (``fetched``, where pages have it). A page that is missing, or landed
    with a status other than 200 (``status``), is empty, or an error; a missing page (404) is empty and not wanted again.
    ``refresh`` asks for pages again that are there.
    """
    has = set(pages.columns)
    status = F.coalesce(F.col("status").cast("int"), F.lit(200)) if "status" in has else F.lit(200)
    when = F.col("fetched") if "fetched" in has else F.lit(0)
    stored = pages.select("page_key", F.struct(when.alias("at"), status.alias("status"), F.col("content").alias("content")).alias("p")).groupBy("page_key").agg(F.max_by("p", "p.at").alias("_p"))
    out = requests.withColumn("page_key", cached_page_key(F.col("url"))).join(stored, "page_key", "left")
    good = F.when(F.col("_p.status") == 200, F.col("_p.content"))
    text = F.coalesce(good, F.when(F.col("_p.status") == 404, ""), F.raise_error(F.concat(F.lit("no page for "), F.col("url"))) if fail_on_missing else F.lit(""))
    again = F.lit(False) if refresh is None else F.coalesce(refresh, F.lit(False))
    return out.withColumns({"content": text, "wanted": again | ~F.coalesce(F.col("_p.status").isin(200, 404), F.lit(False))}).drop("_p")


#: Languages of the translation index by letter, and publishers of the genre.
INDEX_LANGUAGES, INDEX_HOUSES = {"French": "F", "German": "G", "Polish": "P"}, r"(?i)harlequin|cora|arlekin|silhouette|mira"


def _index_works(works: DataFrame) -> DataFrame:
    letter = F.coalesce(*(F.when(F.col("translated_title_language") == k, F.lit(v)) for k, v in INDEX_LANGUAGES.items()))
    own = works.withColumns({"language_letter": letter, "key": T.title_key(T.unwrapped(F.col("original_title")))})
    return own.filter(F.col("language_letter").isNotNull() & F.coalesce("publisher_name", F.lit("")).rlike(INDEX_HOUSES)).drop("original_title")


def _index_books(books: DataFrame) -> DataFrame:
    return books.select(T.title_key(F.col("title")).alias("key"), F.col("title").alias("original_title"), "authors", T.year_of(F.col("pub_date"), "(?:19|20)[0-9]{2}").alias("_y"))


def translation_index_counts(works: DataFrame, books: DataFrame, *, most_gap: int = 15, blank_keys: bool = True) -> DataFrame:
    """(uuid, authors, original_title, pub_date, n): how many rows ``translation_index`` has for each, without making them.

    Equal works and equal books are counted before they meet, and keys meet books once for each year, not for each work.
    """
    own = _index_works(works).groupBy("uuid", "key", "year").agg(F.count(F.lit(1)).alias("_works"))
    known = _index_books(books).groupBy("key", "original_title", "authors", "_y").agg(F.count(F.lit(1)).alias("_books"))
    if not blank_keys:
        own = own.filter("key <> ''")
    met = own.select("key", "year").distinct().join(known, "key").filter((F.col("year") - F.col("_y")).between(0, most_gap))
    shelf = met.groupBy("key", "year", "original_title", "authors").agg(F.sum("_books").alias("_books"))
    found = own.join(shelf, ["key", "year"]).groupBy("uuid", "authors", "original_title", F.col("year").cast("int").cast("string").alias("pub_date"))
    return found.agg(F.sum(F.col("_works") * F.col("_books")).alias("n"))


def translation_index(works: DataFrame, books: DataFrame, *, most_gap: int = 15, blank_keys: bool = True) -> DataFrame:
    """Editions of a translation index whose title is that of a book, as rows of the interchange format.

    ``works`` has uuid, original_title and the translation's columns (``works_exploded``). Titles are compared by key
    only, as the index names no authors; blank keys match blank keys unless ``blank_keys`` is false. The translation must
    follow the book by 0 to ``most_gap`` years and come from a publisher of the genre.
    """
    met = _index_works(works).join(_index_books(books), "key").filter((F.col("year") - F.col("_y")).between(0, most_gap))
    if not blank_keys:
        met = met.filter("key <> ''")
    bare = lambda c: F.trim(F.regexp_replace(T.text_or_empty(F.col(c)), "[<>]", ""))
    place = F.row_number().over(Window.partitionBy("uuid", "language_letter", "year").orderBy("translated_title", "original_title", "authors")) - 1
    number = F.concat(F.lit("unesco:"), "uuid", F.lit(":"), "language_letter", F.col("year").cast("int").cast("string"), F.lit(":"), place.cast("string"))
    empty = F.lit("")
    return met.select("language_letter", "authors", "original_title", bare("translated_title").alias("translated_title"), F.col("year").cast("int").cast("string").alias("pub_date"), F.col("publisher_name").alias("publisher"), bare("place").alias("place"), T.first_word_last(F.col("translator_name")).alias("translators"), empty.alias("series"), empty.alias("isbn"), empty.alias("format"), F.lit("title-only match (the index has no author field)").alias("copyright"), F.lit("UNESCO").alias("source"), number.alias("source_record_id"), empty.alias("url"))
