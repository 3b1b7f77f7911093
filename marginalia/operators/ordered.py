"""Ordered operators: first rows, edition letters, greedy de-duplication, bracketing anchors, running steps.

"First" always means by an explicit position column, as rows of a distributed table have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str], *, last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in ``order``. Null keys form a key of their own."""
    ordered = [c if isinstance(c, Column) else F.col(c) for c in order]
    window = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in ordered) if last else ordered)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def edition_ids(editions: DataFrame, book: str = "book_id", language: str = "language_letter", year: str = "pub_year", record: str = "source_record_id", *, letter_first: bool = False) -> DataFrame:
    """Adds ``translation_id``: book, language and, where a book has several editions in it, a letter by (year or 9999,
    record): "12_G", "12_Ga"; with ``letter_first`` the letter stands before the language: "12a_G"."""
    group = Window.partitionBy(book, language)
    place = F.row_number().over(group.orderBy(T.first_filled(F.col(year), F.lit("9999")), F.coalesce(F.col(record), F.lit(""))))
    letter = F.when(F.count(F.lit(1)).over(group) > 1, T.letters(place - 1)).otherwise("")
    first, second = F.col(book).cast("string"), F.concat(F.lit("_"), F.col(language).cast("string"))
    return editions.withColumn("translation_id", F.concat(first, letter, second) if letter_first else F.concat(first, second, letter))


def greedy_editions(rows: DataFrame, keys: list[str], order: str, record: str, isbn: str, *, by_isbn: bool | Column = True) -> DataFrame:
    """Keep a row unless a kept one before it in its group has its record id or, with ``by_isbn``, its non-blank ISBN.

    ``by_isbn`` may be a condition on the row that arrives. Only rows that share a record id or an ISBN with another of
    their group are folded, as an array in arrival order; all others stay anyway.
    """
    rule = F.lit(by_isbn) if isinstance(by_isbn, bool) else by_isbn
    blank = F.coalesce(F.col(isbn), F.lit("")) == ""
    marked = rows.withColumn("_by_isbn", rule)
    shared = (F.count(F.lit(1)).over(Window.partitionBy(*keys, record)) > 1) | (~blank & (F.count(F.lit(1)).over(Window.partitionBy(*keys, isbn)) > 1))
    marked = marked.withColumn("_shared", shared)
    packed = F.struct(F.col(order).alias("o"), F.struct(*marked.columns).alias("row"))
    empty = F.slice(F.array_sort(F.collect_list(packed)), 1, 0)
    same = lambda k, x: k["row"][record].eqNullSafe(x["row"][record]) | (x["row"]["_by_isbn"] & (F.coalesce(x["row"][isbn], F.lit("")) != "") & F.coalesce(k["row"][isbn] == x["row"][isbn], F.lit(False)))
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: same(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    folded = marked.filter("_shared").groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(packed)), empty, keep).alias("_kept"))
    again = folded.select(F.explode("_kept").alias("_k")).select("_k.row.*")
    return marked.filter("NOT _shared").unionByName(again).drop("_by_isbn", "_shared")


def runner_up(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each key with ``margin``: its score minus the next one's, or minus 0 if it is alone."""
    window = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("margin", F.col(score) - F.lead(score, 1, 0.0).over(window)).withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def carried_forward(rows: DataFrame, keys: list[str], order: str, column: str) -> Column:
    """The last non-null value up to the row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def bracket(records: DataFrame, anchors: DataFrame, keys: list[str], number: str, value: str, *, most_span: int | None = None) -> DataFrame:
    """The nearest anchors around each record: strictly below and at or above its number, in the same group.

    Adds lo_number, lo_value, hi_number and hi_value. Records without both, with falling values or a span above
    ``most_span`` are left out. ``anchors`` has the keys, ``number`` and ``value``; ``records`` the keys and ``number``.
    """
    point = F.struct(F.col(number).alias("number"), F.col(value).alias("value"))
    a = anchors.select(*keys, number, point.alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast(records.schema.simpleString()).alias("_r"))
    r = records.select(*keys, number, F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), F.lit(0).alias("_side"), F.struct(*records.columns).alias("_r"))
    order = Window.partitionBy(*keys).orderBy(number, "_side")  # records stand before anchors of the same number
    lower = F.last("_p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    upper = F.first("_p", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    out = r.unionByName(a).withColumn("_lo", lower).withColumn("_hi", upper).filter("_side = 0 AND _lo IS NOT NULL AND _hi IS NOT NULL AND _hi.value >= _lo.value")
    # equal numbers below a record would be anchors at the number: the lower side is strict
    out = out.filter(F.col("_lo.number") < F.col(number))
    if most_span is not None:
        out = out.filter(F.col("_hi.number") - F.col("_lo.number") <= most_span)
    return out.select("_r.*", F.col("_lo.number").alias("lo_number"), F.col("_lo.value").alias("lo_value"), F.col("_hi.number").alias("hi_number"), F.col("_hi.value").alias("hi_value"))


def interpolated(number: Column, lo_number: Column, lo_value: Column, hi_number: Column, hi_value: Column) -> Column:
    """The value at ``number`` on the line between two anchors."""
    return lo_value + (number - lo_number) * (hi_value - lo_value) / (hi_number - lo_number)


def proximity(value: Column, expected: Column, lo_value: Column, hi_value: Column) -> Column:
    return 1 - F.abs(value - expected) / (hi_value - lo_value + 1)


def gap_pairs(rows: DataFrame, keys: list[str], day: str, item: str, most: int) -> DataFrame:
    """(first, later, gap) of items with equal keys whose days lie 0 to ``most`` apart: a range join.

    Days are cut into cells of ``most`` + 1, and a row meets its own cell and the next, so the range is an equal key too.
    """
    celled = rows.select(*keys, F.col(item).alias("later"), F.to_date(day).alias("_d")).withColumn("_cell", F.floor(F.unix_date("_d") / (most + 1)))
    first = celled.withColumn("_cell", F.explode(F.array(F.col("_cell"), F.col("_cell") + 1))).withColumnsRenamed({"later": "first", "_d": "_from"})
    return first.join(celled, [*keys, "_cell"]).withColumn("gap", F.datediff("_d", "_from")).filter(F.col("gap").between(0, most) & (F.col("first") != F.col("later"))).select("first", "later", "gap")


def neighbours(points: DataFrame, keys: list[str], number: str, value: str) -> DataFrame:
    """Adds lo and hi, the points (number, value) before and after each one in its group: what is left when it is hidden."""
    order = Window.partitionBy(*keys).orderBy(number, value)
    point = F.struct(F.col(number).alias("number"), F.col(value).alias("value"))
    return points.withColumns({"lo": F.lag(point).over(order), "hi": F.lead(point).over(order)})


def cumulative_share(rows: DataFrame, count: str, tie: str) -> DataFrame:
    """Adds ``share``: the running part of the total, largest counts first. For reports of few rows: one window holds all."""
    order = Window.orderBy(F.desc(count), tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("share", F.sum(count).over(order) / F.sum(count).over(Window.partitionBy(F.lit(1))))


def cumulative_steps(rows: DataFrame, step: str, when: str, tie: str) -> DataFrame:
    """Adds ``done``: 1, 2, ... over the dates of each step; rows without a date are left out."""
    return rows.filter(F.col(when).isNotNull()).withColumn("done", F.row_number().over(Window.partitionBy(step).orderBy(when, tie)))


def volumes(books: DataFrame, id_column: str, columns: dict[str, str]) -> DataFrame:
    """Wide to long: (id, kind, value) for each named column, blanks left out."""
    long = books.unpivot([id_column], list(columns), "_c", "value")
    name = F.coalesce(*(F.when(F.col("_c") == c, F.lit(k)) for c, k in columns.items()))
    return long.filter(F.trim(F.coalesce("value", F.lit(""))) != "").select(id_column, name.alias("kind"), "value")
