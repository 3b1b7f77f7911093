"""Aggregations behind reports: dense counts, summaries, coverage, concentration, rank sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows for each key; rows with a null key do not count."""
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def dense_counts(rows: DataFrame, year: str, low: int, high: int) -> DataFrame:
    """(year, n) for every year from ``low`` to ``high``, zeros included."""
    spine = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(year))
    return spine.join(counts(rows, year), year, "left").select(year, F.coalesce("n", F.lit(0)).alias("n"))


def quartiles(value: str) -> list[Column]:
    """Exact quartiles with linear interpolation, and the number of values."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.element_at(q, 1).alias("q1"), F.element_at(q, 2).alias("median"), F.element_at(q, 3).alias("q3"), F.count(value).alias("n")]


def describe(value: str) -> list[Column]:
    return [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *quartiles(value)[:3], F.max(value).alias("max")]


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return counts(rows, column).orderBy(F.desc("n"), column).limit(n)


def histogram(value: Column, steps: int) -> Column:
    """The bin of a value from 0 to 1 in bins of 1 / ``steps``, the last of which is closed; null beyond.

    The edges are the doubles i * (1 / steps), with which a value is compared, whatever its product with ``steps``
    rounds to.
    """
    width, near = F.lit(1.0 / steps), F.floor(value * steps)
    bin_ = near + F.when((near + 1) * width <= value, 1).when(near * width > value, -1).otherwise(0)
    return F.when(value.between(0, 1), F.least(bin_, F.lit(steps - 1))).cast("long")


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of two keys with fixed columns, zeros filled, a total, largest total first."""
    out = rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(str(v)) for v in values))
    return out.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))).orderBy(F.desc("total"), row)


def combination(values: Column, order: list[str], separator: str = "") -> Column:
    """Aggregate: the label of the values that occur, in a fixed order."""
    seen = F.collect_set(values)
    return F.array_join(F.filter(F.array(*map(F.lit, order)), lambda v: F.array_contains(seen, v)), separator)


def with_total(rows: DataFrame, key: str, aggregates: list[Column], label: str = "All") -> DataFrame:
    """Aggregates for each key and one row for all."""
    out = rows.rollup(key).agg(F.grouping(key).alias("_g"), *aggregates)
    return out.withColumn(key, F.when(F.col("_g") == 1, label).otherwise(F.col(key))).drop("_g")


def rate(parts: DataFrame, wholes: DataFrame, key: str, *, least: int = 10) -> DataFrame:
    """(key, part, whole, rate) for keys of at least ``least`` in ``wholes``; keys without parts have rate 0."""
    a, b = counts(parts, key).withColumnRenamed("n", "part"), counts(wholes, key).withColumnRenamed("n", "whole")
    return b.filter(F.col("whole") >= least).join(a, key, "left").na.fill(0, ["part"]).withColumn("rate", F.col("part") / F.col("whole"))


def rank_sum(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """Mann-Whitney U of the rows where ``group`` holds against the rest, with average ranks and the two-sided p-value
    of the normal approximation (ties corrected, continuity corrected).

    Ranks are computed over distinct values and their counts, so the window holds no row for each input row.
    """
    tallies = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(group).alias("a"), F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL")
    before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tallies.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("n") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    u = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    total = F.col("n1") + F.col("n2")
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)) / sigma
    # 2 * (1 - Phi(z)) by a rational approximation of the error function, to 1.2e-7
    t = 1 / (1 + 0.5 * z / F.sqrt(F.lit(2.0)))
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    return u.select("n1", "n2", "u", (t * F.exp(-(z * z) / 2 + poly)).alias("p"))


def summary(rows: DataFrame, group: str, book: str, first: str, last: str, lag: str, flag: Column, total: int | Column) -> DataFrame:
    """For each group: editions, books, first and last year, median lag, share of a flag, share of all books, and the number
    of books with several editions. Nulls of the group do not count."""
    own = rows.filter(F.col(group).isNotNull())
    several = own.groupBy(group, book).agg(F.count(F.lit(1)).alias("_n")).groupBy(F.col(group).alias("_g")).agg(F.count_if(F.col("_n") > 1).alias("books_with_several_editions"))
    out = own.groupBy(group).agg(F.count(F.lit(1)).alias("editions"), F.count_distinct(book).alias("books"), F.min(first).alias("first_year"), F.max(last).alias("last_year"), F.median(lag).alias("median_lag_years"), F.avg(flag.cast("int")).alias("flagged"))
    whole = F.lit(total) if isinstance(total, int) else total
    return out.withColumn("share_of_corpus", F.col("books") / whole).join(several, F.col(group) == F.col("_g")).drop("_g")


def flag_share(rows: DataFrame, key: Column, flag: Column, name: str = "share") -> DataFrame:
    """(key, n, share): how often a flag holds for each key; null keys do not count."""
    return rows.withColumn("_k", key).filter("_k IS NOT NULL").groupBy(F.col("_k").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias(name))


def coverage_share(books: DataFrame, editions: DataFrame, row: str, book: str, column: str, values: list) -> DataFrame:
    """For each ``row`` of the books: the share of its books that have an edition with each value of ``column``."""
    seen = editions.groupBy(F.col(book).alias("_b")).agg(*(F.bool_or(F.col(column) == v).alias(f"_{v}") for v in values))
    return books.join(seen, books[book] == seen["_b"], "left").filter(F.col(row).isNotNull()).groupBy(row).agg(F.count(F.lit(1)).alias("books"), *(F.avg(F.coalesce(F.col(f"`_{v}`"), F.lit(False)).cast("int")).alias(str(v)) for v in values))


def distinct_matrix(rows: DataFrame, row: str, column: str, item: str, values: list, top: int | None = None) -> DataFrame:
    """Distinct items for each row and value, their sum over the values as ``total``; the ``top`` largest totals, ties by row."""
    out = rows.filter(F.col(row).isNotNull()).groupBy(row).agg(*(F.count_distinct(F.when(F.col(column) == v, F.col(item))).alias(str(v)) for v in values))
    out = out.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))).orderBy(F.desc("total"), row)
    return out if top is None else out.limit(top)


def medians(rows: DataFrame, group: Column, *values: str) -> DataFrame:
    """(group, n_x, median_x, ...): median and number of the values that are there, for each group."""
    return rows.groupBy(group.alias("group")).agg(*(c for v in values for c in (F.count(v).alias(f"n_{v}"), F.median(v).alias(f"median_{v}"))))


def compared(rows: DataFrame, others: DataFrame, key: str, *values: str) -> DataFrame:
    """``medians`` of rows with and without a match in ``others``: group true and false."""
    found = others.select(F.col(key).alias("_k")).distinct().withColumn("_found", F.lit(True))
    return medians(rows.join(found, rows[key] == found["_k"], "left"), F.coalesce("_found", F.lit(False)), *values)


def extremes(rows: DataFrame, label: str, share: str) -> DataFrame:
    """One row: the smallest and the largest share with their labels; of equal shares the first label."""
    low, high = F.min_by(F.struct(label, share), F.struct(share, label)), F.min_by(F.struct(label, share), F.struct(-F.col(share), F.col(label)))
    return rows.filter(F.col(share).isNotNull()).agg(low.alias("low"), high.alias("high")).select(F.col(f"low.{label}").alias("low_label"), F.col(f"low.{share}").alias("low_share"), F.col(f"high.{label}").alias("high_label"), F.col(f"high.{share}").alias("high_share"))


def known_and_missing(long: DataFrame, group: str, value: str) -> DataFrame:
    """(group, known, missing, share_known): how many rows of each group have a value that is not blank."""
    filled = F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != ""
    out = long.groupBy(group).agg(F.count_if(filled).alias("known"), F.count_if(~filled).alias("missing"))
    return out.withColumn("share_known", F.col("known") / (F.col("known") + F.col("missing")))


def bounds(rows: DataFrame, *columns: str, margin: int = 0) -> DataFrame:
    """One row (low, high): the smallest and the largest value of several columns, widened by ``margin``."""
    low = F.least(*(F.min(c) for c in columns)) if len(columns) > 1 else F.min(columns[0])
    high = F.greatest(*(F.max(c) for c in columns)) if len(columns) > 1 else F.max(columns[0])
    return rows.agg((low - margin).alias("low"), (high + margin).alias("high"))


def progress(volumes: DataFrame, group: str, steps: list[str], book: str) -> tuple[DataFrame, DataFrame]:
    """(counts, complete): volumes and filled steps for each group, and the books whose volumes have all of the last step."""
    done = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    counts_ = volumes.groupBy(group).agg(F.count(F.lit(1)).alias("volumes"), *(F.count_if(done(c)).alias(c) for c in steps))
    whole = volumes.groupBy(book).agg(F.bool_and(done(steps[-1])).alias("_all")).filter("_all").select(book)
    return counts_, whole


def near_misses(unmatched: DataFrame, *, reason: str = "title did not match", least: float = 0.7) -> DataFrame:
    """Records by the right author whose title is similar, but not enough: the best candidates for a reviewer."""
    return unmatched.filter((F.col("reason") == reason) & (F.col("closest_score") >= least) & F.col("author_confirmed")).orderBy(F.desc("closest_score"), "source_record_id")


def multiplicity(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``n`` and ``anthology``: the rows that share the keys, and whether there are several."""
    own = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("n", own).withColumn("anthology", F.col("n") > 1)


def conditional_counts(rows: DataFrame, keys: list[Column], tests: dict[str, Column], shares: dict[str, Column]) -> DataFrame:
    """For each key: how many rows pass each test, and the share that passes others."""
    return rows.groupBy(*keys).agg(*(F.count_if(t).alias(n) for n, t in tests.items()), *(F.avg(t.cast("int")).alias(n) for n, t in shares.items()))


def shortlist(editions: DataFrame, book: str, order: str, firsts: list[str], joined: dict[str, str], language: str, languages: list[str]) -> DataFrame:
    """One row for each book: the first filled value of some columns, languages and their number, the number of editions, and
    the distinct values of others in order; most languages first, then known translators, then editions."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_first_{c}") for c in firsts]
    seen = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *(F.col(c).cast("string").alias(c) for c in joined))))
    out = editions.groupBy(book).agg(*first, F.count_distinct(language).alias("n_languages"), combination(F.col(language), languages, " + ").alias("languages"), F.count(F.lit(1)).alias("n_editions"), seen.alias("_seen"))
    text = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("_seen", lambda x: x[c]), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")), "; ")
    return out.withColumns({name: text(c) for c, name in joined.items()}).withColumnsRenamed({f"_first_{c}": c for c in firsts}).drop("_seen")


def editions_per_book(editions: DataFrame, book: str, language: str, languages: list[str], *, most: int = 6) -> DataFrame:
    """(language, editions, books): how many books have 1, 2, ... editions in a language; ``most`` stands for that many or more,
    and every number is listed."""
    per = editions.filter(F.col(language).isin(*languages)).groupBy(book, language).agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("int").alias("editions"))
    spine = editions.sparkSession.createDataFrame([(v, n) for v in languages for n in range(1, most + 1)], f"{language} string, editions int")
    return spine.join(per.groupBy(language, "editions").agg(F.count(F.lit(1)).alias("books")), [language, "editions"], "left").na.fill(0, ["books"])


def scarce_books(editions: DataFrame, book: str, language: str, languages: list[str]) -> DataFrame:
    """Books with one edition at most in every language, and one in some."""
    per = editions.filter(F.col(language).isin(*languages)).groupBy(book, language).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(book).agg(F.max("n").alias("_most")).filter("_most = 1").select(book)


def top_exploded(rows: DataFrame, group: str, value: str, top: int = 8) -> DataFrame:
    """(group, value, n): the most frequent parts of packed cells ("a; b") in each group, ties by value."""
    parts = rows.select(group, F.explode(F.split(F.coalesce(F.col(value), F.lit("")), ";")).alias("v")).select(group, F.trim("v").alias(value)).filter(F.col(value) != "")
    order = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return parts.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top).drop("_k")


def issues_of_series(records: DataFrame, series: str) -> DataFrame:
    """Records of a series: its name as a whole word in the series statement, or at the start of the title."""
    word = F.coalesce("series", F.lit("")).rlike(rf"(?iU)\b\Q{series}\E\b")
    return records.filter(word | F.startswith(F.lower(F.coalesce("translated_title", F.lit(""))), F.lit(series.lower())))


def corpus_only(books: DataFrame) -> DataFrame:
    """Books that are no companions; a missing mark counts as none."""
    return books.filter(F.lower(F.coalesce(F.col("is_companion").cast("string"), F.lit("false"))) != "true")


def in_languages(rows: DataFrame, letters: list[str]) -> DataFrame:
    return rows.filter(F.upper(F.trim(F.coalesce("language_letter", F.lit("")))).isin(*letters))
