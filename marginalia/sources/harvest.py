"""Library catalogues over landed pages: search by author, harvest by publisher, in MARC-XML and MARC-in-JSON.

Queries never touch the network: a fetch job lands pages as rows (``url``, ``content``), and these readers name the pages
that a search consists of, follow them, and parse them. Paging by offset is a plan over all searches at once; paging by
a cursor follows all chains one page a round. A large harvest is split by year, so that a year prunes its pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.cluster import Scratch
from marginalia.functions import text as T
from marginalia.operators.ordered import first_per_key
from marginalia.sources import marc

#: Records of a page; the most records a search reads; above this many, a harvest is split by year.
PAGE, MOST_RECORDS, MOST_AT_ONCE = 100, 1000, 9000


@dataclass(frozen=True)
class Catalogue:
    """How a catalogue is asked: address, letter of its language, and templates of its queries."""

    name: str
    letter: str
    base: str
    fixed: tuple[tuple[str, str], ...]
    author: str
    publisher: str
    year: str = ""
    inverted: bool = True
    unimarc: bool = False


# Parameters that the catalogues ask for.
GERMAN = Catalogue("DNB", "G", "https://services.dnb.de/sru/dnb", (("version", "1.1"), ("operation", "searchRetrieve"), ("recordSchema", "MARC21-xml")), 'per="{}"', 'vlg="{}"', 'vlg="{}" and jhr={}')
FRENCH = Catalogue("BnF", "F", "https://catalogue.bnf.fr/api/SRU", (("version", "1.2"), ("operation", "searchRetrieve"), ("recordSchema", "unimarcxchange")), 'bib.author all "{}"', 'bib.publisher all "{}"', 'bib.publisher all "{}" and bib.date all "{}"', inverted=False, unimarc=True)
POLISH = Catalogue("BN", "P", "https://data.bn.org.pl/api/institutions/bibs.json", (("language", "polski"), ("limit", "100")), "author", "publisher")


def _filled(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(part)]
    return F.concat(*pieces)


def address(catalogue: Catalogue, query: Column, start: Column | None = None, size: int = PAGE) -> Column:
    """The url of a page: fixed parameters, the query, and for offsets the first record and the page's size."""
    pairs = [f"{k}={v}" for k, v in catalogue.fixed]
    out = [F.lit(f"{catalogue.base}?{'&'.join(pairs)}&query="), F.url_encode(query)]
    if start is not None:
        out += [F.lit(f"&maximumRecords={size}&startRecord="), start.cast("string")]
    return F.concat(*out)


def cursor_address(catalogue: Catalogue, field: str, value: Column) -> Column:
    return F.concat(F.lit(f"{catalogue.base}?{field}="), F.url_encode(value), F.lit("".join(f"&{k}={v}" for k, v in catalogue.fixed)))


def _stored(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("url").alias("_url"), "content")


def offset_pages(searches: DataFrame, pages: DataFrame, catalogue: Catalogue, *, size: int = PAGE, most: int | None = None) -> DataFrame:
    """The landed pages of each search: its columns, ``start`` and ``content``, up to the first page without records.

    ``searches`` has ``query``. The first page tells the total; ``most`` bounds the first record of a page.
    """
    stored = _stored(pages)
    head = searches.withColumn("_at", address(catalogue, F.col("query"), F.lit(1), size)).join(stored, F.col("_at") == F.col("_url"))
    total = F.coalesce(marc.total_of(F.col("content")), F.lit(0))
    last = F.greatest(F.lit(1), total if most is None else F.least(total, F.lit(most)))
    each = head.select(*searches.columns, F.explode(F.sequence(F.lit(1), last, F.lit(size))).alias("start"))
    each = each.withColumn("_at", address(catalogue, F.col("query"), F.col("start"), size)).join(stored, F.col("_at") == F.col("_url"), "left")
    full = F.contains(F.coalesce("content", F.lit("")), F.lit("datafield"))
    before = Window.partitionBy("query").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # one row for each page of a search
    return each.withColumn("_full", F.min(full).over(before)).filter("_full").drop("_full", "_at", "_url")


def cursor_pages(searches: DataFrame, pages: DataFrame, *, most: int | None = None) -> DataFrame:
    """The landed pages of chains: the columns of ``searches`` (with ``url``), ``turn`` and ``content``.

    A page names the next one as ``nextPage``; a chain ends at a page that is missing, no JSON, or without records, or
    when ``most`` records were read. All chains advance together, a round for each page of the longest.
    """
    spark = searches.sparkSession
    scratch = Scratch(spark, "cursor")
    shape = "bibs array<struct<marc:string>>, nextPage string"
    stored = scratch.table(_stored(pages), "pages")
    names = [c for c in searches.columns if c != "url"]
    now, turn, out = searches.withColumn("read", F.lit(0).cast("long")), 0, None
    while True:
        met = now.join(stored, now["url"] == stored["_url"]).withColumn("_p", F.from_json("content", shape))
        met = met.filter("_p IS NOT NULL").withColumn("_n", F.greatest(F.size(F.coalesce("_p.bibs", F.array().cast("array<struct<marc:string>>"))), F.lit(0)))
        met = scratch.table(met.select(*names, "url", F.lit(turn).alias("turn"), "content", (F.col("read") + F.col("_n")).alias("read"), F.when(F.col("_n") > 0, F.col("_p.nextPage")).alias("next")), f"turn{turn}")
        if met.isEmpty():
            break
        out = met if out is None else out.unionByName(met)
        more = F.lit(True) if most is None else F.col("read") < most
        now, turn = met.filter(F.col("next").isNotNull() & (F.col("next") != "") & more).select(*names, F.col("next").alias("url"), "read"), turn + 1
    return met.select(*names, "turn", "content") if out is None else out.select(*names, "turn", "content")


def _parsed(rows: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Editions of rows with ``content``, with the record's author."""
    if not catalogue.year:  # the catalogue with a cursor answers in JSON
        each = rows.select(*(c for c in rows.columns if c != "content"), F.posexplode(F.from_json("content", "bibs array<struct<marc:string>>")["bibs"]).alias("place", "_b"))
        records = each.filter("_b.marc IS NOT NULL").withColumn("record", marc.record_of_json(F.col("_b.marc"))).drop("_b")
    else:
        records = marc.records_of_xml(rows.withColumnRenamed("content", "xml"))
    parsed = marc.editions_of_unimarc(records, catalogue.name) if catalogue.unimarc else marc.editions_of_marc21(records, catalogue.name)
    return parsed.withColumn("record_author", marc.author_of(F.col("record"), unimarc=catalogue.unimarc)).withColumn("language_letter", F.lit(catalogue.letter))


def author_records(authors: DataFrame, pages: DataFrame, catalogue: Catalogue, *, most: int = MOST_RECORDS) -> DataFrame:
    """The parsed records of a search for each ``author``: "Last, First" or the plain name, as the catalogue wants it."""
    names = T.name_forms(F.col("author"))
    name = names["inverted"] if catalogue.inverted else names["plain"]
    if catalogue.year:
        searches = authors.withColumn("query", _filled(catalogue.author, name))
        found = offset_pages(searches, pages, catalogue, most=most).withColumnRenamed("start", "turn").drop("query")
    else:
        found = cursor_pages(authors.withColumn("url", cursor_address(catalogue, catalogue.author, name)), pages, most=most)
    return _parsed(found, catalogue)


def publisher_records(publishers: list[str], pages: DataFrame, catalogue: Catalogue, years: range, *, most_at_once: int = MOST_AT_ONCE) -> DataFrame:
    """The parsed records of each publisher, a search by year where the whole one is too large for the server.

    ``year`` is the search's year, null for a whole search: a filter on it reads that year's pages only.
    """
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(p,) for p in publishers], "publisher_searched string")
    if not catalogue.year:
        rows = cursor_pages(wanted.withColumn("url", cursor_address(catalogue, catalogue.publisher, F.col("publisher_searched"))), pages)
        return _parsed(rows.withColumn("year", F.lit(None).cast("int")), catalogue)
    whole = wanted.withColumn("query", _filled(catalogue.publisher, F.col("publisher_searched")))
    head = whole.withColumn("_at", address(catalogue, F.col("query"), F.lit(1), 1)).join(_stored(pages), F.col("_at") == F.col("_url"), "left")
    sized = head.select("publisher_searched", "query", F.coalesce(marc.total_of(F.col("content")), F.lit(0)).alias("total"))
    small = sized.filter(F.col("total") <= most_at_once).select("publisher_searched", "query", F.lit(None).cast("int").alias("year"))
    large = sized.filter(F.col("total") > most_at_once).select("publisher_searched", F.explode(F.array(*map(F.lit, years))).alias("year"))
    large = large.select("publisher_searched", _filled(catalogue.year, F.col("publisher_searched"), F.col("year")).alias("query"), "year")
    rows = offset_pages(small.unionByName(large), pages, catalogue).withColumnRenamed("start", "turn").drop("query")
    return _parsed(rows, catalogue)


def harvest(pages: DataFrame, publishers: dict[str, list[str]], years: range, catalogues: tuple[Catalogue, ...] = (GERMAN, FRENCH, POLISH)) -> DataFrame:
    """Records of all catalogues, of each language and record id the first; serials, other languages and translations from
    other languages than English are left out. ``publishers`` names those of each language letter."""
    out = None
    for catalogue in catalogues:
        if catalogue.letter not in publishers:
            continue
        rows = publisher_records(publishers[catalogue.letter], pages, catalogue, years)
        rows = first_per_key(rows, ["record_id"], ["publisher_searched", F.coalesce("year", F.lit(0)), "turn", "place"])
        rows = rows.filter(~marc.is_serial(F.col("record"), F.col("pub_date")))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def harvested_works(editions: DataFrame) -> DataFrame:
    """A row of the interchange format for each distinct work of a record, without the year at the end of its title."""
    works = marc.works_of_record(editions).withColumn("original_title", F.btrim(T.without_year(F.col("original_title")), F.lit(" ,")))
    empty = F.lit("")
    return works.select("language_letter", F.col("record_author").alias("authors"), "original_title", "translated_title", "pub_date", "publisher", "place", "translators", "series", "isbn", empty.alias("format"), F.col("responsibility").alias("copyright"), "source", F.col("record_id").alias("source_record_id"), empty.alias("url"))


def search_hits(wanted: DataFrame, pages: DataFrame, *, base: str, most: int = 10) -> DataFrame:
    """(key, docs) for ``linkage.resolve_titles``: the first ``most`` hits of the landed answer to each wanted title.

    ``wanted`` has (key, author, title). An answer is JSON with ``docs``; one that is missing or no JSON has no hits.
    """
    url = F.concat(F.lit(f"{base}?title="), F.url_encode("title"), F.lit("&author="), F.url_encode("author"), F.lit(f"&limit={most}"))
    shape = "docs array<struct<key:string,title:string,author_name:array<string>,first_publish_year:int,publisher:array<string>>>"
    empty = F.array().cast("array<string>")
    found = wanted.withColumn("_at", url).join(_stored(pages), F.col("_at") == F.col("_url")).withColumn("_d", F.from_json("content", shape)["docs"])
    doc = lambda d: F.struct(F.coalesce(d["title"], F.lit("")).alias("title"), F.coalesce(d["author_name"], empty).alias("authors"), F.filter(F.coalesce(d["publisher"], empty), lambda p: p != "").alias("publishers"), F.element_at(F.split(d["key"], "/"), -1).alias("work_id"), d["first_publish_year"].cast("string").alias("year"))
    return found.filter("_d IS NOT NULL").select("key", F.transform(F.slice("_d", 1, most), doc).alias("docs"))
