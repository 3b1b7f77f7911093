"""Catalogues over landed pages: offsets, cursors, splitting by year, and what a harvest leaves out."""

from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from marginalia.cluster import ship
from marginalia.sources import harvest as H
from marginalia.sources import tables


def marc(number, title="Der Hafen", original="Quiet harbor", author="Doe, Jane", lang="ger", leader="00000nam", date="1990"):
    field = lambda tag, *subs: f'<datafield tag="{tag}" ind1=" " ind2="1">' + "".join(f'<subfield code="{c}">{v}</subfield>' for c, v in subs) + "</datafield>"
    return f'<record><leader>{leader}</leader><controlfield tag="001">{number}</controlfield>' + field("041", ("a", lang), ("h", "eng")) + field("100", ("a", author)) + field("245", ("a", title)) + field("240", ("a", original)) + field("264", ("c", date)) + "</record>"


def answer(total, *records):
    return f"<r><numberOfRecords>{total}</numberOfRecords>{''.join(records)}</r>"


def url(catalogue, query, start, size=100):
    return f"{catalogue.base}?" + urlencode([*catalogue.fixed, ("query", query), ("maximumRecords", size), ("startRecord", start)])


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def landed(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, content string")


def test_search_by_author_pages_by_offset(spark):
    q = 'per="Doe, Jane"'
    pages = landed(spark, (url(H.GERMAN, q, 1), answer(250, marc("a"), marc("b"))), (url(H.GERMAN, q, 101), answer(250, marc("c"))), (url(H.GERMAN, q, 201), answer(250)), (url(H.GERMAN, 'per="Roe, Max"', 1), "<broken"))
    authors = spark.createDataFrame([("Jane Doe",), ("Max Roe",), ("Nobody",)], "author string")
    rows = H.author_records(authors, pages, H.GERMAN)
    assert sorted((r["author"], r["record_id"], r["turn"], r["original_titles"]) for r in rows.collect()) == [("Jane Doe", k, t, ["Quiet harbor"]) for k, t in (("a", 1), ("b", 1), ("c", 101))]
    assert {r["record_id"] for r in H.author_records(authors, pages, H.GERMAN, most=100).collect()} == {"a", "b"}
    french = landed(spark, (url(H.FRENCH, 'bib.author all "Jane Doe"', 1), answer(1, marc("f"))))
    assert [r["language_letter"] for r in H.author_records(authors, french, H.FRENCH).collect()] == ["F"]


def test_a_missing_page_ends_a_search(spark):
    q = 'per="Doe, Jane"'
    pages = landed(spark, (url(H.GERMAN, q, 1), answer(250, marc("a"))), (url(H.GERMAN, q, 201), answer(250, marc("z"))))
    rows = H.author_records(spark.createDataFrame([("Jane Doe",)], "author string"), pages, H.GERMAN)
    assert [r["record_id"] for r in rows.collect()] == ["a"]


def bib(number):
    return '{"marc": {"leader": "00000nam", "fields": [{"001": "%s"}, {"100": {"subfields": [{"a": "Doe, Jane"}]}}, {"245": {"subfields": [{"a": "Port"}]}}]}}' % number


def test_cursor_follows_the_chain(spark):
    first = f"{H.POLISH.base}?" + urlencode({"author": "Doe, Jane", "language": "polski", "limit": 100})
    pages = landed(spark, (first, '{"bibs": [%s, %s], "nextPage": "http://n/2"}' % (bib("1"), bib("2"))), ("http://n/2", '{"bibs": [%s], "nextPage": "http://n/3"}' % bib("3")), ("http://n/3", '{"bibs": [], "nextPage": "http://n/4"}'), ("http://n/4", '{"bibs": [%s]}' % bib("never")))
    authors = spark.createDataFrame([("Jane Doe",), ("Nobody",)], "author string")
    rows = H.author_records(authors, pages, H.POLISH)
    assert sorted((r["record_id"], r["turn"], r["record_author"], r["language_letter"]) for r in rows.collect()) == [("1", 0, "Jane Doe", "P"), ("2", 0, "Jane Doe", "P"), ("3", 1, "Jane Doe", "P")]
    assert {r["record_id"] for r in H.author_records(authors, pages, H.POLISH, most=2).collect()} == {"1", "2"}
    broken = landed(spark, (first, "blocked"))
    assert H.author_records(authors, broken, H.POLISH).collect() == []


def test_large_harvests_are_split_by_year(spark):
    small, large = 'vlg="Cora"', 'vlg="Mira"'
    by = lambda y: f'vlg="Mira" and jhr={y}'
    pages = landed(
        spark, (url(H.GERMAN, small, 1, 1), answer(2, marc("x"))), (url(H.GERMAN, small, 1), answer(2, marc("s1"), marc("s2", leader="00000nas"))), (url(H.GERMAN, large, 1, 1), answer(20_000)), (url(H.GERMAN, large, 1), answer(20_000, marc("never"))),
        (url(H.GERMAN, by(1990), 1), answer(1, marc("y90"))), (url(H.GERMAN, by(1991), 1), answer(1, marc("y91"), marc("s1", title="again"), marc("range", date="1974-"))),
    )
    rows = H.publisher_records(["Cora", "Mira"], pages, H.GERMAN, range(1990, 1993))
    assert {(r["record_id"], r["year"]) for r in rows.collect()} == {("s1", None), ("s2", None), ("y90", 1990), ("y91", 1991), ("s1", 1991), ("range", 1991)}
    assert {r["record_id"] for r in rows.filter("year = 1991").collect()} == {"y91", "s1", "range"}
    works = H.harvested_works(H.harvest(pages, {"G": ["Cora", "Mira"]}, range(1990, 1993))).collect()
    assert sorted(r["source_record_id"] for r in works) == ["s1", "y90", "y91"] and {r["translated_title"] for r in works} == {"Der Hafen"}
    assert set(works[0].asDict()) == {p.split()[0] for p in tables.EXTRA.split(", ")} - {"original_series", "first_edition", "first_edition_year", "blurb"}


def test_delimited_files_open_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("G", 'a "b"; c', None, 1), ("F", "ü\nnext", "y", 2)], "language_letter string, title string, note string, surplus int")
    tables.write_delimited(rows.coalesce(1), str(tmp_path / "one"), ["title", "note"])
    text = next((tmp_path / "one").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿title,note\n") and "surplus" not in text
    back = tables.read_table(spark, str(tmp_path / "one"), sep=",")
    assert sorted(map(tuple, back.collect())) == [('a "b"; c', ""), ("ü\nnext", "y")]
    tables.write_delimited(rows, str(tmp_path / "by"), ["title"], by="language_letter")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"_by=F", "_by=G"}
    tables.write_table(rows, str(tmp_path / "p"), "title", "language_letter", by="language_letter")
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"language_letter=F", "language_letter=G"}


def test_landed_pages_and_people_s_columns(spark):
    pages = spark.createDataFrame([("http://a", "old", 200, 1), ("http://a", "new", 200, 2), ("http://b", "gone", 404, 1), ("http://c", "busy", 503, 1)], "url string, content string, status int, fetched int").withColumn("page_key", tables.cached_page_key(F.col("url"))).drop("url")
    wanted = spark.createDataFrame([("http://a", True), ("http://b", False), ("http://c", False), ("http://d", False)], "url string, again boolean")
    got = {r["url"]: (r["content"], r["wanted"]) for r in tables.landed(wanted, pages, refresh=F.col("again")).collect()}
    assert got == {"http://a": ("new", True), "http://b": ("", False), "http://c": ("", True), "http://d": ("", True)}
    assert {r["url"]: r["wanted"] for r in tables.landed(wanted, pages).collect()}["http://a"] is False
    with pytest.raises(Exception, match="no page for"):
        tables.landed(wanted.filter("url = 'http://d'"), pages, fail_on_missing=True).collect()
    old = spark.createDataFrame([("v1", "2020-01-02", "n"), ("gone", "x", "y")], "volume_id string, ordered string, notes string")
    new = spark.createDataFrame([("v1", "T"), ("v2", "U")], "volume_id string, title string")
    assert sorted(map(tuple, tables.human_columns(old, new, ["ordered", "scanned"]).collect())) == [("v1", "T", "2020-01-02", ""), ("v2", "U", "", "")]
    assert [r["title"] for r in tables.limited(new, ["title"], 1).collect()] == ["T"] and tables.limited(new, ["title"], 0).count() == 2


def test_translation_index(spark):
    works = spark.createDataFrame([("u1", "<The> Quiet Harbor", "[{'translated_title': '<Der> Hafen', 'translated_title_language': 'German', 'year': 1995, 'publisher_name': 'CORA Verlag', 'place': 'Berlin', 'translator_name': 'Meier A.'}, {'translated_title': 'x', 'translated_title_language': 'Dutch', 'year': 1995, 'publisher_name': 'Cora'}]"), ("u2", "Quiet Harbor", "[{'translated_title': 'y', 'translated_title_language': 'French', 'year': 1980, 'publisher_name': 'Harlequin'}]")], "uuid string, original_title string, translations string")
    books = spark.createDataFrame([("Quiet Harbor", "Jane Doe", "Mar 1990"), ("Other", "Max Roe", "1990")], "title string, authors string, pub_date string")
    rows = tables.translation_index(tables.works_exploded(works), books).collect()
    assert [(r["language_letter"], r["authors"], r["translated_title"], r["pub_date"], r["translators"], r["source_record_id"]) for r in rows] == [("G", "Jane Doe", "Der Hafen", "1995", "A. Meier", "unesco:u1:G1995:0")]


def test_search_hits_feed_the_resolution(spark):
    from marginalia.operators.linkage import resolve_titles

    wanted = spark.createDataFrame([("k1", "Jane Doe", "Quiet Harbor"), ("k2", "Jane Doe", "Storm"), ("k3", "Jane Doe", "Lost"), ("k4", "Jane Doe", "The Quiet Harbor")], "key string, author string, title string")
    base = "http://search"
    ask = lambda title: f"{base}?" + urlencode({"title": title, "author": "Jane Doe", "limit": 10})
    hit = '{"docs": [{"key": "/works/W0", "title": "Other"}, {"key": "/works/W1", "title": "Quiet Harbour", "author_name": ["Doe Jane", "Jane Doe"], "publisher": ["", "Mills & Boon"], "first_publish_year": 1990}]}'
    pages = landed(spark, (ask("Quiet Harbor"), hit), (ask("The Quiet Harbor"), hit), (ask("Storm"), '{"docs": [{"key": "/works/W2", "title": "Storm", "author_name": ["Jane Doe"], "publisher": ["Else"]}]}'), (ask("Lost"), "blocked"))
    hits = H.search_hits(wanted, pages, base=base)
    rows = resolve_titles(wanted, hits, houses=["mills"]).collect()
    assert {r["key"]: (r["outcome"], r["doc"] and r["doc"]["work_id"]) for r in rows} == {"k1": ("found", "W1"), "k2": ("other publisher", "W2"), "k3": ("not found", None)}
    assert {r["key"] for r in resolve_titles(wanted, hits, houses=["mills"], any_publisher=True).filter("outcome = 'found'").collect()} == {"k1", "k2"}
