"""List, book and product pages in the forms that the readers meet."""

import pytest
from pyspark.sql import functions as F

from marginalia.cluster import ship
from marginalia.functions import text as T
from marginalia.sources import html

LIST = """<html><head><title>Quiet Line books</title></head><body><h1>All of them</h1><p>Page 1 of 2</p><table>
<tr><td>12</td><td><a href="/book/love-in-1999~51.htm">Love in 1999</a> <span>by <a href="/author/jane-doe~7.htm">Jane Doe</a></span></td><td><a href="/author/jane-doe~7.htm">Jane Doe</a></td><td>Mar. 12, 1983</td><td>4.25</td></tr>
<tr><td>13.5</td><td><a href="/book/other~52.htm"><b>Other</b></a></td><td><a href="/author/m-roe~8.htm">M. Roe</a>, <a href="/author/j~7.htm">Jane Doe</a></td><td>1984-05</td><td>x</td></tr>
<tr><td>1995</td><td><a href="/book/year~53.htm">Year</a></td><td><a href="/author/m-roe~8.htm">M. Roe</a></td><td>1949</td><td>3.5</td></tr>
<tr><td>14</td><td><a href="/book/stamp~54.htm">Stamp</a></td><td><a href="/author/m-roe~8.htm">M. Roe</a></td><td><time datetime="2001-02-03">x</time></td></tr>
<tr><td>15</td><td><a href="/book/tile~55.htm"><img></a></td></tr></table><a href="/book/other~52.htm">Other</a></body></html>"""
BOOK = """<html><head><meta content="c.jpg" property="og:image"><meta name="og:isbn" content="9780000000001"><meta property="og:description" content="short"></head><body>
<h2>About This Book</h2><p>First line.</p><p>Second line.</p><h2>Series Placement</h2><p>no</p>
<a href="/series/quiet~3.htm">Quiet</a> <span>Book 12</span><a href="/series/loud~4.htm">Loud</a> <span>Book 2.5</span>
<h3>Subgenres</h3><a href="/genre/x.htm">Doctors</a><a href="/genre/y.htm">Sea</a><a href="/other">No</a><h3>More</h3><a href="/genre/z.htm">Not here</a>
<h2>Book Details</h2><p>Published</p><p>Mar 1983</p><p>Pages 253</p><p>Rating</p><p>4.25 / 5</p><p>Main Genre</p><p>Romance</p><p>Track This Book</p><p>Pages</p><p>9</p>
<h2>Formats & Editions</h2><p>Paperback</p><p>Mar 1983</p><p>Mills & Co</p><p>ISBN13</p><p>9780000000002</p><p>ISBN10</p><p>123456789X</p><p>Close</p></body></html>"""


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_list_rows_of_written_links(spark):
    frame = spark.createDataFrame([(LIST,), (None,), ("<a href='/book/x~1.htm'",)], "p string")
    rows = [r for r in frame.select(F.explode(html.list_rows("p")).alias("r")).select("r.*").collect()]
    assert [(r["book_id"], r["title"], r["authors"], r["author_ids"], r["series_number"], r["pub_date"], r["rating"]) for r in rows] == [
        ("51", "Love in 1999", "Jane Doe", "7", "12", "Mar. 12, 1983", "4.25"), ("52", "Other", "M. Roe; Jane Doe", "8; 7", "13.5", "1984-05", ""),
        ("53", "Year", "M. Roe", "8", "1995", "1949", ""), ("54", "Stamp", "M. Roe", "8", "14", "2001-02-03", "")]
    assert rows[0]["book_url"] == "/book/love-in-1999~51.htm" and rows[1]["author_urls"] == "/author/m-roe~8.htm; /author/j~7.htm"


def test_a_long_list_takes_linear_time(spark):
    row = '<tr><td>{0}</td><td><a href="/book/b~{0}.htm">T</a><a href="/author/a~{0}.htm">A</a></td></tr>'
    page = "<table>" + "".join(row.format(i) for i in range(20_000)) + "</table>"
    assert len(html._rows(page)) == 20_000


def test_series_pages(spark):
    second = '<table><tr><td>9</td><td><a href="/book/other~52.htm">Other</a><a href="/author/j~7.htm">J</a></td></tr><tr><td>20</td><td><a href="/book/new~60.htm">New</a><a href="/author/j~7.htm">J</a></td></tr></table>'
    pages = spark.createDataFrame([("http://x/quiet.htm", LIST), ("http://x/quiet~2.htm", second), ("http://x/loud.htm", LIST)], "url string, content string")
    series = spark.createDataFrame([("Quiet", "http://x/quiet.htm", "quiet line"), ("Loud", "http://x/loud.htm", "loud line")], "line string, url string, expected string")
    got = html.series_books(series, pages, base="http://x").orderBy("book_id").collect()
    assert [(r["line"], r["book_id"], r["page"]) for r in got] == [("Quiet", k, p) for k, p in (("51", 1), ("52", 1), ("53", 1), ("54", 1), ("60", 2))]
    assert got[0]["book_url"] == "http://x/book/love-in-1999~51.htm"


def test_book_details(spark):
    r = spark.createDataFrame([(BOOK,)], "p string").select(html.book_details("p").alias("d")).select("d.*").first().asDict()
    assert r == {
        "isbn13": "9780000000001", "isbn10": "123456789X", "publisher": "Mills & Co", "format": "Paperback", "pages": "253", "rating_detail": "4.25", "published_detail": "Mar 1983", "main_genre": "Romance",
        "subgenres": "Doctors; Sea", "other_series": "Quiet #12; Loud #2.5", "cover_url": "c.jpg", "description": "First line. Second line."}
    bare = '<script>{"ratingValue": "3.9"}</script><span itemprop="ratingValue" content="4.1"></span><meta property="og:description" content="about">'
    other = spark.createDataFrame([(bare,), (bare.replace("itemprop", "x"),), (None,)], "p string").select(html.book_details("p").alias("d")).select("d.*").collect()
    assert [(r["rating_detail"], r["description"]) for r in other] == [("4.1", "about"), ("3.9", "about"), ("", "")]


def test_details_fill_blanks_only(spark):
    rows = spark.createDataFrame([("1", "", "Mar 1983", "a"), ("2", "4.0", "", "b")], "book_id string, rating string, pub_date string, publisher string")
    details = spark.createDataFrame([("1", "3.0", "1990", "new"), ("2", "3.0", "1990", "new")], "book_id string, rating string, pub_date string, publisher string")
    assert sorted(tuple(r) for r in html.with_details(rows, details).collect()) == [("1", "3.0", "Mar 1983", "new"), ("2", "4.0", "1990", "new")]


def test_stories_are_cut_at_imprint_words(spark):
    page = "<p>© 1999 by A B</p><p>x</p><p>Originaltitel: „The Quiet Harbor“ erschienen bei Mills &amp; Boon</p><p>Übersetzung: Anna Meier.</p><p>in der Reihe: MODERN ROMANCE</p><p>Originaltitel: Storm Published by Mills, Übersetzung: Karl</p><p>© 2001 by C</p><p>Originaltitel: Sie sind erschienen wie Sterne</p>" + "<p>line</p>" * 24 + "<p>Übersetzung: Zu Spät</p>"
    rows = [tuple(r) for r in spark.createDataFrame([(page,)], "p string").select(F.explode(html.product_stories("p")).alias("s")).select("s.*").collect()]
    assert rows == [("The Quiet Harbor", "Anna Meier", "1999 A B", "Modern Romance", "", ""), ("Storm", "Karl", "1999 A B", "", "", ""), ("Sie sind erschienen wie Sterne", "", "2001 C", "", "", "")]
    texts = spark.createDataFrame([("Sie sind erschienen wie Sterne",), ("Storm Published by Mills",), ("„Der Hafen“ © 1999",), ("Titel erschienen bei X, 2000",), ("Plain. ;",)], "t string")
    assert [r[0] for r in texts.select(T.clean_shop_title(F.col("t"))).collect()] == ["Sie sind erschienen wie Sterne", "Storm", "Der Hafen", "Titel", "Plain"]


def test_meta_in_any_order(spark):
    frame = spark.createDataFrame([("<meta content='a \"b\"' property='og:description'>",), ('<meta name="description" content="c">',), ("<p>",), (None,)], "p string")
    assert [r[0] for r in frame.select(html.blurb(F.lit(None).cast("string"), F.col("p"))).collect()] == ['a "b"', "c", "", ""]


def test_product_lists_end_at_the_first_gap(spark):
    page = '{{"products": [{{"handle": "{0}", "tags": {1}}}]}}'
    pages = spark.createDataFrame([(1, page.format("a", '["Julia", "Dani Collins"]')), (2, page.format("b", '"x, y"')), (3, "blocked"), (4, page.format("d", '""'))], "n int, json string")
    rows = html.products(pages, page="n").withColumn("t", T.product_tags(F.col("tags"))).orderBy("handle").collect()
    assert [(r["handle"], r["t"]) for r in rows] == [("a", ["Julia", "Dani Collins"]), ("b", ["x", "y"])] and html.products(pages).count() == 3


def test_names_and_prices(spark):
    one = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*(F.col(f"c{i}") for i in range(len(v)))).alias("x")).first()["x"]
    assert one(T.clean, " Über  uns / ") == "Über uns"
    assert [one(T.price_or_text, v) for v in ("3,99 €", "auf Anfrage", None)] == ["3.99", "auf Anfrage", ""]
    assert [one(T.first_word_last, v) for v in ("Lamorlette M.-J.", "Solo", None)] == ["M.-J. Lamorlette", "Solo", ""]
    assert one(lambda a, h: T.with_holder(F.split(a, ";"), h, "Harlequin"), "Jane Doe", "1999 Max Roe") == ["Jane Doe", "Max Roe"]
    assert one(lambda a, h: T.with_holder(F.split(a, ";"), h, "Harlequin"), "Jane Doe", "1999 Harlequin Books") == ["Jane Doe"]
    assert tuple(one(T.name_forms, "Sandra Lee Brown")) == ("Brown, Sandra Lee", "Sandra Lee Brown") and one(T.language_name, "G") == "German"
    common = F.array(F.lit("the"), F.lit("then"))
    assert sorted(one(lambda t: T.english_names(t, common), "Then Anna met Dr. O'Neil in Rome. The End!")) == ["anna", "end", "rome"]
    assert sorted(one(lambda t: T.german_tokens(t, F.array(F.lit("Der"))), "Der Arzt Karl liebt Änne.")) == ["anne", "arzt", "karl"]


def test_a_read_page_leaves_no_circles():
    import gc

    gc.collect()
    gc.disable()
    try:
        assert html.lines_of("<div><p>one</p><p>two <b>three</b></p></div>" * 50)[:2] == ["one", "two three"]
        assert gc.collect() == 0  # nothing that only the collector can free
    finally:
        gc.enable()
