import pytest
from pyspark.sql import functions as F

from marginalia.cluster import ship
from marginalia.sources import html, marc, tables

XML = """<r xmlns:m="x"><m:numberOfRecords>2</m:numberOfRecords><m:records><m:record><m:recordData><m:record><m:leader>00000nam a2200000</m:leader><m:controlfield tag="001">id1</m:controlfield>
<m:controlfield tag="008">000000s1987                        ger d</m:controlfield>
<m:datafield tag="020" ind1=" " ind2=" "><m:subfield code="a">978 pbk</m:subfield></m:datafield><m:datafield tag="041" ind1="1" ind2=" "><m:subfield code="a">GER</m:subfield><m:subfield code="h">eng</m:subfield></m:datafield>
<m:datafield tag="100" ind1=" " ind2=" "><m:subfield code="a">Doe, Jane</m:subfield></m:datafield>
<m:datafield tag="245" ind1=" " ind2=" "><m:subfield code="a">Der stille Hafen :</m:subfield><m:subfield code="b">Roman /</m:subfield><m:subfield code="c">Jane Doe. Aus dem Amerikan. von Anna Meier</m:subfield></m:datafield>
<m:datafield tag="264" ind1=" " ind2="4"><m:subfield code="c">1900</m:subfield></m:datafield><m:datafield tag="264" ind1=" " ind2="1"><m:subfield code="a">Hamburg</m:subfield><m:subfield code="b">Cora</m:subfield></m:datafield>
<m:datafield tag="490" ind1=" " ind2=" "><m:subfield code="a">Baccara ;</m:subfield><m:subfield code="v">12</m:subfield></m:datafield>
<m:datafield tag="500" ind1=" " ind2=" "><m:subfield code="a">Originaltitel: The quiet harbor. - 2. Aufl.</m:subfield></m:datafield></m:record></m:recordData></m:record></m:records></r>"""


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_marc_xml(spark):
    pages = spark.createDataFrame([(XML,), ("<broken",), (None,)], "xml string")
    assert [r[0] for r in pages.select(marc.total_of(F.col("xml"))).collect()] == [2, None, None]
    rows = marc.editions_of_marc21(marc.records_of_xml(pages), "DNB").withColumn("author", marc.author_of(F.col("record"))).withColumn("serial", marc.is_serial(F.col("record"), F.col("pub_date"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["record_id"], r["langs"], r["orig_lang"], r["author"], r["serial"]) == ("id1", ["ger"], "eng", "Jane Doe", False)
    assert (r["translated_title"], r["original_titles"], r["translators"]) == ("Der stille Hafen : : Roman", ["The quiet harbor"], "Anna Meier")
    assert (r["place"], r["publisher"], r["pub_date"], r["pub_year"], r["series"], r["isbn"]) == ("Hamburg", "Cora", "1987", "1987", "Baccara ; 12", "978")


def test_marc_json_and_unimarc(spark):
    text = '{"leader":"00000nas","fields":[{"001":"x"},{"003":"u1"},{"200":{"ind1":" ","ind2":" ","subfields":[{"a":"Le port"},{"e":"roman"},{"f":"trad. de l\'anglais par Luc Noir"}]}},{"225":{"ind1":" ","ind2":" ","subfields":[{"a":"Harlequin."},{"i":"Série Désir"},{"v":"2"}]}},{"700":{"ind1":" ","ind2":" ","subfields":[{"a":"Doe"},{"b":"Jane"},{"4":"070"}]}},{"300":{"ind1":" ","ind2":" ","subfields":[{"a":"Trad. de : \\"Tomorrow\'s promise\\""}]}}]}'
    rows = spark.createDataFrame([(text,)], "j string").select(marc.record_of_json(F.col("j")).alias("record"))
    r = marc.editions_of_unimarc(rows).withColumn("author", marc.author_of(F.col("record"), unimarc=True)).withColumn("serial", marc.is_serial(F.col("record"))).first()
    assert (r["record_id"], r["translated_title"], r["original_titles"], r["translators"], r["series"], r["author"], r["serial"]) == ("u1", "Le port : roman", ["Tomorrow's promise"], "Luc Noir", "Harlequin. Désir 2", "Jane Doe", True)


def test_notes(spark):
    notes = spark.createDataFrame([(["Tyt. oryg. poszczeg. utworów: The Raider, 1994, Stranded, 1994 Deep cover"],), (["nothing"],), ([],)], "n array<string>")
    assert [r[0] for r in notes.select(marc.titles_of_notes("n")).collect()] == [["The Raider", "Stranded", "Deep cover"], [], []]


def test_works_of_record(spark):
    rows = spark.createDataFrame([(1, ["The Raider", "Raider", "Stranded"]), (2, [])], "id int, original_titles array<string>")
    assert sorted((r["id"], r["original_title"]) for r in marc.works_of_record(rows).collect()) == [(1, "Stranded"), (1, "The Raider"), (2, "")]


def test_list_rows(spark):
    page = '<h1>Presents list</h1>Page 1 of 7<table><tr><td>#12 <a href="/book/5">Love in 1999</a> by <a href="/author/3">Jane Doe</a> Mar 1983 4.25</td></tr><tr><td><a href="/book/6">Other</a> <a href="/author/4">M. Roe</a></td></tr><tr><td><a href="/book/7">No author</a></td></tr></table>'
    frame = spark.createDataFrame([(page,)], "p string")
    rows = frame.select(F.explode(html.list_rows("p")).alias("r")).select("r.*").collect()
    assert [(r["book_id"], r["title"], r["authors"], r["series_number"], r["pub_date"], r["rating"]) for r in rows] == [("5", "Love in 1999", "Jane Doe", "12", "Mar 1983", "4.25"), ("6", "Other", "M. Roe", "", "", "")]
    assert frame.select(html.total_pages(F.col("p")), html.of_series(F.col("p"), F.lit("Presents"))).first() == (7, True)


def test_product_page(spark):
    page = "<script>x</script><p>© 1990 by Jane Doe</p><p>Originaltitel: The Quiet Harbor | Übersetzung: Anna Meier</p><p>Deutsche Erstausgabe in der Reihe: BACCARA</p><p>Band 12, 1991</p><p>Originaltitel: Storm</p><p>ISBN 9783733700000</p><p>Erscheinungstag: 01.02.2010</p>"
    frame = spark.createDataFrame([(page,)], "p string")
    got = [tuple(r) for r in frame.select(F.explode(html.product_stories("p")).alias("s")).select("s.*").collect()]
    assert got == [("The Quiet Harbor", "Anna Meier", "1990 Jane Doe", "", "Baccara 12", "1991"), ("Storm", "", "1990 Jane Doe", "", "", "")]
    assert tuple(frame.select(html.product_info(F.col("p")).alias("i")).first()["i"]) == ("01.02.2010", "9783733700000")


def test_segments(spark):
    rows = spark.createDataFrame([("DAS GROSSE HERZ von JANE DOE Anna liebt. DER STURM KOMMT von MAX ROE Karl geht.", "x; y"), ("Nur Text.", "Doe, Jane"), (None, "")], "blurb string, authors string")
    got = [(r["segment_title"], r["akey"], r["segment_text"].strip()) for r in html.segments(rows).collect()]
    assert got == [("DAS GROSSE HERZ", "doe", "Anna liebt."), ("DER STURM KOMMT", "roe", "Karl geht."), ("", "doe", "Nur Text."), ("", "", "")]


def test_tables(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿book_id;title;n\n1;"a;b";x\n2;;3\n', encoding="utf-8")
    rows = tables.read_table(spark, str(path))
    assert sorted(map(tuple, rows.collect())) == [("1", "a;b", "x"), ("2", "", "3")] and rows.columns == ["book_id", "title", "n"]
    assert [r["n"] for r in tables.typed(rows, {"n": "int", "missing": "date"}).orderBy("book_id").collect()] == [None, 3]
    works = spark.createDataFrame([("u", "[{'translated_title': 'x', 'year': 1999}]"), ("v", "broken[")], "uuid string, translations string")
    assert [(r["uuid"], r["translated_title"], r["year"]) for r in tables.works_exploded(works).collect()] == [("u", "x", 1999)]
    pages = spark.createDataFrame([("http://a",)], "url string").select(tables.cached_page_key(F.col("url")).alias("page_key"), F.lit("text").alias("content"))
    wanted = spark.createDataFrame([("http://a",), ("http://b",)], "url string")
    assert sorted(r["content"] for r in tables.landed(wanted, pages).collect()) == ["", "text"]


def test_translation_index_counts_are_those_of_its_rows(spark):
    works = spark.createDataFrame([("u1", "<The> Bride", 1990), ("u1", "<The> Bride", 1990), ("u2", "Bride", 1995), ("u3", None, 1990)], "uuid string, original_title string, year int")
    works = works.withColumns({"translated_title_language": F.lit("German"), "publisher_name": F.lit("Cora"), **{c: F.lit("x") for c in ("translated_title", "place", "translator_name")}})
    books = spark.createDataFrame([("The Bride", "A", "1990")] * 3 + [("The Bride", "A", "1988"), ("Bride", None, "1989"), (None, "B", "1990"), ("The Bride", "A", "1970")], "title string, authors string, pub_date string")
    rows = tables.translation_index(works, books).groupBy(F.split_part("source_record_id", F.lit(":"), F.lit(2)).alias("uuid"), "authors", "original_title", "pub_date").agg(F.count(F.lit(1)).alias("n"))
    counted = tables.translation_index_counts(works, books)
    assert sorted(map(repr, counted.select(*rows.columns).collect())) == sorted(map(repr, rows.collect())) and counted.agg(F.max("n")).first()[0] == 8


def test_a_record_is_parsed_once_for_all_of_its_readers(spark):
    pages = spark.createDataFrame([(XML,)], "xml string")
    plan = marc.editions_of_marc21(marc.records_of_xml(pages), "DNB")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("xmltostructs(") + plan.lower().count("from_xml(") <= 1
