"""Normalisation of titles, names, series, dates and publishers as built-in expressions.

All functions take and return columns. "Missing" is the empty string unless a docstring says null. Java's patterns are
ASCII by default, so patterns that must see letters of other scripts start with ``(?U)`` or ``(?iu)``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Invisible characters that libraries leave in titles; years; trimmed punctuation.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F​-‏﻿]"
YEAR = r"1[89][0-9]{2}|20[0-9]{2}"
EDGES = " /:;,.="
#: Languages by letter.
LANGUAGES = {"F": "French", "G": "German", "P": "Polish"}
#: A publisher's family by the first fragment that its name holds.
FAMILIES = (("harlequin", "Harlequin"), ("cora", "Cora"), ("silhouette", "Silhouette / AWHE"), ("awhe", "Silhouette / AWHE"), ("weltbild", "Weltbild"))
#: What follows an original title on a shop's page, and quotation marks around it.
IMPRINT, QUOTES = r"\s+(?:erschienen\s+bei\b|Published by\b|©)", "\"'„“‚‘”’»›«‹"
#: Tags that are no names.
NO_NAMES = [
    "Julia", "Bianca", "Tiffany", "Romana", "Baccara", "Historical", "Mira", "Cora", "Extra", "Exklusiv", "Band", "Collection", "Weekend", "Edition", "Saison", "Special",
    "Sommer", "Winter", "Liebesroman", "Liebesromane", "Bestseller", "Gold", "Premium", "Lords", "Ladies", "Kiss", "Serie", "Ärzte", "Arzt",
]


def text_or_empty(s: Column) -> Column:
    return F.coalesce(s.cast("string"), F.lit(""))


@F.pandas_udf(StringType())
def _composed(s):  # canonical composition has no built-in form
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def strip_marks(s: Column, *, compose: bool = True) -> Column:
    """Without ``<<``, ``>>`` and invisible characters; canonically composed, where the text is not plain ASCII anyway."""
    bare = F.regexp_replace(F.replace(F.replace(text_or_empty(s), F.lit("<<"), F.lit("")), F.lit(">>"), F.lit("")), CONTROL, "")
    return _composed(bare) if compose else bare


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(s), r"(?U)\s+", " "))


def clean(s: Column, *, compose: bool = True) -> Column:
    """Marks stripped, canonically composed, white space squeezed, ``/ : ; , . =`` trimmed from both ends."""
    return F.btrim(squeeze(strip_marks(s, compose=compose)), F.lit(EDGES))


def clean_part(s: Column) -> Column:
    """``clean`` for elements of arrays, where no Arrow function runs; the text must be composed already."""
    return clean(s, compose=False)


def composed_record(record: Column, schema: str) -> Column:
    """A struct with all of its texts canonically composed, in one call for each row."""
    return F.from_json(_composed(F.to_json(record)), schema)


def year_text(s: Column, pattern: str = YEAR) -> Column:
    """The first year from 1800 to 2099 as text; empty if there is none."""
    return F.coalesce(F.regexp_substr(text_or_empty(s), F.lit(pattern)), F.lit(""))


def year_of(s: Column, pattern: str = YEAR) -> Column:
    """The first year as an integer, else null; ``pattern`` narrows the range."""
    return F.regexp_substr(text_or_empty(s), F.lit(pattern)).cast("int")


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: one-to-one pairs, and those that become several."""
    source, target, longer = [], [], {}
    for code in range(0x80, 0x1F000):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif len(plain) > 1 and (code < 0x250 or code in (0x2026, 0x2122, 0x20A8) or 0x2153 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06):
            longer[char] = plain
    return "".join(source), "".join(target), longer


def to_ascii(s: Column) -> Column:
    """Letters without their marks; characters that have no ASCII form vanish (ł, ß, ø, dashes, curly quotes)."""
    return F.get(F.transform(F.array(text_or_empty(s)), _ascii_of), F.lit(0))  # the text is read several times, and made once


def _ascii_of(text: Column) -> Column:
    source, target, longer = _ascii_tables()
    out = text
    for char, plain in longer.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    # each step only where the text needs it: plain ASCII has as many bytes as characters, and one comparison passes an
    # ASCII character in the pattern, which would else be held against each of the longer ones
    whole = F.when(text.rlike(f"[[^\\x00-\\x7F]&&[{''.join(longer)}]]"), out).otherwise(text)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(whole, source, target), r"[^\x00-\x7F]+", ""))


def fold(s: Column) -> Column:
    """For comparing names: ASCII, lower case, everything but letters and digits one space. A straight apostrophe
    becomes a space, a curly one vanishes."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(s)), "[^a-z0-9]+", " "))


def fold_joined(s: Column) -> Column:
    """As ``fold``, but apostrophes of all kinds are deleted first."""
    return fold(F.regexp_replace(text_or_empty(s), "[’‘`´']", ""))


def title_key(s: Column) -> Column:
    """The key titles are compared by.

    In this order: marks stripped; text before the first spaced ``/``, ``//``, ``;`` or ``=``; ASCII, lower case; round
    and square brackets dropped; apostrophes deleted; other signs to spaces; a trailing year; "(a) novel"; one article.
    """
    t = F.split_part(F.regexp_replace(strip_marks(s, compose=False), r"(?U)\s+(?:/{1,2}|[;=])\s+", "\u0000"), F.lit("\u0000"), F.lit(1))
    t = F.regexp_replace(F.lower(to_ascii(t)), r"\(.*?\)|\[.*?\]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[`']", ""), "[^a-z0-9 ]+", " ")
    t = squeeze(t)
    t = F.regexp_replace(t, r"\s+(19|20)[0-9]{2}$", "")
    t = F.regexp_replace(t, r"\s+(a )?novel$", "")
    return F.regexp_replace(t, "^(the|a|an) ", "")


def short_title_key(s: Column) -> Column:
    """``fold_joined`` without one leading article."""
    return F.regexp_replace(fold_joined(s), "^(the|a|an) ", "")


def person(name: Column, *, cleaned: bool = True) -> Column:
    """"Last, First" turned round if there is exactly one comma and both parts have text."""
    n = clean_part(name) if cleaned else name
    parts = F.transform(F.split(n, ","), lambda x: F.trim(x))
    whole = (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & (F.try_element_at(parts, F.lit(2)) != "")
    return F.when(whole, F.concat_ws(" ", F.try_element_at(parts, F.lit(2)), F.element_at(parts, 1))).otherwise(n)


def tidy_name(name: Column) -> Column:
    """Without brackets and life dates, then ``person``."""
    bare = F.regexp_replace(text_or_empty(name), r"\(.*?\)|\[.*?\]", "")
    return person(F.regexp_replace(bare, r",?\s*[0-9]{4}\s*[-–]\s*([0-9]{4})?\.?", ""))


def name_forms(full: Column) -> Column:
    """(inverted, plain): "Last, First" and "First Last" of a plain name; one word stays as it is."""
    words = F.split(squeeze(full), " ")
    last = F.element_at(words, -1)
    rest = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(F.when(F.size(words) > 1, F.concat(last, F.lit(", "), rest)).otherwise(last).alias("inverted"), squeeze(full).alias("plain"))


def author_key(name: Column) -> Column:
    """The folded surname: before a comma, else the last word."""
    n = F.trim(text_or_empty(name))
    return fold_joined(F.when(F.contains(n, F.lit(",")), F.split_part(n, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(n, r"(?U)\s+"), -1)))


def translator_list(s: Column) -> Column:
    """Names between semicolons or "und", each turned round, joined again."""
    return F.array_join(F.filter(F.transform(F.split(text_or_empty(s), r";|\s+und\s+"), lambda x: person(x)), lambda x: x != ""), "; ")


def plausibly_english(t: Column) -> Column:
    """At least three ASCII letters, and no letter, word or ending that marks Polish or German."""
    # What English titles never have.
    foreign = (
        r"(?iuU)[ąćęłńśźżäöüß]"
        r"|\b(?:w|z|ze|na|się|nie|dla|pod|nad|jak|czy|od|za|po|oraz|der|das|und|mit|ein|eine)\b"
        r"|\b\w*(?:rz|cz|szcz|cja|cje|ości|nych|owie)\b"
    )
    s = text_or_empty(t)
    return ~s.rlike(foreign) & (F.regexp_count(s, F.lit("[A-Za-z]")) >= 3)


def clean_shop_title(t: Column) -> Column:
    """Cut before "erschienen bei", "Published by" or ©, quotes stripped, white space squeezed, ``. , ;`` trimmed at the end."""
    cut = F.regexp_replace(text_or_empty(t), f"(?iuUs){IMPRINT}.*$", "")
    return F.rtrim(F.btrim(squeeze(cut), F.lit(QUOTES + " ")), F.lit(" .,;"))


def shop_series(title: Column, tags: Column) -> Column:
    """"X Band n" from the title, else the tag that starts with "reihe:", else empty."""
    found = F.regexp_extract(text_or_empty(title), r"(?iu)^(.*?)\s+(?:Band|Bd\.|Nr\.)\s*([0-9]+)", 1)
    number = F.regexp_extract(text_or_empty(title), r"(?iu)^(.*?)\s+(?:Band|Bd\.|Nr\.)\s*([0-9]+)", 2)
    tag = F.try_element_at(F.filter(tags, lambda x: F.startswith(F.lower(x), F.lit("reihe:"))), F.lit(1))
    return F.when(number != "", F.concat_ws(" ", F.trim(found), number)).otherwise(F.coalesce(F.trim(F.substr(tag, F.lit(7))), F.lit("")))


def product_tags(tags: Column) -> Column:
    """Tags as an array, without blanks: from a comma list, or from a JSON list of strings."""
    text = F.trim(text_or_empty(tags))
    listed = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.split(text, ",")), lambda x: F.trim(x)), lambda x: x != "")


def is_name_tag(tag: Column) -> Column:
    """Two to four capitalised words, none of them a series or genre."""
    shape = tag.rlike(r"^(?U)[A-ZÄÖÜ][\w'’.\-]+(?: [A-ZÄÖÜ][\w'’.\-]+){1,3}$")
    return shape & ~F.arrays_overlap(F.split(tag, " "), F.array(*map(F.lit, NO_NAMES)))


def split_series(s: Column) -> Column:
    """(name, number) of the first part between semicolons that ends in a number; nulls if there is none."""
    pattern = r"(?iu)^(.*?)[\s,.;:]*(?:n°|nr\.?|no\.?|band|bd\.?|vol\.?|t\.)?\s*([0-9]{1,5})\s*$"
    parts = F.transform(F.split(text_or_empty(s), ";"), lambda p: F.struct(F.trim(F.regexp_extract(F.trim(p), pattern, 1)).alias("name"), F.regexp_extract(F.trim(p), pattern, 2).alias("number")))
    first = F.try_element_at(F.filter(parts, lambda p: (p["name"] != "") & (p["number"] != "")), F.lit(1))
    return F.struct(fold_or_null(first["name"]).alias("name"), first["number"].cast("int").alias("number"))


def fold_or_null(s: Column) -> Column:
    return F.when(s.isNotNull(), fold(s))


def memberships(line: Column, number: Column, all_lines: Column) -> Column:
    """Distinct (line, number) pairs of "Line #n; ..." and of the book's own line and number."""
    pattern = r"([^;#]+?)\s*#\s*([0-9]+)"
    pair = lambda name, n: F.struct(F.trim(name).alias("line"), n.cast("int").alias("number"))
    listed = F.zip_with(F.regexp_extract_all(text_or_empty(all_lines), F.lit(pattern), F.lit(1)), F.regexp_extract_all(text_or_empty(all_lines), F.lit(pattern), F.lit(2)), pair)
    whole = F.split_part(text_or_empty(number), F.lit("."), F.lit(1))
    own = F.when((text_or_empty(line) != "") & whole.rlike("^[0-9]+$"), F.array(pair(line, whole))).otherwise(F.slice(listed, 1, 0))
    return F.array_union(listed, own)


def collection(s: Column) -> Column:
    """A series statement without "= ...", brackets, trailing numbers, volume labels and punctuation; blank: "(none)"."""
    t = F.regexp_replace(F.split_part(text_or_empty(s), F.lit("="), F.lit(1)), r"\[[^\]]*\]", "")
    t = F.regexp_replace(t, r"\s*[:;,]\s*(?=[:;,])", "")
    t = F.regexp_replace(t, r"(?U)[\s.,;:#-]*\d+[\s\w/()-]*$", "")
    t = F.regexp_replace(t, r"(?iuU)[\s.,;:]*\b(nr|no|n°|bd|band|vol|t)\.?\s*$", "")
    t = F.btrim(squeeze(F.regexp_replace(t, r"\s*[:;,.]\s*$", "")), F.lit(" .,;:"))
    return F.when(t == "", F.lit("(none)")).otherwise(t)


def without_number(s: Column) -> Column:
    """A series name without its trailing number."""
    return F.regexp_replace(text_or_empty(s), r"[\s,;:#]*[0-9]+\s*$", "")


def without_year(s: Column) -> Column:
    """A title without its trailing year."""
    return F.regexp_replace(text_or_empty(s), r",?\s*(19|20)[0-9]{2}\s*$", "")


def publisher_family(p: Column) -> Column:
    n, out = F.lower(text_or_empty(p)), None
    for fragment, family in FAMILIES:
        test = F.contains(n, F.lit(fragment))
        out = F.when(test, family) if out is None else out.when(test, family)
    return out.when(n.isin("", "nan"), "unknown").otherwise(F.initcap(F.trim(n)))


def month_year(s: Column) -> Column:
    """"Mar 1983", "March 1983" or "1983" as a date, else null."""
    t = F.trim(text_or_empty(s))
    return F.coalesce(F.try_to_date(t, "MMM yyyy"), F.try_to_date(t, "MMMM yyyy"), F.try_to_date(t, "yyyy"))


def decade(year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit(0)) > 0, F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))).otherwise("unknown")


def letters(i: Column) -> Column:
    """0 -> a, 25 -> z, 26 -> aa, 701 -> zz, 702 -> aaa (bijective base 26, up to three letters)."""
    n = i.cast("long")
    letter = lambda x: F.char(F.lit(97) + F.pmod(x, F.lit(26)))
    two, three = n - 26, n - 702
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )


def price(s: Column) -> Column:
    """A decimal number from "3,99 €"; null if it cannot be read."""
    return F.regexp_replace(F.replace(text_or_empty(s), F.lit(","), F.lit(".")), r"[€$\s]", "").try_cast("double")


def price_or_text(s: Column) -> Column:
    """A price as a number's text; what cannot be read stays as it is."""
    return F.coalesce(price(s).cast("string"), F.trim(text_or_empty(s)))


def unwrapped(s: Column) -> Column:
    """``<The> Title`` without the angle brackets."""
    return F.regexp_replace(text_or_empty(s), "<([^>]*)>", "$1")


def rotated_name(s: Column) -> Column:
    """"Last F." -> "F. Last"; other names as they are."""
    words = F.split(squeeze(s), " ")
    return F.when(F.element_at(words, -1).rlike(r"\.$") & (F.size(words) > 1), F.concat_ws(" ", F.element_at(words, -1), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "))).otherwise(squeeze(s))


def first_word_last(s: Column) -> Column:
    """A name with its first word moved to the end ("Last F." -> "F. Last"); one word, or none, as it is."""
    words = F.split(squeeze(s), " ")
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.array_join(F.slice(words, 2, F.size(words)), " "), F.element_at(words, 1))).otherwise(text_or_empty(s))


def distance_bucket(span: Column) -> Column:
    return F.when(span <= 10, "<=10").when(span <= 40, "11-40").otherwise(">40")


def furthest_stage(*steps: tuple[str, Column], start: str = "To do") -> Column:
    """The label of the last step that is not blank, in the given order."""
    return F.coalesce(*(F.when(F.trim(text_or_empty(c)) != "", F.lit(label)) for label, c in reversed(steps)), F.lit(start))


def surname_in(author: Column, statement: Column) -> Column:
    """Whether the folded last word of the author is in the folded statement; a missing statement passes."""
    return statement.isNull() | F.contains(fold(statement), F.element_at(F.split(fold(author), " "), -1))


def language_name(letter: Column) -> Column:
    return F.coalesce(*(F.when(letter == k, F.lit(v)) for k, v in LANGUAGES.items()), letter)


def with_holder(authors: Column, holder: Column, house: str) -> Column:
    """The author list with the copyright holder (without its year), unless it names the house or is there already."""
    name = F.trim(F.regexp_replace(text_or_empty(holder), "^(19|20)[0-9]{2}", ""))
    fits = (name != "") & ~F.contains(F.lower(name), F.lit(house.lower())) & ~F.array_contains(F.transform(authors, fold), fold(name))
    return F.when(fits, F.array_append(authors, name)).otherwise(authors)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns), F.lit(""))


def ordered_unique(values: Column, order: Column, separator: str = "; ") -> Column:
    """Aggregate: values in their order, each once, blanks left out, joined."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(values, F.lit("")) != "", F.struct(order.alias("o"), values.alias("v")))))
    return F.array_join(F.array_distinct(F.transform(rows, lambda x: x["v"])), separator)


def english_names(text: Column, common: Column) -> Column:
    """Capitalised words of at least three letters that are not ``common`` (an array of lower-case words), folded, once each."""
    word = r"^[A-ZÄÖÜ][a-zäöüßéèáàíóúñç'’]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?$"
    words = F.transform(F.split(text_or_empty(text), r"(?U)\s+"), lambda w: F.btrim(w, F.lit("\"'“”‘’()[],.;:!?…—–-*")))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(word) & (F.length(w) >= 3) & ~F.array_contains(common, F.lower(w))), fold_joined))


def german_tokens(text: Column, common: Column) -> Column:
    """Capitalised words of at least three letters that are not in ``common`` (case-sensitive), folded, once each."""
    word = r"\b[A-ZÄÖÜ](?U)[a-zäöüßéèáàíóúñç'’]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?\b"
    found = F.filter(F.regexp_extract_all(text_or_empty(text), F.lit(f"(?U){word}"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(common, w))
    return F.array_distinct(F.transform(found, fold_joined))
