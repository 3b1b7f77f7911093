"""Rows and details from list, book and product pages, with the standard library's parser behind Arrow functions.

Which element a row is depends on the tree around its link, and a story's block on the lines around its label; neither
has a built-in form. A page is parsed once in each function; malformed pages give what was read, or empty results.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from marginalia.functions import text as T
from marginalia.operators.ordered import first_per_key

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split())
# Forms of links, dates, ratings and labels on the pages.
BOOK_LINK, AUTHOR_LINK, SERIES_LINK = r"/book/(?:[^\"']*~(\d+)\.htm|(\d+)(?![^\"']*~))", r"/author/(?:[^\"']*~(\d+)\.htm|(\d+)(?![^\"']*~))", r"/series/[^\"']*~\d+\.htm"
DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?\d{4}\b|\b\d{4}-\d{2}(?:-\d{2})?\b"
YEAR_ALONE, RATING, NUMBER = r"(?<![\d.#])((?:19|20)\d\d)(?![\d.])", r"(?<![\d.])([0-5]\.\d{1,2})(?![\d.])", r"#?(\d+(?:\.\d+)?)"
ORIGINAL, TRANSLATION = r"Originaltitel\s*:\s*(.+)", r"Übersetzung\s*:\s*(.+)"
COPYRIGHT = r"©\s*((?:19|20)\d\d)\s*(?:by\s+)?(.+)"
ORIGINAL_SERIES, FIRST_EDITION = r"in der Reihe\s*:?\s*([A-Z][A-Z0-9 &'’.\-]{2,})", r"Deutsche Erstausgabe\s+(?:in der Reihe\s*:?\s*)?(.+?)(?:\s+by\b|$)"
VOLUME = r"Band\s+(\d+)[^|]*?((?:19|20)\d\d)"
PUBLISHED, ISBN = r"(?:Erscheinungs(?:tag|termin|datum)|Erscheint am|Veröffentlicht)\s*:?\s*(\d{1,2}\.\d{1,2}\.\d{4})", r"\b(97[89]\d{10})\b"


class Node:
    """An element: name, attributes, children (elements and texts) and parent."""

    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent, self.children = name, attributes, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.children))

    def take_apart(self) -> None:
        """Cut the links between the elements below, which point at each other: the page's memory is free at once, not
        when the collector next looks for circles."""
        for node in [n for n in self.walk() if isinstance(n, Node)]:
            node.parent, node.children = None, []

    def text(self, separator: str = " ") -> str:
        return separator.join(t for n in self.walk() if isinstance(n, str) and (t := n.strip()))

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if isinstance(n, Node) and n is not self and n.name in names), None)

    def links(self, pattern: re.Pattern) -> list[Node]:
        return [n for n in self.walk() if isinstance(n, Node) and n.name == "a" and pattern.search(n.attributes.get("href", ""))]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.silent += 1
            return
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.silent = max(0, self.silent - 1)
            return
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if not self.silent:
            self.at.children.append(data)


def tree(source: str | None) -> Node:
    parser = _Tree()
    parser.feed(source or "")
    parser.close()
    return parser.root


def lines_of(source: str | None) -> list[str]:
    """The texts of a page, cut at blocks, line ends and ``|``."""
    parts, root = [], tree(source)
    for node in root.walk():
        parts.append(node if isinstance(node, str) else "\n" if node.name in BLOCKS else "")
    root.take_apart()
    return [line for raw in re.split(r"[\n|]", "".join(parts)) if (line := " ".join(raw.split()))]


_STRINGS = lambda *names: StructType([StructField(n, StringType()) for n in names])
ROW = _STRINGS("book_id", "title", "authors", "author_ids", "series_number", "pub_date", "rating", "book_url", "author_urls")
_BOOK, _AUTHOR, _SERIES = re.compile(BOOK_LINK), re.compile(AUTHOR_LINK), re.compile(SERIES_LINK)


def _id(pattern: re.Pattern, node: Node) -> str:
    return next((g for g in pattern.search(node.attributes["href"]).groups() if g), "")


def _book_counts(root: Node) -> dict[int, set[str]]:
    """For each element that holds book links: at most two of their ids, found by climbing from the links."""
    held: dict[int, set[str]] = {}
    for link in root.links(_BOOK):
        number, node = _id(_BOOK, link), link
        while node is not None and (own := held.setdefault(id(node), set())) is not None and len(own) < 2 and number not in own:
            own.add(number)
            node = node.parent
    return held


def _row_of(link: Node, held: dict[int, set[str]]) -> Node | None:
    """The largest element around a link, below the body, that holds no other book."""
    node, row = link.parent, None
    while node is not None and node.name not in ("", "html", "body") and len(held[id(node)]) == 1:
        node, row = node.parent, node
    return row


def _matched(pattern: str, text: str) -> str:
    found = re.search(pattern, text)
    return found[found.re.groups] if found else ""


def _row_date(row: Node, text: str, title: str) -> tuple[str, str]:
    """(date, what follows it): a written date, a time element, or a lone year after the title; a rating stands after a
    written date only."""
    if written := re.search(DATE, text):
        return written[0], text[written.end() :]
    if stamp := row.first("time"):
        if value := stamp.attributes.get("datetime") or stamp.text(""):
            return value, ""
    return _matched(YEAR_ALONE, text.split(title, 1)[-1]), ""


def _rows(source: str | None) -> list[dict]:
    root, out = tree(source), {}
    held = _book_counts(root)
    for link in root.links(_BOOK):
        number = _id(_BOOK, link)
        row = None if number in out else _row_of(link, held)
        authors = {_id(_AUTHOR, a): a for a in reversed(row.links(_AUTHOR))} if row else {}  # the first link of each
        if not authors:
            continue
        people, text, cell = list(authors.items())[::-1], row.text(), row if row.name in ("td", "th") else row.first("td", "th")
        places = [*([cell.text("")] if cell else []), text.split(" ")[0]]
        date, after = _row_date(row, text, link.text())
        out[number] = {
            "book_id": number, "title": link.text(""), "authors": "; ".join(a.text("") for _, a in people), "author_ids": "; ".join(k for k, _ in people),
            "series_number": next((m[1] for p in places if (m := re.fullmatch(NUMBER, p))), ""), "pub_date": " ".join(date.split()), "rating": _matched(RATING, after),
            "book_url": link.attributes["href"], "author_urls": "; ".join(a.attributes["href"] for _, a in people),
        }
    return list(out.values())


@F.pandas_udf(ArrayType(ROW))
def list_rows(pages: pd.Series) -> pd.Series:
    """The books of a list page: one row for each distinct book link with an author link beside it."""
    return pages.map(_rows)


def total_pages(page: Column) -> Column:
    """n of "Page x of n"; 1 if there is none."""
    return F.coalesce(F.regexp_extract(page, r"(?i)Page\s+[0-9]+\s+of\s+([0-9]+)", 1).try_cast("int"), F.lit(1))


def of_series(page: Column, expected: Column) -> Column:
    """The heading guard: whether title and first-level headings hold the expected word; an empty one passes."""
    headings = F.regexp_extract_all(T.text_or_empty(page), F.lit(r"(?is)<(?:title|h1)\b[^>]*>(.*?)</(?:title|h1)>"), F.lit(1))
    text = T.squeeze(F.lower(F.regexp_replace(F.array_join(headings, " "), "<[^>]*>", " ")))
    return (expected == "") | F.contains(text, F.lower(expected))


def page_url(series_url: Column, n: Column) -> Column:
    """The address of the n-th page of a list."""
    return F.when(n == 1, series_url).otherwise(F.replace(series_url, F.lit(".htm"), F.concat(F.lit("~"), n.cast("string"), F.lit(".htm"))))


def series_books(series: DataFrame, pages: DataFrame, *, base: str = "") -> DataFrame:
    """The books of list pages that were landed, once for each line, page by page.

    ``series`` has (line, url, expected); ``pages`` (url, content). Lines whose first page fails the heading guard are
    left out; the number of pages is that of the first page. Relative links get ``base``.
    """
    stored = pages.select(F.col("url").alias("_url"), "content")
    head = series.join(stored, series["url"] == stored["_url"]).filter(of_series(F.col("content"), F.coalesce("expected", F.lit(""))))
    each = head.select("line", "url", F.explode(F.sequence(F.lit(1), total_pages(F.col("content")))).alias("page"))
    wanted = each.withColumn("_at", page_url(F.col("url"), F.col("page")))
    rows = wanted.join(stored, wanted["_at"] == stored["_url"]).select("line", "page", F.posexplode(list_rows("content")).alias("place", "r")).select("line", "page", "place", "r.*")
    whole = lambda c: F.when(F.startswith(c, F.lit("/")), F.concat(F.lit(base), c)).otherwise(c)
    rows = rows.withColumn("book_url", whole(F.col("book_url"))).withColumn("author_urls", F.array_join(F.transform(F.split("author_urls", "; "), whole), "; "))
    return first_per_key(rows, ["line", "book_id"], ["page", "place"])


BOOK = _STRINGS("isbn13", "isbn10", "publisher", "format", "pages", "rating_detail", "published_detail", "main_genre", "subgenres", "other_series", "cover_url", "description")
# Headings of a book's page, and what ends the parts below them.
DETAILS, DETAIL_ENDS, DETAIL_LABELS = "Book Details", {"Continue the Series", "Track This Book"}, ("Published", "Main Genre", "Pages", "Rating")
EDITIONS, EDITION_ENDS, ABOUT, ABOUT_ENDS = "Formats & Editions", {"Manage Tags", "Close"}, "About This Book", {"Series Placement", "Genres & Themes"}
EDITION = r"(Mass Market Paperback|Paperback|Trade Paperback|Hardcover|eBook|Audiobook)\s+[A-Z][a-z]{2} \d{4}\s+(.+?)\s+ISBN13\s+\d{13}(?:\s+ISBN10\s+([\dX]{10}))?"


def _texts(root: Node) -> list[str]:
    """The texts of a page, line by line."""
    return [line for n in root.walk() if isinstance(n, str) for line in (x.strip() for x in n.split("\n")) if line]


def _below(lines: list[str], heading: str, ends: set[str]) -> list[str]:
    """The lines after a heading, up to one that ends its part."""
    if heading not in lines:
        return []
    rest = lines[lines.index(heading) + 1 :]
    return rest[: next((i for i, line in enumerate(rest) if line in ends), len(rest))]


def _labelled(details: list[str]) -> dict[str, str]:
    """The value of each label: the next line, else the rest of a line that starts with it."""
    after = {line: value for line, value in reversed(list(zip(details, details[1:], strict=False))) if line in DETAIL_LABELS}
    joined = {label: line[len(label) + 1 :] for label in DETAIL_LABELS for line in reversed(details) if line.startswith(f"{label} ")}
    return joined | after


def _genres(nodes: list) -> list[str]:
    """Links to genres between the heading "Subgenres" and the next one."""
    heads = [i for i, n in enumerate(nodes) if isinstance(n, Node) and n.name in ("h2", "h3", "h4")]
    start = next((i for i in heads if nodes[i].text("") == "Subgenres"), None)
    if start is None:
        return []
    end = next((i for i in heads if i > start), len(nodes))
    return [n.text("") for n in nodes[start:end] if isinstance(n, Node) and n.name == "a" and "/genre/" in n.attributes.get("href", "")]


def _other_series(nodes: list) -> list[str]:
    """"Name #n" for links to series that a text "Book n" follows."""
    out, number = [], ""
    for n in reversed(nodes):  # the next "Book n" after each link
        if isinstance(n, str):
            number = _matched(r"Book\s+([\d.]+)", n) or number
        elif n.name == "a" and number and _SERIES.search(n.attributes.get("href", "")):
            own = next((m for t in n.walk() if isinstance(t, str) and (m := _matched(r"Book\s+([\d.]+)", t))), number)
            out.append(f"{n.text('')} #{own}")
    return out[::-1]


def _rating(said: str, nodes: list, source: str) -> str:
    if found := re.match(r"\s*([0-5](?:\.\d{1,2})?)\b", said):
        return found[1]
    tag = next((n for n in nodes if isinstance(n, Node) and n.attributes.get("itemprop") == "ratingValue"), None)
    return (tag.attributes.get("content") or tag.text("")).strip() if tag and (tag.attributes.get("content") or tag.text("")) else _matched(r'"ratingValue"\s*:\s*"?([0-5](?:\.\d+)?)', source)


def _book(source: str | None) -> dict:
    root = tree(source)
    nodes, lines = list(root.walk()), _texts(root)
    said = _labelled(_below(lines, DETAILS, DETAIL_ENDS))
    meta: dict[str, str] = {}
    for kind in ("name", "property"):  # of both, the property counts
        for n in reversed(nodes):
            if isinstance(n, Node) and n.name == "meta" and kind in n.attributes and n.attributes.get("content"):
                meta[n.attributes[kind]] = n.attributes["content"].strip()
    edition = re.search(EDITION, " ".join(_below(lines, EDITIONS, EDITION_ENDS)))
    pages = said.get("Pages", "")
    return {
        "isbn13": meta.get("book:isbn") or meta.get("og:isbn", ""), "isbn10": (edition and edition[3]) or "", "publisher": edition[2].strip() if edition else "", "format": edition[1] if edition else "",
        "pages": pages if pages.isdigit() else "", "rating_detail": _rating(said.get("Rating", ""), nodes, source or ""), "published_detail": said.get("Published", ""), "main_genre": said.get("Main Genre", ""),
        "subgenres": "; ".join(dict.fromkeys(_genres(nodes))), "other_series": "; ".join(dict.fromkeys(_other_series(nodes))), "cover_url": meta.get("og:image", ""),
        "description": " ".join(_below(lines, ABOUT, ABOUT_ENDS)) or meta.get("og:description", ""),
    }


@F.pandas_udf(BOOK)
def book_details(pages: pd.Series) -> pd.DataFrame:
    """The labelled values of a book's page; empty where there is none."""
    return pd.DataFrame([_book(p) for p in pages], columns=BOOK.names)


STORY = _STRINGS("original_title", "translators", "copyright", "original_series", "first_edition", "first_edition_year")


#: Lines before a title in which its copyright may stand; lines of a story after its title, where no other title follows.
BEFORE, AFTER = 3, 25


class _Story:
    """What the lines of a story tell, one after another; the first line is that of its original title."""

    def __init__(self, line: str):
        title, *said = re.split(TRANSLATION.replace("(.+)", ""), re.search(ORIGINAL, line, re.I)[1], maxsplit=1, flags=re.I)
        self.title, self.translators, self.series, self.lines = title, said[0].strip() if said else "", "", [line]

    def add(self, line: str) -> None:
        self.lines.append(line)
        self.translators = self.translators or _found(TRANSLATION, line, re.I)
        if not self.series and "Erstausgabe" not in line:
            self.series = _found(ORIGINAL_SERIES, line).strip().title()

    def edition(self) -> tuple[str, str]:
        """The first edition, with its volume, and the volume's year."""
        whole = " | ".join(self.lines)
        found = re.search(FIRST_EDITION, whole, re.I)
        if not found:
            return "", ""
        name, volume = found[1].split("|")[0].strip().strip(" :").title(), re.search(VOLUME, whole[found.start() :], re.I)
        return (f"{name} {volume[1]}".strip(), volume[2]) if volume else (name, "")

    def row(self, copyright_: str) -> dict | None:
        title = " ".join(re.split(T.IMPRINT, self.title, maxsplit=1, flags=re.I)[0].strip().strip(T.QUOTES + "”’").split()).rstrip(" .,;")
        translators = re.split(r"\s+©|\s+Originaltitel|\s*\|", self.translators)[0].strip().rstrip(".")
        return dict(zip(STORY.names, (title, translators, copyright_, self.series, *self.edition()), strict=True)) if title else None


def _found(pattern: str, line: str, flags: int = 0) -> str:
    found = re.search(pattern, line, flags)
    return found[1] if found else ""


def _stories(source: str | None) -> list[dict]:
    """One pass over the lines: each is a title, which opens a story, or belongs to the open one; the copyright that was
    read last, at most BEFORE lines ahead of a title or in its line, holds for it and for those after it."""
    stories: list[tuple[_Story, str]] = []
    holder, recent = "", []
    for line in lines_of(source):
        recent = [*recent[-BEFORE:], line]
        if re.search(ORIGINAL, line, re.I):
            for near in recent:
                if found := re.search(COPYRIGHT, near, re.I):
                    holder = f"{found[1]} {found[2].strip()}"
            stories.append((_Story(line), holder))
        elif stories:
            stories[-1][0].add(line)
    if stories:  # a story that another one follows ends there; only the last one is bounded
        last = stories[-1][0]
        stories[-1] = (_limited(last.lines[:AFTER]), stories[-1][1])
    return [row for story, held in stories if (row := story.row(held))]


def _limited(lines: list[str]) -> _Story:
    story = _Story(lines[0])
    for line in lines[1:]:
        story.add(line)
    return story


@F.pandas_udf(ArrayType(STORY))
def product_stories(pages: pd.Series) -> pd.Series:
    """The stories of a product page, a block of lines for each original title; the copyright line carries on."""
    return pages.map(_stories)


@F.pandas_udf(StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else " ".join(lines_of(p)))


def product_info(page: Column) -> Column:
    """(pub_date, isbn) of a product page."""
    text = visible_text(page)
    return F.struct(F.regexp_extract(text, f"(?iu){PUBLISHED}", 1).alias("pub_date"), F.regexp_extract(text, ISBN, 1).alias("isbn"))


def meta_content(page: Column, name: str) -> Column:
    """The content of a meta element by property or name, whatever the order of its attributes; empty if there is none."""
    elements = F.regexp_extract_all(T.text_or_empty(page), F.lit(r"(?is)<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    named = F.filter(elements, lambda e: e.rlike(rf"(?i)\s(?:property|name)\s*=\s*[\"']{name}[\"']"))
    value = lambda e: F.coalesce(F.nullif(F.regexp_extract(e, r"(?is)\scontent\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(e, r"(?is)\scontent\s*=\s*'([^']*)'", 1))
    return F.coalesce(value(F.get(named, F.lit(0))), F.lit(""))


def blurb(body: Column, page: Column) -> Column:
    """The text of the product's description, else of the page's meta description; at most 4,000 characters."""
    text = F.coalesce(F.nullif(T.squeeze(visible_text(F.coalesce(body, F.lit("")))), F.lit("")), F.nullif(meta_content(page, "og:description"), F.lit("")), meta_content(page, "description"), F.lit(""))
    return F.substring(T.squeeze(text), 1, 4000)


def products(pages: DataFrame, column: str = "json", *, page: str | None = None) -> DataFrame:
    """A row for each product of landed list pages; pages that are no JSON give none.

    With ``page``, the number of a page, the list ends at its first page that is missing, empty or no JSON. ``tags``
    may be a text or a list; a list stays JSON, which ``text.product_tags`` reads.
    """
    schema = "products array<struct<handle:string,title:string,vendor:string,product_type:string,tags:string,body_html:string,published_at:string>>"
    rows = pages.withColumn("_p", F.coalesce(F.from_json(F.col(column), schema)["products"], F.lit(None)))
    if page is not None:
        # pages are numbered from 1: all before the first gap have as many full pages before them as their number says
        full = rows.filter(F.size("_p") > 0)
        whole = full.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(page)))  # one row for each page of 250 products
        rows = whole.filter(F.col("_n") == F.col(page)).drop("_n")
    return rows.select(F.explode("_p").alias("p")).select("p.*")


SEGMENT = _STRINGS("title", "author", "text")
# A title in capitals before "von AUTHOR"; a title in capitals before ordinary text.
BY_AUTHOR = re.compile(r"([A-ZÄÖÜ0-9][A-ZÄÖÜß0-9 ,.!?’'&:–\-…]{5,})\s+von\s+([A-ZÄÖÜ][A-ZÄÖÜ.'’\-]+(?:,?\s+[A-ZÄÖÜ][A-ZÄÖÜ.'’\-]+){1,3})(?=\s)")
IN_CAPITALS = re.compile(r"(?:^|(?<=\s))((?:[A-ZÄÖÜ0-9][A-ZÄÖÜß0-9’'!?.,:–\-…]*\s+){2,}[A-ZÄÖÜ0-9][A-ZÄÖÜß0-9’'!?.,:–\-…]*)(?=\s+[\"„“»(]?[A-ZÄÖÜ][a-zäöüß])")


def _segments(text: str | None) -> list[dict]:
    """Stories start where a title stands: one before "von AUTHOR", or else, if there are several, one in capitals."""
    text = text or ""
    starts = [(m.start(), m.end(), m[1].strip(), m[2]) for m in BY_AUTHOR.finditer(text)]
    if not starts:
        capitals = [(m.start(), m.end(), m[1].strip(), "") for m in IN_CAPITALS.finditer(text)]
        starts = capitals if len(capitals) > 1 else [(0, 0, "", "")]
    stops = [*(s[0] for s in starts[1:]), len(text)]
    return [{"title": title, "author": author, "text": text[begin:stop]} for (_, begin, title, author), stop in zip(starts, stops, strict=True)]


@F.pandas_udf(ArrayType(SEGMENT))
def _segment_cells(texts: pd.Series) -> pd.Series:
    return texts.map(_segments)


def segments(products: DataFrame, blurb_column: str = "blurb", authors: str = "authors") -> DataFrame:
    """A row for each story of a blurb: (title, akey, text) beside the product's columns. Without an author of its own, a
    story has the product's if that is only one."""
    listed = F.filter(F.transform(F.split(T.text_or_empty(F.col(authors)), ";"), lambda a: F.trim(a)), lambda a: a != "")
    rows = products.withColumn("_s", F.explode(_segment_cells(F.col(blurb_column))))
    alone = F.when(F.size(listed) == 1, F.element_at(listed, 1)).otherwise("")
    return rows.withColumns({"segment_title": F.col("_s.title"), "akey": T.author_key(T.first_filled(F.col("_s.author"), alone)), "segment_text": F.col("_s.text")}).drop("_s")


def with_details(rows: DataFrame, details: DataFrame, key: str = "book_id", filled: tuple[str, ...] = ("rating", "pub_date")) -> DataFrame:
    """List rows with their details: ``filled`` columns only where blank, other columns replaced."""
    d = details.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in details.columns if c != key))
    out = rows.join(d, rows[key] == d["_k"], "left").drop("_k")
    names = [c for c in details.columns if c != key]
    cols = [T.first_filled(F.col(c), F.col(f"_{c}")).alias(c) if c in filled and c in rows.columns else F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in names and c in rows.columns else F.col(c) for c in rows.columns]
    return out.select(*cols, *(F.col(f"_{c}").alias(c) for c in names if c not in rows.columns))
