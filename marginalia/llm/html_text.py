"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative; words inside boilerplate, inside links, or
outside content that the page declares have scores of their own. The weights are log-odds learned from labelled pages:
those whose markup declares their content in exactly one ``article`` or ``main`` element, so that each token is known to
lie inside or outside. One linear scan (Kadane) finds the contiguous region with the largest sum. Its text, without
boilerplate parts, is the main text; as these parts are left out anyway, they cost little, and an advert inside an
article does not cut it short.

What is boilerplate is learned too, for each class and id, role and structural tag: how many words below it lie inside and
outside declared content. A name that labelled pages use inside is content, whatever it is called. Names start from a
prior that counts like PRIOR words outside: for structural tags and roles, and for a class or id whose head word (the
last part that is no general word for a box) is a usual name of boilerplate. So the prior decides only about names that
the labelled pages do not know.

The scanner takes time in proportion to the page, also on broken markup.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.cluster import ship, then_give_back

#: The bound of the labelled sample, in pages; the words that a prior counts for, and that a name needs to be judged;
#: names with log-odds below LIMIT are boilerplate.
LABELLED_PAGES, PRIOR, JUDGED, LIMIT = 500, 30, 20, -0.7
# Kinds of elements.
#: Their content is no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select datalist map".split())
#: What these hold ends at their end tag, whatever stands in it.
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
STRUCTURAL = frozenset("nav footer aside form button menu dialog fieldset label input header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out before another of their kind.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
#: Usual head words of names of boilerplate, and general words for boxes, which are no heads.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist respond responses replies reply disqus discussion pagination pager skip outbrain taboola paywall widget buttons".split()
)
BOXES = frozenset("box container wrapper wrap block area section list item inner outer module unit slot bar panel holder row col column group content body zone region top bottom left right main primary secondary".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\S+")
#: Classes of words; tags are features by name, names of elements start with one of ``.@<``.
WORD, LINKED, NAMED, BEYOND = "#word", "#linked", "#named", "#beyond"
DEFAULTS = {WORD: 1.0, LINKED: -0.5, NAMED: -0.1, BEYOND: -1.0, "": -0.5, "p": -0.1, "br": -0.05} | dict.fromkeys(INLINE, -0.02)


def prior(name: str) -> bool:
    """Whether an element's name stands for boilerplate, as long as nothing is known about it."""
    if name[0] != ".":
        return True  # structural tags and roles have names only where they do
    parts = [x for x in _PARTS.findall(name) if not x.isdigit()]
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    return bool(parts) and parts[-1] in BOILERPLATE


def _scan(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of each part: kind is "text", "start" or "end". Comments and the like are left out.

    A tag ends at the first ``>`` outside quotes. Once a quote is open up to the end of the page, quotes count no more,
    so no part of a page is read twice.
    """
    at, end, quoted = 0, len(source), True
    while at < end:
        opening = source.find("<", at)
        if opening < 0:
            yield "text", source[at:], ""
            return
        if opening > at:
            yield "text", source[at:opening], ""
        at = opening
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            at = end if close < 0 else close + 3
            continue
        if source.startswith("<![CDATA[", at):
            close = source.find("]]>", at)
            yield "text", source[at + 9 : end if close < 0 else close], ""
            at = end if close < 0 else close + 3
            continue
        if source[at + 1 : at + 2] in ("!", "?"):
            close = source.find(">", at)
            at = end if close < 0 else close + 1
            continue
        name = _NAME.match(source, at + 1)
        stop = _tag_end(source, name.end(), quoted) if name else -1
        if name and stop < 0 and quoted:
            quoted = False
            stop = _tag_end(source, name.end(), quoted)
        if stop < 0:
            yield "text", "<", ""
            at += 1
            if name:  # no tag ends any more
                yield "text", source[at:].replace("<", " <"), ""
                return
            continue
        ending = name.group()[0] == "/"
        yield "end" if ending else "start", name.group()[ending:].lower(), source[name.end() : stop]
        at = stop + 1
        if not ending and name.group().lower() in RAW:
            close = re.compile(rf"</{re.escape(name.group())}\s*>", re.IGNORECASE).search(source, at)
            body = close.start() if close else end
            if body > at:
                yield "text", source[at:body], ""
            at = body


def _tag_end(source: str, at: int, quoted: bool) -> int:
    """Where the ``>`` of a tag stands; -1 if there is none."""
    if not quoted:
        return source.find(">", at)
    while found := _STOPS.search(source, at):
        if found.group() == ">":
            return found.start()
        close = source.find(found.group(), found.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


class _Element:
    __slots__ = ("closed", "content", "linked", "name", "named", "names", "silent")

    def __init__(self, name: str, names: list[str], named: bool, silent: bool):
        self.name, self.names, self.named, self.silent = name, names, named, silent
        self.linked, self.content, self.closed = name == "a", name in ("article", "main"), False


class _Page:
    """Tokens of a page: (feature, number of words, text or None for a tag, inside declared content).

    ``named`` tells which names of elements are boilerplate; ``below``, if wanted, counts words inside and outside
    declared content below each name.
    """

    def __init__(self, source: str, named, below: tuple[Counter, Counter] | None = None):
        self.tokens: list[tuple[str, int, str | None, bool]] = []
        self.declared = 0
        self._open: list[_Element] = []  # all that are open, and closed ones below them
        self._blocks: list[_Element] = []  # those that are not inline
        self._by_name: dict[str, list[_Element]] = {}
        self._named = self._silent = self._linked = self._content = 0
        self._judge, self._active = named, Counter()
        for kind, text, attributes in _scan(source):
            if kind == "text":
                if not self._silent:
                    words = len(_WORD.findall(text))
                    self.tokens.append((NAMED if self._named else LINKED if self._linked else WORD, words, text, bool(self._content)))
                    if below and words:
                        for name in self._active:
                            below[not self._content][name] += words
            elif kind == "end":
                inside = bool(self._content) or text in ("article", "main")
                if self._by_name.get(text):
                    self._close(self._by_name[text][-1])
                self.tokens.append((text, 0, None, inside))
            else:
                self._start(text, attributes)

    def _start(self, name: str, attributes: str) -> None:
        is_content = name in ("article", "main")
        self.tokens.append((name, 0, None, bool(self._content) or is_content))
        self.declared += is_content and not self._content
        if name in VOID:
            return
        if name in OPEN_ENDED:
            above = next((b for b in reversed(self._blocks[-2:]) if b.name == name or b.name != "p"), None)
            if above is not None and above.name == name:
                self._close(above)
        if attributes.rstrip().endswith("/") and name in ("svg", "path"):
            return
        names, silent = self._names(name, attributes)
        own = _Element(name, names, any(map(self._judge, names)), silent or name in SILENT)
        self._open.append(own)
        if name not in INLINE:
            self._blocks.append(own)
        self._by_name.setdefault(name, []).append(own)
        self._count(own, 1)

    def _names(self, name: str, attributes: str) -> tuple[list[str], bool]:
        """What an element is called, for ``prior`` and the counts; and whether it is hidden."""
        names = [f"<{name}"] if name in STRUCTURAL and (name != "header" or not self._content) else []
        if not attributes or name in ("html", "body", "article", "main"):
            return names, False
        hidden = False
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "role" and value in ROLES:
                names.append(f"@{value}")
            elif key in ("class", "id") and name not in INLINE:
                names += [f".{x}" for x in value.split()]
            hidden = hidden or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(_HIDDEN.search(value))
        return names, hidden

    def _count(self, own: _Element, by: int) -> None:
        self._named += by * own.named
        self._silent += by * own.silent
        self._linked += by * own.linked
        self._content += by * own.content
        for name in own.names:
            self._active[name] += by
            if not self._active[name]:
                del self._active[name]

    def _close(self, own: _Element) -> None:
        """An inline element closes alone, another one with all that is open inside it; each is taken off once."""
        if own.name in INLINE:
            self._by_name[own.name].pop()
            own.closed = True
            self._count(own, -1)
            while self._open and self._open[-1].closed:
                self._open.pop()
            return
        while True:
            last = self._open.pop()
            if not last.closed:
                self._by_name[last.name].pop()
                self._count(last, -1)
            if last.name not in INLINE:
                self._blocks.pop()
            if last is own:
                return


def _judge(weights: dict[str, float]):
    """Whether a name stands for boilerplate under the weights."""
    known: dict[str, bool] = {}

    def judged(name: str) -> bool:
        if name not in known:
            known[name] = weights[name] < LIMIT if name in weights else prior(name)
        return known[name]

    return judged


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, one past last) of the contiguous part with the largest sum; of equal ones the first; (0, 0) if none is positive."""
    best, first, last, run, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, first, last = run, start, i + 1
    return first, last


def main_text(source: str | None, weights: dict[str, float], judged=None) -> str:
    """The main text of a page; empty if there is none."""
    if not source:
        return ""
    page, other = _Page(source, judged or _judge(weights)), weights.get("", DEFAULTS[""])
    beyond = page.declared == 1
    scores = [weights.get(f, other) if t is None else weights[BEYOND if beyond and not within else f] * n for f, n, t, within in page.tokens]
    first, last = best_region(scores)
    parts: list[str] = []
    for feature, _, text, _ in page.tokens[first:last]:
        if text is None:
            if feature not in INLINE:
                parts.append(" ")
        elif feature != NAMED:
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for source in batch.column(0).to_pylist():
            below: tuple[Counter, Counter] = (Counter(), Counter())
            page = _Page(source, prior, below)
            if page.declared == 1:
                for total, own in zip((inside, outside), below, strict=True):
                    total.update(own)
                for feature, words, text, within in page.tokens:
                    (inside if within else outside)[feature] += words if text is not None else 1
    names = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], ["feature", "inside", "outside"])


def fit_weights(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html", labelled_pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``labelled_pages`` pages that declare their content, chosen by a hash; defaults if there are none.

    Log-odds of a token inside declared content against outside, with one added to each count. Words outside links and
    boilerplate keep at least 0.5, words beyond declared content count at least -1; tags of blocks get from -1.5 to
    -0.05, tags inside lines hardly count. Names of elements (``.class``, ``@role``, ``<tag``) that hold JUDGED words or
    more have the log-odds of these words, with PRIOR words more outside where the prior takes them for boilerplate.
    """
    ship(pages.sparkSession)
    source = F.col(f"`{html_column}`").cast("string")
    sample = pages.select(source.alias("html"), F.xxhash64(F.col(f"`{id_column}`"), source).alias("h")).filter(source.rlike("(?i)<(article|main)[\\s>]"))
    count = sample.count()
    # a little more than is needed by the hash alone, so that the pages to be ordered do not grow with the table
    below = int(min(1.0, (labelled_pages + 5 * labelled_pages**0.5) / max(1, count)) * 2**60)
    some = sample.filter(F.shiftrightunsigned("h", 4) <= below)
    found = some.orderBy(F.shiftrightunsigned("h", 4), "html").limit(labelled_pages).select("html").mapInArrow(then_give_back(_label), "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    weights = dict(DEFAULTS)
    for feature, a, b in found:
        odds = max(-4.0, min(4.0, math.log((a + 1) / (b + 1))))
        if feature == WORD:
            weights[WORD] = min(2.0, max(0.5, odds))
        elif feature == LINKED:
            weights[LINKED] = min(0.5, max(-1.0, odds))
        elif feature == NAMED:
            weights[NAMED] = min(-0.02, odds / 20)
        elif feature[0] in ".@<":
            if a + b >= JUDGED:
                weights[feature] = math.log((a + 1) / (b + 1 + PRIOR * prior(feature)))
        elif feature not in INLINE:
            weights[feature] = min(-0.05, max(-1.5, odds / 2))
    return weights


def extract_main_text(pages: DataFrame, weights: dict[str, float], *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row, from the whole html.

    Pages are read whole, however long. Null or empty html, and pages without a region of positive score, give an empty text of 0 characters. Broken markup
    is read as far as it goes. Repeated rows give equal rows, null ids and urls are passed on, an empty table gives an
    empty result, other columns play no part.
    """
    ship(pages.sparkSession)
    chosen = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judge(weights)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(source, weights, judged) for source in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return chosen.mapInArrow(then_give_back(extract), "page_id long, url string, text string, n_chars long")
