"""Main text: learned names, broken and very long pages."""

import re
import time
import html as library

import pytest

from marginalia.llm import html_text as H


def judged(weights=None):
    return H._judge(weights or H.DEFAULTS)


def text(page, weights=None):
    return H.main_text(page, weights or dict(H.DEFAULTS))


BODY = "<h1>Head line</h1><p>First words of the article that go on and on.</p>{}<p>More words of the article follow here.</p>"
WANT = "Head line First words of the article that go on and on. {}More words of the article follow here."


@pytest.mark.parametrize("name", ["share-price", "legal", "post-header", "user-quotes", "searchable-table", "sidebar-layout"])
def test_names_that_only_sound_like_boilerplate_stay(name):
    assert text(f"<article>{BODY.format(f'<div class={name!r}><p>Part of it.</p></div>')}</article>") == WANT.format("Part of it. ")


@pytest.mark.parametrize("block", ["<div class='ad-box'><p>Buy.</p></div>", "<div id='cookie-notice'>We use.</div>", "<section class='x comment-list'><p>I agree.</p></section>", "<aside>See.</aside>", "<form>Mail <input></form>", "<div role='navigation'>Go.</div>", "<div style='display: none'>No.</div>", "<script>var a = '<p>no</p>'</script>", "<button>Press</button>"])
def test_usual_boilerplate_goes(block):
    assert text(f"<nav>Home page</nav><article>{BODY.format(block)}</article><footer>All rights</footer>") == WANT.format("")


def test_names_are_learned_from_labelled_pages(spark):
    """A name that labelled pages use outside is boilerplate, and one that they use inside is not, whatever it is called."""
    words = "words that make a text long enough to be judged by it "
    page = f"<html><body><div class='qx7'>{words}</div><article><p>{words * 4}</p><div class='related'>{words}</div></article><div class='qx7'>{words}</div></body></html>"
    pages = spark.createDataFrame([(i, "u", page + str(i)) for i in range(20)], "page_id long, url string, html string")
    weights = H.fit_weights(pages)
    assert weights[".qx7"] < H.LIMIT < weights[".related"]
    assert text(f"<article>{BODY.format('<div class=qx7><p>Out.</p></div><div class=related><p>In.</p></div>')}</article>", weights) == WANT.format("In. ")


def test_pages_of_the_table_with_and_without_declared_content(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows, weights = pages.collect(), H.fit_weights(pages)

    def plain(source):  # the article as this table writes it
        body = re.search(r"<article>(.*)</article>", source, re.S)[1]
        body = re.sub(r'<div class="ad">.*?</div>|<!--.*?-->|<(script|style).*?</\1>', " ", body, flags=re.S)
        return " ".join(library.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", body))).split())

    assert all(text(r["html"], weights) == plain(r["html"]) for r in rows)
    assert all(text(r["html"].replace("article>", "div>"), weights) == plain(r["html"]) for r in rows)


@pytest.mark.parametrize("page", ['<a "' * 100_000, "<a '\"" * 60_000, "".join(f"<x{i}>" for i in range(50_000)) + "</y>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "<p>" * 50_000, "<li><b>" * 50_000, "<div>" * 60_000 + "</div>" * 60_000, "<" * 200_000, "<a <" * 60_000, "<!--" * 60_000, "<script>" * 40_000, "&amp" * 100_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    text(page)
    assert time.perf_counter() - began < 20  # quadratic time would be an hour


def test_very_long_page():
    page = "<nav>" + "<a href=x>Menu</a>" * 1000 + "</nav><article>" + "<p>Some words of a very long article &amp; more.</p>" * 20_000 + "</article>"
    assert text(page) == " ".join(["Some words of a very long article & more."] * 20_000)
