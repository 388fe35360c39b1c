import random
import re
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import extraction

ARTICLE = "<p>{0}</p>".format("A long paragraph of running text that makes the curve surge well above its threshold. " * 2)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a\n  b<br>c<p>d &eacute;&#x41;</article><footer>f</footer>", "T & U\na b c\nd éA"),
        ("<body><div class='ad'>buy</div><main><p>one <a href=x>link</a> two</p><script>var t='</p>';</script><aside>side</aside><p>three</p></main>", "one link two\nthree"),
        ("<article><p>first</p><div class='comments'><p>nice!</p></div><form><p>mail</p></form><p>last", "first\nlast"),
        ("<article><p>cut in a ta", "cut in a ta"),
        ("<article><p>cut <b", "cut"),
        ("<article><header><h1>Own head</h1></header><p>text</p><ol class='commentlist'><li>me too</li></ol><p class='post-text'>more</p></article>", "Own head\ntext\nmore"),
        ("<div class='page has-sidebar'><p>kept</p></div><div role='navigation'>menu</div><div style='display:none'>gone</div>", "kept"),
        ("<p>x</p><!-- <p>gone</p> --><p>y</p>", "x\ny"),
    ],
)
def test_pages(html, text):
    assert extraction.main_text(html) == text


def test_regions_without_an_article_element():
    menu = "<ul>" + "".join(f"<li><a href='{i}'>Menu entry number {i}</a></li>" for i in range(20)) + "</ul>"
    page = f"<body><div id='top-header'>Site</div>{menu}<div id='content'><h2>Head</h2>{ARTICLE}<div>{ARTICLE}</div></div><div class='sidebar widget'>{ARTICLE}</div><div class='footer-links'>end</div>"
    got = extraction.main_text(page)
    assert got.startswith("Head\nA long") and got.count("A long paragraph") == 4 and "Menu" not in got and "end" not in got.split("\n")[-1][-3:]


LINK = "<p><a href=x>Source {0}</a></p>"


def test_an_article_keeps_its_links():
    assert extraction.main_text("<article><p>text</p><p><a href=x>Read the study</a></p></article>") == "text\nRead the study"
    five = "".join(LINK.format(i) for i in range(5))
    assert extraction.main_text(f"<nav>menu</nav><main><p>text</p>{five}<p>more</p></main>").split("\n") == ["text", *[f"Source {i}" for i in range(5)], "more"]
    assert extraction.main_text("<article><nav>menu</nav></article><p>the text</p>") == "the text"


def test_short_blocks_of_a_container_stay():
    menu = "<ul>" + "".join(f"<li><a href={i}>Menu {i}</a></li>" for i in range(9)) + "</ul>"
    page = "<body><div class=wrap>{0}<div id=content>{1}</div><div>Other</div></div>"
    ad = "<div class=ad>buy</div>"
    assert extraction.main_text(page.format(menu, f"{ARTICLE}{ad}<p>Short end</p>")).split("\n")[1:] == ["Short end"]
    links = "".join(LINK.format(i) for i in range(5))
    assert extraction.main_text(page.format(menu, f"{links}{ad}{ARTICLE}<ul><li>{links}</ul>{ad}{ARTICLE}{links}")).count("Source") == 15
    parts = f"<div>{ARTICLE}</div>{ad}<div>Between</div>{ad}<div>{ARTICLE}</div>"
    assert extraction.main_text(page.format(menu, parts)).split("\n")[1] == "Between"
    assert extraction.main_text(f"<body>{menu}{ARTICLE}{ad}<p>Short end</p>{menu}").split("\n")[1:] == ["Short end"]


@pytest.mark.parametrize(
    "page",
    [
        "<article class='commentary'><p>kept</p></article>",
        "<article class='comment'><p>kept</p></article>",
        "<main id='cookies-recipe'><p>kept</p></main>",
        "<div class='layout-sidebar-right'><p>gone</p><article><p>kept</p></article></div>",
        "<div class='newsletter'><div><a href=x><ul><li>gone<main class='ads'><div class='ad'>buy</div><p>kept</p></main></ul></a></div></div>",
        "<main><div class='layout-sidebar-right'><article><p>kept</p></article></div></main>",
        "<div class='commentator'><p>kept</p></div>",
        "<main><article><p>kept</p></article><div id='comments'><article class='comment-body'><p>nice!</p></article></div></main>",
        "<footer><article>gone</article></footer><article hidden>gone</article><article><p>kept</p></article>",
    ],
)
def test_names_do_not_drop_an_article(page):
    assert extraction.main_text(page) == "kept"


def test_the_curve_decides_whether_an_article_is_one():
    body = ARTICLE * 4
    got = extraction.main_text(f"<article><p>Teaser card</p></article><div class='content'>{body}</div>")
    assert got.split("\n")[-4:] == extraction.main_text(body).split("\n")
    assert extraction.main_text(f"<article><p>A short article, but an article.</p></article><div>{ARTICLE}</div>").startswith("A short article")
    assert "Beside" not in extraction.main_text(f"<article>{ARTICLE}</article><div><p>Beside. {body}</p></div>")
    assert extraction.main_text("<article><p><a href=x>Only a link</a></p></article>") == "Only a link"


SENTENCES = "".join(f"<p>This is a sentence of running text that says something at length, and then more. {i}</p>" for i in range(20))


@pytest.mark.parametrize("name", ["main-content sidebar-layout", "layout-sidebar-right", "page-ads-free", "newsletter", "blog-newsletter-archive", "search-results", "social", "legal", "alert-page content", "cookie-recipes"])
def test_names_do_not_empty_a_page(name):
    page = f"<body><nav><a href=x>menu</a></nav><div class='{name}'>{SENTENCES}<div class='sidebar'>{ARTICLE}</div><div class='comments'>{SENTENCES}{SENTENCES}</div></div><footer>end</footer>"
    got = extraction.main_text(page).split("\n")
    assert len(got) == 20 and all(line.startswith("This is a sentence") for line in got)
    assert extraction.main_text(f"<div class='content'>{ARTICLE}</div><div class='{name}-sidebar'>{SENTENCES}</div>").count("\n") == 0  # where text surges without them, names hold


def neutral(page):
    """The page without any word or tag that tells what a part of it is."""
    page = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


@pytest.fixture(scope="module")
def pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()


def test_the_curve_finds_articles_without_tags_and_names(pages):
    shares, footers = [], 0
    for page in pages:
        want, got = set(extraction.main_text(page).split("\n")), set(extraction.main_text(neutral(page)).split("\n"))
        assert want <= got  # every line of the article
        shares.append(len(got - want))
        footer = re.search(r"<footer>(.*?)</footer>", page, re.S)
        footers += bool(footer) and extraction.main_text(footer[1]) in got
    assert sum(shares) < len(pages) and footers < len(pages) / 20


def test_surge_and_window_matter(pages):
    plain = [neutral(p) for p in pages[:60]]
    base = [extraction.main_text(p) for p in plain]
    changed = lambda window, surge: sum(extraction.main_text(p, window, surge) != b for p, b in zip(plain, base, strict=True))
    assert changed(3, 10) > 50
    two = f"<body><div>{ARTICLE}</div><div>{SENTENCES * 9}</div>"
    assert extraction.main_text(two).startswith("A long") and extraction.main_text(two, 3, 200).startswith("This is")
    # a list of short lines surges over a window of many lines, not over one of few
    listed = "<body><div>" + "".join(f"<p>short line {i}</p>" for i in range(30)) + f"</div><div>{ARTICLE}</div>"
    assert "short line" in extraction.main_text(listed, 12) and "short line" not in extraction.main_text(listed, 3)


def test_kept_lines_by_brute_force_on_flat_pages():
    """Containers of paragraphs, nothing else: those stay whose lines reach the surge within a window."""
    rng = random.Random(0)
    for _ in range(200):
        window, surge = rng.randint(1, 4), rng.choice([20, 60, 86, 150])
        groups = [["x" * rng.randint(1, 70) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 6))]
        page = "".join("<div>" + "".join(f"<p>{line}</p>" for line in g) + "</div>" for g in groups)
        top = [max(sum(map(len, g[i : i + window])) for i in range(len(g))) for g in groups]
        enough = min(surge, max(top))
        assert extraction.main_text(page, window, surge) == "\n".join(line for g, t in zip(groups, top, strict=True) if t >= enough for line in g)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=40), st.integers(1, 4))
def test_regions_against_brute_force(lines, window):
    sizes, is_text = [n * t for n, t in lines], [t for _, t in lines]
    curve = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    want = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes) + 1):  # a longest run of the curve above zero from its first line with text
            begins = is_text[i] and not any(is_text[x] and all(curve[x:i]) for x in range(i))
            if begins and all(curve[i:j]) and (j == len(sizes) or not curve[j]):
                want.append((i, j, max(curve[i:j])))
    assert extraction.regions(sizes, is_text, window) == want


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 20_000 + "</i>" * 20_000,
        "<b><article>" + "<i>" * 20_000 + "</b>" * 20_000,
        "<ul>" + "<b>" * 20_000 + "<li><dt><dd>" * 20_000,
        "<b>" * 20_000 + "<article>" * 20_000,
        "<div class=ad><article>" * 10_000,
        "<div><p>" * 20_000 + "</section>" * 20_000,
        "<table><tr><td>" * 10_000 + "x" + "</td></tr>" * 10_000,
        "<a href='" * 20_000,
    ],
)
def test_time_is_linear(page):
    began = time.process_time()
    extraction.main_text(page)
    assert time.process_time() - began < 2


def test_table(spark):
    rows = [(1, "u", ARTICLE, "x", 1), (1, "u", ARTICLE, "x", 1), (None, None, None, None, None), (2, "v", "<p>" + "word " * 100_000, "y", 2)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 499_999
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
