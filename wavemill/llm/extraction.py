"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block). The text lengths over a sliding
window of lines form a curve; a region of the page begins where the curve
surges from zero and ends where it dives back to zero. Regions with enough
running text are the article.

Where a page has article or main elements whose own lines surge, or with which the
regions outside cannot compare (``rival`` times their running text), only their lines
count in the curve, and of an article that it finds all lines stay. Elsewhere a
container (div, section, list, table, cell) whose own lines surge keeps all its
lines, also short ones and lists of links beside the region; between surging
containers of one container all lines stay. Of the page's body, whose own lines are
beside menus and the like, all own lines stay and what is between regions.

Stripping leaves a gap of a whole window of empty lines where an element stood
that is no running text by its tag, role or name (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, comments), and on pages without an article or main element where a container
begins or ends, so the curve dives there: a line or two in a container of their own are no text, whatever that is called. Text
inside links counts for nothing in the curve, so a list of links cannot surge.

Names are matched by whole parts. They never drop an article or main element or an
element around one, except articles among the comments on an earlier article. And the curve overrules them: where
nothing else of a page surges, an element with more running text than all the rest around it is
text whatever its name, and so on for the named elements in it; comments stay out.

Defined cases: a null page is an empty page; a page that ends within a tag ends
before it; elements that are never closed end with their parent; repeated rows
are extracted each. The time is linear in the page, however its tags are nested: the
open elements of each tag are known by place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form script style noscript iframe svg math canvas object embed template button select option textarea input dialog menu title label fieldset audio video map".split())
CONTAINERS = frozenset("div section table td th ul ol dl center details".split())
APART = frozenset("div section table".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "li", "caption"}
# Words in class, id or role of an element that is no running text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets header masthead topbar footer foot colophon comment comments respond disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login form search share sharing social related recommended recommendations toc skip copyright legal disclaimer complementary contentinfo hidden".split()
)
# Parts of names that mark readers' comments.
COMMENTS = frozenset("comment comments commentlist commentslist commentform commentbox commentsbox commentarea commentsarea commentsection commentssection commentthread commentwrap commentswrap commentswrapper commentrespond disqus disqusthread".split())
# Parts that mark an element as no running text also beside the words that mark running text.
ALWAYS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertbox advertisers sidebar sidebars sidebarleft sidebarright leftsidebar rightsidebar sponsor sponsors sponsored sponsorship sponsorbox cookie cookies cookiebar cookiebanner cookiebox cookieconsent cookielaw cookienotice cookiepolicy newsletter newsletters newsletterbox newsletterform newslettersignup navbar navbars breadcrumb breadcrumbs breadcrumbtrail".split()
)
CONTENT = frozenset("content article main post entry story text body".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WITH = re.compile(r"\b(?:has|no|with|without)[-_][a-z]+")
_SPACE = re.compile(r"\s+")


def _is_dropped_name(name: str) -> bool:
    words = {w for w in _PARTS.split(name) if w}
    last = name.rsplit("-", 1)[-1].rsplit("_", 1)[-1]
    return bool(words & ALWAYS) or last in NAMES or bool(words & NAMES) and not words & CONTENT


def _no_text(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element is no running text: by its tag (or hidden), by its name, or as comments; an article's own header is text."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return "tag"
    if not attributes or tag in ("html", "body"):
        return ""
    if _HIDDEN.search(attributes):
        return "tag"
    found = [n for m in _NAME.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
    names = [_WITH.sub("", _CAMEL.sub("-", n).lower()) for n in found]
    if in_article:
        names = [n for n in names if n.rsplit("-", 1)[-1] != "header"]
    dropped = [n for n in names if _is_dropped_name(n)]
    if any(COMMENTS & set(_PARTS.split(n)) for n in dropped):
        return "comments"
    return "name" if dropped else ""


def lines_of(html: str, window: int, spared: frozenset[int] | range = frozenset(), weighed: list[tuple[int, int, int]] | None = None, apart: bool = False) -> tuple[list[str], list[int], list[bool], list[int], list[int]]:
    """The stripped page: text of each line, its length outside links, whether it is inside article or main, and its container; and each container's parent.

    Containers are numbered as they open; 0 is the body, its own parent; ``apart`` keeps each a window
    away from what is before and after it. Elements that a
    name drops are numbered too; those in ``spared`` stay, and ``weighed`` gets of each of these its number, that of the
    one around it (-1: none) and its running text.
    """
    texts: list[str] = []
    sizes: list[int] = []
    inside: list[bool] = []
    owner: list[int] = []
    parents = [0]
    buffer: list[str] = []
    free = 0
    # open elements: tag, why it starts a dropped part, since which rescue of an article that holds, and what held before it
    stack: list[tuple[str, str, int, tuple[int, int, int, int, int]]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    why = {"tag": 0, "name": 0, "comments": 0}  # dropped parts that are open
    rescues = links = bodies = box = articles = named = weight = 0
    around, held = -1, 0  # the spared element at hand, and the running text before it

    def last(*tags: str) -> int:
        """Place of the innermost open element of some tags, or -1."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def line(gap: int = 0) -> None:
        nonlocal free
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            texts.append(text)
            sizes.append(min(free, len(text)))
            inside.append(bodies > 0)
            owner.append(box)
        buffer.clear()
        free = 0
        for _ in range(gap):
            texts.append("")
            sizes.append(0)
            inside.append(bodies > 0)
            owner.append(box)

    def leave(to: int) -> None:
        nonlocal links, bodies, box, around, held
        while len(stack) > to:
            tag, drops, since, before = stack.pop()
            places[tag].pop()
            if tag in BLOCK and not any(why.values()):
                line(window if apart and tag in APART else tag in APART or tag in ("ul", "ol"))
            if drops and since == rescues:
                why[drops] -= 1
                if not any(why.values()):
                    line(window)
            elif not any(why.values()) and tag in ("article", "main"):
                line()
            if weighed is not None and around != before[3]:
                weighed.append((around, before[3], weight - held))
            links, bodies, box, around, held = before

    def text(raw: str) -> None:
        nonlocal free, weight
        if raw and not any(why.values()):
            got = unescape(raw) if "&" in raw else raw
            buffer.append(got)
            if not links:
                free += len(got)
                weight += len(got.strip())

    at = 0
    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            k = last(tag)
            if k >= 0 and (tag in BLOCK or tag in ("article", "main", "table", "body") or k > last("article", "main", "table", "body")):
                leave(k)
            elif k < 0 and tag in BLOCK and not any(why.values()):
                line()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in ("hr", "img") or tag in VOID:
            if tag == "hr" and not any(why.values()):
                line()
            continue
        if tag in CLOSES_P and last("p") > max(len(stack) - 7, last("article", "main", "div", "table", "section")):
            leave(last("p"))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and last(tag) > last("ul", "ol", "dl", "table", "select"):
            leave(last(tag))
        if m[0].endswith("/>") and tag in ("svg", "path"):
            continue
        drops = _no_text(tag, m[2], bodies > 0)
        number = -1
        if drops == "name":
            if named in spared:
                drops, number = "", named
            named += 1
        if tag in ("article", "main") and drops != "tag":
            # names do not drop an article, nor what is around it; only articles among the comments on an earlier one are comments
            if not why["tag"] and not ((why["comments"] or drops == "comments") and articles):
                drops = ""
                if any(why.values()):
                    rescues += 1
                    why = dict.fromkeys(why, 0)
                articles += 1
        if tag in BLOCK and not any(why.values()):
            line(window if apart and tag in APART and not drops else 0)
        before = (links, bodies, box, around, held)
        if number >= 0:
            around, held = number, weight
        if drops:
            if not any(why.values()):
                line(window)
            why[drops] += 1
        elif not any(why.values()):
            if tag == "a":
                links += 1
            elif tag in ("article", "main"):
                bodies += 1
            elif tag in CONTAINERS:
                parents.append(box)
                box = len(parents) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, drops, rescues, before))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if end:
                text(html[at : end.start()])
                at = end.end()
            else:
                at = n
            leave(len(stack) - 1)
    if not any(why.values()):
        line()
    if weighed is not None:
        leave(0)
    return texts, sizes, inside, owner, parents


def overruled(html: str, window: int) -> frozenset[int]:
    """Numbers of the elements with a dropped name that have more running text than the rest of what they are in."""
    found: list[tuple[int, int, int]] = []
    _, sizes, _, _, _ = lines_of(html, window, range(1 << 62), found, True)
    weight = {-1: sum(sizes)} | {number: size for number, _, size in found}
    spared: set[int] = set()
    for number, outer, size in sorted(found):  # in order of opening: what is around comes first
        if (outer < 0 or outer in spared) and 2 * size > weight[outer]:
            spared.add(number)
    return frozenset(spared)


def _beside(kept: list[bool], sizes: list[int], owner: list[int], parents: list[int], window: int, surge: int) -> list[bool]:
    """``kept`` and the lines that are in one container with it: see the module's text."""
    own: list[list[int]] = [[] for _ in parents]  # lines with text outside links count in the curve of their container
    for i, k in enumerate(owner):
        if sizes[i]:
            own[k].append(i)
    spans: list[list[tuple[int, int]]] = [[] for _ in parents]  # of surging containers, by parent
    first, last = [len(owner)] * len(parents), [-1] * len(parents)
    for i, k in enumerate(owner):
        first[k], last[k] = min(first[k], i), i
    for k in range(len(parents) - 1, 0, -1):
        first[parents[k]], last[parents[k]] = min(first[parents[k]], first[k]), max(last[parents[k]], last[k])
    stay: list[tuple[int, int]] = []
    for k in range(len(parents) - 1, -1, -1):
        lines = own[k]
        held = [i for i in lines if kept[i]]
        span = None
        if held and max(sum(sizes[i] for i in lines[j : j + window]) for j in range(len(lines))) >= surge:
            span = (first[k], last[k]) if k else (held[0], held[-1])
        elif k and len(spans[k]) > 1:
            span = (min(a for a, _ in spans[k]), max(b for _, b in spans[k]))
        if span:
            stay.append(span)
            if k:
                spans[parents[k]].append(span)
            else:
                kept = [x or not o for x, o in zip(kept, owner, strict=True)]
    out = list(kept)
    end = 0
    for a, b in sorted(stay):
        for i in range(max(a, end), b + 1):
            out[i] = True
        end = max(end, b + 1)
    return out


def regions(sizes: list[int], is_text: list[bool], window: int) -> list[tuple[int, int, int]]:
    """Where the sums over ``window`` lines surge from zero at a line with text and dive to zero again: first line, line after the last, highest sum."""
    n = len(sizes)
    curve = [sum(sizes[i : i + window]) for i in range(n)]
    found: list[tuple[int, int, int]] = []
    i = 0
    while i < n:
        if not curve[i] or not is_text[i]:
            i += 1
            continue
        j = i
        top = 0
        while j < n and curve[j]:
            top = max(top, curve[j])
            j += 1
        found.append((i, j, top))
        i = j
    return found


def main_text(html: str | None, window: int = 3, surge: int = 120, rival: int = 5) -> str:
    """The regions between surge and dive points of the line-block curve, blocks joined by line feeds.

    A region counts if its curve reaches ``surge`` characters somewhere; if none does, the largest region counts.
    """
    if not html:
        return ""
    texts, sizes, inside, owner, parents = lines_of(html, window)
    is_text = [bool(t) for t in texts]
    if not any(inside) and (any(is_text) or _NAME.search(html)):
        texts, sizes, inside, owner, parents = lines_of(html, window, apart=True)
        if max((top for _, _, top in regions(sizes, [bool(t) for t in texts], window)), default=0) < surge and (spared := overruled(html, window)):
            texts, sizes, inside, owner, parents = lines_of(html, window, spared, apart=True)
    is_text = [bool(t) for t in texts]
    own = [s if i else 0 for s, i in zip(sizes, inside, strict=True)]
    if marked := any(t and i for t, i in zip(is_text, inside, strict=True)):
        outside = [0 if i else s for s, i in zip(sizes, inside, strict=True)]
        rivals = sum(sum(outside[a:b]) for a, b, top in regions(outside, is_text, window) if top >= surge)
        marked = any(top >= surge for _, _, top in regions(own, is_text, window)) or rivals <= rival * max(sum(own), 1)
    found = regions(own if marked else sizes, is_text, window)
    if not found:  # an article of links only is an article
        return "\n".join(t for t, i in zip(texts, inside, strict=True) if t and i and marked)
    kept = inside
    if not marked:
        enough = min(surge, max(top for _, _, top in found))
        kept = [False] * len(texts)
        for a, b, top in found:
            if top >= enough:  # the curve surges and dives at lines of running text, not at links beside them
                running = [i for i in range(a, b) if sizes[i]]
                kept[running[0] : running[-1] + 1] = [True] * (running[-1] + 1 - running[0])
        kept = _beside(kept, sizes, owner, parents, window, enough)
    return "\n".join(t for t, k in zip(texts, kept, strict=True) if t and k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 120) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, window, surge) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr(f"`{id_col}` as page_id", f"`{url_col}` as url", f"`{html_col}` as html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
