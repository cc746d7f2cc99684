"""Main text of web pages: flat text blocks, judged by a decision tree on their own and their neighbours' shape.

A page becomes a flat list of blocks, cut at block-level tags. A block's features are its word count and link density
(share of words inside links), both for the block before and after it, and what its open elements say: whether it lies in an article
or main element, whether the page has one, whether it is a heading, and a mark. For a block before the
page's first heading, the share of the page's words that follow this heading counts too: text before a title is rarely main text. A mark of 2 comes from elements that can't be main
text (nav, aside, forms, hidden ones, reader comments); one of 1 from a class, id or role with a word that often, but not always, names
page furniture, and then the share of the page's words in that element counts too. The tree is grown by Gini impurity on
``LAYOUTS``, a small table of page layouts whose blocks are labelled; growing it takes milliseconds, so each task grows the same tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from postlake.llm.rows import bounded_batches

#: Comments and CDATA; tags whose values may be quoted; tags with broken quotes. Nothing is tried twice within a tag.
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.DOTALL)
_TAG = re.compile(r"<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_BROKEN = re.compile(r"<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form dialog details fieldset ul ol dl menu table blockquote figure center".split())
FURNITURE = frozenset("nav footer aside form dialog menu fieldset".split())
# Words in class, id or role that name readers' comments, and those that may name other page furniture.
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
HINT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert author banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright disclaimer dropdown footer form gdpr hidden legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promos promotion recommended related search share sharing sidebar signup skip social sponsor sponsored status subscribe subscription tags toolbar widget widgets".split()
)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "has_article", "mark", "share", "heading", "early")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)}


def _mark(tag: str, source: str, in_article: bool) -> int:
    """What an element says of its content: 2 for furniture, 1 for a name that hints at it."""
    if tag in ("html", "body", "main") or tag == "article" and not in_article:
        return 0
    if tag in FURNITURE or tag == "header" and not in_article:
        return 2
    if not source.strip():
        return 0
    given = _attributes(source)
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return 2
    mark = 0
    for k in ("class", "id", "role"):
        for name in given.get(k, "").split():
            parts = {*_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())}
            if not {"has", "with", "no"} & parts:
                mark = max(mark, 2 if COMMENT_WORDS & parts else 1 if HINT_WORDS & parts else 0)
    return mark


def blocks(page: str | None) -> list[tuple[str, tuple]]:
    """(text, features of its own: words, links, in article, page has one, mark, share, heading) of each block that has text, in page order."""
    found: list[list] = []
    holders: list[float] = []  # words outside links in each element with a mark of 1
    open_tags: list[tuple[str, bool, int, int]] = []  # container, in article, mark, its place among the holders
    text: list[str] = []
    linked = [0]
    in_link, heading, raw, depth = False, False, "", 0

    def close() -> None:
        nonlocal heading
        joined = " ".join("".join(text).split())
        if joined:
            n = joined.count(" ") + 1
            _, article, mark, holder = open_tags[-1] if open_tags else ("", False, 0, -1)
            found.append([joined, n, min(1.0, linked[0] / n), article, mark, holder, heading])
        text.clear()
        linked[0] = 0

    def add(chunk: str) -> None:
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            text.append(chunk)
            if in_link:
                linked[0] += len(chunk.split())

    page = page or ""
    at, start, broken = 0, page.find("<"), False
    while start >= 0:
        aside = _ASIDE.match(page, start)
        m = aside or (None if broken else _TAG.match(page, start)) or _BROKEN.match(page, start)
        if m is None:
            start = page.find("<", start + 1)
            continue
        # a quote that is never closed: from here on quotes aren't looked at, so that a broken page costs no more
        broken = broken or not aside and m.re is _BROKEN and ("'" in m[3] or '"' in m[3])
        if not raw:
            add(page[at:start])
        at = m.end()
        start = page.find("<", at)
        if aside:
            if not raw and m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        mark, tag, source = m[1], m[2].lower(), m[3]
        if raw:
            if tag == raw and mark in ("", "/") and not source.endswith("/"):
                depth += -1 if mark == "/" else 1
                raw = raw if depth else ""
            continue
        if mark in ("!", "?"):
            continue
        if tag in RAW:
            if mark != "/" and not source.endswith("/"):
                if tag not in INLINE:
                    close()
                if tag in ("script", "style"):  # their content isn't markup
                    end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else len(page)
                    start = page.find("<", at)
                elif tag != "head":  # which may be left open; its parts are skipped one by one
                    raw, depth = tag, 1
            continue
        if tag == "a":
            in_link = mark != "/"
        if tag == "br":
            text.append(" ")
        if tag in INLINE or tag == "br":
            continue
        close()
        in_link = False
        heading = mark != "/" and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if tag not in CONTAINERS or tag in VOID:
            continue
        if mark == "/":
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    break
        elif not source.endswith("/"):
            _, article, outer, holder = open_tags[-1] if open_tags else ("", False, 0, -1)
            own = _mark(tag, source, article)
            if own == 1 and holder < 0:
                holder = len(holders)
                holders.append(0.0)
            open_tags.append((tag, article or tag in ("article", "main"), max(outer, own), holder))
    if not raw:
        cut = page.rfind("<")  # a tag that the page's end cuts off isn't text
        add(page[at:cut] if cut >= at and re.match(r"<[a-zA-Z/!]", page[cut:]) else page[at:])
    close()
    free = [n * (1 - links) for _, n, links, *_ in found]
    for (*_, holder, _), n in zip(found, free):
        if holder >= 0:
            holders[holder] += n
    total, has_article = max(sum(free), 1.0), any(x[3] for x in found)
    return [(x[0], (x[1], x[2], x[3], has_article, x[4], holders[x[5]] / total if x[4] == 1 else 0.0, x[6])) for x in found]


def features(own: list[tuple]) -> np.ndarray:
    """A row per block, in the order of ``FEATURES``, from the blocks' own features."""
    x = np.array(own, dtype=float).reshape(-1, 7)
    none = np.zeros((1, 2))
    before, after = np.vstack([none, x[:-1, :2]])[: len(x)], np.vstack([x[1:, :2], none])[: len(x)]
    free = x[:, 0] * (1 - x[:, 1])
    titled = np.cumsum(x[:, 6]) > 0
    early = np.where(titled, 0.0, free[titled].sum() / max(free.sum(), 1.0))
    return np.column_stack([x[:, 0], x[:, 1], before, after, x[:, 2:], early])


#: Labelled pages. A block: words, share of them in links, mark, whether it is a heading, whether it is main text; "article" and
#: "/article" stand for the tags.
LAYOUTS = (
    # menu, advert, an article with headings, short and long paragraphs, footer
    ((1, 1.0, 2, 0, 0), (1, 1.0, 2, 0, 0), (2, 1.0, 2, 0, 0), (8, 0.0, 1, 0, 0), "article", (9, 0.0, 0, 1, 1), (60, 0.0, 0, 0, 1), (1, 0.0, 0, 0, 1), (45, 0.1, 0, 0, 1), (3, 0.0, 0, 1, 1), (2, 0.5, 0, 0, 1), (120, 0.02, 0, 0, 1), (7, 0.0, 0, 0, 1), "/article", (12, 0.2, 2, 0, 0)),
    # the same with a notice before and related links after the article, unmarked; one word is a paragraph
    ((3, 1.0, 0, 0, 0), (14, 0.1, 0, 0, 0), "article", (2, 0.0, 0, 1, 1), (1, 0.0, 0, 0, 1), (35, 0.0, 0, 0, 1), (4, 1.0, 0, 0, 1), (20, 0.3, 0, 0, 1), (2, 0.0, 0, 0, 1), "/article", (3, 0.0, 0, 1, 0), (6, 1.0, 0, 0, 0), (5, 1.0, 0, 0, 0), (30, 0.0, 0, 0, 0)),
    # an article with share links, an advert and readers' comments inside, and comments after it
    ("article", (6, 0.0, 0, 1, 1), (80, 0.0, 0, 0, 1), (3, 1.0, 1, 0, 0), (50, 0.05, 0, 0, 1), (18, 0.0, 1, 0, 0), (25, 0.0, 1, 0, 0), (40, 0.0, 0, 0, 1), (2, 0.0, 2, 1, 0), (60, 0.0, 2, 0, 0), (9, 0.0, 2, 0, 0), "/article", (70, 0.0, 2, 0, 0), (4, 0.0, 0, 0, 0)),
    # a short article between long furniture
    ((40, 0.9, 2, 0, 0), (60, 0.0, 1, 0, 0), "article", (12, 0.0, 0, 0, 1), "/article", (90, 0.0, 2, 0, 0), (50, 0.0, 1, 0, 0)),
    # an article in an element whose name hints at furniture
    ((2, 1.0, 2, 0, 0), "article", (5, 0.0, 1, 1, 1), (70, 0.0, 1, 0, 1), (3, 0.0, 1, 0, 1), (55, 0.05, 1, 0, 1), (40, 0.0, 1, 0, 1), "/article", (4, 0.5, 2, 0, 0)),
    ((3, 1.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (5, 0.0, 1, 1, 1), (70, 0.0, 1, 0, 1), (4, 0.0, 1, 0, 1), (55, 0.05, 1, 0, 1), (8, 0.0, 1, 1, 1), (40, 0.0, 1, 0, 1), (5, 0.4, 0, 0, 0)),
    # nothing but an article, with and without a heading; nothing but paragraphs
    ("article", (50, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), "/article"),
    ("article", (2, 0.0, 0, 1, 1), (1, 0.0, 0, 0, 1), "/article"),
    ((30, 0.0, 0, 0, 1),),
    ((2, 0.0, 0, 1, 1), (30, 0.0, 0, 0, 1), (45, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1)),
    ((3, 0.0, 0, 0, 1),),
    ((8, 0.0, 0, 0, 1),),
    ((20, 1.0, 0, 0, 0), (50, 0.0, 0, 0, 1), (45, 0.0, 0, 0, 1)),
    ((2, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (90, 0.0, 0, 0, 1), (15, 0.0, 0, 0, 1), (60, 0.05, 0, 0, 1), (22, 0.0, 0, 0, 1)),
    ((6, 0.0, 0, 1, 1), (9, 0.0, 0, 0, 1)),
    ((5, 0.0, 0, 0, 1), (11, 0.0, 0, 0, 1), (7, 0.0, 0, 0, 1)),
    # no article element: only the shape of blocks tells; menu, title, text, lists of links, footer
    ((1, 1.0, 0, 0, 0), (2, 1.0, 0, 0, 0), (3, 1.0, 0, 0, 0), (6, 0.0, 0, 1, 1), (80, 0.0, 0, 0, 1), (70, 0.05, 0, 0, 1), (5, 0.0, 0, 1, 1), (90, 0.0, 0, 0, 1), (25, 0.0, 0, 0, 1), (4, 0.0, 0, 0, 1), (60, 0.0, 0, 0, 1), (12, 0.1, 0, 0, 1), (40, 0.0, 0, 0, 1), (3, 1.0, 0, 0, 0), (4, 1.0, 0, 0, 0), (5, 0.0, 0, 0, 0)),
    ((4, 1.0, 0, 0, 0), (30, 0.9, 0, 0, 0), (30, 0.0, 0, 0, 1), (25, 0.0, 0, 0, 1), (1, 0.0, 0, 0, 1), (50, 0.1, 0, 0, 1), (2, 0.0, 0, 0, 1), (18, 0.0, 0, 0, 1), (12, 0.8, 0, 0, 0), (10, 0.9, 0, 0, 0), (6, 0.5, 0, 0, 0)),
    ((2, 1.0, 2, 0, 0), (3, 1.0, 2, 0, 0), (7, 0.0, 0, 1, 1), (35, 0.0, 0, 0, 1), (9, 0.0, 0, 0, 1), (40, 0.0, 0, 0, 1), (20, 0.0, 1, 0, 0), (28, 0.1, 1, 0, 0), (22, 0.0, 0, 0, 1), (2, 0.0, 2, 1, 0), (60, 0.0, 2, 0, 0), (15, 0.3, 2, 0, 0)),
    ((5, 1.0, 1, 0, 0), (2, 0.0, 0, 1, 1), (3, 0.0, 0, 0, 1), (1, 0.0, 0, 0, 1), (14, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), (16, 0.0, 1, 0, 0), (6, 0.0, 2, 0, 0)),
    # columns of prose beside an article, without a mark or a link; the first one without headings in the article
    ((60, 0.0, 0, 0, 0), (25, 0.0, 0, 0, 0), "article", (40, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1), (70, 0.0, 0, 0, 1), "/article", (45, 0.0, 0, 0, 0), (9, 0.0, 0, 0, 0)),
    ((60, 0.0, 0, 0, 0), "article", (5, 0.0, 0, 1, 1), (80, 0.0, 0, 0, 1), (40, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), "/article", (4, 0.0, 0, 1, 0), (35, 0.0, 0, 0, 0)),
    ((3, 0.0, 0, 1, 0), (30, 0.0, 0, 0, 0), "article", (30, 0.0, 0, 0, 1), (6, 0.0, 0, 1, 1), (55, 0.0, 0, 0, 1), (1, 0.0, 0, 0, 1), "/article", (20, 0.0, 0, 0, 0)),
    # such columns before the title of a page without an article element
    ((60, 0.0, 0, 0, 0), (12, 0.0, 0, 0, 0), (5, 0.0, 0, 1, 1), (80, 0.0, 0, 0, 1), (40, 0.0, 0, 0, 1), (3, 0.0, 0, 0, 1)),
    ((2, 1.0, 0, 0, 0), (40, 0.0, 0, 0, 0), (7, 0.0, 0, 1, 1), (30, 0.0, 0, 0, 1), (4, 0.0, 0, 1, 1), (65, 0.05, 0, 0, 1)),
    # text whose only heading comes late
    ((50, 0.0, 0, 0, 1), (40, 0.0, 0, 0, 1), (2, 0.0, 0, 0, 1), (80, 0.0, 0, 0, 1), (4, 0.0, 0, 1, 1), (30, 0.0, 0, 0, 1)),
    ((30, 0.0, 0, 0, 1), (60, 0.0, 0, 0, 1), (3, 0.0, 0, 1, 0), (4, 1.0, 0, 0, 0), (5, 1.0, 0, 0, 0)),
    # opening paragraphs before an article's first heading
    ((2, 1.0, 2, 0, 0), "article", (18, 0.0, 0, 0, 1), (3, 0.0, 0, 1, 1), (90, 0.0, 0, 0, 1), (70, 0.0, 0, 0, 1), "/article", (9, 0.2, 2, 0, 0)),
    ("article", (2, 0.0, 0, 0, 1), (30, 0.0, 0, 0, 1), (5, 0.0, 0, 1, 1), (100, 0.0, 0, 0, 1), (60, 0.0, 0, 0, 1), "/article"),
    ("article", (50, 0.0, 0, 0, 1), (20, 0.0, 0, 0, 1), (4, 0.0, 0, 1, 1), (60, 0.0, 0, 0, 1), "/article"),
)


def labelled(layouts: tuple = LAYOUTS) -> np.ndarray:
    """A row per block of ``layouts``: features and label; every page three times, with its longer blocks shorter and longer too."""
    table = []
    for factor in (1.0, 0.5, 2.5):
        for page in layouts:
            inside, has_article, own, labels = False, "article" in page, [], []
            kept = [x for x in page if isinstance(x, tuple)]
            words = [max(12, round(x[0] * factor)) if x[0] > 12 else x[0] for x in kept]
            free = [n * (1 - x[1]) for n, x in zip(words, kept)]
            k, share = 0, 0.0
            for x in page:
                if isinstance(x, str):
                    inside = x == "article"
                    continue
                if x[2] == 1 and (k == 0 or kept[k - 1][2] != 1):  # neighbours with a mark of 1 are of one element
                    end = next((j for j in range(k, len(kept)) if kept[j][2] != 1), len(kept))
                    share = sum(free[k:end]) / max(sum(free), 1.0)
                own.append((words[k], x[1], inside, has_article, x[2], share if x[2] == 1 else 0.0, x[3]))
                labels.append(x[4])
                k += 1
            table.append(np.column_stack([features(own), labels]))
    return np.vstack(table)


def grow(table: np.ndarray, depth: int = 8) -> tuple | float:
    """A tree of (feature, limit, at most, above); a leaf is the share of main text among its rows."""
    y = table[:, -1]
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (1e-9, None)
    base = share * (1 - share)
    for f in range(table.shape[1] - 1):
        values = np.unique(table[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = table[:, f] <= limit
            p, q, w = y[left].mean(), y[~left].mean(), left.mean()
            gain = base - w * p * (1 - p) - (1 - w) * q * (1 - q)
            if gain > best[0] + 1e-12:
                best = (gain, (f, float(limit), left))
    if best[1] is None:
        return share
    f, limit, left = best[1]
    return (f, limit, grow(table[left], depth - 1), grow(table[~left], depth - 1))


def judge(tree: tuple | float, rows: np.ndarray) -> np.ndarray:
    """The leaf's share for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree)
    f, limit, low, high = tree
    left = rows[:, f] <= limit
    out = np.empty(len(rows))
    out[left], out[~left] = judge(low, rows[left]), judge(high, rows[~left])
    return out


def page_text(page: str | None, tree: tuple | float) -> str:
    """The blocks judged main text, joined by single spaces."""
    found = blocks(page)
    if not found:
        return ""
    keep = judge(tree, features([x for _, x in found])) >= 0.5
    return " ".join(text for (text, _), k in zip(found, keep) if k)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tree = grow(labelled())
    for batch in batches:
        texts = [page_text(x, tree) for x in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html; others ignored).

    The text is empty for a null or empty page and for one without main text. Unclosed, unknown and broken tags are
    skipped; of an attribute's value nothing is text, however long it is. Long pages are taken whole. A null page_id or url stays null.
    Repeated rows give repeated results; an empty table gives none. Columns of other names, text and n_chars too, are ignored.
    """
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
