"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: an element is known by the path of styles (sequences of child elements) that
leads to it. Its importance on the site is one where its presentation or content varies from page to page, and falls
towards zero the more pages show the same: with m pages that hold the element, the entropy (base m) of its styles
counts for its presentation, and for every text block one minus log_m of the pages that show the same block. The strings
of elements of low importance are removed from each page: a branch goes as a whole where all its elements are low, and
what varies below a constant label stays.

What a page says about itself weighs beforehand: marked menus, headers, footers, sidebars, notices, adverts, forms,
scripts and comments go (``NOISE_TAGS``, ``NOISE_WORDS``), but an element marked only by a word of its class, id or role stays if
it holds most of the page's varied text. A marked article is the main text unless far more varied text lies outside of it
(``ARTICLE_WEIGHT``); its elements go like others, but only from a lower importance (``ARTICLE_PRIOR``), and never all of them.
Pages with the same marked article are copies. The tree decides about everything else.

Statistics are counted by Spark per (host, element), never per host, so a host of any size spreads over all tasks.

Rows: null html gives an empty text. Pages without a host share the host "". Copies of a page, which hold the same text
in the same elements, are one page of the statistics under whatever id, url and html, and are extracted one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.session import settle

THRESHOLD = 0.35
DECAY = 0.9  # weight of an element's own presentation against its content, per level
LEAST_PAGES = 4
ARTICLE_PRIOR = 0.25  # importance that lying in a marked article gives before anything is counted
ARTICLE_WEIGHT = 3  # a marked article is the main text unless so many times its varied text lie outside
BROADCAST_NUMBERS = 1_000_000  # beyond it, pages and their weak elements meet in a shuffle join

# Elements and words in class, id and role that mark what is no main text
NOISE_TAGS = set(
    "head title script style noscript template nav header footer aside form button select option textarea input label "
    "fieldset dialog menu iframe object embed canvas svg audio video map".split()
)
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar aside header masthead footer bottom copyright cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar pagination pager comment comments commentlist reply replies "
    "respond disqus contentinfo complementary search form dialog alertdialog hidden".split()
)
# Marks that hold even for what looks like an article, or has one inside
SURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended "
    "recommendations comment comments commentlist reply replies respond disqus".split()
)
BLOCKS = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre address figure figcaption hr center details summary hgroup".split()
) | {"nav", "header", "footer", "aside", "form", "fieldset", "menu"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = re.compile(r"<(script|style|textarea|title|noscript|template|iframe|svg)\b", re.I)
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ROOTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
PLAIN, MARKED, ARTICLE = range(3)  # where an element lies
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# a tag's attributes may hold ">" in quotes; where quotes don't match, the tag ends at the next ">"
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    tag: str
    mark: str
    noise: bool
    sure: bool  # noise even around or as an article
    article: bool  # marks the article itself
    children: list = field(default_factory=list)  # elements and strings, in order
    named: bool = False  # noise only by a word of class, id or role
    holds_article: bool = False
    path: int = 0
    number: int = -1


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """What tells elements of one tag apart, whether it is noise, surely so, whether it is the article, and noise by words alone."""
    noise = sure = unseen = tag in NOISE_TAGS
    article, names = tag in ("article", "main"), []
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                words = [w.lower() for w in WORD_PARTS.findall(value)]
                noise |= not NOISE_WORDS.isdisjoint(words)
                sure |= not SURE_WORDS.isdisjoint(words)
                article |= name == "role" and value.strip().lower() in ("main", "article")
                names.append(value if name == "class" else "")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                noise = unseen = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                noise = unseen = True
    if tag in ("html", "body"):
        noise = sure = False
    if article:
        noise = sure
    return " ".join(names), noise, sure, article and not noise, noise and not sure and not unseen


def parse(source: str) -> Element:
    """Tree of a page. Unclosed paragraphs and list items end where a browser would end them."""
    root = Element("", "", False, False, False)
    stack = [root]
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if m[1] is not None:
            stack[-1].children.append(m[1])
            continue
        closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # an inline end tag does not close blocks around it
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break
            continue
        mark, noise, sure, article, named = _marks(tag, attributes)
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY_BLOCK:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in LIST_ROOTS[tag]:
                    break
        element = Element(tag, mark, noise, sure, article, named=named)
        stack[-1].children.append(element)
        if article and not any(e.sure for e in stack):
            for e in stack:  # a wrapper named after the sidebar beside the article is no sidebar
                e.noise, e.holds_article = False, True
        if RAW.match(m[0]):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(element)
        elif tag not in VOID and tag in BLOCKS:
            stack.append(element)
    return root


def weigh(root: Element, low: frozenset[int]) -> tuple[frozenset[int], bool]:
    """Weighs the marks against the page's varied text, that of elements not in ``low``.

    Takes the mark off wrappers that hold most of it. Returns ``low`` without the article's elements if nothing else of the
    article would stay, and whether the article is the main text.
    """
    order: list[tuple[Element, int, bool]] = []
    todo = [(root, -1, False)]
    while todo:
        e, up, inside = todo.pop()
        if e.noise and not e.named:
            continue
        inside = inside or e.article
        todo.extend((c, len(order), inside) for c in e.children if not isinstance(c, str))
        order.append((e, up, inside))
    full = [sum(len(c.strip()) for c in e.children if isinstance(c, str)) for e, _, _ in order]
    own = [0 if e.number in low else n for (e, _, _), n in zip(order, full, strict=True)]
    whole = own.copy()
    for k in range(len(order) - 1, 0, -1):
        whole[order[k][1]] += whole[k]
    gone = []
    for (e, up, _), n in zip(order, whole, strict=True):
        e.noise = e.noise and 2 * n <= whole[0]
        gone.append(e.noise or (up >= 0 and gone[up]))
    stays = [k for k in range(len(order)) if not gone[k]]
    article, outside = (sum(own[k] for k in stays if order[k][2] == inside) for inside in (True, False))
    if not article:
        low = low - {e.number for e, _, inside in order if inside}
        article = sum(full[k] for k in stays if order[k][2])
    return low, article > 0 and ARTICLE_WEIGHT * article >= outside


def blocks(e: Element, low: frozenset[int] = frozenset(), only_article: bool | None = None) -> list[str]:
    """Text blocks in page order, without noise and without the strings of the elements numbered in ``low``."""
    out: list[str] = []
    parts: list[str] = []
    if only_article is None:
        low, only_article = weigh(e, low)

    def flush() -> None:
        text = WHITE.sub(" ", entities.unescape("".join(parts))).strip(" ")
        parts.clear()
        if text:
            out.append(text)

    todo: list[tuple] = [(e, not only_article, False)]
    while todo:
        node, inside, heading_only = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            if inside and not heading_only:
                parts.append(node)
            continue
        if node.noise:
            # the header of an article keeps its headings
            if not (node.tag == "header" and inside and only_article and not node.mark):
                continue
            heading_only = True
        if node.tag == "br":
            if inside:
                parts.append(" ")
            continue
        if node.tag in HEADINGS:
            heading_only = False
        inside = inside or (only_article and node.article)
        block = node.tag in BLOCKS
        if block:
            flush()
            todo.append((None, False, False))
        bare = node.number in low
        todo.extend((c, inside, heading_only) for c in reversed(node.children) if not (bare and isinstance(c, str)))
    flush()
    return out


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def elements(root: Element) -> list[tuple[int, int, int, int, bool, int, int]]:
    """``(number, path, style, content, removable, place, size)`` of every element that is no noise or noise by words alone.

    ``style`` is the sequence of child elements, ``content`` the text of the element's own block (0 if it has none), ``size`` its
    length. The path of a child is its parent's path and style and its place. ``place`` is where the element lies: ``PLAIN``,
    ``MARKED`` as noise, or ``ARTICLE``. Numbers count elements in page order.
    """
    out: list[tuple[int, int, int, int, bool, int, int]] = []
    root.path = _hash("root")
    todo = [(root, PLAIN)]
    while todo:
        e, place = todo.pop()
        kids = [c for c in e.children if not isinstance(c, str) and not c.noise and c.tag not in VOID]
        style = _hash(*(f"{c.tag}.{c.mark}" for c in kids))
        own = WHITE.sub(" ", "".join(c for c in e.children if isinstance(c, str))).strip(" ")
        e.number = len(out)
        if e.noise:
            place = MARKED
        elif e.article and place == PLAIN:
            place = ARTICLE
        out.append((e.number, e.path, style, _hash("text", own) if own else 0, not (e is root or e.tag in ("html", "body")), place, len(own)))
        for k, c in enumerate(kids):
            c.path = _hash(e.path, style, k, c.tag, c.mark)
        # what is marked as noise comes and goes between pages, so it is no part of the style
        marked = [c for c in e.children if not isinstance(c, str) and c.noise and c.named and c.tag not in VOID]
        for k, c in enumerate(marked):
            c.path = _hash(e.path, "marked", k, c.tag, c.mark)
        below = [c for c in e.children if not isinstance(c, str) and c.tag not in VOID and (c.named or not c.noise)] if marked else kids
        todo.extend((c, place) for c in reversed(below))
    return out


def page_hash(found: list[tuple[int, int, int, int, bool, int, int]]) -> int:
    """The same for copies of a page: of the texts of its article if that is the main text, else of texts and paths.

    What is marked as noise may differ between copies, unless most of the page lies there.
    """
    size = [0, 0, 0]
    for *_, place, n in found:
        size[place] += n
    if size[ARTICLE] and ARTICLE_WEIGHT * size[ARTICLE] >= size[PLAIN]:
        return _hash("article", *(content for _, _, _, content, _, place, _ in found if content and place == ARTICLE))
    most = size[MARKED] > size[PLAIN] + size[ARTICLE]
    return _hash("page", *(f"{path} {content}" for _, path, _, content, _, place, _ in found if content and (most or place != MARKED)))


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


ELEMENT_ROWS = "row long, number int, element long, style long, content long, removable boolean"
PAGE_ROWS = ELEMENT_ROWS + ", page long, place int"


def _parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for row, url, source in zip(batch["row"], batch["url"], batch["html"], strict=True):
            if not source:
                continue
            host, found = _host(url), elements(parse(source))
            page = page_hash(found)
            rows += [(row, number, _hash(host, path), style, content, removable, page, place) for number, path, style, content, removable, place, _ in found]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_ROWS.split(", ")])


def importance(nodes: DataFrame) -> DataFrame:
    """``(element, importance, pages)`` of every element on at least ``LEAST_PAGES`` pages of its host.

    The presentation's entropy over styles and the mean importance of the element's distinct text blocks, both in [0, 1],
    the latter for the larger part; an element without text of its own has nothing to lose and counts as one.
    """
    pages = nodes.groupBy("element").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)

    def summed(column: str, value) -> DataFrame:
        counts = nodes.where(F.col(column) != 0).groupBy("element", column).agg(F.count("*").alias("n")).join(pages, "element")
        return counts.groupBy("element").agg(value)

    share = F.col("n") / F.col("pages")
    styles = summed("style", F.sum(-share * F.log(share) / F.log("pages")).alias("presentation"))
    contents = summed("content", F.avg(1 - F.log("n") / F.log("pages")).alias("varied"))
    own = pages.join(styles, "element", "left").join(contents, "element", "left")
    presentation = F.coalesce("presentation", F.lit(0.0))
    return own.select(
        "element", "pages",
        F.when(F.col("varied").isNull(), F.lit(1.0)).otherwise((1 - DECAY) * presentation + DECAY * F.col("varied")).alias("importance"),
    )


def _extract_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for source, low in zip(batch["html"], batch["low"], strict=True):
            if not source:
                texts.append("")
                continue
            root = parse(source)
            if low is not None and len(low):
                elements(root)  # numbers the elements
                texts.append("\n".join(blocks(root, frozenset(int(x) for x in low))))
            else:
                texts.append("\n".join(blocks(root)))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    ).withColumn("row", F.xxhash64("page_id", "url", "html"))
    nodes = settle(rows.select("row", "url", "html").mapInPandas(_parse_rows, PAGE_ROWS))
    # copies are one page of the site
    counted = nodes.groupBy("element", "page").agg(F.min(F.struct("style", "content")).alias("one")).select("element", "one.*")
    weak = importance(settle(counted)).where(F.col("importance") < threshold).select("element", "importance")
    prior = F.when(F.col("place") == ARTICLE, ARTICLE_PRIOR).otherwise(0.0)
    low = settle(
        nodes.where("removable").join(weak, "element").where(prior + (1 - prior) * F.col("importance") < threshold).groupBy("row").agg(F.collect_set("number").alias("low"))
    )
    if (low.agg(F.sum(F.size("low") + 1)).first()[0] or 0) <= BROADCAST_NUMBERS:
        low = F.broadcast(low)
    return rows.join(low, "row", "left").select("page_id", "url", "html", "low").mapInPandas(_extract_rows, "page_id long, url string, text string, n_chars long")
