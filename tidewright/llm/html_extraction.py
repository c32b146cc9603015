"""Main text of web pages by two passes over their blocks.

A page becomes a sequence of blocks: runs of text between tags that start a new line, each with its words, its words known as stop words,
its characters inside links, and where it stands. The first pass decides blocks by link density, length and stop-word density; short
ones stay open, and the second pass gives them the label of their nearest decided neighbour. A page is one row and is read in one
forward scan."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of the languages that pages are in; another set is a parameter.
STOP_WORDS = frozenset(
    """
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there
der die das und ist nicht ein eine zu den mit von sich auf für im dem auch als an nach wie aus bei oder nur noch sind war wird dass über um
le la les de des et un une du en est que qui dans pour par sur pas plus au aux avec ce se il elle sont mais ou nous vous son sa ses cette été
el los las del y que en una por con para es su al lo como más pero sus este ha porque muy sin sobre también hasta hay donde desde nos entre
""".split()
)
#: Elements without content, with raw text, that are never text of a page, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("script style textarea title noscript iframe noembed noframes head template nav aside form footer button select option datalist svg math canvas object audio video map dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class and id names, and roles, that tell what a page shows beside its article.
BESIDE = frozenset(
    """
ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent
gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing shares social sidebar sidebars aside rail related recommended
recommendations breadcrumb breadcrumbs menu menus nav navbar navigation navigations footer footers masthead topbar toolbar pagination pager paging login search
skip alert disclaimer copyright comment comments commentlist disqus respond replies paywall hidden
""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist replies reply respond disqus".split())
WRAPPERS = frozenset("content main article post entry story body page container wrapper text".split())
MAIN = frozenset("content main article post entry story main-content article-body article-content post-content post-body entry-content story-body".split())
NEGATED = frozenset("no without with has not hide show".split())

_MARKED = re.compile(r"<(?:article|main)[\s>]", re.I)
_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![A-Za-z]))|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*))")
#: The rest of a tag: quotes count after `=` only, and one that isn't closed counts as any character.
_REST = re.compile(r"""(?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    landmark: int
    beside: bool
    good: bool | None = None


@dataclass
class _Open:
    """An open element: whether it or one around it is no content, the article or main element it's in (0: none), and links around."""

    name: str
    beside: bool
    landmark: int
    linked: bool


def _is_beside(name: str, attributes: dict[str, str], landmark: int) -> bool:
    """Whether an element shows something else than the page's article."""
    if name in NEVER or (name == "header" and not landmark):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    known = COMMENTS if name in ("article", "main") else BESIDE
    if name in ("html", "body"):
        return False
    classes = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if any(c.lower() in WRAPPERS for c in classes):
        known = COMMENTS
    for token in classes:
        words = [w.lower() for w in _PARTS.findall(token)]
        if any(w in known and not (i and words[i - 1] in NEGATED) for i, w in enumerate(words)):
            return True
        if name != "article" and not landmark and words[-1:] == ["header"]:
            return True
    return False


def _wraps(attributes: dict[str, str]) -> bool:
    """Whether an element's names are those of an article's wrapper, as pages without article and main have them."""
    return any(c.lower() in MAIN for c in f"{attributes.get('class', '')} {attributes.get('id', '')}".split())


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order. Tags that aren't closed end with the element around them; a paragraph or a list item
    ends where the next begins; a tag that never ends, as any comment or script that doesn't, takes the rest of the page."""
    out: list[Block] = []
    marked = bool(_MARKED.search(page))
    stack = [_Open("", False, 0, False)]
    parts: list[tuple[str, bool]] = []
    heading, landmarks, at, n, opened = False, 0, 0, len(page), Counter()

    def flush() -> None:
        nonlocal heading
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(t for t, a in parts if a)).split()))
                out.append(Block(text, linked, heading, stack[-1].landmark, stack[-1].beside))
            parts.clear()
        heading = False

    def close(name: str, within: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
            if stack[i].name == name:
                opened.subtract(e.name for e in stack[i:])
                del stack[i:]
                return
            if stack[i].name in within:
                return

    while at < n:
        start = page.find("<", at)
        if start < 0:
            parts.append((page[at:], stack[-1].linked))
            break
        if start > at:
            parts.append((page[at:start], stack[-1].linked))
        m = _TAG.match(page, start)
        if not m:
            parts.append(("<", stack[-1].linked))
            at = start + 1
            continue
        if m["comment"]:
            end = page.find("-->", start + 4) if not page.startswith(("<!-->", "<!--->"), start) else page.find(">", start) - 2
            at = n if end < 0 else end + 3
            continue
        if m["other"]:
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        rest = _REST.match(page, m.end())
        if not rest:
            break
        end = rest.end()
        name, inside, at = m["name"].lower(), page[m.end() : end - 1], end
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append((" ", stack[-1].linked))
        if m["close"]:
            close(name)
            continue
        if name in VOID:
            continue
        if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
            close(name, frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        elif name in BLOCK:
            close("p", frozenset(("table", "td", "button", "object")))
        around = stack[-1]
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(inside)} if inside.strip(" /\n\t") else {}
        beside = around.beside or _is_beside(name, attributes, around.landmark)
        landmark = around.landmark
        if not beside and not landmark and (name in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody" or (not marked and _wraps(attributes))):
            landmarks += 1
            landmark = landmarks
        if name in HEADINGS:
            heading = True
        if name in RAW:
            ends = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = n if not ends else page.find(">", ends.start()) + 1 or n
            continue
        if inside.endswith("/") and name in ("svg", "path", "use"):
            continue
        opened[name] += 1
        stack.append(_Open(name, beside, landmark, around.linked or name == "a"))
    flush()
    return out


def _words(text: str) -> list[str]:
    return [_EDGES.sub("", w).lower() for w in text.split()]


def classify(blocks: list[Block], stop_words: frozenset, max_link: float, short: int, low: float, high: float) -> None:
    """Sets `good` of every block. First pass: a block beside the article, or mostly of links, is bad. In a page with an article,
    a main element or, without these, an element named like one, blocks out of it are bad, and a block of `short` characters within is good. Elsewhere a block of `short`
    characters is good from a stop-word density of `high`, or of `low` where the page has no stop words at all or the block is twice as
    long, else bad. Second pass: a shorter one gets the label of the nearest decided neighbour of its own article or, in a page
    without one, of the page; a heading looks ahead first, ties are good, an article's ends count as good neighbours, and
    without any a block is bad."""
    marked = any(b.landmark and not b.beside for b in blocks)
    page_words = page_stops = 0
    stops = []
    for b in blocks:
        words = _words(b.text) if not b.beside and not marked else []
        stops.append(sum(w in stop_words for w in words) / max(1, len(words)))
        page_words, page_stops = page_words + len(words), page_stops + stops[-1] * len(words)
    known = page_stops >= 0.02 * page_words
    for b, density in zip(blocks, stops):
        if b.beside or (marked and not b.landmark):
            b.good = False
        elif b.linked > max_link * len(b.text) and not (b.heading and b.landmark):
            b.good = False
        elif len(b.text) >= short and not b.heading:
            b.good = bool(b.landmark or not known or density >= (low if len(b.text) >= 2 * short else high))
    before, after = [None] * len(blocks), [None] * len(blocks)
    for order, found in ((range(len(blocks)), before), (range(len(blocks) - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            b = blocks[i]
            if not (b.beside and marked):
                if b.good is None:
                    found[i] = last.get(b.landmark)
                else:
                    last[b.landmark] = i
    open_blocks = [i for i, b in enumerate(blocks) if b.good is None]
    decided = []
    for i in open_blocks:
        x, y = before[i], after[i]
        if blocks[i].heading and y is not None:
            x = None
        near = [(abs(i - k), not blocks[k].good) for k in (x, y) if k is not None] + [(1, False)] * (blocks[i].landmark > 0 and None in (x, y))
        decided.append(bool(near) and not min(near)[1])
    for i, good in zip(open_blocks, decided):
        blocks[i].good = good


def main_text(page: str | None, stop_words: frozenset = STOP_WORDS, max_link: float = 0.5, short: int = 60, low: float = 0.08, high: float = 0.15) -> str:
    blocks = blocks_of(page or "")
    classify(blocks, stop_words, max_link, short, low, high)
    return "\n".join(b.text for b in blocks if b.good)


def extract_text(pages: DataFrame, html_column: str = "html", stop_words: frozenset = STOP_WORDS, max_link: float = 0.5, short: int = 60, low: float = 0.08, high: float = 0.15) -> DataFrame:
    """pages without html, with text and n_chars (code points): each page's main text, its blocks joined by line ends.

    A null or empty page has an empty text, and so has one without a block of content. References are decoded after tags are read;
    white space (Unicode) inside a block becomes one space. Rows that repeat are treated alike; other columns pass through, but those
    called text or n_chars, which are replaced. No row meets another, so there is no exchange."""
    at = next(i for i, name in enumerate(pages.columns) if name == html_column)
    # By position, so that names which differ in case only, or hold dots, are told apart.
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    others = {f"c{i}": name for i, name in enumerate(pages.columns) if i != at and name.lower() not in ("text", "n_chars")}

    @F.pandas_udf("string")
    def text_of(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in column:
            yield pages.map(lambda p: main_text(p, stop_words, max_link, short, low, high), na_action=None)

    found = plain.select(*others, text_of(F.col(f"c{at}").cast("string")).alias("text"))
    return found.select(*[F.col(c).alias(name) for c, name in others.items()], "text", F.length("text").cast("long").alias("n_chars"))
