"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures.

A page becomes a row of text blocks. Each has its number of words, the share of them inside links, the same of the
block before and the block after, and what the markup around it says (an article, a side part). A decision tree
trained on a small labelled table keeps the blocks of the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apidrift.llm.common import slices
from apidrift.llm.trees import Trees, decision_tree

#: Elements whose content is never text of the page.
UNREAD = "script style noscript template svg iframe object select textarea button title"
#: Those that run to the end of the page without their end tag. Of the others only the tag is passed over then.
RAW = frozenset("script style title textarea iframe".split())
#: Those that cannot hold one of their kind: another start tag before the end tag means that the first was left open.
SINGLE = frozenset("noscript select button".split())
UNREAD_END = {
    name: re.compile(rf"</{name}\s*>" + (rf"|(?=<{name}[\s/>])" if name in SINGLE else ""), re.IGNORECASE) for name in UNREAD.split()
}
#: Elements that stand apart; text runs on through all others.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold others, and whose end tag closes what is still open inside.
HOLDERS = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("br hr img input link meta wbr area base col embed source track".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements, roles and words of class or id that speak against what is inside.
SIDE_TAGS = frozenset(("aside", "dialog", "footer", "form", "menu", "nav"))
SIDE_ROLES = frozenset(("alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"))
SIDE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright dialog disclaimer footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion related "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies reply respond responses".split())
CONTENT_WORDS = frozenset("article content entry post story".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<unread>{UNREAD.replace(' ', '|')})(?=[\s/>])[^>]*+>|"
    r"<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-z/!?][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
#: Words of adverts; they hold for parts of a line as well.
ADVERT_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising promo sponsor sponsored".split())
#: Beside one of these in a class or id, a word tells a state of the page and not what stands inside: no-sidebar, has-comments.
STATE_WORDS = frozenset("allow closed disabled enabled has hide is no not off on open page with without".split())
#: A marked part with this share of what stands outside of all such parts is a side part; with less outside, it is the page.
OUTSIDE_SHARE = 0.2
#: Longest line that a note of rights can be; inside an article such a line is its own.
RIGHTS_WORDS = 25
RIGHTS = re.compile(r"©|copyright\s*(©|\(c\)|\d{4})|\(c\)\s*\d{4}", re.IGNORECASE)
#: Whole attributes, so that neither parts of other names nor values are read as names.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?|\"[^\"]*\"|'[^']*'")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    #: 1 inside side parts, 2 inside reader comments.
    side: int
    article: bool
    content: bool
    heading: bool
    #: The elements around whose class or id speaks against it, outermost first.
    marks: tuple[int, ...] = ()


@dataclass
class _Open:
    name: str
    side: int
    article: bool
    content: bool
    marks: tuple[int, ...] = ()


def _attributes(rest: str) -> dict[str, str]:
    """Attributes by lower-case name; of one given twice the first counts."""
    found: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(rest) if rest.strip() else ():
        if key:
            found.setdefault(key.lower(), (value or "").strip("\"'"))
    return found


def _named_words(found: dict[str, str]) -> set[str]:
    """Words of class and id, without names that tell a state."""
    words: set[str] = set()
    for key in ("class", "id"):
        for name in found.get(key, "").split():
            own = {w.lower() for w in WORD.findall(name)}
            if not own & STATE_WORDS:
                words |= own
    return words


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def _opened(name: str, rest: str, around: _Open, number: int) -> _Open:
    """What an element makes of the context around it; ``number`` tells it from others."""
    found = _attributes(rest)
    words, role = _named_words(found), found.get("role", "").lower()
    article = name in ("article", "main") or role in ("article", "main")
    side, marks = around.side, around.marks
    if article and side < 2:
        side, marks = 0, ()  # an article is no part of a side element that was left open or wraps it
    if name in SIDE_TAGS or _hidden(found) or role in SIDE_ROLES:
        side = max(side, 1)
    elif words & SIDE_WORDS:
        marks = (*marks, number)
    if name == "header" and not (around.article or article):
        side = max(side, 1)
    if words & COMMENT_WORDS and name != "body":
        side = 2
    return _Open(name, side, around.article or article, around.content or bool(words & CONTENT_WORDS), marks)


def _with_side_parts(blocks: list[Block]) -> list[Block]:
    """Blocks in marked parts as side blocks, but for a part that wraps nearly all that is left of the page."""
    void: set[int] = set()
    for mark in sorted({m for b in blocks for m in b.marks}):
        plain = [b for b in blocks if not b.side]
        held = sum(b.words for b in plain if mark in b.marks)
        outside = sum(b.words for b in plain if void.issuperset(b.marks))
        if outside < OUTSIDE_SHARE * held:
            void.add(mark)
    for block in blocks:
        if not void.issuperset(block.marks):
            block.side = max(block.side, 1)
    return blocks


def _tokens(html: str) -> Iterator[re.Match]:
    """Tags and texts of a page without what stands in unread elements."""
    at, open_ended = 0, set()
    while at < len(html):
        found = TOKEN.match(html, at)
        at, name = found.end(), (found["unread"] or "").lower()
        if not name:
            yield found
        elif name not in open_ended and not (name == "svg" and html.endswith("/>", 0, at)):
            end = UNREAD_END[name].search(html, at)
            if end:
                at = end.end() if end[0] else at
            elif name in RAW:
                return
            else:
                open_ended.add(name)


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in its order; white space is one space, character references are decoded."""
    blocks: list[Block] = []
    stack = [_Open("", 0, False, False)]
    pieces: list[tuple[str, bool]] = []
    link = heading = False
    muted, depth, number = "", 0, 0
    only_article = re.search(r"<article\b", html, re.IGNORECASE) is not None

    def close_block():
        nonlocal link
        if not pieces:
            return
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            linked = len("".join(t if inside else " " for t, inside in pieces).split())
            at = stack[-1]
            words = text.count(" ") + 1
            rights = words <= RIGHTS_WORDS and not (at.article or at.content) and RIGHTS.match(text) is not None
            side = max(at.side, int(rights))
            blocks.append(Block(text, words, linked, side, at.article, at.content, heading, at.marks))
            link = False
        pieces.clear()

    for found in _tokens(html):
        text, name = found["text"], found["name"]
        if text:
            if muted:
                continue
            pieces.append((unescape(text), link))
            continue
        if not name:
            continue
        name, closing = name.lower(), bool(found["close"])
        if name == "br":
            pieces.append((" ", link))
        elif name == "a":
            link = not closing
        elif name not in BLOCKS:
            # Hidden or advertising parts of a line, up to their end tag or the end of the block.
            if muted:
                depth += (name == muted) * (-1 if closing else 1)
                muted = muted if depth else ""
            elif not closing and name not in VOID and found["rest"].strip() and not found["rest"].rstrip().endswith("/"):
                own = _attributes(found["rest"])
                if _hidden(own) or _named_words(own) & ADVERT_WORDS:
                    muted, depth = name, 1
        else:
            muted, depth = "", 0
            close_block()
            number += 1
            heading = name in HEADINGS and not closing
            if name in HOLDERS:
                if not closing:
                    if name == "li" and stack[-1].name == "li" or name in ("td", "th", "tr") and stack[-1].name == name:
                        stack.pop()
                    around = stack[-1]
                    opened = _opened(name, found["rest"], around, number)
                    if name == "main" and only_article:
                        opened.article = around.article
                    stack.append(opened)
                elif any(x.name == name for x in stack):
                    while stack.pop().name != name:
                        pass
            elif not closing and found["rest"].strip():
                # Marks on a paragraph or heading hold for it alone.
                marked = _opened(name, found["rest"], stack[-1], number)
                if marked.side > stack[-1].side or marked.marks != stack[-1].marks:
                    while stack[-1].name == "p":
                        stack.pop()
                    stack.append(_Open("p", marked.side, marked.article, marked.content, marked.marks))
                    continue
            if stack[-1].name == "p":
                stack.pop()
    close_block()
    return _with_side_parts(blocks)


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "side", "article", "content", "heading")


def features(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` per block. ``article`` is 1 inside an article, -1 outside of the page's, 0 where it has none."""
    own = np.array([(b.words, b.linked / b.words) for b in blocks]).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    outside = -1 if any(b.article and not b.side for b in blocks) else 0
    marks = np.array([(b.side, 1 if b.article else outside, b.content, b.heading) for b in blocks], float).reshape(-1, 4)
    return np.concatenate([own, before[: len(own)], after[: len(own)], marks], axis=1)


#: The labelled table: pages as rows of blocks, a block as ``label words linked marks``. Marks: a in an article, c in an
#: element called content, h heading, s in a side part, r in reader comments.
LABELLED = """
0 1 1 s|0 1 1 s|0 2 2 s|0 9 0 s|1 7 0 ah|1 6 0 a|1 80 0 a|1 55 2 a|1 1 0 a|1 40 0 a|0 9 0 s|0 6 2 s
0 1 1 s|0 3 3 s|1 5 0 ah|1 120 0 a|1 2 0 a|1 3 0 ah|1 30 30 a|1 90 1 a|0 30 4 as|1 60 0 a|0 12 0 sr|0 70 0 sr|0 45 1 sr|0 8 0 s
0 4 0 s|0 22 1 s|0 60 0 s|1 4 0 a|1 25 3 a|1 3 0 a|0 8 8 as|0 5 5 as|1 33 0 a|0 2 2 |0 14 0 |0 40 0 
0 1 1 |0 2 2 |0 1 1 |1 8 0 h|1 60 1 |1 45 0 |1 12 0 |1 70 3 |0 3 3 |0 2 2 |0 6 1 |0 4 0 
0 2 2 |0 2 2 |0 3 1 |1 5 0 ch|1 40 0 c|1 3 0 c|1 90 2 c|1 4 0 c|1 50 0 c|0 18 0 s|0 2 2 |0 5 0 
0 1 1 s|0 2 2 s|1 6 0 h|1 18 0 |1 70 0 |1 25 2 |0 30 0 s|0 50 0 r|0 35 0 r|0 9 0 s
0 1 1 |0 1 1 |0 5 4 |0 3 3 |0 2 0 |0 4 4 |0 6 5 |0 3 3 |0 2 2 |0 7 6 
0 1 1 s|1 3 0 ah|1 2 0 a|1 5 5 a|1 4 0 a|1 1 0 a|0 4 0 |0 90 0 |0 20 20 |0 7 0 s
0 1 1 s|0 6 0 s|1 6 0 ah|1 6 0 a|0 9 0 s
0 60 0 s|0 50 0 s|1 9 0 h|1 35 0 |1 50 0 |1 45 5 |1 9 0 |1 30 0 |0 4 1 |0 5 5 
1 6 0 |1 40 0 |1 20 0 |1 5 0 h|1 60 0 
1 5 0 c|1 7 0 c|1 6 6 c|1 30 0 c|0 4 4 cs|0 12 0 cs|0 30 0 cr
0 1 1 |0 1 1 s|1 1 0 ch|1 3 0 c|1 22 0 c|1 1 0 c|0 3 0 sr|0 2 0 s
1 7 0 
1 2 0 h|1 9 0 
1 1 0 
1 3 0 h|1 2 0 |1 5 0 |1 1 0 
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED.strip("\n").split("\n"):
        blocks = []
        for block in page.split("|"):
            label, words, linked, *marks = block.split()
            marks = marks[0] if marks else ""
            side = 2 if "r" in marks else int("s" in marks)
            blocks.append(Block("", int(words), int(linked), side, "a" in marks, "c" in marks, "h" in marks))
            labels.append(int(label))
        rows.append(features(blocks))
    return np.concatenate(rows), np.array(labels)


@lru_cache(maxsize=1)
def default_tree() -> Trees:
    return decision_tree(*labelled_table(), depth=6)


def main_text(html: str | None, tree: Trees) -> str:
    """The kept blocks in page order, one per line."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    kept = tree.margin(features(blocks)) >= 0.5
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract_text(pages: DataFrame, tree: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page; ``n_chars`` counts code points.

    Null and empty pages, and pages without text, have an empty text. Repeated rows give repeated rows, null ids and
    urls stay null, an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    tree = tree or default_tree()

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(html, tree) for html in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([narrow.schema["id"], narrow.schema["url"], *T.DataType.fromDDL("text string, n_chars bigint").fields])
    return narrow.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
