"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Elements that never hold the article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments of readers)
are stripped with their text and leave a gap of empty lines. The lengths of lines are then
summed over sliding windows. Text runs until it dives, where a window is empty, and surges
in the first window that reaches a threshold. Characters of links do not count, so a menu
without a telling name is no text.

The text surges and dives where the innermost element that holds all windows of twice the
threshold begins and ends: all its lines are kept, also short ones between or behind gaps,
and what stands before or behind that element is left out, whatever it is called. An element
with a single line is taken with the one around it. Where only the body holds them all, text
goes from the run that surges first to the last dive of the body, and runs before it count
only if the gap between is inside an element that holds both.

An ``article`` or ``main`` element binds its lines: no gap opens inside it, and it surges at
its first line. Such elements come before others, however short: the fullest and its siblings
(in the same element) that surge are the article. Inside them names of classes drop an
element only if the whole name says what it is (``ad``, not ``ad-history``), and never a
paragraph or heading. If nothing reaches the threshold, the fullest window of the page is the
measure.

Null and empty pages have an empty text. Pages are handled one by one and whole; repeated
pages give repeated rows, and other columns are left out.
"""

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import short_batches

# Element names by what they are to a page.
RAW = "script style noscript template textarea title iframe svg math object select".split()
ASIDE = "nav footer aside form button dialog menu head datalist".split()
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
# Elements that hold blocks of a text together and are closed by their own tag.
HOLDERS = ARTICLE | set("div section center blockquote table td ul ol dl figure details fieldset".split())
# Stripped elements that an article never stands in, so one that opens there ends them.
LEFT_OPEN = {"nav", "header", "head", "menu", "button"}
ROLES = (
    "navigation banner contentinfo complementary search dialog alertdialog form menu menubar"
).split()
# Words of class and id names that mark what is not the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment "
    "comments disqus respond replies pagination pager widget copyright disclaimer".split()
)

# Elements that a class does not drop inside an article.
TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")


def is_aside(name: str, attributes: str, within: bool) -> bool:
    """Does the element hold something else than the article? ``within``: inside an article
    element, where a header belongs to the article."""
    if name in ASIDE or name == "header" and not within:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        kind, value = found[1].lower(), (found[2] or "").strip("\"'")
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
            return True
        if kind == "role":
            if value.lower() in ROLES:
                return True
        elif kind in ("class", "id"):
            for token in value.split():
                if within:
                    if token.lower() in MARKS and name not in TEXT:
                        return True
                    continue
                parts = [p.lower() for p in _NAME_PART.findall(token)]
                if parts and (parts[0] in MARKS or parts[-1] in MARKS):
                    return True
    return False


@dataclass
class Holder:
    """An open element that holds blocks, its first line, and the line where it ends."""

    name: str
    begin: int
    end: float = math.inf
    around: "Holder | None" = None


@dataclass
class Line:
    """``article``: number of the article element around it, 0 for none. ``holder``: the
    innermost element, if any but the body, that a gap or the article element is in.
    ``within``: the innermost element around a line. ``size``: characters outside of links."""

    text: str
    article: int = 0
    holder: Holder | None = None
    within: Holder | None = None
    size: int = 0


def lines(page: str, gap: int) -> list[Line]:
    """Text of each block in page order. What was stripped outside of article elements, and
    their ends, leave ``gap`` empty lines."""
    out: list[Line] = []
    holders: list[Holder] = []  # open
    names = Counter()  # of these
    text: list[str] = []
    linked: list[str] = []  # what of it stands in a link
    link = False
    stack: list[str] = []  # elements open inside a stripped one, from that one on
    inside: list[str] = []  # article elements open
    article, opened, at = 0, 0, 0
    around = None  # the element that the article element is in

    def end_block(empty: int = 0) -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                within = holders[-1] if holders else None
                size = max(0, len(line) - len(_SPACE.sub(" ", html.unescape("".join(linked)))))
                out.append(Line(line, article, around if article else None, within, size))
            text.clear()
            linked.clear()
        if not article:
            out.extend([Line("", 0, holders[-1] if holders else None)] * empty)

    def close(name: str) -> None:
        while names[name]:
            last = holders.pop()
            last.end = len(out)
            names[last.name] -= 1
            if last.name == name:
                break

    found = _TOKEN.search(page)
    while found:
        if not stack and found.start() > at:
            text.append(page[at : found.start()])
            if link:
                linked.append(text[-1])
        at = found.end()
        closing, name, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if name == "a":
            link = not closing
        alone = name in VOID or attributes.endswith("/") and name not in ARTICLE
        if stack and not closing:
            if name == "body" or name in ARTICLE and stack[0] in LEFT_OPEN:
                stack.clear()  # the page forgot to close it
        if not name:
            if found[0].startswith("<![CDATA[") and not stack:
                text.append(html.escape(found[0][9:].removesuffix("]]>")))
        elif name in RAW and not closing and not alone:
            if not stack:
                end_block()
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        elif stack:
            if not closing:
                if not alone:
                    stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
            elif name in ("body", "html"):
                stack.clear()
        elif closing:
            if name not in INLINE:
                end_block()
                if name in HOLDERS:
                    close(name)
                if name in ARTICLE and inside:
                    inside.pop()
                    if not inside:
                        article = 0
                        end_block(gap)
        elif name in ARTICLE and not is_aside(name, attributes, bool(inside)):
            end_block(gap)
            inside.append(name)
            if not article:
                opened += 1
                article = opened
                around = holders[-1] if holders else None
            holders.append(Holder(name, len(out), around=holders[-1] if holders else None))
            names[name] += 1
        else:
            aside = is_aside(name, attributes, bool(inside))
            if aside or name not in INLINE:
                end_block(gap * aside)
            if aside and not alone:
                stack.append(name)
            elif name in HOLDERS and not alone:
                holders.append(Holder(name, len(out), around=holders[-1] if holders else None))
                names[name] += 1
        found = _TOKEN.search(page, at)
    if not stack:
        text.append(page[at:])
    end_block()
    return out


def runs(found: list[Line], window: int) -> list[tuple[int, int]]:
    """Stretches of lines from text on to where the text dives: the next ``window`` lines
    are empty."""
    out, start, empty = [], None, 0
    for n, line in enumerate(found):
        empty = 0 if line.text else empty + 1
        if line.text and start is None:
            start = n
        elif empty == window and start is not None:
            out.append((start, n + 1 - window))
            start = None
    if start is not None:
        out.append((start, len(found)))
    return out


def body_start(found: list[Line], spans: list[tuple[int, int]], first: int, surge: int) -> int:
    """The first line that counts if ``spans[first]`` is the run that surges, at line
    ``surge``: earlier runs do if an element holds the surge, the gap and a line of theirs."""
    start = spans[first][0]
    for before, end in reversed(spans[:first]):
        gap = (line.holder for line in found[end:start])
        if not any(h and h.begin < end and h.end > surge for h in gap):
            break
        start = before
    return start


def chain(holder: Holder | None) -> list[Holder]:
    """The elements around a line, the outermost first."""
    out = []
    while holder:
        out.append(holder)
        holder = holder.around
    return out[::-1]


def sums(sizes: list[int], window: int) -> list[int]:
    return [sum(sizes[n : n + window]) for n in range(len(sizes))]


def dense_element(found: list[Line], window: int, level: int) -> Holder | None:
    """The innermost element that holds all windows that reach ``level``, or the fullest one
    if none does. Windows end where the element around their lines does. None if only the
    body holds them."""
    each, at = [], 0
    while at < len(found):
        if not found[at].text:
            at += 1
            continue
        end = at + 1
        while end < len(found) and found[end].text and found[end].within is found[at].within:
            end += 1
        blocks = sums([line.size for line in found[at:end]], window)
        each.append((max(blocks), found[at].within))
        at = end
    level = min(level, max(block for block, _ in each))
    strong = [holder for block, holder in each if block >= level]
    common = None
    for n, holder in enumerate(strong):
        own = chain(holder)
        common = own if n == 0 else [a for a, b in zip(common, own) if a is b]
    while common:
        inside = found[common[-1].begin : min(common[-1].end, len(found))]
        if sum(bool(line.text) for line in inside) > 1:
            return common[-1]
        common.pop()
    return None


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """``window``: lines per block; ``surge``: characters from which a block is text."""
    found = lines(page or "", window)
    if not any(line.text for line in found):
        return ""
    if not any(line.size for line in found):  # links alone
        for line in found:
            line.size = len(line.text)
    sizes = [line.size for line in found]
    blocks = sums(sizes, window)
    level = min(surge, max(blocks))
    spans = runs(found, window)
    kept = []
    for k, (start, end) in enumerate(spans):
        above = next((n for n in range(start, end) if blocks[n] >= level), None)
        if above is not None:
            kept.append((k, above))
    articles = [spans[k] for k, _ in kept if found[spans[k][0]].article]
    articles = articles or [span for span in spans if found[span[0]].article]
    if articles:
        fullest = max(articles, key=lambda run: (sum(sizes[run[0] : run[1]]), -run[0]))
        around = found[fullest[0]].holder
        parts = [run for run in articles if found[run[0]].holder is around]
    elif element := dense_element(found, window, 2 * surge):
        parts = [(element.begin, int(min(element.end, len(found))))]
    else:
        first, above = kept[0]
        # The line of text in the window that surges.
        above = max(range(above, min(above + window, spans[first][1])), key=lambda n: sizes[n])
        parts = [(body_start(found, spans, first, above), len(found))]
    return " ".join(line.text for start, end in parts for line in found[start:end] if line.text)


def page_texts(
    pages: DataFrame, html_col: str = "html", window: int = 3, surge: int = 80
) -> DataFrame:
    """Columns page_id, url, text and n_chars (code points)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, window, surge) for page in batch], dtype=object)

    rows = short_batches(pages).select("page_id", "url", F.col(html_col).alias("__html"))
    return rows.select("page_id", "url", text("__html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
