"""HTML extraction by line-block distribution: markup is stripped into lines, text lengths are summed over sliding windows of lines, and the text
between a surge and the dive after it is kept.

Lines: a block element starts and ends a line; a container (div, section, list, table) leaves an empty line at each of its ends, so that what stands
beside an article is parted from it. Elements that hold no article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are told by their tag, role, class or id and leave empty lines only. Where a page marks its article (``article``, else ``main``, else a class
or id that says so), lines outside of it count as empty.

Distribution: a line counts the code points of its text that are not links (all of them within a marked article). Lines whose windows of ``WINDOW`` sum
to nothing part the page into rises. A rise surges if a window in it reaches ``SURGE`` code points, or the page's highest window where none does, or any
text at all where the article is marked. It begins at its first counting line and dives at its last; what lies between is kept whole.

Defined results: null and empty pages give an empty text; a tag that the page's end cuts off is dropped; elements that are never closed end with
their parents; where hints by class or id leave nothing of a page, they are ignored, then those by tag. White space is what Unicode calls so, a decoded
&nbsp; among it. Rows that repeat or lack an id are answered each; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import batch, bounded, by_bytes

WINDOW = 3
SURGE = 80

#: Elements without an article, by tag; a header or form that holds the article does not count.
NOISE_TAGS = frozenset("aside button canvas datalist dialog fieldset footer form head header iframe input label menu nav noscript object option script select style svg template textarea title video audio".split())
#: The same by a word of their class, id or role.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert alerts aside banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header login masthead menu menus modal nav navbar"
    " navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: Beside such a word a class says what the element holds or lacks, not what it is.
NOT_ITSELF = frozenset("has no with without".split())
#: A header of these belongs to the article.
TITLE_WORDS = frozenset("article entry headline post story title".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
CONTAINERS = frozenset("article aside body details div dl fieldset figure footer form header main nav ol section table tbody tfoot thead ul".split())
BLOCKS = CONTAINERS | frozenset("address blockquote br caption center dd dt figcaption h1 h2 h3 h4 h5 h6 hr html legend li option p pre summary td th tr".split())
#: What an opening tag ends if it is still open, and where the search for it stops.
ENDS = {"p": ({"p"}, CONTAINERS), "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"})}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_HINT = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _hints(attributes: str) -> set[str]:
    """Lower-case words of class, id, role and itemprop."""
    if "=" not in attributes:
        return set()
    return {w.lower() for m in _HINT.finditer(attributes) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")}


def _is_noise(tag: str, hints: set[str], in_main: bool, level: int) -> bool:
    """level 2 trusts tags and hints, 1 tags only, 0 but what never shows."""
    if level == 0:
        return tag in RAW or tag in ("head", "template", "noscript")
    if tag in NOISE_TAGS:
        return not (tag == "header" and in_main)
    if level == 1 or tag in ("html", "body", "main") or hints & NOT_ITSELF:
        return False
    found = hints & NOISE_WORDS
    if "header" in found and (in_main or hints & TITLE_WORDS):
        found = found - {"header"}
    return bool(found)


def _main_rank(tag: str, hints: set[str]) -> int:
    if tag == "article":
        return 3
    if tag == "main" or "articlebody" in hints or {"article", "body"} <= hints:
        return 2
    return 1 if hints & MAIN_WORDS and tag in CONTAINERS and tag != "body" else 0


def page_lines(page: str, level: int = 2) -> list[tuple[str, int, int]]:
    """(text, code points outside of links, rank of the article's mark) of each line; empty lines have an empty text. Linear in the page's length."""
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, whether it is noise, rank outside of it
    noise = rank = links = linked = 0

    def end_line(blanks: int = 0) -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - linked), rank))
            parts.clear()
        linked = 0
        lines.extend([("", 0, 0)] * blanks)

    def close(depth: int) -> None:
        nonlocal noise, rank, links
        while len(stack) > depth:
            tag, was_noise, outer = stack.pop()
            if tag in BLOCKS or was_noise:
                end_line(WINDOW if was_noise else tag in CONTAINERS)
            noise -= was_noise
            links -= tag == "a"
            rank = outer

    def put(text: str) -> None:
        nonlocal linked
        if text and not noise:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif after and after in "!?" or page.startswith("</", lt) and not page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif not (after == "/" or after.isascii() and after.isalpha()):
            put("<")
            at = lt + 1
        else:
            m = _TAG.match(page, lt)
            if m is None:
                break  # the page ends within a tag
            at, tag, hints = m.end(), m[2].lower(), set()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if any(s[0] == tag for s in stack[-64:]) else None
                if depth is not None:
                    close(depth)
                elif tag in BLOCKS:
                    end_line()
                continue
            if tag in ENDS or tag in CONTAINERS:
                ended, stop = ENDS.get(tag, ENDS["p"])
                for i in range(len(stack) - 1, max(-1, len(stack) - 64), -1):
                    if stack[i][0] in ended:
                        close(i)
                        break
                    if stack[i][0] in stop:
                        break
            hints = _hints(m[3])
            mark = _main_rank(tag, hints)
            is_noise = _is_noise(tag, hints, rank >= 2, level)
            if mark >= 2 and noise and not is_noise and all(t == "form" for t, n, _ in stack if n):
                stack[:] = [(t, False, k) for t, _, k in stack]  # a form around the whole page
                noise = 0
            if tag in BLOCKS or is_noise:
                end_line(WINDOW if is_noise else tag in CONTAINERS)
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else size
                if end:
                    gt = page.find(">", at)
                    at = size if gt < 0 else gt + 1
                continue
            stack.append((tag, is_noise, rank))
            if not (is_noise or noise):
                rank = max(rank, mark)
            noise += is_noise
            links += tag == "a"
    end_line()
    return lines


def between_surges(lines: list[tuple[str, int, int]]) -> str:
    """The lines from each surge to its dive, joined by a space."""
    top = max((mark for text, _, mark in lines if text), default=0)
    if top:
        counts = np.array([len(text) if mark == top else 0 for text, _, mark in lines], np.int64)
    else:
        counts = np.array([n for _, n, _ in lines], np.int64)
    at = np.flatnonzero(counts)
    if not len(at):
        return ""
    sums = np.convolve(counts, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of the window that starts at each line
    surge = 1 if top else min(SURGE, int(sums.max()))
    cuts = np.flatnonzero(np.diff(at) > WINDOW) + 1
    kept = []
    for rise in np.split(at, cuts):
        if sums[rise].max() >= surge:
            kept += [text for text, _, mark in lines[rise[0] : rise[-1] + 1] if text and mark == top]
    return " ".join(kept)


def main_text(page: str | None) -> str:
    for level in (2, 1, 0):
        if text := between_surges(page_lines(page or "", level)):
            return text
    return ""


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for b in (part for whole in batches for part in by_bytes(whole, 2)):
        found = [main_text(t) for t in b.column(2).to_pylist()]
        yield batch(_OUT, b.column(0), b.column(1), found, [len(t) for t in found])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page; one pass, nothing is shuffled."""
    rows = bounded(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
