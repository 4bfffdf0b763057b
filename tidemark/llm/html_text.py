"""Main text of web pages by two passes over their blocks.

First pass: the page is cut into blocks of text at block-level tags. What is hidden, navigation, a menu or a dialog is dropped; the
other blocks are judged by link density, length and the share of stop words: good, bad, or undecided. Where ``article`` or ``main``
elements hold the page's text, only their blocks count, and one with few stop words (a table, say) is undecided, not bad.
Second pass: undecided blocks take the label of the nearest decided blocks; where the two sides differ, the
nearer one, and good on a tie. A page with no decided block keeps its undecided ones if they hold no links.

Forms, headers, footers, asides, and elements whose class, id or role has a part that names such things (``comment-body``, ``ad-slot``,
``sidebar-left``) are evidence, not a verdict: they go if there is an article beside them, but where what stands outside of them all
is little against one of them, this one holds the page (a page in one form, ``class="main sidebar"`` around the article) and stays, and
what is named within it is weighed in the same way. ``has-sidebar`` and the like name a state and say nothing.

Stop words are of four languages. Where they can't tell (a block mostly in letters outside Latin script, or a
page on whose longer blocks they are rare), link density and length decide alone.

The page is read by a scanner of tags, comments and raw text elements that takes broken markup as it
comes: tags left open, cut-off pages, stray ends. Its work is in proportion to the page's length.

Defined results: null html counts as empty, and gives an empty text. Rows are treated one by one, so
repeated rows give repeated results; an empty table gives no rows. Columns other than the three are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names of HTML, by how they act here.
RAW = frozenset("script style noscript template iframe svg math object canvas video audio select textarea button head title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav menu dialog".split())
DOUBTFUL = frozenset("header footer aside form fieldset".split())
MAIN = frozenset(["article", "main"])
NEVER_ROLES = frozenset("navigation dialog alertdialog menu menubar toolbar".split())
DOUBTFUL_ROLES = frozenset("banner contentinfo complementary search form alert".split())
#: Parts of ids and classes, between other characters than letters and digits.
DOUBTFUL_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising adsense alert alerts banner breadcrumb breadcrumbs cc comment comments commentlist consent cookie "
    "cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination pager popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags toolbar widget widgets".split()
)
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "das dem den der des die ein eine einen einer er es für ich im ist mit nicht sich sie sind und von war wie zu auf als auch "
    "au aux avec ce cette dans de des du elle en est et il je la le les mais ne nous ou par pas pour qui que sa se son sur un une vous "
    "al como con de del el ella en es la las lo los más no para pero por que se sin su una un y".split()
)

#: An article's own header holds its title.
TITLE_NAMES = frozenset(["header", "masthead"])
#: An article element that is named so isn't the page's article.
NOT_MAIN_NAMES = frozenset("ad ads comment comments promo related replies reply sponsored teaser".split())

#: Beside a name these say what the element's surroundings have.
STATES = frozenset("has have no not with without is show hide hidden enable enabled disable disabled".split())
STATE = "state"

#: A doubtful element holds the page if it has so many times as much good text as there is outside, and there is less than ENOUGH; more times beside text in an article element.
TIMES, TIMES_IN_MAIN, ENOUGH = 4, 10, 400

#: A block with at least this share of its characters in links is bad.
MAX_LINKS = 0.3
#: A block of fewer characters is too short to judge by its words.
SHORT = 60
STOP_LOW, STOP_HIGH = 0.08, 0.2
#: In an article, a paragraph with so many characters outside of its links isn't a list of links.
LEAST_WORDING = 25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(id|class|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")


def _named(value: str, names: frozenset[str]) -> bool | str:
    """Whether one of the names in an id or class has a part among ``names``; STATE if it only names a state."""
    found: bool | str = False
    for name in value.split():
        parts = _PART.findall(_HUMP.sub("-", name).lower())
        if not names.isdisjoint(parts):
            if STATES.isdisjoint(parts):
                return True
            found = STATE
    return found


def _last(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names ends in a part among ``names``."""
    return any((parts := _PART.findall(name)) and parts[-1] in names for name in value.lower().split())


def _kind(tag: str, attributes: str, main: int) -> bool | str | None:
    """Of an element: True if it is never article text, False if it is doubtful, STATE if so should it be mostly links, None if nothing is against it."""
    if tag in NEVER:
        return True
    doubtful: bool | str = tag in DOUBTFUL and not (main and tag in TITLE_NAMES)
    if attributes and tag not in ("body", "html"):
        if _HIDDEN.search(attributes):
            return True
        names = DOUBTFUL_NAMES - TITLE_NAMES if main else DOUBTFUL_NAMES
        for name, value in _NAMES.findall(attributes):
            value = value.strip("\"'")
            if name.lower() == "role":
                roles = _PART.findall(value.lower())
                if not NEVER_ROLES.isdisjoint(roles):
                    return True
                doubtful = doubtful or not DOUBTFUL_ROLES.isdisjoint(roles)
            else:
                own = _last(value, NOT_MAIN_NAMES) if tag in MAIN else _named(value, names)
                doubtful = True if own is True else doubtful or own
    return STATE if doubtful == STATE else False if doubtful else None


class Block:
    __slots__ = ("doubt", "label", "linked", "main", "text")

    def __init__(self, text: str, linked: int, main: int, doubt: int = 0):
        self.text, self.linked, self.main, self.doubt, self.label = text, linked, main, doubt, None


def blocks(page: str, around: list[int], states: set[int]) -> Iterator[Block]:
    """The page's blocks outside of what is never article text, in order.

    ``main``: 0, or the number of the article or main element around; ``doubt``: 0, or that of the innermost doubtful element around.
    ``around`` (with one 0 to begin with) gets for each doubtful element the number of the one around it, ``states`` those named by a state only.
    """
    stack: list[tuple[str, bool, int, int]] = []  # open elements: tag, and what held outside of it: never text, main, doubt
    never, main, mains, doubt, links = False, 0, 0, 0, 0
    parts: list[str] = []
    linked = 0
    at, size = 0, len(page)
    endless: set[str] = set()  # raw text tags without an end from here on
    opened: dict[str, int] = {}  # how many of a tag are open

    def close() -> Block | None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        found = Block(text, linked, main, doubt) if text and not never else None
        parts, linked = [], 0
        return found

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not never:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            attributes = m[3]
            if tag in RAW and not attributes.endswith("/"):
                end = None if tag in endless else _ENDS[tag].search(page, at)
                if not end:
                    endless.add(tag)
                    if tag in ("head", "title", "select", "button"):
                        continue  # left open: what follows is still the page
                    break
                at = page.find(">", end.start()) + 1 or size
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "a":
                links = 1
                continue
            if tag in BLOCK and (found := close()):
                yield found
            if tag in VOID or tag not in BLOCK:
                continue
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
                _, never, main, doubt = stack.pop()
                opened[tag] -= 1
            stack.append((tag, never, main, doubt))
            opened[tag] = opened.get(tag, 0) + 1
            kind = True if never else _kind(tag, attributes, main)
            never = kind is True
            if kind is False or kind == STATE:
                around.append(doubt)
                doubt = len(around) - 1
                if kind == STATE:
                    states.add(doubt)
            if tag in MAIN and kind is None:
                mains += 1
                main = mains
        elif tag == "a":
            links = 0
        elif tag in BLOCK:
            if found := close():
                yield found
            links = 0
            while opened.get(tag):
                name, never, main, doubt = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
    if found := close():
        yield found


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()[]") in STOP_WORDS for w in words), len(words)


def _foreign(text: str) -> bool:
    """Whether most letters are outside Latin script."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" and not "\u1e00" <= c <= "\u1eff" for c in letters) > len(letters)


def _lettered(text: str) -> bool:
    """Whether letters are at least half of what isn't white space."""
    return 2 * sum(map(str.isalpha, text)) >= len(text) - text.count(" ")


def judge(block: Block, known: bool = True) -> bool | None:
    """First pass: True for article text, False for other text, None if it can't tell. ``known``: the page has its share of stop words."""
    n = len(block.text)
    density = block.linked / n
    if density >= MAX_LINKS and (n < SHORT * 4 or density >= 0.6):
        return None if block.main and n >= SHORT and n - block.linked >= LEAST_WORDING else False
    if n < SHORT:
        return None
    stop, words = _stops(block.text)
    if stop >= STOP_HIGH * words:
        return True
    if stop >= STOP_LOW * words:
        return True if n >= 4 * SHORT or block.main else None
    if block.main or not _lettered(block.text):
        return None  # a table, a formula, another language: what stands around it tells
    return density < MAX_LINKS and (not known or _foreign(block.text))


def _marked(found: list[Block]) -> bool:
    """Whether the page's article and main elements hold its text: at least a quarter of what stands in longer blocks outside of them."""
    inside = sum(len(b.text) for b in found if b.main)
    outside = sum(len(b.text) for b in found if not b.main and len(b.text) >= SHORT and b.linked < MAX_LINKS * len(b.text))
    return inside > 0 and 4 * inside >= outside


def _judged(found: list[Block]) -> None:
    """First pass over all blocks."""
    counts = [_stops(b.text) for b in found if not b.main and len(b.text) >= SHORT and b.linked < MAX_LINKS * len(b.text)]
    known = sum(stop for stop, _ in counts) >= STOP_LOW * sum(words for _, words in counts)
    for b in found:
        b.label = judge(b, known)


def _without_states(found: list[Block], around: list[int], states: set[int]) -> None:
    """Elements named by a state count as doubtful only where their own text is mostly links."""
    size, linked = [0] * len(around), [0] * len(around)
    for b in found:
        size[b.doubt] += len(b.text)
        linked[b.doubt] += b.linked
    stands = list(range(len(around)))
    for k in range(1, len(around)):
        around[k] = stands[around[k]]
        if k in states and linked[k] <= MAX_LINKS * size[k]:
            stands[k] = around[k]
    for b in found:
        b.doubt = stands[b.doubt]


def _undoubted(found: list[Block], around: list[int]) -> list[Block]:
    """Blocks outside of doubtful elements, and of those that hold the page: taken in, the largest first, while what is outside is little against it."""
    if not any(b.doubt for b in found):
        return found
    good = any(b.label for b in found)
    own, inside, below = [0] * len(around), [0] * len(around), [[] for _ in around]
    for b in found:
        weight = len(b.text) if b.label or b.label is None and (b.main or not (good or b.linked)) else 0
        own[b.doubt] += weight
        inside[b.doubt] += weight * (b.main > 0)
    total = own[:]
    for k in range(len(around) - 1, 0, -1):  # an element's number is larger than that of the one around it
        total[around[k]] += total[k]
        below[around[k]].append(k)
    kept, text, in_main = {0}, own[0], inside[0]
    heap = [(-total[k], k) for k in below[0]]
    heapify(heap)
    while heap and text < ENOUGH and -heap[0][0] > (TIMES_IN_MAIN if in_main else TIMES) * text:
        _, k = heappop(heap)
        kept.add(k)
        text, in_main = text + own[k], in_main + inside[k]
        for x in below[k]:
            heappush(heap, (-total[x], x))
    return [b for b in found if b.doubt in kept]


def main_text(page: str | None) -> str:
    around, states = [0], set()
    found = list(blocks(page or "", around, states))
    _without_states(found, around, states)
    _judged(found)
    found = _undoubted(found, around)
    if not _marked(found):  # a page that doesn't say where its article is
        for b in found:
            b.main = 0
    else:
        found = [b for b in found if b.main]
    _judged(found)
    decided = [i for i, b in enumerate(found) if b.label is not None]
    if not decided:
        return "\n".join(b.text for b in found if not b.linked)
    k, out = 0, []
    for i, b in enumerate(found):
        while k < len(decided) and decided[k] < i:
            k += 1
        label = b.label
        if label is None:
            sides = [(i - decided[k - 1], found[decided[k - 1]].label)] if k else []
            if k < len(decided):
                sides.append((decided[k] - i, found[decided[k]].label))
            nearest = min(d for d, _ in sides)
            label = any(yes for d, yes in sides if d == nearest)
        if label:
            out.append(b.text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
