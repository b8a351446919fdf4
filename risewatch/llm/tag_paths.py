"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with the path of open elements from the
root. For every distinct path two ratios are taken over its blocks: text length for each block, and punctuation marks
for each block. Both are smoothed over the blocks in page order, averaged for each path, scaled to their mean and fused by
a product; paths at or above a threshold (a share of the mean score of a character) are content paths.

The outermost article and main elements are the article if they hold most of the content paths' text, else the deepest
container (no list, no table) that holds all of it. Inside, a container is kept if it holds text of a content path, with
its short blocks too; one without goes, unless it holds only headings. The cells of a table that lays out the page
(a content block lies deeper in one of its cells) are containers. Elements go that are boilerplate by kind (menus, forms,
asides ...) or by a name: a class, id or role that consists of such words (adverts, comments ...) and of neutral ones
(site, left, box ...). A name does not bar an element that holds most of the article. An article's own header is a
container, and its headings are kept. The bounded lists of such names are parameters. Text of formulas and drawings is kept.

Broken markup: an unclosed inline element ends with its block, a block-level tag closes an open paragraph, end tags
without a start are skipped, everything open is closed at the end. Whole pages are read. Null and empty pages, and pages
without text, give an empty text. Repeated rows get equal texts; equal scores keep the earlier element.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from risewatch.llm.common import map_texts, spare

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes desc metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption button".split()
)
#: Elements that are never part of an article.
BARRED = frozenset("nav header footer aside form menu dialog button select option script style noscript template iframe textarea head title fieldset".split())
#: Words of class, id or role that mark boilerplate, if the whole name consists of them and of neutral words.
WORDS = (
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored comment comments commentlist thread threads disqus reply replies respond "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login "
    "share sharing social related recommended popular widget popup modal overlay toolbar pagination pager skip copyright complementary contentinfo search form alert"
).split()
#: Words of a discussion, which may be longer than its article.
TALK = frozenset("comment comments commentlist thread threads disqus reply replies respond".split())
NEUTRAL = frozenset(
    "site page main global top bottom left right center inner outer primary secondary first last small large mobile desktop sticky fixed inline section area block box bar row col column panel container "
    "wrapper wrap holder region zone slot unit group list lists item items link links button buttons icon icons text title heading header body post posts entry article articles story stories news "
    "content contents media image form field input policy message user users the of".split()
)
#: Whole classes or ids that do.
NAMES = frozenset("header site-header page-header siteheader topbar top-bar side-bar leftbar rightbar".split())
#: An end tag closes nothing beyond these.
SCOPE = frozenset("html body table td th article section main div".split())
#: Start tags that close an open element of the same list entry.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)[a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]")
#: What ends a tag or begins a quoted value.
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: What bars an element: its kind, a name, or the name of a discussion.
KIND, NAME, DISCUSSION = 1, 2, 3


def barred(name: str, attributes: str, words: frozenset[str]) -> int:
    """What bars the element, or 0."""
    if name in BARRED:
        return KIND
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    if "hidden" in re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes).split():
        return KIND
    found = 0
    for token in " ".join(a or b or c for a, b, c in _MARK.findall(attributes)).split():
        parts = {w.lower() for w in _PARTS.findall(token) if len(w) > 1}
        own = parts & words
        if token.lower() in NAMES or own and parts - own <= NEUTRAL:
            found = max(found, DISCUSSION if own & TALK else NAME)
    return found


class Tags:
    """Tags of a page in order, each character read a bounded number of times.

    A tag ends at the first ``>`` outside quotes. Without one, or with a quote that never closes, the ``<`` is text. What
    is found from a mark outside quotes is remembered, and a mark known not to follow is not sought.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.stops = [m.start() for m in _STOP.finditer(page)]
        self.cut = 0  # where the name that is being read ends
        self.known: dict[int, int] = {}  # mark outside quotes -> end of a tag that goes on there

    def end(self, at: int) -> int:
        """The place after the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        page, last, passed, out = self.page, self.last, [], -1
        while at <= last[">"]:
            stop = self.stops[bisect_left(self.stops, at)]
            if stop in self.known:
                out = self.known[stop]
                break
            passed.append(stop)
            mark = page[stop]
            if mark == ">":
                out = stop + 1
                break
            if stop == last[mark]:
                break
            at = page.find(mark, stop + 1) + 1
        self.known.update(dict.fromkeys(passed, out))
        return out

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag or comment from ``at``; a comment has no name."""
        page = self.page
        while m := _OPEN.search(page, at):
            if m[1] is None:
                close = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
                return m.start(), len(page) if close < 0 else close + (3 if m[0] == "<!--" else 1), "", False, ""
            if self.cut < m.end():
                found = _NAME_END.search(page, m.end())
                self.cut = found.start() if found else len(page)
            end = self.end(self.cut)
            if end >= 0:
                return m.start(), end, page[m.end() - 1 : self.cut].lower(), bool(m[1]), page[self.cut : end - 1]
            at = m.start() + 1
        return None


def blocks(page: str, words: frozenset[str]) -> list[tuple[str, tuple[int, ...], tuple[str, ...], tuple[tuple[int, int], ...]]]:
    """(text, elements' numbers from the root, their names, what bars it) of each block with text, in page order; the
    last are the elements here or above that bar, with their reasons."""
    out: list = []
    stack: list[tuple[str, int, tuple | None]] = []  # name, number, what bars here or above: (number, reason, those above)
    held: list[str] = []
    spot: list = []
    count = at = 0

    def listed(bars):
        all_ = []
        while bars:
            all_.append(bars[:2])
            bars = bars[2]
        return tuple(all_)

    def flush():
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, tuple(n for _, n, _ in spot[0]), tuple(t for t, _, _ in spot[0]), listed(spot[0][-1][2] if spot[0] else None)))
        spot.clear()

    def say(raw: str):
        if raw:
            if not held:
                # a block belongs to its nearest block-level element
                depth = max((i + 1 for i, (t, _, _) in enumerate(stack) if t in BLOCK), default=0)
                spot[:] = [stack[:depth] if not any(b for _, _, b in stack[depth:]) else stack[:]]
            held.append(html.unescape(raw))

    def close(names: tuple[str, ...] | frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    tags = Tags(page)
    while at < len(page):
        tag = tags.next(at)
        if tag is None:
            say(page[at:])
            break
        start, after, name, end, attributes = tag
        say(page[at:start])
        at = after
        if not name:
            continue
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            flush()
        if end:
            if name in BLOCK:
                close((name,), frozenset() if name in SCOPE else frozenset(("body", "article", "main", "table", "td")))
            elif any(t == name for t, _, _ in stack):
                close((name,), BLOCK)
            continue
        if name in BLOCK:
            close(("p",), SCOPE)
            if name in CLOSES:
                close(CLOSES[name], frozenset(("ul", "ol", "dl", "table", "select")))
            while stack and stack[-1][0] not in BLOCK:
                stack.pop()
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = page.find(">", stop.end()) + 1 if stop else 0
            at = at or len(page)
            continue
        count += 1
        above = stack[-1][2] if stack else None
        # below an element barred by its kind nothing can be kept
        bar = 0 if above and above[1] == KIND else barred(name, attributes, words)
        if name == "header" and bar == KIND and any(t in SAID for t, _, _ in stack):
            bar = 0  # the article's own
        if bar and name not in BLOCK and not above:
            flush()
        stack.append((name, count, (count, bar, above) if bar else above))
    flush()
    return out


def smooth(v: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian smoothing with repeated ends; light, as a menu may be next to the article."""
    kernel = np.exp(-2.0 * np.arange(-radius, radius + 1.0) ** 2)
    return np.convolve(np.pad(v, radius, mode="edge"), kernel / kernel.sum(), "valid")


def path_scores(found: list, radius: int = 1) -> dict[tuple[str, ...], float]:
    """Fused ratio of each tag path: mean 1 before the product."""
    own = [b for b in found if not b[3]]
    if not own:
        return {}
    number: dict[tuple[str, ...], int] = {}
    at = np.array([number.setdefault(b[2], len(number)) for b in own])
    n, fused = np.bincount(at), np.ones(len(number))
    for total in ([len(b[0]) for b in own], [len(_PUNCTUATION.findall(b[0])) for b in own]):
        ratio = np.bincount(at, total) / n
        v = np.bincount(at, smooth(ratio[at], radius)) / n
        fused *= v / v.mean() if v.mean() > 0 else 1.0
    return dict(zip(number, fused.tolist()))


def content_paths(found: list, threshold: float, radius: int) -> frozenset[tuple[str, ...]]:
    """Paths whose score is at least a share of the mean score of a character."""
    scores = path_scores(found, radius)
    own = [b for b in found if not b[3]]
    mean = sum(scores[b[2]] * len(b[0]) for b in own) / max(1, sum(len(b[0]) for b in own))
    return frozenset(p for p, score in scores.items() if score >= threshold * mean)


#: Elements that are parts of an article, not its container.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption".split())
SAID = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CELLS = ("td", "th")


def cleared(found: list, threshold: float, share: float, radius: int) -> frozenset[int]:
    """Elements that their name does not bar, as they hold most of the article: of the text in article and main
    elements, or on a page without them of the content paths' text."""
    if not any(b[3] for b in found):
        return frozenset()
    rest = [b for b in found if all(why == NAME for _, why in b[3])] or [b for b in found if all(why != KIND for _, why in b[3])]
    own = [b for b in rest if not set(SAID).isdisjoint(b[2])]
    if not own:
        content = content_paths([(*b[:3], ()) for b in rest], threshold, radius)
        own = [b for b in rest if b[2] in content]
    inside: dict[int, int] = defaultdict(int)
    for text, _, _, bars in own:
        for number, _ in bars:
            inside[number] += len(text)
    total = sum(len(b[0]) for b in own)
    return frozenset(n for n, size in inside.items() if size > share * total)


def layout_tables(chosen: list) -> frozenset[int]:
    """Tables with a content block that lies deeper in a cell."""
    out = set()
    for _, numbers, path, _ in chosen:
        table, deeper = 0, False
        for n, t in zip(reversed(numbers), reversed(path)):
            if t == "table" and table < 0:
                out.add(n)
            # the cell counts for the table around it, if another element lies between it and the text
            table = -1 if t in CELLS and deeper else 0 if t == "table" else table
            deeper = t != "table"
    return frozenset(out)


def holder(numbers: tuple[int, ...], path: tuple[str, ...], layout: frozenset[int]) -> tuple[int, str]:
    """The container of a block: its innermost element that is no part of an article; (0, "") is the page."""
    table, cell = 0, (0, "")
    for n, t in zip(reversed(numbers), reversed(path)):
        if t == "table" and n in layout and cell[0]:
            return cell
        if t not in PARTS:
            return n, t
        cell = (0, "") if t == "table" else (n, t) if t in CELLS else cell
    return 0, ""


def extract(page: str | None, words: frozenset[str] = frozenset(WORDS), threshold: float = 1 / 3, share: float = 0.5, radius: int = 1) -> str:
    """Blocks of the article, one a line."""
    found = blocks(page or "", words)
    free = cleared(found, threshold, share, radius)
    found = [(*b[:3], any(n not in free for n, _ in b[3])) for b in found]
    content = content_paths(found, threshold, radius)
    if not content:
        return ""
    chosen = [b for b in found if not b[3] and b[2] in content]
    inside: dict[int, int] = defaultdict(int)
    total = sum(len(b[0]) for b in chosen)
    for text, numbers, _, _ in chosen:
        for number in numbers:
            inside[number] += len(text)
    # elements that say they are the article are taken at their word; else the deepest that holds all the content
    said = {next(n for n, t in zip(b[1], b[2]) if t in SAID) for b in found if not set(SAID).isdisjoint(b[2])}
    if not total or sum(inside[n] for n in said) < share * total:
        said = set()
    groups = {n for b in chosen for n, t in zip(b[1], b[2]) if t not in PARTS}
    roots = said or {max((n for n in groups if inside[n] == total), default=0)}  # numbers grow inwards
    rest = [b for b in found if not b[3] and (0 in roots or not roots.isdisjoint(b[1]))]
    layout = layout_tables(chosen)
    homes = [holder(b[1], b[2], layout) for b in rest]
    heads = [not HEADINGS.isdisjoint(b[2]) for b in rest]
    mixed = {n for (n, _), head in zip(homes, heads) if not head}
    inside[0] = total
    return "\n".join(b[0] for b, (n, name), head in zip(rest, homes, heads) if inside[n] or head and (n not in mixed or name == "header"))


def extract_pages(df: DataFrame, column: str, **settings) -> DataFrame:
    """Adds ``main_text`` to every page."""
    name = spare(df.columns, "main_text")[0]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType(), False)])

    def work(part, texts):
        return pa.RecordBatch.from_arrays([*part.columns, pa.array([extract(t, **settings) for t in texts], pa.string())], [*part.schema.names, name])

    return map_texts(df, column, work, schema)
