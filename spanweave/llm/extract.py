"""Operator 9, HTML extraction: tag-path ratios select the content nodes of a page."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|xmp|noframes|canvas|object)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont frame".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CONTAINER = frozenset("article main section div td body html center".split())
#: Elements that are never part of an article.
_NEVER = frozenset("head nav footer aside button select menu dialog fieldset input label option datalist".split())
#: What an opening tag ends if it is open, up to the first of the fences.
_ENDS = {
    "p": (frozenset(["p"]), _BLOCK - {"p"}), "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd p".split()), frozenset(["dl"])), "dd": (frozenset("dt dd p".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th p".split()), frozenset(["table"])), "td": (frozenset("td th p".split()), frozenset("tr table".split())), "th": (frozenset("td th p".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Names of classes and ids that hint at what isn't content: adverts and reader comments, and the rest.
_STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|dfp|banner\w*|sponsor\w*|promo\w*|comments?|commentlist|comment-?\w*|respond|disqus\w*|repl(?:y|ies)|discussion|reviews?)(?:[\s_-]|$)", re.I)
_WEAK = re.compile(
    r"(?:^|[\s_-])(?:sidebar\w*|menu\w*|nav|navbar\w*|navigation|breadcrumbs?|footer|foot|cookies?\w*|consent|gdpr|notices?|notification\w*"
    r"|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|read-?more|widgets?|toolbar|pagination|pager|skip|masthead|topbar|search|copyright|paywall|disclaimer)(?:[\s_-]|$)", re.I)
_HEAD = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:[\s_-]|$)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_PUNCT = re.compile(r"[.,;:!?()\"'…。，；：！？、«»„“”-]")
#: Units to each side that smooth a unit's ratios, the spread of their weights in page order, and the steps between two paths beyond which they are strangers.
REACH, SPREAD, STEPS = 2, 1.0, 8
#: A path is content from so many standard deviations of all scores, and such a part of the greatest score, on.
STRICT, LEAST = 0.25, 0.3
#: What a name leaves of a score: outside article and main elements, and inside them by a weak and a strong hint.
HINTS = (0.002, 0.5, 0.05)
#: The main region is the deepest container that holds this part of the score of all content.
REGION = 0.8


class _Element:
    __slots__ = ("article", "depth", "hint", "inside", "mass", "n", "n_article", "named", "opened", "out", "parent", "path", "scope", "tag", "unit")

    def __init__(self, tag: str, parent: _Element | None, out: bool, named: int, path: int):
        self.tag, self.parent, self.out, self.named, self.path = tag, parent, out, named, path
        self.depth = parent.depth + 1 if parent else 0
        self.article = (parent.article if parent else None) or (self if tag in ("article", "main") and not out else None)
        block = parent is None or tag in _BLOCK
        #: the nearest block, which knows how many inline elements are open in it; and the nearest block or named element, whose text is one unit
        self.scope = self if block else parent.scope
        self.unit = self if block or named else parent.unit
        self.opened: dict[str, int] | None = {} if block else None
        self.n = self.n_article = 0
        self.mass, self.hint, self.inside = 0.0, 1.0, 0


class _Page:
    """Elements in order of their start, and text nodes that could be content, in page order: (block number, element, text, whether in a link)."""

    def __init__(self, page: str):
        #: a path is a number; (path above, tag and names) leads to it, and it knows the path above and its length
        self.paths: dict[tuple[int, str], int] = {}
        self.above, self.length = [-1], [0]
        root = _Element("html", None, False, 0, 0)
        self.elements, self.found, self.stack, self.block, self.open = [root], [], [root], 0, {}
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if tag:
                self._end(tag) if m[2] or m[5] else self._start(tag, m[4] or m[7] or "")
        if at < len(page):
            self._text(page[at:])

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.out:
            return
        if not raw.isspace():
            self.found.append((self.block, top, html.unescape(raw) if "&" in raw else raw, self.open.get("a", 0) > 0))
        elif self.found and self.found[-1][0] == self.block:
            self.found.append((self.block, top, " ", False))

    def _pop(self, low: int) -> None:
        """Close what is open from ``low`` on."""
        for e in self.stack[low:]:
            self.open[e.tag] -= 1
            if e.scope is not e:
                e.scope.opened[e.tag] -= 1
        del self.stack[low:]

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.block += 1
            there = self.open.get(tag, 0)
        else:  # ends only what is open in the same block
            there = self.stack[-1].scope.opened.get(tag, 0)
        if there:
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self._pop(k)

    def _close(self, tags: frozenset, fences: frozenset) -> None:
        if not any(self.open.get(t, 0) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while k > 1 and self.stack[k - 1].tag in tags:
                    k -= 1
                self._pop(k)
                return
            if self.stack[k].tag in fences:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            return self._text(" ")
        if tag in _BLOCK:
            self.block += 1
            if tag not in _ENDS and self.open.get("p", 0):
                self._close(*_ENDS["p"])
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCK:
            return
        if tag in ("html", "body") and len(self.stack) > 1 and self.stack[1].tag == "head":
            self._pop(1)
        if tag == "html" or tag == "body" and self.open.get("body", 0):
            return
        parent = self.stack[-1]
        out, named, names = _read(tag, attributes, parent)
        path = parent.path
        if tag in _BLOCK or named:
            step = (path, f"{tag} {names}")
            path = self.paths.get(step, 0)
            if not path:
                path = self.paths[step] = len(self.above)
                self.above.append(parent.path)
                self.length.append(self.length[parent.path] + 1)
        e = _Element(tag, parent, out, named, path)
        self.elements.append(e)
        self.stack.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1
        if e.scope is not e:
            e.scope.opened[tag] = e.scope.opened.get(tag, 0) + 1

    def distance(self, a: int, b: int) -> int:
        """Steps from one path to the other through what they share; STEPS + 1 if they are more."""
        n = 0
        while a != b:
            if n > STEPS:
                break
            if self.length[a] >= self.length[b]:
                a = self.above[a]
            else:
                b = self.above[b]
            n += 1
        return min(n, STEPS + 1)


def _read(tag: str, attributes: str, parent: _Element) -> tuple[bool, int, str]:
    """Whether an element is a menu, header, footer or sidebar by its tag, role or style; whether its name hints weakly (1) or strongly (2) that it isn't content; its class and id."""
    if parent.out or tag in _NEVER or tag == "header" and parent.article is None:
        return True, 0, ""
    names = ""
    if attributes:
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if tag in ("html", "body"):
                continue
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, 0, ""
            if name == "role" and value.lower() in _ROLES:
                return True, 0, ""
            if name in ("class", "id"):
                names += " " + value
    if tag in ("article", "main", "html", "body"):
        return False, 0, ""
    hint = 2 if _STRONG.search(names) else 1 if tag == "form" or _WEAK.search(names) or parent.article is None and _HEAD.search(names) else 0
    return False, hint, re.sub(r"\d+", "", " ".join(names.lower().split()))


def _hint(page: _Page) -> None:
    """Give each element its hint: what the names above it leave of a score.

    A name says nothing about an element that holds most of the page's text, unless an article or main element beside it has text.
    """
    for _, e, t, _ in page.found:
        n = len(t.strip())
        e.n += n
        e.n_article += n if e.article else 0
    for e in reversed(page.elements[1:]):
        e.parent.n += e.n
        e.parent.n_article += e.n_article
    total, most = page.elements[0].n, page.elements[0].n_article
    for e in page.elements[1:]:
        e.hint = e.parent.hint
        if e.named and 2 * e.n > total and (e.article or e.n_article >= most):
            e.named = 0
        if e.named:
            e.hint *= HINTS[0] if e.article is None else HINTS[e.named]


def _smooth(values: list[float], kin: list[list[tuple[int, float]]]) -> list[float]:
    return [sum(values[j] * w for j, w in near) / sum(w for _, w in near) for near in kin]


def _scores(page: _Page, units: list[tuple[_Element, int, int]]) -> dict[int, float]:
    """The score of each path, from units (element, characters outside links, marks) in page order.

    Two ratios of a path, characters and punctuation marks per unit that has it, are smoothed over the units beside it, by
    distance in the page and between their paths, averaged by path and multiplied, with what names leave of them.
    """
    sums: dict[int, list[float]] = {}
    for e, n, marks in units:
        s = sums.setdefault(e.path, [0, 0, 0, 0.0, 0.0])
        s[0], s[1], s[2] = s[0] + n, s[1] + marks, s[2] + 1
    kernel = [math.exp(-((k / SPREAD) ** 2) / 2) for k in range(-REACH, REACH + 1)]
    kin = []
    for i, (e, _, _) in enumerate(units):
        near = []
        for j in range(max(0, i - REACH), min(len(units), i + REACH + 1)):
            far = page.distance(e.path, units[j][0].path)
            if far <= STEPS:
                near.append((j, kernel[j - i + REACH] * math.exp(-far)))
        kin.append(near)
    length = _smooth([sums[e.path][0] / sums[e.path][2] for e, _, _ in units], kin)
    marks = _smooth([sums[e.path][1] / sums[e.path][2] for e, _, _ in units], kin)
    for (e, _, _), x, y in zip(units, length, marks, strict=True):
        sums[e.path][3] += x * e.hint
        sums[e.path][4] += y
    return {path: s[3] / s[2] * (1 + s[4] / s[2]) for path, s in sums.items()}


def main_text(page: str | None) -> str:
    """The main text of a page, one block a line; '' if there is none.

    Elements that are menus, footers and so on by their tag, role or style never count. The text of every other block (or
    named element in it) is a unit, whose path leads by tags, classes and ids from the root to it. Paths whose score
    (:func:`_scores`) is over the threshold are content. The deepest container that holds most of the content's score is
    the main region, in which other units (headings, short lists) are content too, but for lists of links and what is under
    a name in it.
    """
    read = _Page(page or "")
    _hint(read)
    at: dict[tuple[int, _Element], list[int]] = {}
    for block, e, t, link in read.found:
        u = at.setdefault((block, e.unit), [0, 0, 0])
        n = len(t.strip())
        u[0] += n
        if not link:
            u[1], u[2] = u[1] + n, u[2] + len(_PUNCT.findall(t))
    at = {k: u for k, u in at.items() if u[0]}
    if not at:
        return ""
    units = [(e, u[1], u[2]) for (_, e), u in at.items()]
    scores = _scores(read, units)
    each = [scores[e.path] for e, _, _ in units]
    mean = sum(each) / len(each)
    least = max(STRICT * math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)), LEAST * max(each))
    content = {p for p, x in scores.items() if x >= least}
    for e, _, _ in units:
        if e.path in content:
            e.mass += scores[e.path]
    for e in reversed(read.elements[1:]):
        e.parent.mass += e.mass
    region = max((e for e in read.elements if e.tag in _CONTAINER and e.mass >= REGION * read.elements[0].mass), key=lambda e: e.depth)
    region.inside = 1
    for e in read.elements[1:]:  # 1: in the region, 2: under a name in it
        if not e.inside:
            up = e.parent.inside
            e.inside = 2 if up and e.named else up
    kept = {k for k, u in at.items() if k[1].path in content or k[1].inside == 1 and (2 * u[1] >= u[0] or not _listed(k[1], region))}
    lines, now, parts = [], None, []
    for block, e, t, _ in read.found:
        if (block, e.unit) not in kept:
            continue
        if block != now:
            lines.append(parts)
            now, parts = block, []
        parts.append(t)
    lines.append(parts)
    return "\n".join(x for x in (" ".join("".join(p).split()) for p in lines) if x)


def _listed(e: _Element, region: _Element) -> bool:
    """Whether an element is no paragraph or heading: links alone are then a menu."""
    return e is not region and e.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "article", "main")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Each page is read by itself: no shuffle, no state. Null or empty html, and a page without content: text ''. Broken
    markup is read as far as it goes. Null ids and repeated rows stay. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_pages, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
