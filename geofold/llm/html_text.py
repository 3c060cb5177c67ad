"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line's weight is its text's length;
``MARKED`` times that inside of an element by which a page marks its article, but 1 / ``NAMED`` of it in
any block whose class or id says that it is a menu, header, footer, sidebar, notice, advert, form or
comments (a name counts by its last word: ``cookie-notice`` is a notice, ``notice-period`` isn't). Outside of
a marked article, lines that are mostly links weigh nothing. Elements that never hold an article (menus, footers, forms, code,
styles) aren't lines. Where blocks end and others begin stand empty lines, at an article's edges and at such elements ``WINDOW`` of them, elsewhere fewer.

Weights are summed over sliding windows of ``WINDOW`` lines. The threshold comes from the page: half of
its largest sum, at most ``ENOUGH``. Silence (``WINDOW`` lines without weight) parts the lines into stretches. In each,
the text surges at the first line of the first window over the threshold and dives
behind the last line of the last one; lines beside without an empty line between belong to it. What lies
between surge and dive is kept, whatever its length. Blocks with a name are stretches of their own.

What the surges found also says where the article stands: in the innermost part of the page (a box, section, cell; not the page itself) that holds
over half of it. Short lines that stand there too, parted from the rest by an advert, a form or a table, are the article's and stay, as do those in parts of
the same kind beside it (sections, articles, cells); lists of links there and blocks with a name go, a single line that is a link stays. All else goes.
A form that holds more text than what was kept is the page's wrapping, and no form.

Defined cases: null, empty and text-free pages give an empty text; markup cut off
at the end of a page is dropped, text before it stays; unclosed elements end with their
parents, stray end tags are ignored; very long pages are read in one pass, in time linear in their length; repeated pages are
each extracted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from geofold.llm.common import mapped

WINDOW = 3
#: A window's sum that is text on any page.
ENOUGH = 240
MARKED, NAMED = 8, 32
LINK_SHARE = 0.6

# HTML's element names.
_RAW = "script|style|textarea|title|noscript|template|iframe|noembed|noframes|xmp"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_PARTS = frozenset("article main section div table tr td th body aside details".split())
_NEVER = frozenset("nav footer aside form head script style textarea title noscript template iframe noembed noframes xmp button select option dialog menu svg math canvas object audio video map datalist".split())
_ARTICLE = frozenset(("article", "main"))
#: Parts that are repeated beside one another in one text.
_REPEATED = frozenset("article section td tr tbody".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: What the task names as not being the article, and words that only say that a name is of a box.
_THINGS = frozenset("ad ads advert adverts advertisement advertisements advertising menu nav navbar navigation header footer sidebar notice notices comment comments form newsletter".split())
_BOXES = frozenset("area block box container content inner item list outer panel section slot unit widget wrap wrapper".split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z>][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CASES = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_\d]+")


def names_thing(value: str) -> bool:
    """Whether a class or id says that a block is no part of an article."""
    for name in value.split():
        words = [w.lower() for w in _CASES.split(name) if w]
        while len(words) > 1 and words[-1] in _BOXES:
            words.pop()
        if words and words[-1] in _THINGS:
            return True
    return False


def _read(attrs: str) -> tuple[bool, bool]:
    """(never shown or of a role that no article has, named as another thing)."""
    never = named = False
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            named = named or names_thing(value)
        elif key == "role":
            never = never or value.lower() in _ROLES
        else:
            never = never or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(_HIDDEN.search(value))
    return never, named


class Lines:
    """Lines of a page in order: (text, share of it in links, whether in a marked article, number of the named block or 0, number of the part or 0), or the number of empty lines.

    parts: the parent and the element's name of each part of the page; the first is the page. in_forms: code points in forms that aren't lines; with ``forms``, forms are parts like others.
    """

    def __init__(self, page: str, forms: bool = False):
        self.lines: list[tuple[str, float, bool, int, int] | int] = []
        self.parents, self.names, self.inside = [0], [""], [0]
        self.forms, self.in_forms = forms, 0
        self.parts: list[str] = []
        self.linked = self.links = self.blocks = self.gap = 0
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, never, article, named block; parents' included
        self.open: Counter = Counter()  # block elements on the stack
        self.frames: list[tuple[str, Counter]] = [("", Counter())]  # the blocks on the stack, each with the inline elements open in it
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m["raw"]:
                self._break()
            elif m["name"]:
                self._tag(m["name"].lower(), bool(m["end"]), m["attrs"])
        self._text(page[at:])
        self._break()

    def _state(self) -> tuple[bool, bool, int]:
        return self.stack[-1][1:] if self.stack else (False, False, 0)

    def _text(self, raw: str) -> None:
        text = html.unescape(raw)
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def _break(self, gap: int = 0) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(raw.split())
            if text:
                never, article, block = self._state()
                if never:
                    self.in_forms += len(text) if self.open["form"] else 0
                    self.gap = max(self.gap, 1 if article else WINDOW)
                else:
                    if self.gap:
                        self.lines.append(self.gap)
                    self.gap = 0
                    self.lines.append((text, self.linked / len(raw), article, block, self.inside[-1]))
            self.parts, self.linked = [], 0
        self.gap = max(self.gap, min(self.gap + 1, WINDOW - 1) if gap == 1 else gap)

    def _push(self, name: str, never: bool, article: bool, block: int) -> None:
        self.stack.append((name, never, article, block))
        if name in _INLINE:
            self.frames[-1][1][name] += 1
            self.links += name == "a"
        else:
            self.frames.append((name, Counter()))
            self.open[name] += 1
            if name in _PARTS and name != "body":
                self.parents.append(self.inside[-1])
                self.names.append(name)
                self.inside.append(len(self.names) - 1)
            else:
                self.inside.append(self.inside[-1])

    def _pop(self) -> None:
        name = self.stack.pop()[0]
        if name in _INLINE:
            self.frames[-1][1][name] -= 1
            self.links -= name == "a"
        else:
            self.frames.pop()
            self.open[name] -= 1
            self.inside.pop()

    def _tag(self, name: str, end: bool, attrs: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        inline = name in _INLINE
        if end:
            if not (self.frames[-1][1] if inline else self.open)[name]:
                if not inline:
                    self._break()
                return
            if not inline:
                self._break()
            before = self._state()
            while True:
                top = self.stack[-1][0]
                if inline:
                    outer = self.stack[-2][1:] if len(self.stack) > 1 else (False, False, 0)
                    if outer != self.stack[-1][1:]:
                        self._break()
                self._pop()
                if top == name:
                    break
            if not inline:
                self._edge(name, before, self._state())
            return
        never, article, block = self._state()
        drops, named = _read(attrs)
        drops = drops and name not in ("html", "body") or name in _NEVER and not (self.forms and name == "form") or (name == "header" and not article)
        if not inline or drops:
            self._break()
        if name in _VOID:
            return
        if name in _CLOSES_P and self.frames[-1][0] == "p":
            while self.stack[-1][0] != "p":
                self._pop()
            self._pop()
            never, article, block = self._state()
        if named and not inline and not block and name not in _ARTICLE and name not in ("html", "body"):
            self.blocks += 1
            block = self.blocks
        after = (never or drops, article or name in _ARTICLE, block)
        if not inline:
            self._edge(name, self._state(), after)
        self._push(name, *after)

    def _edge(self, name: str, before: tuple[bool, bool, int], after: tuple[bool, bool, int]) -> None:
        """Empty lines between what stands before and after the border of a block."""
        if before[1] != after[1]:
            self._break(WINDOW)
        elif name in _PARTS:
            self._break(1)


def surges(weights: list[float], threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches (first line, end) from the surge of the windows' sums to their dive. weights: one for each line, 0 for empty ones."""
    out: list[tuple[int, int]] = []
    at, n = 0, len(weights)
    sums = window_sums(weights, window)
    while at < n:
        if not weights[at]:
            at += 1
            continue
        end, quiet = at, 0  # the stretch up to the next silence
        while end < n and quiet < window:
            quiet = 0 if weights[end] else quiet + 1
            end += 1
        stop = end - quiet
        high = [i for i in range(max(0, at - window + 1), stop) if sums[i] >= threshold]
        if high:
            first = next(i for i in range(max(high[0], at), stop) if weights[i])
            last = next(i for i in range(min(high[-1] + window, stop) - 1, -1, -1) if weights[i])
            while first > at and weights[first - 1]:
                first -= 1
            while last + 1 < stop and weights[last + 1]:
                last += 1
            out.append((first, last + 1))
        at = end
    return out


def window_sums(weights: list[float], window: int = WINDOW) -> list[float]:
    """Sums of the windows that start at each line."""
    upto = [0.0]
    for w in weights:
        upto.append(upto[-1] + w)
    n = len(weights)
    return [upto[min(n, i + window)] - upto[i] for i in range(n)]


def beside(page: Lines, kept: list[int]) -> list[int]:
    """Lines that weren't kept but stand in the part of the page that holds over half of what was, or in parts of its kind beside it."""
    size = [0] * len(page.names)
    for i in kept:
        size[page.lines[i][4]] += len(page.lines[i][0])
    total, half = size[:], sum(size) / 2
    for part in range(len(size) - 1, 0, -1):  # parts have higher numbers than those around them
        total[page.parents[part]] += total[part]
    chosen = 0
    for part in range(1, len(size)):  # each next one over half lies in the last
        if total[part] > half:
            chosen = part
    if not chosen:
        return []
    around, kind = page.parents[chosen], page.names[chosen]
    own = [False] * len(size)
    for part in range(1, len(size)):
        own[part] = part == chosen or own[page.parents[part]] or kind in _REPEATED and page.parents[part] == around and page.names[part] == kind
    there, out = set(kept), []
    near = [(i, x) for i, x in enumerate(page.lines) if not isinstance(x, int) and own[x[4]] and not x[3]]
    linked = [False, *(x[1] > LINK_SHARE for _, x in near), False]
    for k, (i, _) in enumerate(near, 1):
        if i not in there and not (linked[k] and (linked[k - 1] or linked[k + 1])):
            out.append(i)
    return out


def main_text(page: str | None, window: int = WINDOW, enough: float = ENOUGH) -> str:
    if not page:
        return ""
    read = Lines(page)
    text = _chosen(read, window, enough)
    return _chosen(Lines(page, forms=True), window, enough) if read.in_forms > len(text) else text


def _chosen(page: Lines, window: int, enough: float) -> str:
    lines = page.lines
    streams: dict[int, list[tuple[int, float]]] = {0: []}  # by named block: (place of the line or -1, weight)
    for i, line in enumerate(lines):
        if isinstance(line, int):
            for s in streams.values():
                s.extend([(-1, 0.0)] * line)
            continue
        text, linked, article, block, _ = line
        weight = len(text) / NAMED if block else len(text) * (MARKED if article else 0 if linked > LINK_SHARE else 1)
        streams.setdefault(block, []).append((i, weight))
    weights = {k: [w for _, w in s] for k, s in streams.items()}
    largest = max((x for w in weights.values() for x in window_sums(w, window)), default=0)
    threshold = min(enough, largest / 2)
    if not threshold:  # nothing but links
        return "\n\n".join(x[0] for x in lines if not isinstance(x, int))
    kept = [i for k, s in streams.items() for a, b in surges(weights[k], threshold, window) for i, _ in s[a:b] if i >= 0]
    return "\n\n".join(lines[i][0] for i in sorted(kept + beside(page, kept)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, enough: float = ENOUGH) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, window, enough) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return mapped(chosen, run, "page_id long, url string, text string, n_chars long")
