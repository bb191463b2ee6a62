"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is a row of words (positive scores) and tags (negative scores).  One linear scan
finds the contiguous run with the greatest sum.  The weights are log odds from labelled
pages: those whose markup names its content (one ``article`` or ``main``), up to
``SAMPLE_PAGES``.  Words and tags inside elements that are never content (menus, forms,
adverts, comments, ...) leave the row before the scan, so they neither join two regions
nor stand in the text.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ship

#: Labelled pages that the weights are fitted on, at most, and characters of each.
SAMPLE_PAGES, SAMPLE_CHARS = 500, 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?:script|style|noscript|template|svg|iframe|textarea|select|object|canvas|title|annotation)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(?<!/)>"
    r"|<[!?][^>]*>?|</?[a-zA-Z](?:[^\s/>]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>?|[^<]+|<",
    re.S | re.I,
)
_RAW = frozenset("script style noscript template svg iframe textarea select object canvas title annotation".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option head".split()
)
#: Elements that are never content.
_OUTSIDE = frozenset("nav aside form footer menu button dialog select head fieldset".split())
#: Those of them that may stand around a whole page.
_WRAPPING = frozenset(("form", "fieldset"))
#: Roles of elements that are never content.
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id names of elements that are never content.
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup paywall
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside widget widgets
    footer masthead topbar toolbar share sharing social related recommended recommendations comment comments disqus reply replies respond
    login search skip sr hidden""".split()
)
#: Words that such names are put together with.
_LAYOUT = frozenset(
    """list box section wrapper wrap container area block item items bar links link post posts article articles story stories content main inner outer header
    title body row col column grid group panel card cards module unit slot top bottom left right primary secondary site page global local mobile desktop fixed
    sticky inline js wp text button buttons icons icon form field message strip tags tag feed thread threads count info more latest popular trending""".split()
)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_CONTENT = frozenset(("article", "main"))
#: Opening one of these ends an open p; opening a key ends an open element of its values.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}


def _never_content(name: str, tag: str) -> int:
    """0: no.  1: by a rule that doesn't hold for wrappers of the page's content (names in
    class and id, forms).  2: by another rule.  3: by a name that has other words in it, such
    as related-work, which says so only of what is mostly links."""
    if name in _OUTSIDE:
        return 1 if name in _WRAPPING else 2
    found = 0
    for key, a, b, c in _ATTRIBUTES.findall(tag, 1 + len(name)) if len(tag) > len(name) + 2 else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            for own in value.split():
                parts = {x.lower() for x in _PART.findall(own) if not x.isdigit()}
                if not _NAMES.isdisjoint(parts):
                    found = 1 if found == 1 or parts <= _NAMES | _LAYOUT else 3
        elif key == "role":
            if value.lower() in _ROLES:
                return 2
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 2
    return found


class Elements:
    """The page's elements in the order of their openings; 0 stands for the page itself."""

    def __init__(self):
        self.names, self.parents, self.never, self.words, self.linked = [""], [-1], [0], [0], [0]

    def open(self, name: str, parent: int, never: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.never.append(never)
        self.words.append(0)
        self.linked.append(0)
        return len(self.names) - 1

    def ancestors(self, some) -> set[int]:
        """The elements and those that contain them."""
        found: set[int] = set()
        for e in some:
            while e >= 0 and e not in found:
                found.add(e)
                e = self.parents[e]
        return found

    def holder(self, some: set[int]) -> int:
        """The innermost article or main around all of the elements, or -1."""
        open_ = [-e for e in some]
        heapq.heapify(open_)
        while len(open_) > 1:  # parents open before their children, so have lower numbers
            e = heapq.heappop(open_)
            if e != open_[0]:
                heapq.heappush(open_, -self.parents[-e])
        e = -open_[0]
        while e > 0 and self.names[e] not in _CONTENT:
            e = self.parents[e]
        return e if e > 0 else -1

    def within(self, holder: int) -> list[bool]:
        """Of each element: is it the holder or inside of it."""
        found = [False] * len(self.names)
        for e in range(holder, len(found)):
            found[e] = e == holder or (self.parents[e] >= holder and found[self.parents[e]])
        return found

    def flags(self) -> tuple[list[bool], list[int]]:
        """Of each element: is it outside; the innermost article or main around it, or -1.

        Names and forms don't count for html, body, the page's own article or main, what
        contains these, and, on pages without any, for what has four fifths of the words.
        The own article is the one with over half of the words, else the longest that is
        in nothing that is never content, else the longest.
        """
        n = len(self.names)
        total, linked = self.words[:], self.linked[:]
        for e in range(n - 1, 0, -1):
            total[self.parents[e]] += total[e]
            linked[self.parents[e]] += linked[e]
        self.never = [(1 if 2 * k >= t else 0) if x == 3 else x for x, t, k in zip(self.never, total, linked, strict=True)]
        kept = {e for e in range(n) if self.names[e] in ("html", "body")}
        articles = sorted((e for e in range(n) if self.names[e] == "article"), key=lambda e: -total[e])
        mains = [e for e in range(n) if self.names[e] == "main"]
        own = mains[:]
        if articles:
            # Inside of a kept main, its own names and those around it say nothing.
            around = self.ancestors(mains) | kept
            barred = [False] * n
            for e in range(1, n):
                barred[e] = barred[self.parents[e]] or bool(self.never[e] and e not in around)
            free = [e for e in articles if not barred[e]]
            own.append(articles[0] if total[articles[0]] * 2 > total[0] or not free else free[0])
        if own:
            kept |= self.ancestors(own)
        else:
            kept.update(e for e in range(n) if total[e] * 5 >= total[0] * 4)
        outside, content = [False] * n, [-1] * n
        for e in range(1, n):
            p = self.parents[e]
            outside[e] = outside[p] or self.never[e] == 2 or (self.never[e] == 1 and e not in kept)
            content[e] = e if self.names[e] in _CONTENT else content[p]
        return outside, content


def items(page: str) -> tuple[list[tuple], Elements]:
    """The page's row, ``(kind, value, outside, content, link)`` each, and its elements.

    kind: ``tag`` (its name, or /name), ``text`` (decoded) or ``break`` (a block begins or
    ends here, always after its tag).  outside: in an element that is never content.
    content: the innermost article or main around it, or -1.  link: in an a.
    """
    elements = Elements()
    row = list(_walk(page, elements))
    outside, content = elements.flags()
    return [(kind, value, outside[e], content[e], link) for kind, value, e, link in row], elements


def _walk(page: str, elements: Elements):
    """``(kind, value, element, link)``."""
    stack: list[tuple[str, int]] = []  # name, element
    places: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
    blocks: list[int] = []  # the same for blocks of any name
    at = content = links = 0
    skip_to = -1
    lower = None

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def pop():
        nonlocal at, content, links
        name, e = stack.pop()
        places[name].pop()
        if name in _BLOCKS:
            blocks.pop()
        at, content, links = elements.parents[e], content - (name in _CONTENT), links - (name == "a")
        return name

    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            if m.end() <= skip_to:
                continue
            token = page[skip_to : m.end()]
        else:
            token = m.group()
        if token[0] != "<" or len(token) == 1 or token[1] not in "/!?" and not token[1].isalpha():
            text = entities.unescape(token)
            n = len(text.split())
            elements.words[at] += n
            elements.linked[at] += n if links else 0
            yield "text", text, at, links > 0
            continue
        named = _NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        if token[1] == "/":
            if places.get(name):
                while pop() != name:
                    pass
            elif name not in ("p", "br"):
                continue
            yield "tag", "/" + name, at, links > 0
            if name in _BLOCKS:
                yield "break", "", at, links > 0
            elif name == "br":
                yield "text", " ", at, links > 0
            continue
        if name in _RAW:
            if token.endswith("/>") and name == "svg":
                continue
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + name, m.end())
            if len(lower) != len(page):  # a character whose lower case is longer
                found = re.compile("</" + name, re.I).search(page, m.end())
                end = found.start() if found else -1
            if end < 0:
                skip_to = len(page)
            else:
                close = page.find(">", end)
                skip_to = len(page) if close < 0 else close + 1
            continue
        if name in _CLOSES:
            k = last(_CLOSES[name])
            if k > last(_SCOPE[name]):
                while len(stack) > k:
                    pop()
        elif name in _BLOCKS and blocks and stack[blocks[-1]][0] == "p":
            for _ in range(len(stack) - blocks[-1]):
                pop()
        never = 2 if name == "header" and not content else _never_content(name, token)
        if name not in _VOID and not token.endswith("/>"):
            at = elements.open(name, at, never)
            places.setdefault(name, []).append(len(stack))
            if name in _BLOCKS:
                blocks.append(len(stack))
            stack.append((name, at))
            content, links = content + (name in _CONTENT), links + (name == "a")
        yield "tag", name, at, links > 0
        if name in _BLOCKS:
            yield "break", "", at, links > 0
        elif name == "br":
            yield "text", " ", at, links > 0


#: Scores where no page is labelled.
DEFAULT_WEIGHTS = {"word": 1.0, "link": 0.2, "tag": -1.0}


def page_features(page: str) -> tuple[Counter, Counter] | None:
    """Counts of words and tags (in content, elsewhere) of a page that is labelled by one
    article or main; None of others."""
    marks = [m.lower() for m in re.findall(r"<(article|main)\b", page, re.I)]
    if len(marks) != 1:
        return None
    inside, rest = Counter(), Counter()
    for kind, value, out, content, link in items(page)[0]:
        to = inside if content >= 0 and not out else rest
        if kind == "tag":
            to["tag:" + value.removeprefix("/")] += 1
        elif kind == "text":
            to["link" if link else "word"] += len(value.split())
    return inside, rest


def _drawn(pages: DataFrame, sample_pages: int) -> DataFrame:
    """``(html, u)`` of the pages of the ``sample_pages`` lowest hashes u among the distinct
    ones that name their content.  The driver gets about twice as many hashes at most."""
    marked = pages.select(F.col("html").cast("string").alias("html")).where(F.expr(f"html IS NOT NULL AND length(html) <= {SAMPLE_CHARS}"))
    marked = marked.where(F.col("html").rlike("(?i)<(article|main)\\b")).withColumn("u", F.xxhash64("html").bitwiseAND(F.lit((1 << 62) - 1)))
    about = marked.agg(F.approx_count_distinct("u")).first()[0]
    some = marked.where(F.col("u") < int(min(1.0, 2 * sample_pages / max(about, 1)) * (1 << 62)))
    lowest = [r[0] for r in some.select("u").distinct().orderBy("u").limit(sample_pages).collect()]
    return marked.where(F.col("u") <= (lowest[-1] if lowest else -1))


def fit_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of words, link words and each tag, from at most ``sample_pages`` distinct
    pages.  Words are held to be positive and tags negative.  Tasks count, the driver gets
    the sums; copies of a page count once."""
    ship(pages.sparkSession)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            out = []
            for page, u in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = None if u in seen else page_features(page.as_py())
                seen.add(u)
                if found:
                    out += [(u, kind, found[0][kind], found[1][kind]) for kind in found[0].keys() | found[1].keys()]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["u", "kind", "inside", "rest"])

    features = _drawn(pages, sample_pages).mapInArrow(run, "u long, kind string, inside long, rest long")
    once = features.groupBy("u", "kind").agg(F.max("inside").alias("inside"), F.max("rest").alias("rest"))
    sums = once.groupBy("kind").agg(F.sum("inside"), F.sum("rest")).collect()
    inside, rest = Counter({k: n for k, n, _ in sums}), Counter({k: n for k, _, n in sums})
    if not +inside or not +rest:
        return dict(DEFAULT_WEIGHTS)
    kinds = inside.keys() | rest.keys() | {"word", "link"}
    n, k = sum(inside.values()) + len(kinds), sum(rest.values()) + len(kinds)
    odds = {x: math.log((inside[x] + 1) / n) - math.log((rest[x] + 1) / k) for x in kinds}
    weights = {x: min(w, -0.1) for x, w in odds.items() if x.startswith("tag:")}
    weights |= {"word": max(odds["word"], 0.1), "link": max(min(odds["link"], odds["word"]), 0.01)}
    return weights | {"tag": min(weights.get("tag:div", -1.0), -0.1)}


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by an empty line.

    White space in a block becomes one space.  A page without words outside of menus and
    the like has an empty text.  Of regions with equal scores the first and longest wins,
    whatever elements it lies in.  The region's first and last block come whole, and a
    region inside of an article or main grows to the innermost one that holds all of it: a
    heading or a last line beside some tags belongs to the text although it scores little.
    Very long pages take time and memory in proportion to their length.
    """
    if not page:
        return ""
    row, elements = items(page)
    word, link, other = weights["word"], weights["link"], weights["tag"]
    best = total = 0.0
    start = 0
    region = None
    for i, (kind, value, out, _, in_link) in enumerate(row):
        if out or kind == "break":
            continue
        if kind == "tag":
            total += weights.get("tag:" + value.removeprefix("/"), other)
        elif n := len(value.split()):
            if total <= 0:
                total, start = 0.0, i
            total += n * (link if in_link else word)
        if total > best:
            best, region = total, (start, i)
    if region is None:
        return ""
    first, last = region
    words = [x[3] for x in row[first : last + 1] if x[0] == "text" and not x[2] and x[1].strip()]
    holder = elements.holder(set(words)) if min(words) >= 0 else -1
    if holder >= 0:
        held_in = elements.within(holder)
        inside = [i for i, x in enumerate(row) if x[3] >= 0 and held_in[x[3]]]
        first, last = min(first, inside[0]), max(last, inside[-1])
    else:
        while first > 0 and row[first - 1][0] != "break":
            first -= 1
        while last + 1 < len(row) and row[last + 1][0] != "break":
            last += 1
    blocks, held = [], []
    for kind, value, out, _, _ in row[first : last + 1]:
        if kind == "break":
            blocks.append("".join(held))
            held = []
        elif kind == "text" and not out:
            held.append(value)
    blocks.append("".join(held))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages(page_id, url, html)``.

    Null html has the text "".  Unclosed tags, comments and elements end with the page.
    Other columns are ignored; repeated rows get a row each.
    """
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(weights or fit_weights(pages))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py(), held.value) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
