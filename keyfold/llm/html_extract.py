"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. A tag scores the log of the probability that a tag of its kind stands in
the article, which is never positive. A word scores the log odds of being in the article, by the elements that it stands
in, the names of their classes, whether it is a link's, and the block that it is in: words of paragraphs score positive,
those of menus and the like don't. A linear scan finds the contiguous region with the largest sum. Inside the region,
stretches of blocks between two blocks of it that score negative by more than `CUT` together are left out (adverts, forms,
comments within the article). Nothing else decides what is text: names that often stand for menus, adverts and so on are
no more than one feature among others, with a prior of its own.

Weights come from labelled pages: those that mark their article themselves, of which a bounded sample (`sample` pages, by
hash of their id and address, of at most `longest` characters) is read to fit them. A page is labelled if an open article
or main that doesn't stand in an element of such a name holds words that aren't a link's. Each labelled page is learned
from with the marker hidden, once with the names of its classes and once without. Words are fitted by logistic regression
towards a prior (`MEANS`, `HOLDS`), which speaks for what a sample doesn't show. On a page with a marker, whether a word
is inside it is a feature as well.

Pages are rows of a single map; the weights are a few hundred numbers.

Defined results: a null or empty page, or one without words, gives the empty text. Unclosed tags, comments and raw
text elements end with the page; a tag that the page's end cuts off isn't text. Of equally good regions the first counts.
If all words stand in elements apart, the text is empty. Very long pages are read
whole, in time linear in their length. Repeated rows and null ids are rows like others; of further columns none is read;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import batches

#: Elements whose text isn't shown, or isn't part of the page's body.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "xmp", "noembed", "noframes"}
#: Elements that hold others and so are kept on the stack.
HOLDERS = {
    "div", "section", "article", "main", "header", "body", "ul", "ol", "dl", "table", "center", "details", "figure", "nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset",
    "p", "li", "td", "th", "dd", "dt", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6",
}
#: Of these a new one ends an open one, and the end of any other holder does.
LEAVES = {"p", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that say nothing of the words in them but for those that they hold without another element between.
PLAIN = {"div", "section", "center", "article", "main", "body", "table", "figure", "blockquote", "pre", "ul", "ol", "dl"}
#: Elements that aren't part of an article.
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
#: Names, in classes, ids and roles, of what often isn't part of an article: a feature of words.
APART_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "copyright", "dialog", "disclaimer", "disqus", "footer", "form", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navi", "navigation", "newsletter", "notice",
    "notices", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "signup", "sitenav", "social",
    "sponsor", "sponsored", "subnav", "subscribe", "toolbar", "topbar", "widget",
}
#: Elements inside a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")
SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")

#: The prior of a word's features by their kind: mean, and how firmly it holds, in pages. Kinds: base, every word; length,
#: log2 of the words of its block; link, in a link; apart, how many open elements are of APART, or named as in
#: APART_NAMES or hidden; name, an open element's name in a class or id; tag, an open element; block, the innermost one;
#: header, in a header; marked and unmarked, in and outside the marker of a page that has one.
MEANS = {"base": 0.8, "length": 0.3, "link": -1.0, "apart": -8.0, "header": -3.0, "marked": 1.0, "unmarked": -6.0, ("block", "h1"): 2.5}
HOLDS = {"base": 30.0, "length": 5.0, "link": 5.0, "apart": 20.0, "header": 5.0, "name": 2.0, "tag": 10.0, "block": 5.0}
#: How often tags not met in the sample stand in articles and outside.
TAG_PRIOR = (9.0, 1.0)
#: What a stretch without a positive score may cost between two that have one; however long, a region may go on after it.
GAP = 6.0
#: A page's best word that isn't apart scores this at least.
LEAST = 1.0
#: Bound of a word's score either way.
MOST = 6.0
#: Score, below zero, from which a stretch inside the region is left out.
CUT = 4.0


class Weights(NamedTuple):
    words: dict[tuple, float]
    tags: dict[tuple, float]


NONE = Weights({}, {})


def features_of(name: str, attributes: str) -> tuple[tuple, ...]:
    """Features that words have for standing in an element."""
    out: list[tuple] = [("tag", name)]
    apart = name in APART
    if name == "header":
        out.append(("header",))
    for key, *values in NAMED.findall(attributes) if attributes else ():
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or key == "aria-hidden":
            apart = apart or key == "hidden" or value == "true"
            continue
        names = NAME.findall(value)
        out += [("name", n) for n in names]
        apart = apart or not APART_NAMES.isdisjoint(names)
    if apart:
        out.append(("apart",))
    return tuple(out)


class Inside(NamedTuple):
    """An open element's features, the element around it, and whether one of them is apart."""

    own: tuple
    around: Inside | None
    apart: bool


class Run(NamedTuple):
    """A run of text: its block, the innermost open element, and whether a link and a marker are open."""

    block: int
    inside: Inside | None
    link: bool
    marked: bool
    text: str


def read(html: str) -> Iterator[Run | tuple[str, bool]]:
    """Runs of text, and tags as (name, whether in or of an element apart)."""
    at, block, n = 0, 0, len(html)
    stack: list[tuple[str, bool, bool]] = []  # name, apart, marker
    inside: Inside | None = None
    open_names: Counter[str] = Counter()
    known: dict[tuple[str, str], tuple] = {}
    markers = links = 0

    def pop() -> str:
        nonlocal inside, markers
        top, _, marker = stack.pop()
        inside = inside.around
        open_names[top] -= 1
        markers -= marker
        return top

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield Run(block, inside, links > 0, markers > 0, html[at:lt])
        if lt >= n:
            return
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if m is None:
            if lt + 1 < n and (html[lt + 1].isalpha() and html[lt + 1].isascii() or html[lt + 1] == "/"):
                return  # a tag that the page's end cuts off
            yield Run(block, inside, links > 0, markers > 0, "<")
            at = lt + 1
            continue
        closing, name, attributes = m[1] == "/", m[2].lower(), m[3]
        at = m.end()
        if name in RAW and not closing:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            yield name, bool(inside and inside.apart)
            continue
        if name not in INLINE and name != "br":
            block += 1
        if closing or name not in HOLDERS:
            yield name, bool(inside and inside.apart)
        if name == "br":
            yield Run(block, inside, False, markers > 0, "\n")
        elif name == "a":
            links = 0 if closing else 1
        elif name in HOLDERS and not closing:
            while stack and stack[-1][0] in LEAVES and (name in LEAVES or stack[-1][0] == "p"):
                pop()
            key = (name, attributes)
            found = known.get(key)
            if found is None:
                found = known[key] = features_of(name, attributes)
            if markers and name == "header":  # the article's own
                found = tuple(f for f in found if f != ("header",))
            apart = found[-1] == ("apart",)
            marker = name in ("article", "main") and not apart
            if marker:
                while stack and stack[-1][1] and stack[-1][0] in ("div", "section", "center"):  # left open
                    pop()
            inside = Inside(found, inside, apart or bool(inside and inside.apart))
            stack.append((name, apart, marker))
            open_names[name] += 1
            markers += marker
            yield name, inside.apart
        elif name in HOLDERS and open_names[name]:
            while pop() != name:
                pass


def _mean(feature: tuple) -> float:
    return MEANS.get(feature, MEANS.get(feature[0], 0.0))


def _kinds(own: tuple, hidden: bool = False) -> list[tuple]:
    """Features that hold for all words in an element, but for being apart. hidden: without names."""
    return [f for f in own if f != ("apart",) and not (f[0] == "tag" and (f[1] in LEAVES or f[1] in PLAIN)) and not (hidden and f[0] == "name")]


def _all_kinds(inside: Inside | None, hidden: bool) -> tuple[tuple, ...]:
    """Features of the words of a run. hidden: without names, nor what they say."""
    out = [("block", inside.own[0][1])] if inside else []
    apart = False
    while inside:
        out += _kinds(inside.own, hidden)
        apart = apart or inside.own[-1] == ("apart",) and (not hidden or inside.own[0][1] in APART)
        inside = inside.around
    return tuple(sorted([*out, ("apart",)] if apart else out))


def _context(inside: Inside | None, weigh: Callable[[tuple], float], known: dict[int, float]) -> float:
    """The sum of the open elements' weights, being apart counted once. known: by the elements' identity."""
    path = []
    while inside is not None and id(inside) not in known:
        path.append(inside)
        inside = inside.around
    total = known[id(inside)] if inside is not None else 0.0
    for e in reversed(path):
        total += sum(map(weigh, _kinds(e.own)))
        if e.apart and not (e.around and e.around.apart):
            total += weigh(("apart",))
        known[id(e)] = total
    return total


def _length(words: int) -> int:
    return min(8, words.bit_length())


def lengths(runs: list[Run]) -> Counter[int]:
    """Words of each block."""
    found: Counter[int] = Counter()
    for r in runs:
        found[r.block] += len(r.text.split())
    return found


def is_marked(runs: list[Run]) -> bool:
    """Whether the page has words in a marker that are neither a link's nor of an element apart."""
    return any(r.marked and not r.link and not (r.inside and r.inside.apart) and not r.text.isspace() for r in runs)


def fit(pages: list[str]) -> Weights:
    """Weights from the pages that mark their article."""
    seen: Counter[tuple] = Counter()  # (features, length, link, in the article): pages' shares of words
    tags: dict[tuple, list[float]] = {}
    n = 0
    for html in pages:
        events = list(read(html))
        runs = [e for e in events if isinstance(e, Run)]
        if not is_marked(runs):
            continue
        n += 1
        size = lengths(runs)
        parts = [(r, len(r.text.split()), r.marked and not (r.inside and r.inside.apart)) for r in runs]
        shares = [sum(words for _, words, y in parts if y is k) for k in (False, True)]
        for r, words, y in parts:  # a page's words inside and outside weigh 1 each, as the prior's
            for hidden in (False, True) if words else ():
                seen[_all_kinds(r.inside, hidden), _length(size[r.block]), r.link, y] += 0.5 * words / shares[y]
        open_in = False
        for e in events:
            if isinstance(e, Run):
                open_in = e.marked
            elif e[0] not in ("article", "main"):
                count = tags.setdefault(e, [*TAG_PRIOR])
                count[0 if open_in and not e[1] else 1] += 1
    return Weights(_regression(seen), {k: math.log(a / (a + b)) for k, (a, b) in tags.items()})


def _regression(seen: Counter[tuple], rounds: int = 30) -> dict[tuple, float]:
    """Logistic regression by Newton's method, with a normal prior for each feature."""
    names = sorted({f for k, *_ in seen for f in k} | {("base",), ("length",), ("link",)})
    at = {f: i for i, f in enumerate(names)}
    mean = np.array(list(map(_mean, names)))
    hold = np.array([HOLDS.get(f[0], 5.0) for f in names])
    w = mean.copy()
    if seen:
        x, y, c = np.zeros((len(seen), len(names))), np.zeros(len(seen)), np.zeros(len(seen))
        for i, ((kinds, length, link, inside), share) in enumerate(sorted(seen.items())):
            for f in kinds:
                x[i, at[f]] += 1
            x[i, at["base",]], x[i, at["length",]], x[i, at["link",]] = 1, length, link
            y[i], c[i] = inside, share
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (c * p * (1 - p))) @ x + np.diag(hold), x.T @ (c * (y - p)) - hold * (w - mean))
            w = w + step * min(1.0, 3.0 / (np.abs(step).max() + 1e-9))
    return dict(zip(names, w.tolist()))


def scored(html: str, weights: Weights) -> tuple[list[Run | None], list[float]]:
    """Runs, None for a tag, and their scores. As a page is taken to have an article, words gain what the best of those
    that aren't apart lacks of `LEAST`."""
    events = list(read(html))
    runs = [e for e in events if isinstance(e, Run)]
    size, marked = lengths(runs), is_marked(runs)
    weigh = lambda f: weights.words[f] if f in weights.words else _mean(f)
    base, length, link = weigh(("base",)), weigh(("length",)), weigh(("link",))
    known: dict[int, float] = {}
    unknown = math.log(TAG_PRIOR[0] / sum(TAG_PRIOR))
    words: list[int] = []
    scores: list[float] = []
    best = -math.inf
    for e in events:
        n = len(e.text.split()) if isinstance(e, Run) else 0
        if isinstance(e, Run):
            s = 0.0
            if n:
                s = _context(e.inside, weigh, known) + base + length * _length(size[e.block]) + link * e.link
                if e.inside:
                    s += weigh(("block", e.inside.own[0][1]))
                if marked:
                    s += MEANS["marked"] if e.marked else MEANS["unmarked"]
                if s > best and not (e.inside and e.inside.apart):
                    best = s
        else:
            s = weights.tags.get(e, unknown) if e[0] not in ("article", "main") else 0.0
        words.append(n)
        scores.append(s)
    more = max(0.0, LEAST - best) if best > -math.inf else 0.0
    scores = [n * max(-MOST, min(MOST, s + more)) if n else s for n, s in zip(words, scores)]
    return [e if isinstance(e, Run) else None for e in events], scores


def bounded(scores: list[float]) -> list[float]:
    """Scores with what a stretch without a positive one costs bounded to `GAP`."""
    out, spent = [], 0.0
    for s in scores:
        s = s if s > 0 else max(s, -GAP - spent)
        spent = 0.0 if s > 0 else spent + s
        out.append(s)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch [start, stop) with the largest positive sum, the first of equals; empty if none has one."""
    best, start, stop, total, begin = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, start, stop = total, begin, i + 1
    return start, stop


def main_text(html: str | None, weights: Weights, scan: bool = True) -> str:
    """The text of a page. scan: False takes the whole page for the region, to see what the scan does."""
    runs, scores = scored(html or "", weights)
    start, stop = best_region(bounded(scores)) if scan else (0, len(runs))
    touched = {r.block for r in runs[start:stop] if r and not r.text.isspace()}
    texts: dict[int, list[str]] = {}
    sums: dict[int, float] = {}
    for r, s in zip(runs, scores):
        if r and r.block in touched:
            texts.setdefault(r.block, []).append(r.text)
            sums[r.block] = sums.get(r.block, 0.0) + s
    blocks = list(texts)
    good = [i for i, b in enumerate(blocks) if sums[b] > 0]
    left_out: set[int] = set()
    for a, b in zip(good, good[1:]):  # stretches between two good blocks
        if b - a > 1 and sum(sums[k] for k in blocks[a + 1 : b]) < -CUT:
            left_out.update(k for k in blocks[a + 1 : b] if sums[k] < 0)
    lines = (SPACES.sub(" ", unescape("".join(texts[b]))).strip(" ") for b in blocks if b not in left_out)
    return "\n".join(x for x in lines if x)


def sample_pages(pages: DataFrame, sample: int, longest: int) -> list[str]:
    """The pages with a marker that have the smallest hashes of their ids and addresses. A share of hashes is cut off
    first that leaves about twice the sample of all pages, so tasks don't each send a sample of their own."""
    low = F.lower("html")
    marked = pages.filter((low.contains("<article") | low.contains("<main")) & (F.length("html") <= longest)).select(F.xxhash64("page_id", "url").alias("h"), "html")
    n = marked.count()
    few = marked.filter(F.shiftrightunsigned("h", 2) <= int(2**62 * min(1.0, 2 * sample / max(1, n))))
    return [r["html"] for r in few.orderBy("h", "html").limit(sample).collect()]


def extract(pages: DataFrame, sample: int = 300, longest: int = 20_000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    weights = fit(sample_pages(rows, sample, longest))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1000, column="html"):
            texts = [main_text(h, weights) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
