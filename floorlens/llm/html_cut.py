"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks with the elements around them. A logistic
classifier over what an element is called and how its text looks gives each
block a cost of either label; they are the capacities to the two terminals.
Neighbouring blocks, and blocks under the same element, are tied by edges that
weigh less the further apart their elements are. The minimum cut of that graph,
found by maximum flow, separates content from boilerplate.

The classifier is trained on a bounded sample of pages. A block's label there
is that of the nearest element whose name settles it (an article or main
element against navigation, footers, forms and the like); the name is hidden
from the features of every other block, so that text, links and place in the
page learn weights of their own.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import add_columns

SAMPLE = 400
STEPS, RATE, PENALTY = 300, 0.5, 1e-3
NEXT, SAME = 0.8, 0.4  # weight of an edge to the next block, to the next under the same element

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template head title svg math iframe object select textarea button canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
#: An open paragraph ends where one of these begins.
ENDS_P = BREAKING - {"body", "html", "caption", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that end an open one of the same set.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Words in names of elements that speak for and against main text.
FOR = frozenset("article main content post entry story body text".split())
AGAINST = frozenset(
    "ad ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notification pager pagination popup privacy promo promoted promotion recommended related replies reply respond search share "
    "sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toolbar widget".split()
)

FEATURES = [
    "against_near", "against_far", "for_near", "for_far", "in_list", "heading", "paragraph", "links", "length", "long", "stops", "place",
    "after_place", "one",
]


def names(tag: str, attributes: str) -> frozenset[str]:
    """The words an element is named by: its tag, and its class, id and role."""
    words = {tag}
    for value in NAMED.findall(attributes):
        words.update(x.lower() for x in PART.findall(value))
    return frozenset(words)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text, path, linked):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. ``path``: (element number, tag, names) from
    the root; ``linked``: characters inside links. Unread elements, comments
    and markup are left out; character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[int, str, frozenset[str]]] = []
    pieces: list[tuple[str, bool]] = []
    number, at, hidden, linked = 0, 0, 0, 0

    def flush():
        if pieces:
            whole = " ".join(html.unescape("".join(x for x, _ in pieces)).split())
            if whole:
                out.append(Block(whole, tuple(s for s in stack if s[1] in BREAKING), sum(len(x.strip()) for x, a in pieces if a)))
            pieces.clear()

    def close(index):
        nonlocal hidden, linked
        for _, tag, _ in stack[index:]:
            hidden -= tag in UNREAD
            linked -= tag == "a"
        del stack[index:]

    while True:
        found = TAG.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text and not hidden:
            pieces.append((text, linked > 0))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if tag == "br":
            if not hidden:
                pieces.append((" ", False))
            continue
        if tag in BREAKING:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][1] == tag:
                    close(i)
                    break
            continue
        if tag in EMPTY:
            continue
        if tag in ENDS_P or tag in SIBLINGS:
            ends = SIBLINGS.get(tag, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][1] in ends:
                    close(i)
                    break
                if stack[i][1] in ("ul", "ol", "table", "dl", "div", "article", "section", "main", "body"):
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            if found[0].endswith("/>"):
                continue
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        number += 1
        stack.append((number, tag, names(tag, attributes)))
        hidden += tag in UNREAD
        linked += tag == "a"
    flush()
    return out


def settled(block: Block) -> int | None:
    """1 or 0 where an element's name settles it, the nearest one first."""
    for _, tag, words in reversed(block.path):
        if words & AGAINST and not (tag == "header" and any(t in ("article", "main") for _, t, _ in block.path)):
            return 0
        if tag in ("article", "main"):
            return 1
    return None


def describe(page: list[Block], shown: np.ndarray | None = None) -> np.ndarray:
    """A row of features for each block; ``shown``: whose element names count."""
    n = len(page)
    x = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(page):
        near_against = near_for = far_against = far_for = 0
        inside = any(t in ("article", "main") for _, t, _ in b.path)
        if shown is None or shown[i]:
            nearest = 0
            for _, tag, words in reversed(b.path):
                against = bool(words & AGAINST) and not (tag == "header" and inside)
                speaks = -1 if against else 1 if words & FOR - {"body", "text"} or tag != "body" and words & FOR else 0
                nearest = nearest or speaks
                far_against |= speaks < 0
                far_for |= speaks > 0
            near_against, near_for = nearest < 0, nearest > 0
        tags = {t for _, t, _ in b.path[-2:]}
        size = len(b.text)
        x[i] = (
            near_against, far_against, near_for, far_for, bool(tags & {"li", "td", "th", "dt", "dd"}),
            bool(tags & {"h1", "h2", "h3", "h4", "h5", "h6"}), "p" in tags, min(1.0, b.linked / size), min(np.log1p(size) / 5, 2), size > 120,
            min(3, sum(b.text.count(c) for c in ".,;:!?")) / 3, i / n, (n - 1 - i) / n, 1.0,
        )
    return x


def train(pages: list[str]) -> np.ndarray:
    """Logistic weights; with nothing to learn from, those of the names alone."""
    prior = np.zeros(len(FEATURES))
    prior[[0, 2]] = -4.0, 4.0
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for p in pages:
        found = blocks(p)
        if found:
            truth = [settled(b) for b in found]
            rows.append(describe(found, rng.random(len(found)) < 0.5)[[t is not None for t in truth]])
            labels += [t for t in truth if t is not None]
    if len(set(labels)) < 2:
        return prior
    x, y, w = np.concatenate(rows), np.array(labels, float), prior.copy()
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-x @ w))
        w -= RATE * (x.T @ ((p - y) * weight) / len(y) + PENALTY * (w - prior))
    return w


def _apart(a: Block, b: Block) -> int:
    """Elements between the two blocks' own, by way of what holds both."""
    same = 0
    for p, q in zip(a.path, b.path, strict=False):
        if p[0] != q[0]:
            break
        same += 1
    return len(a.path) + len(b.path) - 2 * same


def minimum_cut(margin: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost. ``margin``: how much cheaper True is for a
    node; an edge costs its weight if its ends differ. Nodes whose margin beats
    all their open edges keep their own label in every minimum, so they are
    settled first; the rest is a maximum flow by shortest paths."""
    n = len(margin)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull, rest = list(margin), [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) >= rest[i]:
            label[i] = pull[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    pull[j] += w if label[i] else -w
                    rest[j] -= w
                    queue.append(j)
    free = [i for i in range(n) if label[i] is None]
    if not free:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: {} for i in (*free, source, sink)}

    def join(a, b, there, back):
        room[a][b] = room[a].get(b, 0.0) + there
        room[b][a] = room[b].get(a, 0.0) + back

    for i in free:
        join(*((source, i) if pull[i] > 0 else (i, sink)), abs(pull[i]), 0.0)
        for j, w in near[i]:
            if i < j and label[j] is None:
                join(i, j, w, w)
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            break
        way, b = [], sink
        while b != source:
            way.append((came[b], b))
            b = came[b]
        least = min(room[a][b] for a, b in way)
        for a, b in way:
            room[a][b] -= least
            room[b][a] += least
    for i in free:
        label[i] = i in came
    return [bool(x) for x in label]


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    margin = (describe(found) @ weights).tolist()
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT / (1 + _apart(found[i - 1], b))))
        holder = b.path[-2][0] if len(b.path) > 1 else 0
        if last.get(holder, i - 1) < i - 1:
            edges.append((last[holder], i, SAME))
        last[holder] = i
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(margin, edges), strict=True) if keep)


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Trains on about ``sample`` pages, drawn by a hash of their url and html."""
    rows = pages.where(F.col("html").isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("url", "html"), F.lit(1_000_000)) < F.lit(int(1e6 * sample / n) + 1))
    return train(sorted(r[0] for r in rows.select("html").limit(sample).collect()))


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds ``text`` (main blocks in page order, joined by a newline; empty if
    there are none) and ``n_chars`` to each row of ``pages``. Null and empty
    html has no blocks; a page cut off in the middle is read as far as it goes.
    Repeated rows each return; columns of the same names are replaced."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    given = weights.tolist()

    def make():
        learned = np.array(given)

        def work(part):
            texts = [main_text(x, learned) for x in part.column("html").to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return add_columns(pages, "html", fields, make, drop=("html",))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), fit(pages)).select("page_id", "url", "text", "n_chars")
