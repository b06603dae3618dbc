"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of HTML, and the names that sites give to what is no article: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style".split())
NOISE = frozenset("head title script style noscript template nav header footer aside form button select option textarea iframe object svg canvas menu dialog video audio map".split())
NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside widget ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager search toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that an opening block ends, and those that end a sibling of their kind.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
KEEP = frozenset("html body article main".split())
#: Elements whose text is no text of the page.
HIDDEN = frozenset("head title script style noscript template textarea select option iframe object svg canvas video audio map".split())
#: What a block's score counts by its element's names.
NOISE_WEIGHT, ARTICLE_WEIGHT = 0.02, 4.0

_MARK = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)")
_LOOSE = re.compile(r"</?[a-zA-Z][^>]*+>")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")


@lru_cache(4096)
def noisy(tag: str, attrs: str) -> bool:
    """Whether an element, by its own tag and attributes, is no part of an article."""
    if tag in NOISE:
        return True
    if tag in KEEP or not attrs.strip(" /"):
        return False
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        return True
    if got.get("role", "").lower() in ROLES:
        return True
    return any(w.lower() in NAMES for k in ("class", "id") for w in _PART.split(got.get(k, "")) if w)


class Node:
    """An element: its tag, whether it is noise by its own or an outer one's names,
    whether an article or main element holds it, and the number of its tag path."""

    __slots__ = ("tag", "noise", "article", "parent", "path", "gain", "inside")

    def __init__(self, tag: str, noise: bool, parent: Node | None, path: int) -> None:
        self.tag, self.parent, self.path = tag, parent, path
        self.noise = noise or bool(parent and parent.noise)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.gain, self.inside = 0.0, False


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements, outer ones first, and the blocks of text in page order: innermost
    element, text. What is never shown as text (head, scripts, styles and the like) has
    none. Every mark is handled in constant or amortised time, however deep the page."""
    root = Node("", False, None, 0)
    nodes, stack, paths = [root], [root], {}
    #: Places in the stack of the open elements of each tag.
    opened: dict[str, list[int]] = {}
    out, held = [], []
    owner = root
    hidden = 0
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((owner, text))
            held = []

    def words(raw: str) -> None:
        nonlocal owner
        if hidden or not raw:
            return
        if not held:
            if raw.isspace():
                return
            owner = stack[-1]
        held.append(html.unescape(raw) if "&" in raw else raw)

    def cut(to: int) -> None:
        """Close all elements from a place in the stack on."""
        nonlocal hidden
        while len(stack) > to:
            x = stack.pop()
            opened[x.tag].pop()
            hidden -= x.tag in HIDDEN

    def last(tags: str) -> int:
        return max((opened[t][-1] for t in tags.split() if opened.get(t)), default=0)

    def leave(kinds: str, scope: str) -> None:
        """Close the innermost element of the kinds, unless one of the scope is nearer."""
        x = last(kinds)
        if x > last(scope) and x > last("article main body"):
            cut(x)

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            words(page[pos:])
            break
        m = _MARK.match(page, lt) or None
        if m is None and (loose := _LOOSE.match(page, lt)):
            inner = loose.group()[1:-1]
            close = inner.startswith("/")
            name, attrs, end = re.split(r"[\s/>]", inner.lstrip("/"), maxsplit=1)[0], "", loose.end()
        elif m is None:
            words(page[pos : lt + 1])
            pos = lt + 1
            continue
        else:
            close, name, attrs, end = bool(m[3]), m[4] or "", m[5] or "", m.end()
        words(page[pos:lt])
        if m is not None and m[1]:
            end = page.find("-->", lt + 4)
            pos = n if end < 0 else end + 3
            continue
        if m is not None and m[2]:
            end = page.find(">", lt)
            pos = n if end < 0 else end + 1
            continue
        pos, name = end, name.lower()
        if name in VOID:
            if name in ("br", "hr", "img") and not hidden and held:
                held.append(" ")
            if name == "hr":
                flush()
            continue
        block = name not in INLINE
        if block:
            flush()
        if close:
            if opened.get(name):
                cut(opened[name][-1])
            continue
        if block and name not in RAW:
            if name in SIBLINGS:
                leave(*SIBLINGS[name])
            else:
                leave("p", "td th li button")
        if attrs.rstrip().endswith("/") and name not in INLINE and name in ("svg", "path"):
            continue
        up = stack[-1]
        node = Node(name, noisy(name, attrs), up, paths.setdefault((up.path, name), len(paths) + 1))
        opened.setdefault(name, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
        hidden += name in HIDDEN
        if name in RAW or name in ("title", "textarea"):
            end = re.compile(f"</{name}", re.I).search(page, pos)
            pos = end.start() if end else n
    flush()
    return nodes, out


def _smooth(values: list[float], reach: int = 2) -> list[float]:
    """Weights 1, 1/2, 1/4 by distance, in page order."""
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = 0.5 ** abs(i - j)
            total, weight = total + w * values[j], weight + w
        out.append(total / weight)
    return out


def content_nodes(found: list[tuple[Node, str]]) -> list[bool]:
    """Which blocks are content: text length and punctuation are summed over each
    root-to-leaf tag path and divided by its nodes; both ratios are smoothed in page
    order, multiplied, and held against their standard deviation. Names are a feature:
    the score of a block that they call noise counts a fiftieth, that of one in an
    article or main element four times."""
    if not found:
        return []
    stats: dict[int, list[int]] = {}
    for node, text in found:
        s = stats.setdefault(node.path, [0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCT.findall(text))
        s[2] += 1
    length = _smooth([stats[x.path][0] / stats[x.path][2] for x, _ in found])
    marks = _smooth([stats[x.path][1] / stats[x.path][2] for x, _ in found])
    fused = [a * (1 + b) * (NOISE_WEIGHT if x.noise else ARTICLE_WEIGHT if x.article else 1.0) for a, b, (x, _) in zip(length, marks, found)]
    mean = sum(fused) / len(fused)
    spread = (sum((f - mean) ** 2 for f in fused) / len(fused)) ** 0.5
    bar = min(spread, max(fused))
    return [f >= bar for f in fused]


def main_text(page: str) -> str:
    """The article of a page. An element gains the text of its blocks that are content
    nodes, and loses that of others outside of articles; the one that holds the article is
    the innermost with nine tenths of the largest gain, or the page if none gains. Its
    blocks are given one a line, but for those that names call noise and scores don't
    call content."""
    nodes, found = blocks(page)
    if not found:
        return ""
    chosen = content_nodes(found)
    for (node, text), yes in zip(found, chosen):
        node.gain += len(text) if yes else 0 if node.article else -len(text)
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.gain += x.gain
    best, most = nodes[0], max(x.gain for x in nodes)
    for x in nodes:
        if x.gain >= 0.9 * most and most > 0 and x.tag not in INLINE and x.tag != "p":
            best = x
    best.inside = True
    for x in nodes:
        x.inside = x.inside or bool(x.parent and x.parent.inside)
    return "\n".join(text for (node, text), yes in zip(found, chosen) if node.inside and (yes or not node.noise))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars.

    Null html is an empty page, whose text is empty; null ids and urls stay null. Pages
    are read whole, in time linear in their length and depth, and rows are independent, so repeated rows give repeated results and nothing is shuffled;
    extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(h or "") for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
