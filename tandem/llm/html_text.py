"""HTML extraction by minimum-cut labelling.

A page becomes its blocks of text, in page order. A logistic classifier, trained in numpy on a bounded sample of labelled pages
(html_sample), gives each block a logit from its length, links, tags, place, containers and neighbours; it is the
capacity to the terminal of content or of boilerplate. Blocks that follow each other, and blocks of the same container, are joined
by smoothness edges that grow with their proximity in the document tree and shrink where a container with a meaning of its
own (navigation, article, advert) stands between them. The minimum cut that separates the terminals, found by maximum
flow, is the cheapest labelling. Costs are tempered, so that a short or odd block follows its neighbours; the strength of
the edges is the one that labels most blocks of a second sample rightly.

The text is whole: nothing but boilerplate is dropped, nothing is capped. Character references are decoded, white space
in a block becomes one space, and blocks are joined by a line feed. Line breaks and inline markup are white space or
nothing inside a block. What is marked as hidden is not shown and so no text. Markup that is broken or cut off is read as far as it goes.

Null, empty and text-free pages give an empty text. Repeated rows are extracted each.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_sample import labelled_pages
from .tables import map_arrow

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of the HTML standard, and words used in class and id names.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = set("nav header footer aside form button select menu head noscript template dialog fieldset svg object canvas audio video".split())
GOOD_TAGS = set("article main".split())
BAD_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s])", re.I)
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
GOOD_NAMES = re.compile(r"(?:^|[-_\s])(?:article|articlebody|content|entry|post|story)(?:$|[-_\s])", re.I)

COMMENT_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|replies|reply|respond)(?:$|[-_\s])", re.I)
#: Class names that tell what a page has, not what an element is.
ABOUT = re.compile(r"(?:^|\s)(?:has|with|no|without|is)-\S*", re.I)
CELLS = set("td th pre blockquote figcaption dd dt code".split())

#: Smoothness of neighbours by how many containers up they meet; the share left where a wall stands between; that of blocks of one container.
PROXIMITY, WALL, SIBLING = (1.0, 0.6, 0.3), 0.1, 0.3
#: Pages of the training sample, and of the one that chooses the strength of edges; the strengths; the largest logit.
SAMPLE, STRENGTHS, CLIP = 140, (0.25, 0.5, 1.0, 1.5, 2.0, 3.0), 8.0


@dataclass
class Element:
    """An open element, with what its name and attributes tell."""

    tag: str
    kind: int
    hidden: bool
    number: int
    #: Of this element and those around it: how many have a kind, names of content, tags and names of boilerplate, headers.
    walls: int = 0
    within: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    #: What they tell together, see placed(); the place on the stack of the innermost block element.
    told: tuple[float, float, float, float, float, float] = (0.0,) * 6
    block: int = -1


@dataclass
class Block:
    """A stretch of text between block boundaries."""

    path: tuple[Element, ...]  # the innermost three
    depth: int = 0
    shared: int = 0  # elements around both this block and the one before, and how many of them have a kind
    shared_walls: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(tag: str, attributes: str, number: int) -> Element:
    named = {}
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            named.setdefault(name.lower(), a or b or c)
    label = ABOUT.sub(" ", f"{named.get('class', '')} {named.get('id', '')}")
    role = named.get("role", "").lower()
    style = named.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    bad_names = COMMENT_NAMES if tag in GOOD_TAGS or role in ("main", "article") else BAD_NAMES
    if tag in BAD_TAGS or role in BAD_ROLES or bad_names.search(label) and tag not in ("html", "body"):
        # A name of content of its own beside one of boilerplate ("post share") says nothing either way: the text inside decides.
        torn = not COMMENT_NAMES.search(label) and any(GOOD_NAMES.search(x) and not BAD_NAMES.search(x) for x in label.split())
        kind = -1 if tag in BAD_TAGS or role in BAD_ROLES else 0 if torn else -2
    elif tag in GOOD_TAGS or role in ("main", "article") or named.get("itemprop") == "articleBody":
        kind = 2
    else:
        kind = int(bool(GOOD_NAMES.search(label)) and tag in BLOCKS)
    return Element(tag, kind, hidden, number)


def placed(e: Element, stack: list[Element]) -> Element:
    """e with what it and the elements around it tell: (bad tag, bad name, header, good tag, good name, something bad outside a good tag)."""
    around = stack[-1] if stack else Element("", 0, False, 0)
    e.hidden, e.walls = e.hidden or around.hidden, around.walls + (e.kind != 0)
    e.block = len(stack) if e.tag in BLOCKS else around.block
    name, bad_tag, bad_name, header = around.within
    head = e.kind < 0 and e.tag == "header"
    if head:
        e.told = (*around.told[:2], 1.0, *around.told[3:])
    elif e.kind < 0:
        e.told = (max(bad_tag, float(e.kind == -1)), max(bad_name, float(e.kind == -2)), header, 0.0, 0.0, 0.0)
    elif e.kind == 2:
        e.told = (0.0, 0.0, 0.0, 1.0, name, max(bad_tag, bad_name, header))
    else:
        e.told = (*around.told[:4], 1.0, around.told[5]) if e.kind == 1 else around.told
    bad = e.kind < 0 and not head
    e.within = (max(name, float(e.kind == 1)), max(bad_tag, float(bad and e.kind == -1)), max(bad_name, float(bad and e.kind == -2)), max(header, float(head)))
    return e


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text."""
    stack: list[Element] = []
    out: list[Block] = []
    now: Block | None = None
    at, number, links = 0, 0, 0
    low = 0  # the least depth of the stack since the last block began
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        nonlocal low
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]
        low = min(low, i)

    def text(raw: str) -> None:
        nonlocal now, low
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(tuple(stack[-3:]), len(stack), low, stack[low - 1].walls if low else 0)
            low = len(stack)
            out.append(now)
        decoded = unescape(raw) if "&" in raw else raw
        now.parts.append(decoded)
        if links:
            now.linked += len("".join(decoded.split()))

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in BLOCKS:
                now = None
            if tag == "a":
                links = max(links - 1, 0)
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # the end of an inline element does not close a block
            continue
        if tag in BLOCKS:
            now = None
            if stack and tag not in ("html", "body") and (i := _ended(stack, tag)) >= 0:
                close(i)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag == "br":
            text(" ")
        elif tag not in EMPTY:
            number += 1
            if tag in BLOCKS or tag in BAD_TAGS or "=" in (m["attributes"] or m["attributes2"] or ""):
                stack.append(placed(_element(tag, m["attributes"] or m["attributes2"] or "", number), stack))
            else:
                stack.append(placed(Element(tag, 0, False, number), stack))
            opened[tag] += 1
            links += tag == "a"
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    kept: list[Block] = []
    shared = None  # with the last block kept, over those left out
    for b in out:
        shared = (b.shared, b.shared_walls) if shared is None else min(shared, (b.shared, b.shared_walls))
        if b.text and not (b.path and b.path[-1].hidden):
            b.shared, b.shared_walls = shared
            kept.append(b)
            shared = None
    return kept


def _ended(stack: list[Element], tag: str) -> int:
    """The place of the paragraph, item, row or cell that the start of a block ends, or -1."""
    ended = {"p"} | ({tag} if tag in ("li", "tr", "option") else {"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else set())
    i = stack[-1].block
    return i if i >= 0 and stack[i].tag in ended else -1


def _own(b: Block) -> list[float]:
    """Features of a block by itself."""
    words = b.text.count(" ") + 1
    density = min(b.linked / max(len(b.text) - words + 1, 1), 1.0)
    tags = {e.tag for e in b.path}
    bad_tag, bad_name, header, good_tag, good_name, outer = b.path[-1].told if b.path else (0.0,) * 6
    sentence = float(words >= 8 and b.text[-1] in ".!?…。！？")
    return [
        float(np.log1p(words)) / 3, sentence, density, float(density > 0.9), float(bool(tags & HEADINGS)), float("p" in tags), float("li" in tags), float(bool(tags & CELLS)),
        bad_tag, bad_name, header * (1 - good_tag), header * good_tag, good_tag, good_name, outer, float(not (bad_tag or bad_name or good_tag or good_name)) * (sentence - density),
    ]


def features(found: list[Block]) -> np.ndarray:
    """One row for each block: its own features, length and links of its neighbours, its place, and a constant."""
    own = np.array([_own(b) for b in found])
    around = np.zeros((len(own) + 2, 2))
    around[1:-1] = own[:, [0, 2]]
    place = np.arange(len(own)) / max(len(own) - 1, 1)
    return np.column_stack((own, around[:-2], around[2:], place, np.ones(len(own))))


def trained(x: np.ndarray, y: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
    return w


def _labelled(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    pages = [(blocks(html), kept) for html, kept in labelled_pages(n, seed)]
    return [(found, np.array([b.text.split()[0] in kept for b in found])) for found, kept in pages]


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    """Weights of the classifier, and the strength of the edges."""
    sample = _labelled(SAMPLE, 1)
    weights = trained(np.concatenate([features(f) for f, _ in sample]), np.concatenate([y for _, y in sample]))
    other = _labelled(SAMPLE, 2)
    right = [sum((np.array(labels(f, (weights, s))) == y).sum() for f, y in other) for s in STRENGTHS]
    return weights, STRENGTHS[int(np.argmax(right))]


def costs(found: list[Block], weights: np.ndarray) -> list[float]:
    """The classifier's logits: above 0 for content."""
    return np.clip(features(found) @ weights, -CLIP, CLIP).tolist()


def proximity(a: Block, b: Block) -> float:
    """The smoothness between a block and the next: by how far up the tree their paths meet, and whether a wall stands between."""
    up = max(a.depth, b.depth) - b.shared
    wall = any(x.path and x.path[-1].walls > b.shared_walls for x in (a, b))
    return PROXIMITY[min(max(up - 1, 0), len(PROXIMITY) - 1)] * (WALL if wall else 1.0)


def max_flow(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The side of the minimum cut on which each node is: True with the source (content)."""
    n = len(costs)
    graph: list[list[list]] = [[] for _ in range(n + 2)]
    s, t = n, n + 1

    def link(u: int, v: int, there: float, back: float) -> None:
        graph[u].append([v, there, len(graph[v])])
        graph[v].append([u, back, len(graph[u]) - 1])

    for i, c in enumerate(costs):
        link(*((s, i) if c > 0 else (i, t)), abs(c), 0.0)
    for (i, j), w in edges.items():
        link(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, room, _ in graph[u]:
                if room > 1e-9 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        spot = [0] * (n + 2)
        path: list[tuple[int, int]] = []
        u = s
        while True:  # a blocking flow, by depth-first search without recursion
            if u == t:
                least = min(graph[a][k][1] for a, k in path)
                for a, k in path:
                    e = graph[a][k]
                    e[1] -= least
                    graph[e[0]][e[2]][1] += least
                path, u = [], s
            elif spot[u] < len(graph[u]):
                v, room, _ = graph[u][spot[u]]
                if room > 1e-9 and level[v] == level[u] + 1:
                    path.append((u, spot[u]))
                    u = v
                else:
                    spot[u] += 1
            elif path:
                u, k = path.pop()
                spot[u] += 1
            else:
                break


def edges(found: list[Block], strength: float) -> dict[tuple[int, int], float]:
    """Smoothness of pairs of blocks: neighbours in the page, and in the same container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out[i - 1, i] = strength * proximity(found[i - 1], b)
        parent = b.path[-2].number if len(b.path) > 1 else -1
        if parent in last:
            out[last[parent], i] = out.get((last[parent], i), 0) + strength * SIBLING
        last[parent] = i
    return out


def labels(found: list[Block], fitted: tuple[np.ndarray, float]) -> list[bool]:
    """Whether each block is content: the sides of the minimum cut.

    A block whose own cost outweighs all its edges is on that side of every minimum cut; it is merged with the terminal before
    the flow is sought among the rest.
    """
    if not found:
        return []
    own, joined = costs(found, fitted[0]), edges(found, fitted[1])
    around: list[list[tuple[int, float]]] = [[] for _ in found]
    for (i, j), w in joined.items():
        around[i].append((j, w))
        around[j].append((i, w))
    sure = {i: c > 0 for i, c in enumerate(own) if abs(c) > sum(w for _, w in around[i])}
    rest = [i for i in range(len(found)) if i not in sure]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        left = [own[i] + sum(w if sure[j] else -w for j, w in around[i] if j in sure) for i in rest]
        inner = {(at[i], at[j]): w for (i, j), w in joined.items() if i in at and j in at}
        sure |= dict(zip(rest, max_flow(left, inner)))
    return [sure[i] for i in range(len(found))]


def main_text(html: str, fitted: tuple[np.ndarray, float] | None = None) -> str:
    """The main text of a page."""
    found = blocks(html)
    return "\n".join(b.text for b, content in zip(found, labels(found, fitted or model())) if content)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points)."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    fitted = model()  # trained once, here; tasks get the weights
    kinds = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h or "", fitted) for h in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    own = "_".join(["html", *kept])  # differs from every other name
    return map_arrow(pages.select(*kept, F.col(html_col).cast("string").alias(own)), run, kinds)
