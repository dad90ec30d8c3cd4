"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A classifier of structure (tags, class and id
words of the enclosing elements, link share, length) gives each block a cost for
either label; the costs are the capacities from the source (content) and to the sink
(boilerplate).  Neighbouring blocks, and blocks under one parent, are joined by edges
whose capacity falls with their distance in the DOM.  A maximum flow separates
the two sides; the blocks that stay with the source are the text.

Blocks whose own capacity exceeds all their edges are on a known side of every minimum
cut and are settled first; the flow is then run on what is left.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.text import small_batches

# Elements and words that mark structure.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template svg math canvas object select option "
    "datalist button head audio video map".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar side aside footer foot masthead header topbar toolbar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login register search comment "
    "comments disqus reply replies respondent discussion share sharing social related recommended recommendations widget "
    "pagination pager tags copyright legal disclaimer form skip outbrain taboola".split())
GOOD_WORDS = frozenset("article content main post entry story body text page prose".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """An open element: its depth and what its attributes say."""

    __slots__ = ("tag", "parent", "depth", "cue", "hidden", "link")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = (parent.hidden if parent else False) or tag in HIDDEN
        self.link = (parent.link if parent else False) or tag == "a"
        self.cue = -1 if tag in BAD_TAGS else 1 if tag in GOOD_TAGS else 0
        if tag == "header" and not self.within(GOOD_TAGS):
            self.cue = -1
        if attributes and tag not in ("html", "body"):
            self._read(attributes)

    def within(self, tags: frozenset) -> bool:
        node = self.parent
        while node:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def _read(self, attributes: str) -> None:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role" and value.lower() in BAD_ROLES:
                self.cue = -1
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                self.hidden = True
            elif name in ("class", "id", "itemprop") and self.cue == 0:
                words = {w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value))}
                if words & BAD_WORDS and not words & {"with", "has", "no", "without"}:
                    self.cue = -1
                elif words & GOOD_WORDS:
                    self.cue = 1


class Block:
    """A run of text without a block boundary inside."""

    __slots__ = ("text", "parent", "linked")

    def __init__(self, text: str, parent: Element, linked: float):
        self.text, self.parent, self.linked = text, parent, linked


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, character references decoded, white space collapsed."""
    root = Element("", None, "")
    stack = [root]
    out: list[Block] = []
    pieces: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            home = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)
            out.append(Block(text, home, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def say(data: str) -> None:
        nonlocal linked
        if data and not stack[-1].hidden:
            data = html.unescape(data) if "&" in data else data
            pieces.append(data)
            if stack[-1].link:
                linked += len(data.strip())

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if any(e.tag in BLOCK for e in stack[k:]):
                    flush()
                del stack[k:]
                return
            if stack[k].tag in ("table", "td", "th") and tag not in BLOCK:
                return

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            tail = page[at:]
            # a tag cut off by the end of the page is markup
            cut = re.search(r"<[/!a-zA-Z][^>]*\Z", tail)
            say(tail[:cut.start()] if cut else tail)
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                say(" ")
            elif tag == "p" and not any(e.tag == "p" for e in stack):
                flush()
            else:
                close(tag)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
            # a new block ends an open paragraph, a new item the item before it
            if stack[-1].tag != "p" and any(e.tag == "p" for e in stack[-8:]):
                while any(e.tag == "p" for e in stack[-8:]):
                    stack.pop()
            elif stack[-1].tag == "p":
                stack.pop()
            for same in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)):
                if tag in same and stack[-1].tag in same:
                    stack.pop()
        if tag in VOID:
            if tag == "img":
                say(" ")
            continue
        element = Element(tag, stack[-1], m[3] or "")
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 or end if stop else end
            continue
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append(element)
    flush()
    return out


def block_score(block: Block) -> float:
    """Positive for content, negative for boilerplate."""
    words = block.text.count(" ") + 1
    score = -0.4 + min(words / 20, 1.5) - 3.0 * block.linked
    score += {"p": 0.8, "pre": 0.8, "blockquote": 0.8, "h1": 0.8, "h2": 0.4, "h3": 0.4}.get(block.parent.tag, 0.0)
    node, strong = block.parent, 0
    while node:
        if node.cue and not strong:
            strong = node.cue
            score += 6.0 * node.cue
        elif node.tag in BAD_TAGS:
            score -= 8.0
        elif node.cue:
            score += 1.0 * node.cue
        node = node.parent
    return score


def _steps(a: Element, b: Element) -> int:
    """Edges between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True where a node stays with the source.

    unary > 0 is the capacity from the source, < 0 that to the sink.
    """
    n = len(unary)
    unary = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if side[k] is None and abs(unary[k]) > sum(near[k].values()):
            side[k] = unary[k] > 0
            for other, w in near[k].items():
                unary[other] += w if side[k] else -w
                del near[other][k]
                todo.append(other)
            near[k] = {}
    left = [k for k in range(n) if side[k] is None]
    if not left:
        return [bool(s) for s in side]
    # breadth-first augmenting paths on the rest
    source, sink = n, n + 1
    flow: dict[int, dict[int, float]] = {k: dict(near[k]) for k in left}
    flow[source], flow[sink] = {}, {}
    for k in left:
        if unary[k] > 0:
            flow[source][k] = unary[k]
            flow[k][source] = 0.0
        else:
            flow[k][sink] = -unary[k]
            flow[sink][k] = 0.0
    while True:
        back = {source: source}
        queue = deque([source])
        while queue and sink not in back:
            a = queue.popleft()
            for b, room in flow[a].items():
                if room > 1e-9 and b not in back:
                    back[b] = a
                    queue.append(b)
        if sink not in back:
            return [k in back if side[k] is None else bool(side[k]) for k in range(n)]
        path, b = [], sink
        while b != source:
            path.append((back[b], b))
            b = back[b]
        push = min(flow[a][b] for a, b in path)
        for a, b in path:
            flow[a][b] -= push
            flow[b][a] = flow[b].get(a, 0.0) + push


def main_text(page: str, smoothness: float = 1.5) -> str:
    """The content blocks of a page in order, separated by an empty line."""
    found = blocks(page)
    edges: dict[tuple[int, int], float] = {}
    last: dict[Element, int] = {}
    for k, b in enumerate(found):
        if k:
            edges[k - 1, k] = smoothness / (1 + _steps(found[k - 1].parent, b.parent))
        above = b.parent.parent or b.parent
        if above in last and last[above] != k - 1:
            edges[last[above], k] = smoothness / 4
        last[above] = k
    keep = minimum_cut([block_score(b) for b in found], edges)
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches):
    for batch in batches:
        texts = [main_text(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                         names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages without `html`, with `text`, the main text (empty if there is none, or html is null).

    Rows are independent: repeated rows give repeated results, whole pages are read
    whatever their length.  A column named text is replaced, others pass through.
    """
    small_batches(pages.sparkSession, 256)
    own = [c for c in pages.columns if c.lower() not in ("html", "text")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*own).schema)
    return pages.select(*own, F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_extract, f"{schema}text string")
