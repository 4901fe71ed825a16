"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier over a block's ancestors,
words, links and punctuation gives what it costs to call the block content or
boilerplate: the capacities to the two terminals. Smoothness edges cost their capacity
if the labels of their ends differ: blocks next to each other are joined by one that is
the weaker the further apart they are in the tree of elements, and blocks whose
elements follow each other below one parent by another. A maximum flow finds the
cheapest labelling: what a block of few words says for itself weighs less than its
edges, so it goes with the blocks around it.

The edges are nested arcs over the row of blocks, so there is always a block with two
neighbours at most. Its flow is settled in closed form (it becomes capacities of its
neighbours and of one edge between them), and the next one's after it: a page takes
time in proportion to its blocks. In other graphs, what is left is solved by
augmenting paths.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML's element kinds.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes svg math object xmp title".split())
CLOSES_P = BLOCKS - {"html", "head", "body", "title", "option", "optgroup"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select body html article section div".split())

#: Weights of the classifier, in thousandths; positive speaks for content. Pages have no labels: the weights are parameters.
IN_TAG = {"article": 900, "main": 900, "nav": -3000, "footer": -3000, "aside": -3000, "form": -3000, "header": -2500, "menu": -3000, "head": -20000, "select": -3000, "button": -3000, "dialog": -3000, "label": -1500, "figure": -200, "fieldset": -2000}
OWN_TAG = {"p": 300, "h1": 500, "h2": 400, "h3": 400, "h4": 300, "blockquote": 300, "pre": 300, "td": -100, "li": -150, "dd": 100, "dt": 0}
BAD_NAME, GOOD_NAME = -3000, 500
LENGTH, LINKS, SENTENCE, BIAS = 350, -4000, 400, -1200
#: Capacities between blocks next to each other (of sibling elements; less by the cube of the distance in the tree), and between blocks of one parent that follow each other.
NEXT, SAME_PARENT = 450, 450
#: Words in class, id or role that speak for boilerplate and for content.
BAD = frozenset("ad ads advert advertisement advertising adbox adslot banner sponsor sponsored promo promoted cookie cookies consent gdpr notice notification alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager legal copyright toc complementary contentinfo dialog".split())
GOOD = frozenset("article articlebody content main post entry body story text maincontent postcontent entrycontent".split())

#: A value's quote follows its =; it ends where white space, / or > follows the next quote of its kind, however far
#: that is. Every other quote is a character like any other: the tag ends at the first > outside a value. A scan from
#: a quote ends at the next one, so that all scans together take time in proportion to the page.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*"[^"]*+"(?=[\s/>])|=\s*'[^']*+'(?=[\s/>])|[="'])*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z]+")


class Block:
    """Text, score, and where it hangs: number of its element's parent, depth, and distance in the tree from the block before."""

    __slots__ = ("cost", "depth", "distance", "parent", "text")

    def __init__(self, text: str, cost: int, parent: int, depth: int, distance: int):
        self.text, self.cost, self.parent, self.depth, self.distance = text, cost, parent, depth, distance


class _Node:
    __slots__ = ("container", "depth", "good", "holder", "inherited", "number", "tag", "up")

    def __init__(self, tag: str, number: int, inherited: int, good: bool, container: bool, up: _Node | None):
        self.tag, self.number, self.inherited, self.good, self.container = tag, number, inherited, good, container
        block = up is None or tag in BLOCKS
        #: the nearest element that makes blocks, that one's depth among such, and the one above it
        self.holder = self if block else up.holder
        self.depth = (up.depth + 1 if up else 0) if block else up.depth
        self.up = (up.holder if up else None) if block else up.up


def _open(tag: str, attributes: str, parent: _Node, number: int) -> _Node:
    """What a block below the new element inherits: content counts once."""
    inherited, good = parent.inherited, parent.good
    own = IN_TAG.get(tag, 0)
    if tag == "header" and parent.container:
        own = 0  # the article's own heading
    names = {p for m in NAMES.finditer(attributes) for p in PART.findall(m[1].lower())} if attributes and "=" in attributes else ()
    if names and not BAD.isdisjoint(names) and tag not in ("body", "html", "main", "article"):
        own = min(own, BAD_NAME)
    elif names and not GOOD.isdisjoint(names) and own == 0:
        own = GOOD_NAME
    if own > 0 and not good:
        inherited, good = inherited + own, True
    elif own < 0:
        inherited += own
    return _Node(tag, number, inherited, good, parent.container or tag in ("article", "main"), parent)


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order, with their classifier scores."""
    out: list[Block] = []
    root = _Node("", 0, 0, False, False, None)
    stack, number, pieces, linked, at, link_depth = [root], 0, [], 0, 0, 0
    opened: Counter[str] = Counter()
    # the least depth since the last block, and that block's
    low, last = 0, 0

    def flush() -> None:
        nonlocal pieces, linked, low, last
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            holder = stack[-1].holder
            shorter = min(len(text), 400)
            score = BIAS + stack[-1].inherited + OWN_TAG.get(holder.tag, 0) + LENGTH * (shorter.bit_length() - 4) + LINKS * min(linked, len(text)) // max(1, len(text))
            if text[-1] in ".!?…:;\"»”)。！？" or ". " in text:
                score += SENTENCE
            low = min(low, holder.depth)
            out.append(Block(text, score, holder.up.number if holder.up else 0, holder.depth, last + holder.depth - 2 * low))
            low = last = holder.depth
        pieces, linked = [], 0

    def close(depth: int) -> None:
        nonlocal link_depth, low
        while len(stack) > depth:
            tag = stack.pop().tag
            opened[tag] -= 1
            if tag == "a":
                link_depth -= 1
        low = min(low, stack[-1].depth)

    def innermost(tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of ``tags`` that no list or section inside it hides, or 0."""
        if not any(opened[t] for t in tags):
            return 0
        depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags or stack[i].tag in LISTS), 0)
        return depth if depth and stack[depth].tag in tags else 0

    while at < len(html):
        m = TOKEN.search(html, at)
        run = html[at : m.start()] if m else html[at:]
        if run:
            pieces.append(run)
            if link_depth and not run.isspace():
                linked += len(run)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag in BLOCKS:
                flush()
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else len(html)
            if tag in BLOCKS:
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "img", "wbr"):
                pieces.append(" " if tag != "wbr" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and (depth := innermost(("p",))):
                close(depth)
            if (kinds := SIBLINGS.get(tag)) is not None and (depth := innermost(kinds)):
                close(depth)
        number += 1
        stack.append(_open(tag, attributes, stack[-1], number))
        opened[tag] += 1
        if tag == "a":
            link_depth += 1
    flush()
    return out


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (block, block, capacity): nested arcs, so that the graph can be drawn on one side of a line."""
    edges: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int, int]] = []
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, 8 * NEXT // max(2, b.distance) ** 3))
        while open_ and open_[-1][0] > b.depth:
            open_.pop()
        if open_ and open_[-1][:2] == (b.depth, b.parent):
            edges.append((open_.pop()[2], i, SAME_PARENT))
        open_.append((b.depth, b.parent, i))
    return edges


def minimum_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is content in the cheapest labelling (of equal ones, that with the most content).

    A node of score s > 0 pays s as boilerplate, of s < 0 pays -s as content; an edge
    (a, b, c) costs c if its ends differ. Nodes with two neighbours at most are taken
    out one by one: the flow through one is known from what its two edges can carry,
    and leaves scores at the neighbours and an edge between them (which may carry more
    one way than the other). Augmenting paths solve what is left.
    """
    left = list(scores)
    # room[a][b]: what is paid if a is content and b isn't
    room: list[dict[int, int]] = [{} for _ in scores]
    for a, b, c in edges:
        if a != b:
            room[a][b] = room[a].get(b, 0) + c
            room[b][a] = room[b].get(a, 0) + c
    ready = [i for i in range(len(left)) if len(room[i]) <= 2]
    gone, taken = [False] * len(left), []
    while ready:
        i = ready.pop()
        if gone[i] or len(room[i]) > 2:
            continue
        gone[i] = True
        near = [(j, out, room[j].pop(i)) for j, out in room[i].items()]
        taken.append((i, left[i], near))
        s = left[i]
        if len(near) == 1:
            j, out, back = near[0]
            left[j] += min(out, s) - min(0, s + back)
        elif near:
            (j, out_j, back_j), (k, out_k, back_k) = near
            both, none = min(0, s + back_j + back_k), min(out_j + out_k, s)
            only_j, only_k = min(out_k, s + back_j), min(out_j, s + back_k)
            left[j] += only_k - both
            left[k] += none - only_k
            if (more := only_j + only_k - both - none) or k in room[j]:
                room[j][k] = room[j].get(k, 0) + more
                room[k].setdefault(j, 0)
        ready += [j for j, _, _ in near if len(room[j]) <= 2]
    label = _augment(left, room, gone)
    for i, s, near in reversed(taken):
        as_content = sum(out for j, out, _ in near if not label[j])
        label[i] = as_content <= s + sum(back for j, _, back in near if label[j])
    return label


def _augment(left: list[int], room: list[dict[int, int]], gone: list[bool]) -> list[bool]:
    """Labels of the nodes that aren't gone: flow is pushed from positive to negative scores along shortest paths until none is left."""
    for start in range(len(left)):
        while not gone[start] and left[start] > 0:
            before, queue, end = {start: start}, deque([start]), -1
            while queue and end < 0:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 0 and v not in before:
                        before[v] = u
                        if left[v] < 0:
                            end = v
                            break
                        queue.append(v)
            if end < 0:
                break
            flow, v = min(left[start], -left[end]), end
            while v != start:
                flow = min(flow, room[before[v]][v])
                v = before[v]
            v = end
            while v != start:
                u = before[v]
                room[u][v] -= flow
                room[v][u] = room[v].get(u, 0) + flow
                v = u
            left[start] -= flow
            left[end] += flow
    # boilerplate: what can still reach a node with room to the sink
    bad = [x < 0 and not g for x, g in zip(left, gone, strict=True)]
    queue = deque(i for i, x in enumerate(bad) if x)
    while queue:
        v = queue.popleft()
        for u in room[v]:
            if not bad[u] and room[u].get(v, 0) > 0:
                bad[u] = True
                queue.append(u)
    return [not x for x in bad]


def extract(html: str | None) -> str:
    """Content blocks of a page, in its order, joined by an empty line."""
    found = blocks(html or "")
    good = minimum_cut([b.cost for b in found], smoothness(found))
    return "\n\n".join(b.text for b, ok in zip(found, good, strict=True) if ok)


def extract_pages(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep``, text and n_chars (code points) for every row; a null page has an empty text.

    Rows are independent: nothing is exchanged. Repeated rows give repeated rows. Of
    labellings that cost the same, that with the most content is taken. Pages are
    taken whole, however long or malformed; time grows in proportion to them.
    """
    fields = [pages.schema[c] for c in keep]
    schema = ", ".join([*(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(x) for x in part.column(len(fields)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"k{i}" for i in range(len(fields))), "text", "n_chars"])

    out = pages.select(*(pages[c].alias(f"k{i}") for i, c in enumerate(keep)), pages[html].alias("h")).mapInArrow(run, schema)
    return out.toDF(*keep, "text", "n_chars")
