"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier over a block's place and text
says how much evidence there is for content or for boilerplate; that is the
capacity of the block's edge to one of the two terminals. Blocks that follow each
other, and blocks of one parent, are tied by smoothness edges that weaken with the
distance of their containers. The cheapest cut labels the blocks: a block whose own
evidence points the wrong way is labelled by those around it if that costs less.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"'<]++|"[^"<]*"|'[^'<]*')*+>|[^>]*>)|<[!?][^>]*>""", re.DOTALL)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg iframe noframes textarea title select".split())
#: Tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body html head button caption legend option td th tr tbody thead tfoot summary figcaption".split())
#: What a container says of the blocks in it.
IN_ARTICLE, IN_NAV, IN_EDGE, IN_ASIDE, IN_FORM, IN_AD, IN_COMMENTS, IN_NOTICE, IN_HEAD = (1 << k for k in range(9))
TAG_MARKS = {"article": IN_ARTICLE, "main": IN_ARTICLE, "nav": IN_NAV, "menu": IN_NAV, "footer": IN_EDGE, "header": IN_EDGE, "aside": IN_ASIDE, "form": IN_FORM, "button": IN_FORM, "head": IN_HEAD, "dialog": IN_NOTICE}
NAME_MARKS = (
    (IN_AD, re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner)(?:$|[^a-z])")),
    (IN_COMMENTS, re.compile(r"(?:^|[^a-z])(?:comments?|replies|disqus|discussion)(?:$|[^a-z])")),
    (IN_NOTICE, re.compile(r"cookie|consent|notice|popup|modal|subscribe|newsletter|disclaimer|gdpr")),
    (IN_NAV, re.compile(r"(?:^|[^a-z])(?:nav\w*|menu\w*|breadcrumbs?|pagination|pager|share|social|skip)(?:$|[^a-z])")),
    (IN_ASIDE, re.compile(r"(?:^|[^a-z])(?:side-?bar|related|widget|recommended|aside)(?:$|[^a-z])")),
    (IN_EDGE, re.compile(r"(?:^|[^a-z])(?:footer|header|masthead|copyright|byline-bar)(?:$|[^a-z])")),
    (IN_ARTICLE, re.compile(r"(?:^|[^a-z])(?:article|post-?(?:body|content)?|entry-?(?:content)?|story|main-?(?:content)?|content)(?:$|[^a-z])")),
)
#: Log-odds for content, in hundredths, that a mark or a property of a block adds. One mark is worth about two or three ties, so that blocks around it can outvote it.
MARK_COSTS = {IN_ARTICLE: 150, IN_NAV: -250, IN_EDGE: -250, IN_ASIDE: -250, IN_FORM: -200, IN_AD: -400, IN_COMMENTS: -400, IN_NOTICE: -350, IN_HEAD: -5000}
#: The tie of blocks that follow each other under one parent; of blocks whose containers are more than ``FAR`` steps apart, the least.
TIE, LEAST_TIE, FAR = 90, 10, 8


class Place:
    """A container: its number, how deep it lies, and what it lies in."""

    __slots__ = ("depth", "number", "outer")

    def __init__(self, number: int, outer: "Place | None"):
        self.number, self.outer, self.depth = number, outer, outer.depth + 1 if outer else 0


def steps_apart(a: Place, b: Place) -> int:
    """Steps up and down between two containers; ``FAR + 1`` if there are more."""
    steps = 0
    while a is not b and steps <= FAR:
        if a.depth >= b.depth:
            a, steps = a.outer, steps + 1
        else:
            b, steps = b.outer, steps + 1
    return steps


class Block:
    __slots__ = ("linked", "marks", "parent", "size", "tag", "text")

    def __init__(self, text: str, tag: str, marks: int, parent: Place, linked: int):
        self.text, self.tag, self.marks, self.parent, self.size = text, tag, marks, parent, len(text)
        self.linked = min(1.0, linked / self.size)


def split_blocks(page: str) -> list[Block]:
    """Text blocks in page order. Lenient: open paragraphs end where a block starts,
    an end tag closes what is open inside its element, one without a start is passed over."""
    found: list[Block] = []
    stack: list[tuple[str, int, Place]] = [("", 0, Place(0, None))]
    count: dict[str, int] = {}
    pieces: list[str] = []
    linked = ids = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                where = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in BLOCKS), 0)
                found.append(Block(text, stack[where][0], stack[-1][1], stack[where][2], linked))
            pieces.clear()
        linked = 0

    def close(name: str) -> None:
        if count.get(name):
            while True:
                top = stack.pop()[0]
                count[top] -= 1
                if top == name:
                    return

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            if "&" in piece:
                piece = unescape(piece)
            pieces.append(piece)
            if count.get("a"):
                linked += len(piece.strip())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCKS
        if m[1]:
            if block:
                flush()
            close(name)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if block:
            flush()
            if name in ENDS_P and count.get("p"):
                close("p")
            elif name in ("li", "dd", "dt", "option", "tr", "td", "th") and stack[-1][0] == name:
                close(name)
        if name in RAW and not (name in ("svg", "math") and m[3].endswith("/>")):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            if end or name in ("script", "style", "template", "textarea", "title"):
                at = end.end() if end else len(page)
                continue
        if name in VOID or m[3].endswith("/>") and not block:
            continue
        marks = stack[-1][1] | TAG_MARKS.get(name, 0)
        if m[3] != ">":
            for value in NAMES.findall(m[3]):
                for mark, pattern in NAME_MARKS:
                    if pattern.search(value.lower()):
                        marks |= mark
        if block:
            ids += 1
        stack.append((name, marks, Place(ids, stack[-1][2]) if block else stack[-1][2]))
        count[name] = count.get(name, 0) + 1
    if at < len(page):
        pieces.append(unescape(page[at:]))
    flush()
    return found


def evidence(block: Block) -> int:
    """The classifier: positive for content, negative for boilerplate."""
    cost = -30
    for mark, c in MARK_COSTS.items():
        if block.marks & mark:
            cost += c
    cost += min(block.size, 400) // 4 - int(150 * block.linked)
    if block.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "figcaption"):
        cost += 40
    if block.text[-1] in ".!?:;\"'”»…":
        cost += 40
    if block.text.startswith("©"):
        cost -= 300
    return cost


def smoothness(a: Block, b: Block) -> int:
    """Between neighbours: full for two blocks of one container, halved with each step more between their containers."""
    return max(LEAST_TIE, TIE >> max(0, steps_apart(a.parent, b.parent) - 2))


def min_cut(terminal: list[int], ties: dict[tuple[int, int], int]) -> list[bool]:
    """Labels of a cheapest cut: True for the side of the source, which positive
    terminals pull to. A node whose terminal outweighs all its ties is labelled at
    once and its ties become terminals of its neighbours; the rest goes to max-flow."""
    n = len(terminal)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in ties.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    pull = list(terminal)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        x = todo.popleft()
        if label[x] is None and abs(pull[x]) >= sum(near[x].values()):
            label[x] = pull[x] > 0
            for y, c in near[x].items():
                del near[y][x]
                pull[y] += c if label[x] else -c
                todo.append(y)
            near[x] = {}
    open_nodes = [x for x in range(n) if label[x] is None]
    if open_nodes:
        for x in max_flow(open_nodes, pull, near):
            label[x] = True
    return [bool(x) for x in label]


def max_flow(nodes: list[int], pull: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic)."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {x: dict(near[x]) for x in nodes}
    room[source] = {x: pull[x] for x in nodes if pull[x] > 0}
    room[sink] = {}
    for x in nodes:
        room[x][source] = 0
        if pull[x] < 0:
            room[x][sink] = -pull[x]
            room[sink][x] = 0
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            x = todo.popleft()
            for y, c in room[x].items():
                if c > 0 and y not in level:
                    level[y] = level[x] + 1
                    todo.append(y)
        if sink not in level:
            return set(level) - {source}
        edges = {x: iter(list(room[x])) for x in level}
        path = [source]
        while path:
            x = path[-1]
            if x == sink:
                most = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= most
                    room[b][a] = room[b].get(a, 0) + most
                path = path[: 1 + next(k for k, (a, b) in enumerate(zip(path, path[1:])) if not room[a][b])]
                edges[path[-1]] = iter(list(room[path[-1]]))
                continue
            y = next((y for y in edges[x] if room[x][y] > 0 and level.get(y) == level[x] + 1), None)
            if y is None:
                level[x] = -5
                path.pop()
            else:
                path.append(y)


def main_text(page: str | None) -> str:
    """The content blocks of ``page``, one a line; null and pages without content give ''."""
    blocks = split_blocks(page) if page else []
    if not blocks:
        return ""
    ties = {(k, k + 1): smoothness(a, b) for k, (a, b) in enumerate(zip(blocks, blocks[1:]))}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        around = b.parent.outer.number if b.parent.outer else -1
        if k - last.get(around, k) > 1:
            ties[last[around], k] = TIE // 4
        last[around] = k
    keep = min_cut([evidence(b) for b in blocks], ties)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``, whole pages.
    A null page is empty; repeated rows stay; very long pages are read whole; an empty
    table gives an empty result; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    slim = pick(pages, [id_col, url_col, html_col])
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars bigint")
