"""Main text of web pages by minimum-cut labelling.

A page is split into text blocks. What a classifier says for and against each block becomes its two terminal
capacities; blocks that follow each other, and blocks near each other in the element tree, get smoothness
edges. The minimum cut separates content from boilerplate. Only tags that never hold content and hidden elements settle
a label; names of block-level elements are a cost, and say nothing where they stand around the page's main text.

Nulls and empty pages give an empty text. Pages without any content block give an empty text. Rows are
independent of each other; repeated pages give repeated rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURE = 1000.0  # capacity of a block whose place settles its label
NAMED = 8.0  # capacity against a block inside an element with the name of boilerplate
NEXT_TO = 0.6  # smoothness of blocks that follow each other
SAME_PARENT = 0.8  # smoothness of blocks of one parent, falling with the distance in the tree
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_content int"

#: A tag with its attributes; every part is taken once and for all, so it costs one pass whatever the page. A quote only
#: opens a value behind an equals sign; one that is never closed is part of a name.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)>"
)
_TAG_BEGINS = re.compile(r"</?[a-zA-Z]")
#: A slash that ends a tag and is not part of a value without quotes.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
_FOREIGN = frozenset(["svg", "math"])
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_SPACE = re.compile(r"\s+")
_SCRIPT_PART = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)
_RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr label acronym ruby rb rp rt nobr".split()
)
_CLOSED_BY = {  # an open element on the left ends where an element on the right begins
    "p": frozenset(
        "p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre blockquote "
        "figure hr address fieldset details".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
_SCOPE = frozenset("ul ol dl table section article div body aside nav header footer main form".split())
_NEVER = frozenset("head title nav footer aside form button menu dialog".split())
_MAIN = frozenset("article main".split())
_MARKS = frozenset("article main h1".split())
_MAIN_NAMES = frozenset("article content post entry story main body text".split())
_OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside rail widget widgets footer foot masthead "
    "comment comments reply replies respondent disqus discussion notice notices cookie cookies consent gdpr privacy "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommend more pager pagination toolbar tools copyright legal disclaimer form search tags skip".split()
)
_BESIDE = frozenset("has with without no".split())  # names that say what is beside an element, as in has-sidebar
_OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split()
)


@dataclass
class Element:
    tag: str
    number: int
    depth: int
    never: bool
    inside: bool  # of an article or main element


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    tag: str = ""
    path: tuple[int, ...] = ()
    never: bool = False
    inside: bool = False
    named: bool = False  # a name around it is that of boilerplate
    text: str = ""


def _evidence_of(tag: str, raw: str, inside: bool) -> tuple[bool, bool | None]:
    """Whether what the element holds is never main text, and whether its names are those of boilerplate.

    None: the names say nothing.
    """
    if tag in _NEVER or (tag == "header" and not inside):
        return True, None
    if not raw:
        return False, None
    held = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}
    if "hidden" in held or held.get("aria-hidden", "").lower() == "true":
        return True, None
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held.get("style", ""), re.I):
        return True, None
    if held.get("role", "").lower() in _OTHER_ROLES:
        return True, None
    words: set[str] = set()
    for name in f"{held.get('class', '')} {held.get('id', '')}".split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if parts and parts[0] not in _BESIDE:
            words.update(parts)
    if words & _OTHER_NAMES and tag not in ("body", "html", "article", "main", "h1"):
        return False, True
    return False, False if words & _MAIN_NAMES else None


def _script_end(page: str, at: int) -> int:
    """Where the end tag of a script begins. A script tag written inside ``<!--`` has an end tag of its own."""
    commented = nested = False
    for m in _SCRIPT_PART.finditer(page, at):
        if m[1] is None:
            commented = m[0] == "<!--"
            nested = nested and commented
        elif not m[1]:
            nested = nested or commented
        elif nested:
            nested = False
        else:
            return m.start()
    return -1


def _next_token(page: str, at: int) -> tuple[int, int, re.Match | None] | None:
    """(start, end, tag or None for comments and the like) of the next markup; a tag that the page's end cuts off takes all the rest."""
    while (lt := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), lt):
            comment = page.startswith("<!--", lt)
            mark = "-->" if comment else ">"
            stop = page.find(mark, lt + 2)
            return lt, len(page) if stop < 0 else stop + len(mark), None
        if _TAG_BEGINS.match(page, lt):
            tag = _TAG.match(page, lt)
            return (lt, tag.end(), tag) if tag else (lt, len(page), None)
        at = lt + 1
    return None


def _behind_raw(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of a raw element whose content begins at ``at``; without one the end of the page."""
    start = _script_end(page, at) if tag == "script" else -1
    if start < 0:
        m = _RAW_END[tag].search(page, at)
        start = m.start() if m else len(page)
    return page.find(">", start) + 1 or len(page)


def _judge_names(blocks: list[Block], named: dict[int, bool], marks: list[tuple[str, tuple[int, ...]]]) -> None:
    """Sets ``named`` of the blocks inside an element of ``named`` that does not stand around the main text.

    ``named`` tells of each element (by number) whether it lies in an article or main element; ``marks`` are the article,
    main and h1 elements with their paths. An element stands around the main text if it holds a main element, or, with
    a part of the page's prose, an h1 or the largest article, or most of the prose. Elements without such marks are set
    apart: their prose does not count against others, and they need most of it with no main text elsewhere.
    """
    landmarks = {n for _, path in marks for n in path}
    bare = named.keys() - landmarks
    articles = {path[-1] for tag, path in marks if tag == "article"}
    titled = {n for tag, path in marks if tag == "h1" for n in path}
    around_main = {n for tag, path in marks if tag == "main" for n in path}
    prose = [0 if b.never else max(0, len(b.text) - b.linked) for b in blocks]
    apart = [bare.intersection(b.path) for b in blocks]
    own, total, everything = Counter(), 0, sum(prose)
    extent: dict[int, tuple[int, int]] = {}  # first and last block of each bare element; those between lie in it as well
    for i, (b, p, a) in enumerate(zip(blocks, prose, apart)):
        if not a:
            total += p
        for n in a:
            extent[n] = (extent.get(n, (i, i))[0], i)
        for n in b.path:
            if n in bare or not a:
                own[n] += p
    largest = max(articles, key=lambda n: (n in titled, own[n]), default=0)
    around_largest = {n for tag, path in marks if path[-1] == largest for n in path}

    def stands_around(e: int) -> bool:
        if e in bare:
            if 2 * own[e] <= everything:
                return False
            first, last = extent[e]
            path = blocks[first].path
            outer = set(path[: path.index(e)])
            beside = (*range(first), *range(last + 1, len(blocks)))
            return not any(blocks[i].inside and prose[i] and apart[i] <= outer for i in beside)
        if e in around_main:
            return True
        marked = own[largest] if e in around_largest else own[e] if e in titled else 0
        return (2 if named[e] else 4) * marked >= total or (not named[e] and 2 * own[e] > total)

    against = {e for e in named if not stands_around(e)}
    for b in blocks:
        b.named = not against.isdisjoint(b.path)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: runs of text between block-level tags."""
    stack: list[Element] = [Element("", 0, 0, False, False)]
    blocks: list[Block] = []
    named: dict[int, bool] = {}
    marks: list[tuple[str, tuple[int, ...]]] = []
    current: Block | None = None
    count, at, linked_depth = 0, 0, 0

    def end() -> None:
        nonlocal current
        if current is not None:
            current.text = _SPACE.sub(" ", entities.unescape("".join(current.pieces))).strip()
            if current.text:
                blocks.append(current)
        current = None

    def path_of() -> tuple[int, ...]:
        return tuple(e.number for e in stack if e.tag not in _INLINE)

    def add(text: str) -> None:
        nonlocal current
        holder = next(e for e in reversed(stack) if e.tag not in _INLINE)
        if stack[-1].never and not holder.never:  # a hidden part of a line
            return
        if current is None:
            if not text.strip():
                return
            current = Block(tag=holder.tag, path=path_of(), never=holder.never, inside=holder.inside)
        current.pieces.append(text)
        if linked_depth:
            current.linked += len(text.strip())

    while (token := _next_token(page, at)) is not None:
        start, stop, m = token
        if start > at:
            add(page[at:start])
        at = stop
        if m is None:
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            if tag not in _INLINE:
                end()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    linked_depth -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE and tag in _INLINE:
                    break
            continue
        if tag in _RAW and not (tag in _FOREIGN and _SELF_CLOSED.search(raw)):
            at = _behind_raw(page, tag, at)
            if tag not in _INLINE:
                end()
            continue
        if tag == "br":
            if current is not None:
                current.pieces.append(" ")
            continue
        if tag not in _INLINE:
            end()
            for i in range(len(stack) - 1, 0, -1):
                if tag in _CLOSED_BY.get(stack[i].tag, ()):
                    linked_depth -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        if tag in _VOID:
            continue
        top = stack[-1]
        never, other = _evidence_of(tag, raw, top.inside)
        count += 1
        # The names of an element inside a rejected one do not bring it back.
        inside = top.inside or tag in _MAIN or (other is False and tag not in _INLINE)
        stack.append(Element(tag, count, top.depth + 1, top.never or never, inside))
        if other and tag not in _INLINE:
            named[count] = top.inside
        if tag in _MARKS and not stack[-1].never:
            marks.append((tag, path_of()))
        linked_depth += tag == "a"
    if at < len(page):
        add(page[at:])
    end()
    if named:
        _judge_names(blocks, named, marks)
    return blocks


def evidence(block: Block) -> float:
    """Classifier cost of a block: above 0 for content, below for boilerplate."""
    if block.never:
        return -SURE
    n = len(block.text)
    links = min(1.0, block.linked / max(1, n))
    score = 0.9 * math.log1p(n) - 3.0
    score += 1.0 if re.search(r"[.!?…:;]", block.text) else 0.0
    score += 1.2 if block.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td") else 0.0
    score -= 5.0 * links * links
    if block.named:
        return score - NAMED
    return score + (6.0 * (1 - links * links) if block.inside else 0.0)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, capacity): each block with the next, and with the next one of its parent."""
    edges = [(i, i + 1, NEXT_TO) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for j, block in enumerate(blocks):
        for distance, number in enumerate(reversed(block.path[-3:])):
            if number and number in last:
                edges.append((last[number], j, SAME_PARENT / (1 + distance)))
                break
        for number in block.path[-3:]:
            last[number] = j
    return edges


def minimum_cut(weights: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow.

    ``weights[i]`` is the capacity from the source (above 0) or to the sink (below 0): a pair of terminal
    capacities differs from it by a constant that flows through the node anyway. Flow runs in phases: all nodes get their
    distance from the nearest excess, and then all shortest ways are filled at once, looking at each edge once. Neighbours
    on a page are near each other, so a page of many blocks takes few phases.
    """
    n, small = len(weights), 1e-9
    excess = list(weights)
    left: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        left[i][j] = left[i].get(j, 0.0) + c
        left[j][i] = left[j].get(i, 0.0) + c
    near = [list(own) for own in left]
    while True:
        level = _distances(excess, near, left, small)
        if not any(d >= 0 > e + small for d, e in zip(level, excess)):
            return [d >= 0 for d in level]
        tried = [0] * n  # edges of each node that are of no more use in this phase
        for source in range(n):
            if level[source] == 0 and excess[source] > small:
                _fill(source, excess, level, near, left, tried, small)


def _distances(excess: list[float], near: list[list[int]], left: list[dict[int, float]], small: float) -> list[int]:
    """Steps from the nearest node with an excess, up to the nearest ones that take some; -1 where none leads."""
    level = [0 if e > small else -1 for e in excess]
    front, distance, found = [i for i, d in enumerate(level) if d == 0], 0, False
    while front and not found:
        distance += 1
        after = []
        for i in front:
            for j in near[i]:
                if level[j] < 0 and left[i][j] > small:
                    level[j] = distance
                    found = found or excess[j] < -small
                    after.append(j)
        front = after
    return level


def _fill(
    source: int,
    excess: list[float],
    level: list[int],
    near: list[list[int]],
    left: list[dict[int, float]],
    tried: list[int],
    small: float,
) -> None:
    """Send the excess of a node along shortest ways until it is gone or all of them are full."""
    path = [source]
    while path and excess[source] > small:
        i = path[-1]
        if excess[i] < -small:
            ways = list(zip(path, path[1:]))
            flow = min(excess[source], -excess[i], *(left[a][b] for a, b in ways))
            excess[source] -= flow
            excess[i] += flow
            for a, b in ways:
                left[a][b] -= flow
                left[b][a] += flow
            full = next((k for k, (a, b) in enumerate(ways) if left[a][b] <= small), len(path) - 1)
            del path[full + 1 :]
            continue
        while tried[i] < len(near[i]):
            j = near[i][tried[i]]
            if level[j] == level[i] + 1 and left[i][j] > small:
                path.append(j)
                break
            tried[i] += 1
        else:
            path.pop()
            if path:
                tried[path[-1]] += 1


def main_text(page: str | None) -> tuple[str, int, int]:
    """(text, number of blocks, number of content blocks) of one page."""
    blocks = blocks_of(page or "")
    weights = [evidence(b) for b in blocks]
    if all(w > 0 for w in weights):
        kept = blocks
    elif all(w <= 0 for w in weights):
        kept = []
    else:
        labels = minimum_cut(weights, smoothness(blocks))
        kept = [b for b, content in zip(blocks, labels) if content]
    return "\n".join(b.text for b in kept), len(blocks), len(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page with its main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([t for t, _, _ in found], pa.string()),
                    pa.array([len(t) for t, _, _ in found], pa.int64()),
                    pa.array([n for _, n, _ in found], pa.int32()),
                    pa.array([k for _, _, k in found], pa.int32()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
            )

    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html")
    )
    return rows.mapInArrow(run, SCHEMA)
