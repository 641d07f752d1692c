"""Operator 1: main text of web pages by minimum cuts.

A page becomes a list of blocks (runs of text between block-level tags, in page order). A
classifier gives every block a cost of being called boilerplate and one of being called
content, from the elements it is in, the words of their class, id and role, its length,
punctuation and share of link text; these are capacities to the two terminals. Blocks that
follow each other, and blocks that are the next ones in one parent, are joined by edges
that are the stronger the nearer their common ancestor. The minimum cut (Dinic's maximum
flow) labels all blocks of a page together, so that a short line among paragraphs goes
with them and a long notice among menus doesn't.

An element's name or words speak for what is in it, but not those of html and body, and not
those against an element that holds the page itself (nearly all of its text, or most of it
with the heading or the one article, and no article outside it): a page wrapped in one form is
no form, but a long list of comments beside an article is one, even if each is an article too.

Words that a hyphen joins are weaker evidence: a post's class may tell its category (tag-ads) or
a state (comments-open), which say nothing, and beside a word for content, in the same name or as
a class or element of its own, they count for less. Controls inside a line of text are left out.

Defined cases: null or empty html and pages without text give the empty text; text outside
any tag is a block; tags may be unclosed or cut off (a script or style without an end reaches
to the end of the page, as in browsers; other elements whose content is never text are
skipped only if they end); pages of any length and depth are taken whole, in linear time;
repeated rows are extracted each; an empty table gives an empty one; other columns aren't
looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Element names by role.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never markup, and ones whose content is never page text.
RAW = ("script", "style", "textarea")
HIDDEN = {"noscript", "template", "iframe", "svg", "object"}
BAD = {"nav": 8, "footer": 8, "aside": 8, "form": 8, "menu": 8, "button": 8, "select": 8, "dialog": 8, "head": 12, "label": 4, "fieldset": 6}
GOOD = {"article": 5, "main": 3}
#: Words of class, id and role attributes.
BAD_WORDS = set("ad ads advert advertisement adsense banner breadcrumb breadcrumbs byline-ads comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted reader-comments recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
GOOD_WORDS = set("article articlebody body-text content entry main post postbody story text".split())

#: First parts of a hyphenated class that speak of a layout or a subject, and last parts
#: that speak of a state, not of the element.
LAYOUT = set("author category format has is no not section status tag term topic type with without".split())
STATES = set("allowed closed count disabled enabled free hidden off on open visible".split())
#: Controls whose text is never part of the line they stand in.
CONTROLS = {"button", "select"}

_REST = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _REST + r">.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<rest>" + _REST + r")>|<(?P<end2>/?)(?P<name2>[a-zA-Z][\w:-]*+)(?P<rest2>[^>]*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_HINTS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS - {"option"})) + r")(?=[\s/>])", re.I)
_LIST_PARTS = {"li", "td", "th", "tr", "dd", "dt", "option"}
_LISTS = {"ul", "ol", "table", "dl", "select", "menu", "article", "body", "tbody"}


class Element:
    """A place in the tree. size, articles, headed: characters of text in it, articles (or main parts), and
    whether a first heading is, filled in when the page has ended."""

    __slots__ = ("articles", "depth", "headed", "hint", "name", "parent", "size")

    def __init__(self, name: str, parent: Element | None, hint: float) -> None:
        self.name, self.parent, self.hint, self.size, self.articles, self.headed = name, parent, hint, 0, 0, False
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("box", "hint", "links", "text")

    def __init__(self, text: str, links: int, box: Element) -> None:
        self.text, self.links, self.box, self.hint = text, links, box, 0.0


def own_hint(name: str, rest: str, inside: bool) -> float:
    """What an element's name and the words of its class, id and role say for its content."""
    hint = GOOD.get(name, 0) - BAD.get(name, 0)
    if name == "header" and not inside:
        hint -= 6
    whole, joined = set(), []
    for values in _HINTS.findall(rest):
        for word in re.split(r"[\s_]+", "".join(values).lower()):
            parts = word.split("-")
            if len(parts) == 1 or word in BAD_WORDS or word in GOOD_WORDS:
                whole.add(word)
            elif parts[0] not in LAYOUT and parts[-1] not in STATES:
                joined.append(set(parts))
    said = name in GOOD or bool(whole & GOOD_WORDS)
    against = [9.0] if whole & BAD_WORDS else []
    against += [4.0 if said else 2.5 if parts & GOOD_WORDS else 9.0 for parts in joined if parts & BAD_WORDS]
    if against:
        return hint - max(against) + (3 if whole & GOOD_WORDS and max(against) < 9 else 0)
    return hint + (3 if whole & GOOD_WORDS or any(parts & GOOD_WORDS for parts in joined) else 0)


def parse(page: str) -> list[Block]:
    """Blocks of a page in order, with their place in the tree and what their elements say."""
    root = Element("", None, 0.0)
    every, blocks, text = [root], [], []
    # open elements, those of them that are blocks, and how many have each name
    open_, boxes, names = [root], [root], Counter()
    links = anchors = articles = 0
    unended: set[str] = set()

    def close() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append(Block(joined, links, boxes[-1]))
            text.clear()
        links = 0

    def leave(depth: int) -> None:
        nonlocal anchors, articles
        while len(open_) > depth:
            e = open_.pop()
            names[e.name] -= 1
            anchors -= e.name == "a"
            articles -= e.name in GOOD
            if boxes[-1] is e:
                boxes.pop()

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if anchors:
                    links += len(piece)
            elif m["raw"]:
                text.append(" ")
            continue
        if m["end"] or m["end2"]:
            if name in BLOCKS:
                close()
            if names[name]:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].name == name:
                        leave(i)
                        break
                    if name not in BLOCKS and open_[i].name in BLOCKS:
                        break  # an inline end tag doesn't close blocks
            continue
        if name == "br":
            text.append(" ")
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in HIDDEN and name not in unended:
            if rest.endswith("/"):
                continue
            if end := re.compile(rf"</{name}\s*>", re.I).search(page, at):
                text.append(" ")
                at = end.end()
                continue
            unended.add(name)  # it has no end from here on: what follows is the page
        if name in CONTROLS and name not in unended:
            if not (end := re.compile(rf"</{name}\s*>", re.I).search(page, at)):
                unended.add(name)
            elif not _BLOCK_TAG.search(page, at, end.start()):
                text.append(" ")
                at = end.end()
                continue
        if name in BLOCKS:
            close()
            # a paragraph, and an inline element in it, ends where the next block begins
            while open_[-1].name == "p" or (names["p"] and len(open_) > 1 and open_[-1].name not in BLOCKS):
                leave(len(open_) - 1)
            if name in _LIST_PARTS:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].name == name:
                        leave(i)
                        break
                    if open_[i].name in _LISTS:
                        break
        if name in VOID or name in HIDDEN:
            continue
        e = Element(name, open_[-1], 0.0 if name in ("html", "body") else own_hint(name, rest, articles > 0))
        every.append(e)
        open_.append(e)
        names[name] += 1
        anchors += name == "a"
        articles += name in GOOD
        if name in BLOCKS:
            boxes.append(e)
    close()
    for b in blocks:
        b.box.size += len(b.text)
    for e in reversed(every):
        if e.parent:
            e.parent.size += e.size
            e.parent.articles += e.articles + (e.name in GOOD)
            e.parent.headed |= e.headed or e.name == "h1"
    for e in every:  # parents come before what they hold
        alone = e.articles + (e.name in GOOD) == root.articles
        if e.hint < 0 and alone and e.size >= (0.6 if e.headed or e.articles == 1 else 0.95) * root.size:
            e.hint = 0.0
        e.hint += e.parent.hint if e.parent else 0.0
    for b in blocks:
        b.hint = b.box.hint
    return blocks


def apart(x: Element, y: Element, most: int = 20) -> int:
    """Steps between two elements by way of their common ancestor, most at the end."""
    steps = 0
    while x is not y and steps < most:
        steps += 1
        if x.depth > y.depth:
            x = x.parent
        else:
            y = y.parent
    return steps


def costs(block: Block) -> float:
    """How much more a block costs as boilerplate than as content; below 0 the other way."""
    n = len(block.text)
    score = block.hint + min(n, 240) / 80 - 1.2
    score += 0.6 * min(4, sum(block.text.count(c) for c in ".,;!?"))
    score -= 5 * min(1.0, block.links / n)
    tag = block.box.name
    if tag in ("p", "blockquote", "pre"):
        score += 1.5
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 1.0
    elif tag in ("li", "td", "th", "option", "dt"):
        score -= 0.5
    elif tag == "title":
        score -= 12
    return score


def content(blocks: list[Block]) -> list[bool]:
    """The minimum cut: which blocks stay on the content side."""
    n = len(blocks)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: float, back: float) -> None:
        edges[u].append(len(to))
        edges[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        score = costs(b)
        if score > 0:
            join(source, i, score, 0.0)
        elif score < 0:
            join(i, sink, -score, 0.0)
        near = {i - 1} if i else set()
        parent = id(b.box.parent)
        if parent in last:
            near.add(last[parent])
        last[parent] = i
        for j in near:
            strength = 2.0 / (1 << apart(b.box, blocks[j].box))
            join(j, i, strength, strength)
    flow(to, room, edges, source, sink)
    side, todo = [False] * (n + 2), [source]
    side[source] = True
    while todo:
        for e in edges[todo.pop()]:
            if room[e] > 1e-9 and not side[to[e]]:
                side[to[e]] = True
                todo.append(to[e])
    return side[:n]


def flow(to: list[int], room: list[float], edges: list[list[int]], source: int, sink: int) -> None:
    """Dinic's algorithm; room becomes the residual capacities."""
    while True:
        level = [-1] * len(edges)
        level[source] = 0
        todo = deque([source])
        while todo and level[sink] < 0:
            u = todo.popleft()
            for e in edges[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return
        at, path, u = [0] * len(edges), [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-9 and not cut:
                        cut = k + 1
                u = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
            elif at[u] < len(edges[u]):
                e = edges[u][at[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                else:
                    at[u] += 1
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
            else:
                break


def main_text(page: str | None) -> str:
    blocks = parse(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, content(blocks), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [main_text(h) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[id_col], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    rows = pages.select(id_col, F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
