"""Main text of web pages by composite text density.

For every DOM node: characters per tag, adjusted by how much of its text is in
links; then the sum of its children's densities.  The subtree of the largest
sum is content; the thinnest node on the way from the body to it sets a
threshold.  Another subtree joins if it is as dense and its own sum is near the
largest.  Only what is no text of a page at all (scripts, form controls, hidden
elements, ...) is taken out of the tree; elements and names that tell of menus,
notices, comments and the like lower the density of a block, no more: it stays
if it is as dense as the threshold, or its sum near the largest, even so.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are no text of a page.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas math form button select textarea input fieldset dialog audio video map noembed noframes title".split())
#: Elements that surround an article as a rule.
AROUND = frozenset("nav footer aside menu".split())
#: What remains of the density of text in blocks that tell by element, role or name that they surround an article.
LOWERED = 0.02
#: The share of the largest sum that another subtree needs.
NEAR = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: Words of class and id names that mark what surrounds an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "notice notices alert cookie cookies consent gdpr banner popup modal overlay comment comments commentlist disqus respond reply replies discussion share sharing social related recommended "
    "newsletter subscribe subscription signup signin login search searchform widget widgets toolbar pagination pager skip paywall form".split()
)
KEPT = frozenset(["html", "body", "article", "main"])
#: Start tags that end an open paragraph, and what ends open list items, cells and so on, up to which scope.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCOPE = frozenset("table td th caption button object html body template".split())
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset("tr".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
}

TOKEN = re.compile(
    r"<!--(?:-?>|(?P<note>.*?)(?:--!?>|\Z))|<[!?](?P<decl>[^>]*)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
WORD = re.compile(r"[a-z]+")


def _judged(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is no text of the page (by its name, or hidden), and whether it tells that it surrounds an article."""
    if tag in DROPPED:
        return True, False
    if not attrs:
        return False, tag in AROUND
    names = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attrs)}
    hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").replace(" ", "").lower()
    told = names.get("role", "").lower() in ROLES or not NAMES.isdisjoint(WORD.findall(f"{names.get('class', '')} {names.get('id', '')}".lower()))
    return hidden, tag in AROUND or told and tag not in KEPT


class Tree:
    """DOM nodes in page order: a node's subtree is the range up to its ``end``."""

    def __init__(self) -> None:
        self.tag, self.parent, self.end, self.drop, self.told = ["html"], [0], [0], [False], [False]
        self.pieces: list[tuple[int, str]] = []

    def open(self, tag: str, parent: int, drop: bool, told: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.end.append(0)
        self.drop.append(drop)
        self.told.append(told)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    tree, stack, at = Tree(), [0], 0
    opened: Counter[str] = Counter()  # open elements by name: no walk up the stack for what is not there

    def text(part: str) -> None:
        if part:
            tree.pieces.append((stack[-1], html.unescape(part)))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[tree.tag[node]] -= 1
            tree.end[node] = len(tree.tag)
            if tree.tag[node] not in INLINE:
                tree.pieces.append((stack[-1] if stack else 0, " "))

    def end_open(closed: frozenset, scope: frozenset) -> None:
        if not any(opened[t] for t in closed):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = tree.tag[stack[depth]]
            if tag in closed:
                pop_to(depth)
                return
            if tag in scope:
                return

    while match := TOKEN.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        if not match["tag"]:
            continue
        tag = match["tag"].lower()
        if match["close"]:
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if tree.tag[stack[depth]] == tag:
                    pop_to(depth)
                    break
                if tag in INLINE and tree.tag[stack[depth]] not in INLINE:
                    break
            continue
        if tag == "html" or tag == "body" and opened[tag]:
            continue
        if tag in ENDS_P:
            end_open(frozenset(["p"]), SCOPE)
        if tag in ENDS:
            end_open(*ENDS[tag])
        if tag not in INLINE:
            tree.pieces.append((stack[-1], " "))
        node = tree.open(tag, stack[-1], *_judged(tag, match["attrs"]))
        if tag in VOID:
            tree.end[node] = node + 1
        elif tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            tree.end[node] = node + 1
        else:
            stack.append(node)
            opened[tag] += 1
    text(page[at:])
    pop_to(0)
    return tree


def _dropped(tree: Tree) -> list[bool]:
    """Nodes that are no text of the page, with all below them."""
    gone = [False] * len(tree.tag)
    for node in range(1, len(gone)):
        gone[node] = gone[tree.parent[node]] or tree.drop[node]
    return gone


def _around(tree: Tree) -> list[bool]:
    """Nodes that tell that they surround an article; what lies in one of them is not marked by itself."""
    n = len(tree.tag)
    holds, in_article, out = [False] * n, [False] * n, [False] * n
    for node in range(n - 1, 0, -1):
        if holds[node] or tree.tag[node] in ("article", "main"):
            holds[tree.parent[node]] = True
    for node in range(1, n):
        up, tag = tree.parent[node], tree.tag[node]
        in_article[node] = in_article[up] or tag in ("article", "main")
        # a page's header surrounds the article; of an article's own header the headings belong to it
        header = tag == "header" and not in_article[node] or tree.tag[up] == "header" and in_article[node] and tag not in HEADINGS
        out[node] = (tree.told[node] or header) and not holds[node]
    return out


def _boxes(tree: Tree) -> list[int]:
    """For every node the nearest one, itself included, that counts as a tag: formatting within a line does not, links do."""
    box = list(range(len(tree.tag)))
    for node in range(1, len(box)):
        if tree.tag[node] != "a" and tree.tag[node] in INLINE or tree.tag[node] == "br":
            box[node] = box[tree.parent[node]]
    return box


def composite(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density of a subtree; ``ratio``: the share of link characters in the whole page.

    Characters per tag, times the logarithm of how much of characters and tags
    is outside of links, to a base that grows with the characters in links.
    """
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + ratio * chars + math.e)
    spread = math.log(max(1.0, chars / lc * t / lt))
    return chars / t * spread / max(math.log(base), 1e-9) if base > 1 + 1e-9 else chars / t * spread


def densities(tree: Tree, gone: list[bool]) -> tuple[list[float], list[float]]:
    """Composite density of every node, and the sum over its children; both lowered by the share of text in what surrounds an article."""
    n, box = len(tree.tag), _boxes(tree)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link, lowered, around, worth = [False] * n, [False] * n, _around(tree), [0.0] * n
    for node in range(1, n):
        lowered[node] = lowered[tree.parent[node]] or around[node]
        in_link[node] = in_link[tree.parent[node]] or tree.tag[node] == "a"
    for node, piece in tree.pieces:
        if not gone[node]:
            size = len("".join(piece.split()))
            chars[box[node]] += size
            worth[box[node]] += size * (LOWERED if lowered[node] else 1)
            if in_link[node]:
                link_chars[box[node]] += size
    for node in range(n - 1, 0, -1):
        if gone[node] or box[node] != node:
            continue
        up = box[tree.parent[node]]
        chars[up] += chars[node]
        worth[up] += worth[node]
        tags[up] += tags[node] + 1
        link_chars[up] += link_chars[node]
        link_tags[up] += link_tags[node] + (tree.tag[node] == "a")
    ratio = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for node in range(n):
        if chars[node] and not gone[node]:
            density[node] = composite(chars[node], tags[node], link_chars[node], link_tags[node], ratio) * (worth[node] / chars[node])
    for node in range(1, n):
        if box[node] == node:
            total[box[tree.parent[node]]] += density[node]
    return density, total


def choose(tree: Tree, gone: list[bool], density: list[float], total: list[float]) -> bytearray:
    """A mark for every node that the densities take.

    The subtree of the largest sum is content.  The thinnest node on the way
    from the body to it sets a threshold.  Of any other node as dense the subtree
    of its largest sum joins if that sum is near the largest, if the node lies in
    the same article element, or if it is a heading in a block on that way.  Of
    equal sums the outermost, then the first in page order, wins.
    """
    n = len(tree.tag)
    best = list(range(n))
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        more, own = total[best[node]], total[best[up]]
        if not gone[node] and (more > own or more == own and best[up] != up):
            best[up] = best[node]
    path = [best[0]]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    # from the body on; a page without one counts from its root
    upto = next((i for i, x in enumerate(path) if tree.tag[x] == "body"), len(path) - 1)
    box = _boxes(tree)
    threshold = min(density[x] for x in path[: upto + 1] if box[x] == x)
    near, way = NEAR * total[best[0]], set(path[:upto])
    own = next((x for x in path[:upto] if tree.tag[x] in ("article", "main")), None)
    inside = range(own, tree.end[own] or n) if own is not None else range(0)
    marked = bytearray(n)

    def mark(node: int, value: int) -> None:
        begin, end = node, tree.end[node] or n
        marked[begin:end] = bytes([value]) * (end - begin)

    mark(best[0], 1)
    for node in range(n):
        if density[node] > 0 and density[node] >= threshold and not marked[node] and not marked[best[node]]:
            if total[best[node]] >= near or node in inside or tree.tag[node] in HEADINGS and tree.parent[node] in way:
                mark(best[node], 1)
    # what surrounds an article stays only if it is as dense or its sum is near, and a block of nothing but links (density 0, two or more of them) is a menu
    links, around = [0] * n, _around(tree)
    for node in range(n - 1, 0, -1):
        links[tree.parent[node]] += links[node] + (tree.tag[node] == "a")
    for node in range(1, n):
        thin = around[node] and density[box[node]] < threshold and total[best[node]] < near
        if marked[node] and (thin or box[node] == node and density[node] == 0 and links[node] > 1):
            mark(node, 0)
    return marked


def main_text(page: str) -> str:
    """The article's text: blocks in page order, joined by one space; '' if there is none."""
    tree = parse(page)
    gone = _dropped(tree)
    marked = choose(tree, gone, *densities(tree, gone))
    return " ".join("".join(piece for node, piece in tree.pieces if piece == " " or marked[node] and not gone[node]).split())


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All columns of ``pages``, and main_text (string, '' if there is none).

    Null and empty pages have none; broken markup is read as browsers do, near
    enough.  A column named main_text is replaced.  Rows are independent, so
    repeated ones repeat, and an empty table gives an empty result.
    """
    columns = [c for c in pages.columns if c != "main_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.decode()) for x in text_bytes(batch["page"])]
            yield pa.record_batch({"row": batch["row"], "main_text": pa.array(texts, pa.string())})

    rows = pages.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(html_column).alias("page"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, main_text string").select("row.*", "main_text")
