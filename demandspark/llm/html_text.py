"""Main text of web pages by a tree-structured graphical model over the DOM.

Every structural element is a node with the hidden state *content* or *other*. Node potentials come from its tag, the
words of its class, id and role, the amount and link share of its text, the sectioning element around it, its place
towards the page's articles, and how many siblings bear its names; parent-child potentials tie each node to the
element around it. Messages pass from the leaves to the root and back (sum-product), which gives each node's exact
marginal on the tree; the text of nodes that are content with a probability above one half is the main text. The potentials are
smoothed counts over labelled pages (``html_pages``). Inline elements are part of the text around them, not nodes.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandspark.llm.common import map_batches

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*)?((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
_LOOSE = re.compile(r"<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*)?([^>]*+)>")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'\bdata-main="([01])"')

# Their text is never part of a page's text.
DROPPED = frozenset("head script style noscript template svg iframe textarea select button object canvas audio video".split())
# What may stand in a head; any other start tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())  # no tags inside until their end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mtable mtr mtd mstyle mspace mpadded mphantom "
    "menclose merror semantics annotation annotation-xml".split()
)
# An element that ends when one of these starts inside it.
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}


@dataclass
class Page:
    """The elements of a page in order of their starts, and the runs of text in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    blocks: list[tuple[int, list[str]]] = field(default_factory=list)

    def add(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        names = []
        if attributes and not attributes.isspace():
            for found in _NAMED.findall(attributes):
                for word in re.split(r"[^A-Za-z]+", "".join(found)):
                    names += [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", word)]
        self.names.append(names)
        own = _LABEL.search(attributes) if "data-main" in attributes else None
        self.label.append(int(own[1]) if own else self.label[parent] if parent >= 0 else 0)
        self.chars.append(0)
        self.link_chars.append(0)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """The tree of a page; unclosed, crossed and stray tags are taken as browsers take them, nearly."""
    page = Page()
    root = page.add(-1, "html", "")
    # Open elements: name, node, and whether text in it is dropped. A dropped element has the node of the one around it.
    stack = [("html", root, False)]
    link = False
    open_block = False
    at, end = 0, len(source)

    def text(piece: str) -> None:
        nonlocal open_block
        if stack[-1][0] == "head" and piece.strip():
            stack.pop()
        if stack[-1][2] or not piece:
            return
        node = stack[-1][1]
        if not open_block:
            page.blocks.append((node, []))
            open_block = True
        page.blocks[-1][1].append(piece)
        size = len(piece) if not piece.isspace() else 0
        page.chars[node] += size
        if link:
            page.link_chars[node] += size

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                break

    while at < end:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        found = _TAG.match(source, start) or _LOOSE.match(source, start)
        if found is None:  # a stray sign, or a tag that the page's end cuts off
            cut = start + 1 < end and (source[start + 1].isalpha() or source[start + 1] in "/!?") and source.find(">", start) < 0
            text(source[at : start if cut else start + 1])
            if cut:
                break
            at = start + 1
            continue
        kind, name, attributes = found[1], found[2], found[3]
        if name is None and kind is not None and not kind:  # "<" before anything but a name is text
            text(source[at : start + 1])
            at = start + 1
            continue
        text(source[at:start])
        at = found.end()
        if name is None or kind in ("!", "?"):  # a comment, a declaration or an empty end tag
            continue
        name = name.lower()
        if kind == "/":
            if name == "a":
                link = False
            elif name not in INLINE and name not in VOID:
                close(name)
                open_block = False
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD and name != "head":
            stack.pop()
        if name in RAW:
            until = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
            at = until.end() if until else end
            continue
        if name in DROPPED:
            if name == "button":  # one never holds another
                close(name)
            if not attributes.endswith("/"):
                stack.append((name, stack[-1][1], True))
            continue
        if name in ("body", "html"):  # what a head left open ends here
            del stack[next((k for k, (_, _, drop) in enumerate(stack) if drop), len(stack)) :]
        if name == "html":  # the root stands for it, also where it is left out
            page.label[root] = int("data-main=\"1\"" in attributes)
            continue
        if name == "br":
            text(" ")
            continue
        if name == "a":
            link = True
            continue
        if name in INLINE:
            continue
        open_block = False
        if stack[-1][2] and name in CLOSES["p"]:  # a drawing holds no such element but within foreignObject
            names = [n for n, _, _ in stack]
            if "svg" in names and "foreignobject" not in names[names.index("svg") :]:
                del stack[names.index("svg") :]
        while len(stack) > 1 and name in CLOSES.get(stack[-1][0], ()):
            stack.pop()
        if name in VOID:
            continue
        node = page.add(stack[-1][1], name, attributes)
        if not attributes.endswith("/"):
            stack.append((name, node, stack[-1][2]))
    return page


# Elements that tell what the elements inside them are for.
SECTIONS = frozenset("article aside footer form header main nav section".split())
ASIDE = frozenset("aside footer form header nav".split())


def _size(chars: int) -> int:
    """Steps of text amount; beyond about a sentence, more text says nothing: sidebars may be long and articles short."""
    return 0 if chars == 0 else min(4, 1 + int(math.log2(chars) / 1.5))


def _places(page: Page) -> tuple[list[str], list[str]]:
    """For each node the nearest sectioning element around it, and whether it is in an article, holds one or stands beside."""
    n = len(page.tag)
    within, depth, aside = ["-"] * n, [0] * n, [False] * n
    inside, holds = [False] * n, [False] * n
    for k in range(1, n):
        p = page.parent[k]
        within[k] = page.tag[p] if page.tag[p] in SECTIONS else within[p]
        depth[k], aside[k] = depth[p] + 1, aside[p] or page.tag[k] in ASIDE
    # Comments and teasers may be articles too; the page's own are those that lie least deep.
    articles = [k for k in range(n) if page.tag[k] in ("article", "main") and not aside[k]]
    least = min((depth[k] for k in articles), default=-1)
    own = {k for k in articles if depth[k] == least}
    for k in range(1, n):
        inside[k] = k in own or (inside[page.parent[k]] and page.tag[k] not in ("aside", "footer", "form", "nav"))
    for k in range(n - 1, 0, -1):
        holds[page.parent[k]] = holds[page.parent[k]] or holds[k] or inside[k]
    if not any(inside):
        return within, ["none"] * n
    return within, ["in" if i else "holds" if h else "beside" for i, h in zip(inside, holds, strict=True)]


def features(page: Page) -> list[list[str]]:
    """The features of every node."""
    n = len(page.tag)
    chars, links = list(page.chars), list(page.link_chars)
    for k in range(n - 1, 0, -1):
        chars[page.parent[k]] += chars[k]
        links[page.parent[k]] += links[k]
    within, place = _places(page)
    kin = Counter((page.parent[k], page.tag[k], *page.names[k]) for k in range(n) if page.names[k])
    out = []
    for k in range(n):
        share = links[k] * 4 // chars[k] if chars[k] else -1
        alike = min(3, kin[page.parent[k], page.tag[k], *page.names[k]])
        shown = [f"tag={page.tag[k]}", f"size={_size(page.chars[k])}", f"links={share}", f"within={within[k]}", f"place={place[k]}"]
        shown += [f"alike={alike}"] if alike > 1 else []
        out.append(shown + [f"name={w}" for w in dict.fromkeys(page.names[k])])
    return out


@dataclass(frozen=True)
class TreeModel:
    """Log potentials; state 1 is content."""

    root: tuple[float, float]
    edge: tuple[tuple[float, float], tuple[float, float]]  # [parent][child]
    feature: dict[str, tuple[float, float]]

    @staticmethod
    def train(pages: list[Page], smooth: float = 1.0) -> TreeModel:
        """Smoothed relative frequencies over labelled pages."""
        states, roots, edges, seen = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            found = features(page)
            for k, label in enumerate(page.label):
                states[label] += 1
                if page.parent[k] < 0:
                    roots[label] += 1
                else:
                    edges[page.label[page.parent[k]], label] += 1
                seen.update((f, label) for f in found[k])

        def log(count: float, total: float, kinds: int) -> float:
            return math.log((count + smooth) / (total + smooth * kinds))

        def both(f):
            return f(0), f(1)

        root = both(lambda s: log(roots[s], sum(roots.values()), 2))
        edge = both(lambda p: both(lambda c: log(edges[p, c], edges[p, 0] + edges[p, 1], 2)))
        names = {f for f, _ in seen}
        # A feature's potential is its frequency in each state; a node has the features that it shows.
        feature = {f: both(lambda s, f=f: log(seen[f, s], states[s], 2)) for f in names}
        return TreeModel(root, edge, feature)

    def marginals(self, page: Page) -> list[float]:
        """The probability of each node to be content, by messages up and down the tree."""
        n = len(page.tag)
        own = []
        for found in features(page):
            a = b = 0.0
            for f in found:
                x = self.feature.get(f)
                if x is not None:
                    a, b = a + x[0], b + x[1]
            own.append((a, b))
        (e00, e01), (e10, e11) = self.edge
        up0, up1 = [x for x, _ in own], [x for _, x in own]  # own potential and the messages of all children
        to0, to1 = [0.0] * n, [0.0] * n  # the message to the parent
        for k in range(n - 1, 0, -1):
            to0[k], to1[k] = _log_sum(e00 + up0[k], e01 + up1[k]), _log_sum(e10 + up0[k], e11 + up1[k])
            up0[page.parent[k]] += to0[k]
            up1[page.parent[k]] += to1[k]
        all0, all1 = list(up0), list(up1)
        all0[0] += self.root[0]
        all1[0] += self.root[1]
        for k in range(1, n):
            p = page.parent[k]
            rest0, rest1 = all0[p] - to0[k], all1[p] - to1[k]  # the parent's belief without this child
            all0[k] += _log_sum(e00 + rest0, e10 + rest1)
            all1[k] += _log_sum(e01 + rest0, e11 + rest1)
        return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in zip(all0, all1, strict=True)]


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


@functools.lru_cache(maxsize=1)
def trained() -> TreeModel:
    from demandspark.llm.html_pages import labelled_pages

    return TreeModel.train([parse(source) for source in labelled_pages()])


def main_text(source: str, model: TreeModel) -> str:
    """The text of content nodes: references decoded, white space of a block as one space, blocks joined by one space."""
    page = parse(source)
    chance = model.marginals(page)
    blocks = (" ".join(html.unescape("".join(parts)).split()) for node, parts in page.blocks if chance[node] > 0.5)
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if there is none), n_chars (code points).

    A null or empty html has no text; a page of any length is read whole; any null id or url is kept; repeated rows are
    extracted each; other columns are ignored; an empty table gives an empty result.
    """
    model = model or trained()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, model) if h else "" for h in batch["html"].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
            ["page_id", "url", "text", "n_chars"],
        )

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), per_batch, f"page_id {kind}, url string, text string, n_chars long")
