"""Main text of HTML pages by boosted trees over DOM nodes with hierarchical decoding.

A page's block elements form a tree. Each node has features of its own (kind, attribute tokens), of its
subtree (text, words, link density, punctuation), of its place (depth, siblings, share of the page) and of
its ancestors. Attribute tokens are the words of class, id and role values; what a token says is learned: the
log odds of the nodes that bear it, counted over the training pages. Boosted trees give the log odds that a
node belongs to the article. The decoder keeps or drops whole branches: it maximises the sum of the log odds
under the rule that nothing below a dropped node is kept.

The trees are grown on a bounded sample of the pages themselves, where an article or main element marks
the text, and on layouts composed from that sample's paragraphs, in which menus, notices, adverts, forms,
sidebars and comments come under many names, meaningless ones among them, and articles without telling ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.boosting import BoostedTrees
from rowforge.llm.common import first_texts, unit_hash

#: Pages that the trees are grown on at most, bytes of all of them, which bounds what the driver gathers, and composed layouts.
SAMPLE_PAGES, SAMPLE_BYTES, LAYOUTS = 150, 1 << 24, 500
#: Characters of pages that are extracted together; a longer page comes alone.
GROUP_CHARS = 1 << 20

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What is no text of a page, and the controls of forms; all other elements are judged as blocks or are part of a block's text.
HIDDEN = frozenset("head script style template title textarea select option button".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | {"p"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table article section div main body".split())

#: Nodes that must bear a token before it counts, and the log odds that one token is worth at most.
LEAST_SEEN, MOST_SAID = 4, 4.0
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element; runs holds its own text in the order of the page's blocks."""

    __slots__ = ("tag", "tokens", "parent", "children", "runs", "links", "depth", "keep")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None, keep: str):
        self.tag, self.tokens, self.parent, self.keep = tag, tokens, parent, keep
        self.children: list[Node] = []
        self.runs: list[tuple[int, str]] = []
        self.links = 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.children.append(self)


class _Tree(HTMLParser):
    """Builds the block tree; forgiving about missing and crossed end tags.

    Each open element's place in the stack is kept by name, so that no tag costs more than what it closes.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", [], None, "")
        self.open: list[tuple[str, Node | None]] = [("html", self.root)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.node = self.root
        self.text: list[str] = []
        self.order = self.hidden = self.anchors = 0

    def _end_run(self) -> None:
        if self.text:
            run = _SPACE.sub(" ", "".join(self.text)).strip()
            if run:
                self.node.runs.append((self.order, run))
                self.order += 1
            self.text = []

    def _push(self, tag: str, node: Node | None) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if node is not None:
            self.blocks.append(len(self.open))
        self.open.append((tag, node))

    def _pop(self) -> None:
        tag, node = self.open.pop()
        self.places[tag].pop()
        if tag in HIDDEN:
            self.hidden -= 1
        elif tag == "a":
            self.anchors -= 1
        if node is not None:
            self.blocks.pop()
            self._end_run()
            self.node = node.parent or self.root

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _last(self, tags) -> int:
        """Place of the innermost open element of these names, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close_open(self, tags, stop) -> None:
        place = self._last(tags)
        if place > self._last(stop):
            self._close(place)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            if self.places.get("head"):
                self._close(1)
            return
        if self.hidden:
            if tag not in VOID and tag in HIDDEN:
                self._push(tag, None)
                self.hidden += 1
            elif tag in BLOCK and tag != "noscript" and self.open[-1][0] == "head":  # a head that was never closed
                self._pop()
                self.handle_starttag(tag, attrs)
            return
        if tag == "br":
            self.text.append(" ")
        if tag in VOID and tag != "hr":
            return
        if tag in HIDDEN:
            self._push(tag, None)
            self.hidden += 1
            return
        if tag in CLOSES_P:
            self._close_open({"p"}, BOUNDARY)
        if tag in SELF_CLOSING:
            self._close_open(SELF_CLOSING[tag], BOUNDARY)
        if tag == "hr":
            self._end_run()
            return
        if tag in BLOCK and not (tag == "noscript" and self.node.tag in TEXT_BLOCKS):
            self._end_run()
            named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
            keep = next((v or "" for k, v in attrs if k == "data-keep"), "")
            self.node = Node(tag, _TOKEN.findall(named.lower()), self.node, keep)
            self._push(tag, self.node)
        else:
            self._push(tag, None)
            if tag == "a":
                self.anchors += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        place = self._last((tag,))
        if not place:
            if tag == "p":
                self._end_run()
        elif tag in BLOCK or tag in HIDDEN or not self.blocks or place > self.blocks[-1]:
            self._close(place)  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.anchors:
                self.node.links += len(data)


def tree(page: str | None) -> Node:
    """The block tree of a page; null is an empty page."""
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    while len(parser.open) > 1:
        parser._pop()
    parser._end_run()
    return parser.root


def flat(root: Node) -> list[Node]:
    """Nodes in document order, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


_KINDS = (
    frozenset(["article", "main"]), frozenset(["nav", "menu"]), frozenset(["header"]), frozenset(["footer"]), frozenset(["aside"]),
    frozenset(["form", "fieldset", "dialog", "search", "legend", "noscript"]), frozenset(["p", "pre", "blockquote"]), HEADINGS, frozenset(["ul", "ol", "li", "dl", "dt", "dd"]),
)
_PUNCTUATION = re.compile(r"[.,;:!?]")


def learned_tokens(pages: list[list[Node]], marks: list[np.ndarray]) -> dict[str, float]:
    """What each attribute token says: the smoothed log odds of the nodes that bear it, those of all nodes taken off."""
    counts: dict[str, list[int]] = {}
    kept = total = 0
    for nodes, own in zip(pages, marks, strict=True):
        for node, keep in zip(nodes[1:], own[1:], strict=True):
            total += 1
            kept += bool(keep)
            for token in set(node.tokens):
                counts.setdefault(token, [0, 0])[bool(keep)] += 1
    base = np.log((kept + 1) / (total - kept + 1))
    return {
        t: float(np.clip(np.log((yes + 0.5) / (no + 0.5)) - base, -MOST_SAID, MOST_SAID))
        for t, (no, yes) in counts.items() if no + yes >= LEAST_SEEN
    }


def features(nodes: list[Node], tokens: dict[str, float]) -> np.ndarray:
    """One row for each node of a page, in document order."""
    n = len(nodes)
    place = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([place[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    own = np.zeros((n, 5))  # characters, words, punctuation, characters in links, runs
    for i, node in enumerate(nodes):
        for _, run in node.runs:
            own[i] += (len(run), run.count(" ") + 1, len(_PUNCTUATION.findall(run)), 0, 1)
        own[i, 3] = min(node.links, own[i, 0])
    below = own.copy()
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
    kinds = np.array([[x.tag in k for k in _KINDS] for x in nodes], dtype=float)
    said = [[tokens[t] for t in x.tokens if t in tokens] for x in nodes]
    for_it, against = (np.array([f([0.0, *v]) for v in said]) for f in (max, min))
    telling = np.array([1.0 if x.tokens and not v else 0.0 for x, v in zip(nodes, said, strict=True)])  # names of no known token
    against = np.minimum(against, -2.0 * kinds[:, 1:6].max(axis=1))
    above_against, above_for, above_kinds, index = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        p = parent[i]
        above_against[i] = min(above_against[p], against[p])
        above_for[i] = max(above_for[p], for_it[p])
        above_kinds[i] = above_kinds[p] + kinds[p, 0]
        index[i] = seen.get(p, 0)
        seen[p] = int(index[i]) + 1
    siblings = np.array([len(x.parent.children) if x.parent is not None else 1 for x in nodes], dtype=float)
    chars, words = np.maximum(below[:, 0], 1), np.maximum(below[:, 1], 1)
    total = max(below[0, 0], 1)
    ahead = np.cumsum(own[:, 0]) - own[:, 0]
    # The neighbours on the same level: -1 stands for none.
    left, right = np.full(n, -1), np.full(n, -1)
    for x in nodes:
        at = [place[id(c)] for c in x.children]
        left[at[1:]], right[at[:-1]] = at[:-1], at[1:]
    beside = []
    for at in (left, right):
        beside += [np.where(at >= 0, np.log1p(below[at, 0]), -1.0), np.where(at >= 0, below[at, 3] / chars[at], -1.0)]
    columns = [
        *kinds.T, for_it, against, telling, above_for, above_against, np.minimum(above_kinds, 3),
        np.log1p(below[:, 0]), np.log1p(below[:, 1]), below[:, 3] / chars, below[:, 2] / words, below[:, 1] / np.maximum(below[:, 4], 1),
        np.array([x.depth for x in nodes], dtype=float), np.array([len(x.children) for x in nodes], dtype=float),
        siblings, index / siblings, below[:, 0] / total, ahead / total, np.where(parent >= 0, below[:, 0] / chars[np.maximum(parent, 0)], 1.0), *beside,
    ]
    return np.column_stack(columns)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best total of log odds where nothing below a dropped node is kept."""
    place = {id(node): i for i, node in enumerate(nodes)}
    weight = np.array([1.0 + np.log1p(sum(len(r) for _, r in x.runs)) if x.runs else 0.2 for x in nodes])
    value = odds * weight
    kept, dropped = value.copy(), -value
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        kept[up] += max(kept[i], dropped[i])
        dropped[up] += dropped[i]
    keep = np.zeros(len(nodes), dtype=bool)
    keep[0] = True  # the page itself is no choice
    for i in range(1, len(nodes)):
        keep[i] = keep[place[id(nodes[i].parent)]] and kept[i] > dropped[i]
    return keep


@dataclass
class Model:
    """Boosted trees and what they read of attribute tokens."""

    trees: BoostedTrees
    tokens: dict[str, float]


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page: kept blocks in page order, joined by one newline."""
    trees = [flat(tree(p)) for p in pages]
    rows = [features(nodes, model.tokens) for nodes in trees]
    odds = model.trees.predict(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        own = odds[at : at + len(nodes)]
        at += len(nodes)
        keep = decode(nodes, own)
        if nodes[0].runs:  # text right below the body has no element of its own to be judged by
            keep[0] = own[0] > 0 or len(nodes) == 1
        runs = sorted(run for node, yes in zip(nodes, keep, strict=True) if yes for run in node.runs)
        out.append("\n".join(text for _, text in runs))
    return out


def truth(nodes: list[Node]) -> np.ndarray | None:
    """Whether each node lies in the marked article; None if the page marks none."""
    out = np.zeros(len(nodes), dtype=bool)
    place = {id(node): i for i, node in enumerate(nodes)}
    for i, node in enumerate(nodes):
        out[i] = i > 0 and out[place[id(node.parent)]]
        if node.keep:
            out[i] = node.keep == "1"
        elif node.tag in ("article", "main"):
            out[i] = True
        elif node.tag in ("nav", "footer", "aside", "form", "header") or set(node.tokens) & {"comments", "comment", "ad", "ads"}:
            out[i] = False
    return out if out.any() else None


def _layout(rng: np.random.Generator, lines: list[str]) -> str:
    """A page of random structure; data-keep marks what is article and what is not."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    line = lambda: lines[int(rng.integers(len(lines)))]
    word = lambda: pick(*line().split()[:12] or ["more"])[:20]

    def named(names: str) -> str:
        if rng.random() < 0.35:  # a name that says nothing
            name = "".join(pick(*"bcdfghklmnprstvz") + pick(*"aeiou") for _ in range(int(rng.integers(1, 4))))
        else:
            name = pick(*names.split())
        return pick("class", "id", "class") + f'="{name}{pick("", "", "-box", " wrap", "-1")}"'

    def part(tags: str, names: str, inside: str, share: float = 0.6) -> str:
        tag = pick(*tags.split())
        attribute = " " + named(names) if tag in ("div", "section", "ul") or rng.random() < share else ""
        return f'<{tag}{attribute} data-keep="0">{inside}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{" ".join(word() for _ in range(int(rng.integers(1, 5))))}</a></li>' for i in range(n)) + "</ul>"

    def remarks() -> str:
        return "".join(f'<{pick("div", "li", "article", "p")} class="{pick("comment", "reply", "comment-body")}" data-keep="0"><p>{line()}</p></div>' for _ in range(int(rng.integers(1, 6))))

    def paragraphs(n: int) -> str:
        made = []
        for _ in range(n):
            kind = rng.random()
            text = line() if rng.random() < 0.8 else " ".join(line().split()[: int(rng.integers(1, 8))])
            if kind < 0.08:
                made.append(f"<h2>{' '.join(text.split()[:6])}</h2>")
            elif kind < 0.14:
                made.append("<ul>" + "".join(f"<li>{' '.join(line().split()[:14])}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.18:
                made.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.21:
                made.append(f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>")
            elif kind < 0.3:
                made.append(f'<p><b>{text[:40]}</b> {text[40:]} <a href="/x">{word()}</a></p>')
            else:
                made.append(f"<p>{text}</p>")
        return "".join(made)

    short = lambda n: " ".join(line().split()[:n])
    before = [
        part("header header div", "header masthead topbar site-header", f"<h1>{short(int(rng.integers(1, 6)))}</h1>" + links(int(rng.integers(0, 5)))),
        part("nav nav ul div", "nav menu navbar breadcrumb", links(int(rng.integers(2, 10)))),
        part("div div section aside", "ad ads advert sponsored banner promo", f"<p>{short(14)}</p>" if rng.random() < 0.5 else short(14)),
        part("div section dialog", "cookie notice consent alert gdpr", f"<p>{short(18)}</p>"),
        part("noscript", "notice", short(9)),
        part("form form div", "search login signup form", f"<p>{short(6)}</p><label>{word()}</label><input>"),
    ]
    after = [
        part("aside aside div", "sidebar widget related recommended", f"<h3>{word()}</h3>" + (links(4) if rng.random() < 0.6 else f"<p>{short(25)}</p>")),
        part("section div div ol", "comments discussion replies respond", f"<h3>{word()}</h3>" + remarks()),
        part("div section form form", "newsletter subscribe signup", f"<p>{short(15)}</p><input>"),
        part("div ul", "share social tags related", links(3)),
        part("footer footer div", "footer copyright site-footer", f"&copy; {short(8)}" if rng.random() < 0.5 else f"<p>{short(12)}</p>" + links(2)),
    ]
    many = int(rng.integers(1, 12)) if rng.random() < 0.7 else 1
    body = f"<h1>{short(int(rng.integers(1, 13)))}</h1>" * int(rng.random() < 0.8) + paragraphs(many)
    bare = rng.random() < 0.15
    if bare:  # no element holds the article together
        body = re.sub(r"<(h1|h2|p|ul|blockquote|table)(?=[ >])", r'<\1 data-keep="1"', body)
    elif rng.random() < 0.25:
        body = body + pick(*before[2:5], *after[:3]) + paragraphs(int(rng.integers(0, 3)))
    tag = pick("article", "article", "main", "div", "div", "section")
    attribute = pick("", " " + named("content article post entry story main body"), " " + named("col left x1 container page"))
    core = body if bare else f'<{tag}{attribute} data-keep="1">{body}</{tag}>'
    some = 0.2 if bare else 0.5
    chosen = [x for x in before if rng.random() < some] + [core] + [x for x in after if rng.random() < some]
    if rng.random() < 0.3:
        chosen = ['<div class="' + pick("page", "container", "wrapper", "x") + '">', *chosen, "</div>"]
    return "<html><body>" + "".join(chosen) + "</body></html>"


def train(pages: list[str | None], layouts: int = LAYOUTS, seed: int = 21, folds: int = 5) -> Model:
    """Trees from marked pages among the given ones and composed layouts of their lines.

    A training page's tokens are read by what the other folds' pages say of them, so that the trees do not trust
    tokens more than unseen pages warrant.
    """
    rng = np.random.default_rng(seed)
    trees = [flat(tree(p)) for p in pages]
    lines = [text for nodes in trees for node in nodes if node.tag == "p" for _, text in node.runs]
    lines = lines or ["These are some words of a paragraph, and here are a few more of them.", "Short line."]
    trees += [flat(tree(_layout(rng, lines))) for _ in range(layouts)]
    marked = [(nodes, marks) for nodes in trees if (marks := truth(nodes)) is not None]
    x, y, w = [], [], []
    for fold in range(folds):
        others = [p for i, p in enumerate(marked) if i % folds != fold]
        tokens = learned_tokens([nodes for nodes, _ in others], [marks for _, marks in others])
        for nodes, marks in marked[fold::folds]:
            x.append(features(nodes, tokens)[1:])
            y.append(marks[1:])
            w.append(np.full(len(nodes) - 1, 1 / np.sqrt(len(nodes))))
    model = BoostedTrees().fit(np.concatenate(x), np.concatenate(y).astype(float), np.concatenate(w))
    return Model(model, learned_tokens([nodes for nodes, _ in marked], [marks for _, marks in marked]))


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", rows: int = SAMPLE_PAGES, most_bytes: int = SAMPLE_BYTES, seed: int = 23) -> Model:
    """A model from whole pages, at most `rows` with `most_bytes` together, those of the smallest hashes of key and page.

    Repeated pages and keys each count as a page; null pages count as empty ones.
    """
    near = unit_hash("k", "h", seed=seed)
    read = pages.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("h"))
    named = read.withColumns({"near": near, "own": F.xxhash64(F.lit(seed), "h")}).where(F.col("near") < F.lit(min(1.0, 2 * rows / max(pages.count(), 1) + 0.01)))
    return train([r["h"] for r in first_texts(named, ["near", "own"], "h", rows, most_bytes)])


def main_text(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Add text: the whole article of every page.

    A page is read whole by one task, in memory that grows with the page. Null, empty and unmarked input gives what the trees keep of it, '' for null and empty pages; text
    outside of any markup is kept where the page has no elements at all. Repeated rows get equal texts; an
    input column named text is replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        made: list[str] = []
        group: list[str | None] = []
        size = 0
        for i, page in enumerate(batch):
            group.append(page)
            size += len(page or "") + 1
            if size >= GROUP_CHARS or i == len(batch) - 1:
                made += extract(group, model)
                group, size = [], 0
        return pd.Series(made, index=batch.index, dtype=object)

    return pages.withColumn("text", of(F.col(f"`{html}`")))
