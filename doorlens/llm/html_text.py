"""Main text of web pages by a tree-structured graphical model over the page's nodes.

Every element and every run of text is a variable with one of three labels: outer (holds article and
other things), content, other. A node's own features (tag, words of class and id, length, share of
linked text) give its potential, and parent and child labels one for each edge. Messages go from the
leaves to the root and back; on a tree the resulting marginals are exact. Text whose
content marginal is over one half is kept. The potentials are frequencies counted on labelled pages,
which `labelled_pages` makes in many layouts.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTER, CONTENT, OTHER = 0, 1, 2

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split())
#: Their content is no text of the page.
RAW = frozenset("script style template".split())
#: Their content is text, comment marks included.
NO_COMMENTS = frozenset("textarea title".split())
#: What a start tag closes if it is open, up to the nearest of the elements that hold it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Start tags that leave an open paragraph open, and the blocks that an open paragraph therefore never lies beneath.
KEEPS_P = frozenset("button iframe noscript option select textarea".split())
NOT_IN_P = tuple(BLOCK - KEEPS_P - {"p"}) + ("button",)


@dataclass
class Page:
    """Nodes in document order; a text node has no tag. `events` are text nodes, white space (-2) and block borders (-1)."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)
    events: list[int] = field(default_factory=list)


_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.DOTALL)


class _Builder(HTMLParser):
    """A lenient tree: unclosed paragraphs, items and cells end where HTML ends them; stray end tags do nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack = [self._node(-1, "#root", (), None, None)]
        self.raw = 0
        self.open: Counter[str] = Counter()

    def _node(self, parent: int, tag: str, names: tuple[str, ...], text: str | None, label: str | None) -> int:
        page = self.page
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.tag.append(tag)
        page.names.append(names)
        page.text.append(text)
        page.label.append(label)
        return len(page.parent) - 1

    def _pop_to(self, at: int) -> None:
        if any(self.page.tag[n] in BLOCK for n in self.stack[at:]):
            self.page.events.append(-1)
        self.open.subtract(self.page.tag[n] for n in self.stack[at:])
        self.raw = sum(self.open[tag] for tag in RAW)
        del self.stack[at:]

    def _open(self, tags: tuple[str, ...], until: tuple[str, ...]) -> int | None:
        """The outermost open element of `tags` that stands inside the nearest open one of `until`."""
        found = None
        if not any(self.open[tag] for tag in tags):
            return None
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.page.tag[self.stack[at]]
            if tag in tags:
                found = at
            elif tag in until:
                break
        return found

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment ends at `-->` or `--!>`, or at once as `<!-->` or `<!--->`; without an end it takes the rest of the page, as in HTML."""
        if self.page.tag[self.stack[-1]] in NO_COMMENTS:
            self.handle_data("<!--")
            return i + 4
        found = _COMMENT.match(self.rawdata, i)
        return found.end() if found else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            if tag not in KEEPS_P and (at := self._open(("p",), NOT_IN_P)):
                self._pop_to(at)
            if tag in CLOSES and (at := self._open(CLOSES[tag], HOLDS[tag])):
                self._pop_to(at)
            self.page.events.append(-1)
        elif tag == "br":
            self.page.events.append(-2)
        given = dict(attrs)
        words = " ".join(filter(None, (given.get("class"), given.get("id"), given.get("role")))) if given else ""
        names = tuple(dict.fromkeys(w.lower() for w in _NAME.findall(words))) if words else ()
        node = self._node(self.stack[-1], tag, names, None, given.get("data-label"))
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1
            self.raw += tag in RAW

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.page.tag[self.stack[at]] == tag:
                self._pop_to(at)
                return

    def handle_data(self, data: str) -> None:
        if self.raw:
            return
        if data.isspace():
            self.page.events.append(-2)
        elif data:
            self.page.events.append(self._node(self.stack[-1], "#text", (), data, None))


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.page


def _bucket(n: int) -> int:
    return min(8, n.bit_length() // 2 + (n > 0))


def features(page: Page) -> tuple[list[str], list[int]]:
    """Feature names and the node each belongs to."""
    n = len(page.parent)
    length, linked = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.text[i] is not None:
            length[i] = len(page.text[i])
        if page.tag[i] == "a":
            linked[i] = length[i]
        length[page.parent[i]] += length[i]
        linked[page.parent[i]] += linked[i]
    out, owner = [], []
    for i in range(n):
        tag = page.tag[i]
        found = [f"tag {tag}{' named' if page.names[i] else ''}"]
        # A text's length speaks once, through its block: below blocks, tags alone.
        if tag in BLOCK:
            found += [f"long {_bucket(length[i])}", f"linked {4 * linked[i] // (length[i] or 1)}"]
        found += [f"name {w}" for w in page.names[i]]
        out += found
        owner += [i] * len(found)
    return out, owner


def _kind(tag: str) -> int:
    """0 a block, 1 an inline element, 2 text."""
    return 0 if tag in BLOCK else 2 if tag == "#text" else 1


@dataclass
class Model:
    """Log potentials: of features by label, and of child label by parent label for each kind of child."""

    index: dict[str, int]
    node: np.ndarray
    edge: np.ndarray

    def potentials(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node log potentials, each node's edge potentials to its parent, parents, depths) of all pages as one forest."""
        ids, owner, parent, depth, kinds, base = [], [], [], [], [], 0
        for page in pages:
            names, nodes = features(page)
            ids += [self.index.get(f, -1) for f in names]
            owner += [base + i for i in nodes]
            parent += [base + p if p >= 0 else -1 for p in page.parent]
            depth += page.depth
            kinds += map(_kind, page.tag)
            base += len(page.parent)
        ids, owner = np.array(ids, np.int64), np.array(owner, np.int64)
        out = np.stack([np.bincount(owner, np.where(ids >= 0, self.node[ids, y], 0.0), base) for y in range(3)], 1) if base else np.zeros((0, 3))
        return out, self.edge[np.array(kinds, np.int64)], np.array(parent, np.int64), np.array(depth, np.int64)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(node: np.ndarray, edge: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Label marginals of every node by sum-product, level by level: upward, then downward."""
    if not len(node):
        return node
    belief, upward = node.copy(), np.zeros_like(node)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    for level in levels[:0:-1]:
        upward[level] = _logsum(edge[level] + belief[level][:, None, :], 2)
        np.add.at(belief, parent[level], upward[level])
    for level in levels[1:]:
        above = belief[parent[level]] - upward[level]
        belief[level] += _logsum(edge[level] + above[:, :, None], 1)
        belief[level] -= belief[level].max(1, keepdims=True)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True)


def main_text(page: Page, content: np.ndarray) -> str:
    """Text of the kept nodes: one line per block, its white space single."""
    lines, parts = [], []
    for event in [*page.events, -1]:
        if event == -2:
            parts.append(" ")
        elif event >= 0:
            if content[event]:
                parts.append(page.text[event])
        elif parts:
            line = " ".join("".join(parts).split())
            if line:
                lines.append(line)
            parts = []
    return "\n".join(lines)


# Words of class and id attributes, by what they usually mark.
OUTER_NAMES = "app columns container grid inner layout page root row site wrap wrapper".split()
CONTENT_NAMES = "article blog body content entry hentry main post primary reader single story text".split()
PART_NAMES = "caption intro lead paragraph quote section subtitle summary title".split()
OTHER_NAMES = (
    "account ad ads advert advertisement alert author banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright date discussion "
    "disclaimer disqus dropdown footer form gdpr header login logo masthead menu meta modal more nav navbar navigation newsletter notice pagination "
    "pager popular popup privacy promo promoted recommended related reply respond responses search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags teaser toolbar topbar trending widget".split())
_SYLLABLES = "an ba cor de el fi gan ho in ka lo me nor pe qua ri so ta ur ve".split()


class _Maker:
    """Labelled pages: every element carries its label in `data-label`."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, least: int, most: int) -> str:
        r = self.rng
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(least, most)))

    def tag(self, tag: str, label: str, inside: str, names: list[str] | None = None) -> str:
        r = self.rng
        chosen = " ".join(r.sample(names, min(len(names), r.randint(1, 2)))) if names else ""
        attribute = f' {r.choice(["class", "class", "id"])}="{chosen}"' if chosen else ""
        return f'<{tag} data-label="{label}"{attribute}>{inside}</{tag}>'

    def inline(self, label: str, least: int, most: int) -> str:
        r = self.rng
        text = self.words(least, most)
        for kind in ("b", "i", "em", "strong", "a", "span", "code"):
            if r.random() < 0.08:
                text += " " + self.tag(kind, label, self.words(1, 6)) + " " + self.words(1, 12)
        return text

    def links(self, n: int) -> str:
        listed = "".join(self.tag("li", "other", self.tag("a", "other", self.words(1, 4))) for _ in range(n))
        return self.tag(self.rng.choice(["ul", "ul", "ol"]), "other", listed)

    def prose(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.8:
            out.append(self.tag("h1", "content", self.words(2, 12), PART_NAMES if r.random() < 0.2 else None))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            kind = r.random()
            names = PART_NAMES if r.random() < 0.1 else None
            if kind < 0.72:
                out.append(self.tag("p", "content", self.inline("content", 1, r.choice([3, 12, 60, 120])), names))
            elif kind < 0.8:
                out.append(self.tag(r.choice(["h2", "h3", "h4"]), "content", self.words(1, 8), names))
            elif kind < 0.86:
                out.append(self.tag("blockquote", "content", self.tag("p", "content", self.words(5, 40)), names))
            elif kind < 0.92:
                out.append(self.tag(r.choice(["ul", "ol"]), "content", "".join(self.tag("li", "content", self.inline("content", 2, 25)) for _ in range(r.randint(1, 6)))))
            elif kind < 0.95:
                rows = "".join(self.tag("tr", "content", "".join(self.tag("td", "content", self.words(1, 3)) for _ in range(3))) for _ in range(3))
                out.append(self.tag("table", "content", self.tag("tbody", "content", rows)))
            elif kind < 0.97:
                out.append(self.tag("pre", "content", self.words(3, 30)))
            else:
                out.append(self.tag("figure", "content", self.tag("figcaption", "content", self.words(3, 15))))
            if r.random() < 0.06:
                out.append(self.other(inside=True))
        if r.random() < 0.15:
            half = len(out) // 2
            out[half:] = [self.tag(r.choice(["section", "div"]), "content", "".join(out[half:]), PART_NAMES if r.random() < 0.5 else None)]
        return "".join(out)

    def other(self, inside: bool = False) -> str:
        r = self.rng
        kind = r.choice(["nav", "header", "footer", "aside", "div", "div", "div", "section", "form", "ul", "comments", "comments", "p"])
        named = OTHER_NAMES
        if kind == "comments":
            each = "".join(self.tag(r.choice(["li", "div", "article"]), "other", self.tag("p", "other", self.inline("other", 3, 60)), ["comment", "reply", "response"])
                           for _ in range(r.randint(1, 5)))
            return self.tag(r.choice(["section", "div", "ol"]), "other", self.tag("h3", "other", self.words(1, 3)) + each, ["comments", "discussion", "responses", "respond"])
        if kind == "form":
            return self.tag("form", "other", self.tag("label", "other", self.words(1, 4)) + '<input data-label="other">' + self.tag("button", "other", self.words(1, 2)),
                            named if r.random() < 0.5 else None)
        if kind == "p":
            return self.tag("p", "other", self.words(2, 30), named)
        if kind == "ul":
            return self.tag("ul", "other", "".join(self.tag("li", "other", self.tag("a", "other", self.words(1, 3))) for _ in range(r.randint(2, 8))), named)
        if kind in ("nav", "header", "footer", "aside"):
            body = r.choice([self.links(r.randint(2, 9)), self.words(2, 25), self.tag("p", "other", self.inline("other", 3, 50)), self.tag("h2", "other", self.words(1, 3)) + self.links(3)])
            return self.tag(kind, "other", body, named if r.random() < 0.4 else None)
        body = r.choice([self.words(2, 40), self.tag("p", "other", self.inline("other", 3, 60)), self.tag("h3", "other", self.words(1, 4)) + self.links(4),
                         self.tag("span", "other", self.words(1, 6)) + self.tag("a", "other", self.words(1, 4))])
        return self.tag(kind, "other", body, named)

    def page(self) -> str:
        r = self.rng
        head = self.tag("head", "other", '<meta data-label="other">' + self.tag("title", "other", self.words(2, 12)) + self.tag("style", "other", "")
                        + self.tag("script", "other", ""))
        wrapper = r.choice(["article"] * 5 + ["main", "div", "section"])
        names = CONTENT_NAMES if wrapper in ("div", "section") or r.random() < 0.3 else None
        bare = r.random() < 0.08  # an article without an element of its own
        core = self.prose() if bare else self.tag(wrapper, "content", self.prose(), names)
        parts = [self.other() for _ in range(r.randint(0, 4))] + [core] + [self.other() for _ in range(r.randint(0, 4))]
        while r.random() < 0.35:
            at, count = r.randrange(len(parts)), r.randint(1, 3)
            parts[at:at + count] = ["".join(parts[at:at + count])]
            if 'data-label="content"' in parts[at]:
                parts[at] = self.tag(r.choice(["div", "main", "section"]), "outer", parts[at], OUTER_NAMES if r.random() < 0.7 else None)
        return self.tag("html", "outer", head + self.tag("body", "outer", "".join(parts)))


def labelled_pages(count: int = 1500, seed: int = 5) -> list[str]:
    maker = _Maker(random.Random(seed))
    return [maker.page() for _ in range(count)]


def train(pages: list[str], smooth: float = 0.3) -> Model:
    """Counts potentials on pages whose elements carry `data-label`; a text has its element's label."""
    codes = {"outer": OUTER, "content": CONTENT, "other": OTHER}
    counts: dict[str, np.ndarray] = {}
    edge, total = np.full((3, 3, 3), 0.05), np.zeros(3)
    for html in pages:
        page = parse(html)
        labels = [OUTER] * len(page.parent)
        for i in range(1, len(labels)):
            labels[i] = codes.get(page.label[i], labels[page.parent[i]])
            edge[_kind(page.tag[i]), labels[page.parent[i]], labels[i]] += 1
        for y in labels:
            total[y] += 1
        names, owner = features(page)
        for name, i in zip(names, owner):
            counts.setdefault(name, np.zeros(3))[labels[i]] += 1
    index = {f: i for i, f in enumerate(counts)}
    node = np.log((np.array(list(counts.values())) + smooth) / (total + 10 * smooth))
    return Model(index, node, np.log(edge / edge.sum(2, keepdims=True)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null, empty or textless page has an empty text; a page of any length is read whole; repeated
    rows come out as often; null ids and urls are kept; an empty table gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast(train(labelled_pages()))  # a fixed number of labelled pages
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def texts(htmls: list[str], model: Model) -> list[str]:
        parsed = [parse(h) for h in htmls]
        kept, at, out = marginals(*model.potentials(parsed))[:, CONTENT] > 0.5, 0, []
        for page in parsed:
            out.append(main_text(page, kept[at:at + len(page.parent)]))
            at += len(page.parent)
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = texts([h or "" for h in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(work, f"{kinds}, text string, n_chars long")
