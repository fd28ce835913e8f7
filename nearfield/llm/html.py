"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is content or not. A node has a potential of its own
(logistic regression on tag, attribute words, text and link figures) and one with its parent.
Sum-product messages upward and downward give exact marginals, as the page is a tree; text whose
element is more likely content than not is kept.

The model learns from labelled pages: a bounded sample of the pages themselves, labelled by their
semantic tags, and the same articles set into other layouts, in which the place of menus, sidebars,
notices, adverts, forms and comments is known because they were put there.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape
from html.parser import HTMLParser
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages the model is fitted on: those with the smallest digests.
TRAIN_PAGES = 300
# Bytes of these pages in all; one that does not fit is passed over.
TRAIN_BYTES = 32 << 20
LAYOUTS = 3
SPACE = 1 << 13
STEPS = 250
# The attribute by which pages made for training say what is content; no other page is asked.
LABEL = "data-nearfield-label"
# Python reads no number of more digits than 4,300; all from eight on are beyond the characters.
_LONG_REFERENCE = re.compile("&#([0-9]{4000,})")

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style head title template noscript iframe svg object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTROLS = frozenset("input button select textarea option fieldset legend".split())
# What may stand in a head; any other start tag ends an open one.
IN_HEAD = frozenset("title base link meta style script noscript template".split())
# Rules by which a start tag ends an open element: its kinds, and the boundary it is sought up to.
RULES = (
    ({"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dl"}),
    ({"tr", "td", "th"}, {"table"}),
    ({"td", "th"}, {"tr", "table"}),
    ({"option"}, {"select"}),
    ({"p"}, {"table", "td", "th", "li", "div", "article", "section", "button"}),
    ({"svg"}, {"foreignobject"}),
)
# The rule of a start tag; any other block ends a paragraph, and any block but these an svg.
CLOSES = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4}
PARAGRAPH, DRAWING = 5, 6
BREAKS_OUT = frozenset(
    "article aside blockquote body center dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav"
    " ol p pre section table ul".split()
)
_RULED = frozenset().union(*(kinds | until for kinds, until in RULES))
# Attribute words that name a role.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu topbar"
    " breadcrumb breadcrumbs header masthead footer bottom copyright sidebar side aside widget"
    " related recommended popular cookie consent notice alert popup modal overlay gdpr comment"
    " comments reply replies discussion respond disqus share social follow login signup signin"
    " subscribe newsletter search form pagination pager toolbar tags".split()
)
MAIN_WORDS = frozenset(
    "article content post entry story body text main page prose maincontent articlebody".split()
)


@dataclass
class Page:
    """Elements in page order, and the runs of text with their elements and blocks."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    labels: list[int | None] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


class _Builder(HTMLParser):
    def __init__(self, labelled: bool):
        super().__init__(convert_charrefs=True)
        self.labelled = labelled
        self.page = Page()
        self.open: list[int] = []
        # Open elements of each tag, and for each open element the depth that every rule would end.
        # Both spare walks up the open elements, whose number a page does not bound.
        self.count: Counter[str] = Counter()
        self.ends: list[tuple[int, ...]] = []
        self.silent = 0
        self.block = 0
        self.bodied = False
        self._add("#page", [])

    def _add(self, tag: str, attrs) -> None:
        page = self.page
        page.parents.append(self.open[-1] if self.open else -1)
        page.tags.append(tag)
        found: list[str] = []
        label = None
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                apart = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
                found += re.findall(r"[a-z]+", apart)
            elif self.labelled and name == LABEL and value in ("0", "1"):
                label = int(value)
        page.words.append(found)
        page.labels.append(label)
        depth = len(self.open)
        ends = self.ends[-1] if self.ends else (0,) * len(RULES)
        if tag in _RULED:
            ends = tuple(
                depth if tag in kinds else 0 if tag in until else above
                for (kinds, until), above in zip(RULES, ends, strict=True)
            )
        self.ends.append(ends)
        self.open.append(len(page.tags) - 1)
        self.count[tag] += 1

    def _pop(self) -> None:
        tag = self.page.tags[self.open.pop()]
        self.ends.pop()
        self.count[tag] -= 1
        if tag in SILENT:
            self.silent -= 1
        if tag not in INLINE:
            self.block += 1

    def _pop_from(self, depth: int) -> None:
        while len(self.open) > depth:
            self._pop()

    def _close(self, rule: int) -> None:
        if self.ends[-1][rule]:
            self._pop_from(self.ends[-1][rule])

    def _end_head(self) -> None:
        """Close a head, and an unclosed title in it, whose end tag was left out."""
        self.handle_endtag("title")
        if self.count["head"] and self.page.tags[self.open[-1]] == "head":
            self._pop()

    def _start_body(self) -> None:
        """The html and body elements that every page has, whether it names them or not."""
        if self.count["head"]:
            self._end_head()
        if not self.bodied and not self.silent:
            self._root()
            self.bodied = True
            self._add("body", [])

    def _root(self) -> None:
        if len(self.page.tags) == 1:
            self._add("html", [])

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body") and self.count[tag]:
            return
        if tag == "body":
            if self.count["head"]:
                self._end_head()
            self.bodied = True
        elif tag not in IN_HEAD and tag not in ("html", "head"):
            self._start_body()
        if tag != "html":
            self._root()
        if tag in VOID:
            if tag == "input":
                self._add(tag, attrs)
                self.open.pop()
                self.ends.pop()
                self.count[tag] -= 1
            elif tag == "hr":
                self.block += 1
            elif tag == "br":
                self.handle_data("\n")
            return
        if tag in BREAKS_OUT:
            self._close(DRAWING)
        if tag in CLOSES:
            self._close(CLOSES[tag])
        elif tag not in INLINE:
            self._close(PARAGRAPH)
        if tag not in INLINE:
            self.block += 1
        if tag in SILENT:
            self.silent += 1
        self._add(tag, attrs)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:  # what the walk passes is closed with it
            depth = len(self.open) - 1
            while self.page.tags[self.open[depth]] != tag:
                depth -= 1
            self._pop_from(depth)

    def handle_data(self, data: str) -> None:
        if (self.count["head"] or not self.bodied) and not data.isspace():
            if self.page.tags[self.open[-1]] in ("head", "html", "#page"):
                self._start_body()
        if not self.silent and data:
            self.page.texts.append((self.open[-1], self.block, data))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown section is a comment up to the next ">"
            return self.parse_bogus_comment(i, report)


def _short_reference(match: re.Match) -> str:
    return "&#" + (match[1].lstrip("0")[:8] or "0")


def parse(html: str, labelled: bool = True) -> Page:
    """Elements and texts of a page; labels only of a page that was made for training."""
    builder = _Builder(labelled)
    builder.feed(_LONG_REFERENCE.sub(_short_reference, html))
    builder.close()
    return builder.page


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= edge for edge in edges)


def figures(page: Page) -> list[list[int]]:
    """Per element, of its whole subtree: letters, letters in links, marks, words, controls."""
    n = len(page.tags)
    sums = [[0, 0, 0, 0, 0] for _ in range(n)]
    inside = [False] * n
    for i, tag in enumerate(page.tags):
        parent = page.parents[i]
        inside[i] = tag == "a" or (parent >= 0 and inside[parent])
        sums[i][4] = int(tag in CONTROLS)
    for element, _, text in page.texts:
        letters = len(text.strip())
        if letters:
            own = sums[element]
            own[0] += letters
            own[1] += letters if inside[element] else 0
            own[2] += sum(map(text.count, ".,;!?"))
            own[3] += text.count(" ") + 1
    for i in range(n - 1, 0, -1):  # children stand behind their parents
        above = sums[page.parents[i]]
        for k, value in enumerate(sums[i]):
            above[k] += value
    return sums


@lru_cache(maxsize=1 << 16)
def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % SPACE


def features(page: Page) -> list[list[int]]:
    """Hashed features of every element."""
    sums = figures(page)
    out = []
    for i, tag in enumerate(page.tags):
        names = ["bias", f"tag {tag}"]
        for word in set(page.words[i]):
            names.append(f"word {word}")
            if word in ASIDE_WORDS:
                names.append("aside word")
            if word in MAIN_WORDS:
                names.append("main word")
        if tag not in INLINE:
            letters, linked, marks, words, controls = sums[i]
            size = _bin(letters, (1, 20, 60, 150, 400, 1000, 4000))
            share = _bin(linked / max(letters, 1), (0.05, 0.25, 0.5, 0.9))
            names += [
                f"size {size}",
                f"links {share}",
                f"size {size} links {share}",
                f"marks {_bin(marks / max(words, 1), (0.01, 0.05, 0.1, 0.2))}",
                f"controls {controls > 0} {size < 4}",
            ]
            parent = page.parents[i]
            if parent >= 0:
                names.append(f"below {page.tags[parent]} {tag}")
                part = letters / max(sums[parent][0], 1)
                names.append(f"part {_bin(part, (0.02, 0.1, 0.4, 0.8))}")
        out.append([_number(name) for name in names])
    return out


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + log1p(exp(-abs(a - b)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    # Log potentials by kind of child (block, inline), label of the parent, label of the child.
    tree: np.ndarray

    def marginals(self, page: Page) -> list[float]:
        """Probability of content per element, by messages up to the root and down again.

        A message is the log odds it gives to its receiver's being content.
        """
        n = len(page.tags)
        weights, tree = self.weights, self.tree.tolist()
        belief = [max(-30.0, min(30.0, float(weights[f].sum()))) for f in features(page)]
        links = [tree[tag in INLINE] for tag in page.tags]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            (no_no, no_yes), (yes_no, yes_yes) = links[i]
            odds = belief[i]
            up[i] = _log_sum(yes_no, yes_yes + odds) - _log_sum(no_no, no_yes + odds)
            belief[page.parents[i]] += up[i]
        for i in range(1, n):
            (no_no, no_yes), (yes_no, yes_yes) = links[i]
            odds = belief[page.parents[i]] - up[i]  # what the parent knows without this child
            belief[i] += _log_sum(no_yes, yes_yes + odds) - _log_sum(no_no, yes_no + odds)
        return [1 / (1 + exp(-max(-500.0, min(500.0, odds)))) for odds in belief]


def main_text(html: str, model: Model) -> str:
    """Blocks of content in page order, white space inside them folded, joined by empty lines."""
    page = parse(html, labelled=False)
    if not page.texts:
        return ""
    content = [p >= 0.5 for p in model.marginals(page)]
    blocks: list[str] = []
    last, parts = None, []
    for element, block, text in [*page.texts, (0, -1, "")]:
        if block != last:
            joined = " ".join("".join(parts).split())
            if joined:
                blocks.append(joined)
            last, parts = block, []
        if block >= 0 and content[element]:
            parts.append(text)
    return "\n\n".join(blocks)


# Labelled pages -----------------------------------------------------------------------------

_ARTICLE = frozenset(["article", "main"])
_NEVER = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "textarea"])


def label_by_tags(page: Page) -> list[int]:
    """Text is content inside an article or main element, outside of what is never content."""
    inside = [0] * len(page.tags)
    for i in range(1, len(page.tags)):
        tag, parent = page.tags[i], page.parents[i]
        if tag in _NEVER or any(w in ASIDE_WORDS for w in page.words[i]):
            inside[i] = -1
        elif inside[parent] == 0 and tag in _ARTICLE:
            inside[i] = 1
        else:
            inside[i] = inside[parent]
    return [int(v == 1) for v in inside]


def labels_of(page: Page) -> np.ndarray:
    """Label of every element: whether most of the text below it is content."""
    if any(label is not None for label in page.labels):
        own = []
        for i, label in enumerate(page.labels):
            own.append(label if label is not None else own[page.parents[i]] if i else 0)
    else:
        own = label_by_tags(page)
    mass = np.zeros((len(page.tags), 2))
    for element, _, text in page.texts:
        mass[element, own[element]] += len(text.strip())
    for i in range(len(page.tags) - 1, 0, -1):
        mass[page.parents[i]] += mass[i]
    empty = mass.sum(1) == 0
    return np.where(empty, np.array(own), mass[:, 1] >= mass[:, 0]).astype(int)


def _pieces(page: Page) -> tuple[list[str], list[str]]:
    """Blocks of a page labelled by tags: content and other."""
    inside = label_by_tags(page)
    blocks: dict[tuple[int, int], list[str]] = {}
    for element, block, text in page.texts:
        blocks.setdefault((block, inside[element]), []).append(text)
    out: tuple[list[str], list[str]] = ([], [])
    for (_, label), parts in blocks.items():
        joined = " ".join("".join(parts).split())
        if joined:
            out[label].append(joined)
    return out[1], out[0]


def other_layout(content: list[str], other: list[str], elsewhere: list[str], draw: random.Random) -> str:
    """The same article in another layout; ``LABEL`` says what is content."""
    pick = draw.choice

    def some(low: int, high: int) -> str:
        words = pick(elsewhere).split()
        size = min(len(words), draw.randint(low, high))
        start = draw.randint(0, len(words) - size)
        return escape(" ".join(words[start : start + size]))

    def named(tags: str, words: str) -> tuple[str, str]:
        """An element by its own tag, or a plain one that an attribute names."""
        tag = pick(tags.split())
        if tag in ("div", "section", "ul", "ol", "p", "span") or draw.random() < 0.3:
            return tag, f' {pick(["class", "id"])}="{pick(words.split())}"'
        return tag, ""

    def links(count: int) -> str:
        return "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(count))

    def aside(kind: str) -> str:
        if kind == "menu":
            tag, name = named("nav nav div ul", "menu navbar navigation nav breadcrumb topbar main-menu")
            inner = links(draw.randint(3, 9)) if tag == "ul" else f"<ul>{links(draw.randint(3, 9))}</ul>"
        elif kind == "header":
            tag, name = named("header header div", "header masthead site-header page-header top")
            inner = f"<{pick(['h1', 'h2', 'div', 'p', 'span'])}>{some(1, 5)}</>" + pick(
                ["", f"<ul>{links(3)}</ul>", f"<p>{some(3, 9)}</p>"]
            )
            inner = re.sub(r"<(\w+)>([^<]*)</>", r"<\1>\2</\1>", inner)
        elif kind == "footer":
            tag, name = named("footer footer div", "footer site-footer bottom copyright")
            inner = pick(["&copy; ", ""]) + some(3, 25) + pick(["", f"<ul>{links(4)}</ul>"])
        elif kind == "sidebar":
            tag, name = named("aside aside div section", "sidebar side widget related popular recommended")
            inner = f"<{pick(['h2', 'h3', 'h4'])}>{some(1, 3)}</h3>" + pick(
                [f"<ul>{links(5)}</ul>", f"<p>{some(5, 40)}</p>", f"<p>{some(8, 30)}</p><p>{some(8, 30)}</p>"]
            )
        elif kind == "notice":
            tag, name = named("div div section aside p", "cookie cookie-notice notice consent alert banner popup gdpr")
            inner = some(6, 30) + pick(["", f"<button>{some(1, 2)}</button>", f'<a href="#">{some(1, 2)}</a>'])
        elif kind == "advert":
            tag, name = named("div div aside section p", "ad ads advert advertisement sponsored promo banner")
            inner = pick([some(5, 25), f"<p>{some(5, 25)}</p>", f'<a href="/x">{some(3, 12)}</a>'])
        elif kind == "form":
            tag, name = named("form form form div", "form newsletter subscribe login search signup")
            inner = f"<label>{some(1, 4)}</label><input type=text><button>{some(1, 2)}</button>" + pick(
                ["", f"<p>{some(4, 15)}</p>", f"<select><option>{some(1, 2)}<option>{some(1, 2)}</select>"]
            )
        elif kind == "share":
            tag, name = named("div ul p", "share social share-buttons follow tags")
            inner = links(4) if tag == "ul" else " ".join(f'<a href="/{i}">{some(1, 2)}</a>' for i in range(4))
        else:
            tag, name = named("div section ol ul", "comments comment-list replies discussion comments-area respond")
            inner = f"<h3>{some(1, 3)}</h3>" if tag not in ("ul", "ol") else ""
            child, own = "li", ""
            if tag not in ("ul", "ol"):
                child = pick(["div", "article", "p"])
                own = f' class="{pick(["comment", "reply", "comment-body"])}"'
            for _ in range(draw.randint(1, 5)):
                inner += f"<{child}{own}>" + pick(["", f"<b>{some(1, 2)}</b> "])
                inner += some(5, 60) if child == "p" else f"<p>{some(5, 80)}</p>"
                inner += f"</{child}>"
        return f'<{tag}{name} {LABEL}="0">{inner}</{tag}>'

    def body_block(text: str, first: bool) -> str:
        words = escape(text)
        if first:
            return f"<h1>{words}</h1>"
        kind = draw.random()
        if kind < 0.7:
            if draw.random() < 0.3:
                cut = words.split(" ")
                at = draw.randrange(len(cut))
                mark = pick(["b", "i", "em", "strong", "a href=/l", "span", "code"])
                cut[at] = f"<{mark}>{cut[at]}</{mark.split()[0]}>"
                words = " ".join(cut)
            return f"<p>{words}" + pick(["</p>", "</p>", ""])
        if kind < 0.8:
            return f"<{pick(['h2', 'h3'])}>{words[:60]}</h3><p>{words}</p>"
        if kind < 0.88:
            return f"<ul><li>{words}</li><li>{words[:50]}</li></ul>"
        if kind < 0.94:
            return f"<blockquote>{words}</blockquote>"
        return pick([f"<div>{words}</div>", f"<pre>{words}</pre>", f"<table><tr><td>{words}<td>{words[:20]}</table>"])

    if draw.random() < 0.3:  # short blocks
        content = [" ".join(text.split()[: draw.randint(3, 25)]) for text in content]
    share = pick([0.0, 0.5, 0.5, 0.5])  # some pages are nothing but the article
    before = [aside(k) for k in ("menu", "header", "notice", "advert", "form", "share") if draw.random() < share]
    after = [
        aside(k)
        for k in ("sidebar", "comments", "form", "advert", "share", "notice", "footer", "menu")
        if draw.random() < share
    ]
    within = [aside(k) for k in ("advert", "sidebar", "share", "form", "notice", "comments") if draw.random() < 0.4 * share]
    draw.shuffle(before)
    draw.shuffle(after)
    blocks = [body_block(text, i == 0 and draw.random() < 0.8) for i, text in enumerate(content)]
    for extra in within:
        blocks.insert(draw.randint(0, len(blocks)), extra)
    tag, name = named(
        "article article main div div div section",
        "content post entry entry-content article-body story main-content post-body text prose",
    )
    if tag == "div" and draw.random() < 0.3:
        name = ""
    article = f'<{tag}{name} {LABEL}="1">{"".join(blocks)}</{tag}>'
    if draw.random() < 0.4:
        article = f'<div class="{pick(["container", "wrapper", "row", "page", "layout"])}">{article}</div>'
    if draw.random() < 0.1:  # a bare page
        return f'<html><body {LABEL}="1">{"".join(blocks)}</body></html>'
    head = f"<html><head><title>{some(2, 8)}</title></head><body>"
    return f'{head}{"".join(before)}{article}{"".join(after)}</body></html>'


def fit(pages: list[str], layouts: int = LAYOUTS) -> Model:
    """Fit both potentials on the pages as they are and in other layouts."""
    labelled: list[Page] = []
    parsed = [(p, _pieces(p)) for p in (parse(html, labelled=False) for html in pages)]
    elsewhere = [t for _, (content, other) in parsed for t in content + other] or ["some text"]
    draw = random.Random(7)
    for page, (content, other) in parsed:
        if content:
            labelled.append(page)
            for _ in range(layouts):
                short = content[: draw.randint(1, 12)]
                labelled.append(parse(other_layout(short, other, elsewhere, draw)))
    if not labelled:  # nothing is marked: fall back on layouts alone
        labelled = [parse(other_layout(["a title", "some text"], [], elsewhere, draw)) for _ in range(60)]
    rows, labels = [], []
    tree = np.ones((2, 2, 2))
    for page in labelled:
        truth = labels_of(page)
        rows += features(page)
        labels.append(truth)
        for i in range(1, len(truth)):
            tree[int(page.tags[i] in INLINE), truth[page.parents[i]], truth[i]] += 1
    y = np.concatenate(labels).astype(float)
    numbers = np.array([f for row in rows for f in row])
    sizes = np.array([len(row) for row in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    weights, speed, size = np.zeros(SPACE), np.zeros(SPACE), np.zeros(SPACE)
    for step in range(1, STEPS + 1):  # Adam over all nodes
        z = np.bincount(owner, weights[numbers], minlength=len(rows))
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.bincount(numbers, gap[owner], minlength=SPACE) + 1e-6 * weights
        speed = 0.9 * speed + 0.1 * slope
        size = 0.99 * size + 0.01 * slope**2
        weights -= 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-9)
    # P(child | parent) over P(child): what the tree adds to the nodes' own potentials.
    given = tree / tree.sum(2, keepdims=True)
    alone = tree.sum(1) / tree.sum((1, 2))[:, None]
    return Model(weights, np.log(given) - np.log(alone)[:, None, :])


def train(
    pages: DataFrame, rows: int = TRAIN_PAGES, html: str = "html", most: int = TRAIN_BYTES
) -> Model:
    """Fit on at most ``rows`` different pages of at most ``most`` bytes, chosen by digest.

    Digests are chosen first, so that only chosen pages leave their tasks.
    """
    marked = pages.where(F.col(html).isNotNull() & (F.col(html) != "")).select(
        F.xxhash64(html).alias("turn"), F.col(html).alias("html")
    )
    sizes = marked.groupBy("turn").agg(F.max(F.octet_length("html")).alias("bytes"))
    chosen, left = [], most
    for row in sizes.orderBy("turn").limit(rows).collect():
        if row["bytes"] <= left:
            chosen.append(row["turn"])
            left -= row["bytes"]
    sample = marked.where(F.col("turn").isin(chosen)).groupBy("turn").agg(F.min("html").alias("html"))
    return fit([row["html"] for row in sample.orderBy("turn").collect()])


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``.

    A null or empty page has an empty text; repeated rows are extracted each; an empty table gives
    no rows.
    """

    def extract(pages_html: pa.Array) -> pa.Array:
        return pa.array([main_text(h or "", model) for h in pages_html.to_pylist()], pa.string())

    text = F.arrow_udf(extract, "string")(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
