"""Main text of HTML pages by a tree-structured graphical model.

The nodes are a page's block elements and their runs of text. Each is in one of five states: container (it encloses
content), the top or the inside of content, the top or the inside of boilerplate. Node potentials come from the tag,
words of the class, id and role, and the share of the text in links; parent-child potentials from the states'
transitions, counted apart for text, plain elements and others. All are counted on labelled pages. What lies inside content and
inside boilerplate looks alike, so both share the potentials of tags and links: a long list can't outvote its top.
Sum-product messages passed up and then down the tree give each text run's marginal; runs more likely content than
not are the text, in page order.

* A null or empty page has no text. Repeated rows are extracted each alone; equal pages have equal texts.
* Broken markup is read leniently: unclosed elements end with their parents (those whose insides are no text, such as
  ``svg`` or ``button``, where the next block begins), stray end tags are skipped, and a tag, comment or script cut off by the end of the page reaches to
  that end. Quotes count only after an equals sign. A slash ends an ``svg``, ``math`` or ``object`` tag's element. Pages of any
  length and depth are read whole, in time that grows with their length.
* White space (also that of character references) inside a block becomes one space; blocks without text vanish.
* Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal
from .labelled_pages import MAIN_TEXT, labelled_pages

CONTAINER, CONTENT_TOP, CONTENT, BOILERPLATE_TOP, BOILERPLATE = STATES = range(5)
TEXT_SCHEMA = "page_id long, url string, text string, n_chars long"

#: Fixed values of HTML: elements whose insides are never text of the page, void elements, inline elements.
_RAW = "script|style|noscript|iframe|textarea|title"
_HIDDEN = frozenset("template svg math object select button video audio canvas datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Which open elements an opening tag ends, and where looking for them stops.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",), "tbody": ("thead", "tbody", "tr", "td", "th")}
_SCOPES = frozenset("ul ol dl table body html article section main div".split())
_ATTRIBUTES = r"""(?:[^>=]+|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*["']))*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW})(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that, without a class, id or role, are mere parts of what holds them.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption hgroup center".split())
#: Fixed values of HTML: elements that begin parts of a page.
_SECTIONS = frozenset("#page #text html head body main article section div nav aside header footer form fieldset legend label address dialog details summary menu search hgroup center".split())
#: Words in a custom element's name that make it more than a mere part.
_PARTS = frozenset("ad ads aside banner comment comments cookie footer header menu nav newsletter popup related share sidebar social toolbar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """A parsed page: nodes in page order with parents before children; text runs are nodes of the tag ``#text``."""

    def __init__(self, html: str):
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [-1]
        self.attributes: list[str] = [""]
        self.texts: dict[int, str] = {}
        self.links: dict[int, int] = {}
        self.sums: list[list[int]] | None = None  # the length of each node's text and of that in links
        open_: list[int] = [0]
        places: dict[str, list[int]] = {}  # where in open_ the elements of a tag are
        scopes = [0]  # where in open_ those of _SCOPES are
        hidden: list[str] = []  # open elements of a part whose insides are no text, from its own on
        loose = False  # whether that part has no end tag, so that a block ends it
        inside: Counter = Counter()  # how often each tag is among them
        run: list[str] = []
        linked, in_link, at = 0, 0, 0
        tags = self.tags

        def end(place: int) -> None:
            while len(open_) > place:
                tag = tags[open_.pop()]
                places[tag].pop()
                if tag in _SCOPES:
                    scopes.pop()

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    self.texts[len(tags)] = text
                    self.links[len(tags)] = linked
                    self.add("#text", open_[-1], "")
                run.clear()
            linked = 0

        tokens = list(_TOKEN.finditer(html))
        unended = self.unended(tokens)
        for m in tokens:
            if m.start() > at and not hidden:
                run.append(html[at : m.start()])
                linked += (m.start() - at) * (in_link > 0)
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name, closing = name.lower(), bool(m[2])
            if hidden and loose and not closing and name not in _VOID and name not in _INLINE and name not in _HIDDEN:
                hidden.clear()  # it ends where a block begins
                inside.clear()
            if hidden:
                if not closing:
                    if name not in _VOID and not m[4].endswith("/"):
                        hidden.append(name)
                        inside[name] += 1
                    continue
                if inside[name]:
                    while (last := hidden.pop()) != name:
                        inside[last] -= 1
                    inside[name] -= 1
                    continue
                if not places.get(name):
                    continue
                hidden.clear()  # it ends with what holds it
                inside.clear()
            elif name in _HIDDEN and not closing:
                if not m[4].endswith("/"):
                    hidden.append(name)
                    inside[name] += 1
                    loose = m.start() in unended
                continue
            if name in _INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                continue
            if name in _VOID:
                if name in ("br", "img", "input", "wbr"):
                    run.append("" if name == "wbr" else " ")
                elif name == "hr":
                    flush()
                continue
            if closing and name in _HIDDEN:
                continue
            flush()
            if closing:
                if places.get(name):
                    end(places[name][-1])
                in_link = 0
                continue
            if tags[open_[-1]] == "p":
                end(len(open_) - 1)
            last = [x for tag in _ENDS.get(name, ()) for x in places.get(tag, ())[-3:] if x > scopes[-1]]
            if last:
                end(min(last))
            places.setdefault(name, []).append(len(open_))
            if name in _SCOPES:
                scopes.append(len(open_))
            open_.append(len(tags))
            self.add(name, open_[-2], m[4] or "")
        if at < len(html) and not hidden:
            run.append(html[at:])
        flush()

    @staticmethod
    def unended(tokens: list[re.Match]) -> set[int]:
        """Where elements of _HIDDEN begin that no end tag ends, each end tag being that of the last open one of its name."""
        open_: dict[str, list[int]] = {}
        for m in tokens:
            name = m[3].lower() if m[3] else ""
            if name in _HIDDEN:
                if not m[2]:
                    if not m[4].endswith("/"):
                        open_.setdefault(name, []).append(m.start())
                elif open_.get(name):
                    open_[name].pop()
        return {x for found in open_.values() for x in found}

    def add(self, tag: str, parent: int, attributes: str) -> None:
        self.tags.append(tag)
        self.parents.append(parent)
        self.attributes.append(attributes)

    def kind(self, i: int) -> int:
        """0: a run of text; 1: a plain element; 2: an element that may begin a part of another sort."""
        return 0 if i in self.texts else 1 if self.plain(i) and not _ATTRIBUTE.search(self.attributes[i]) else 2

    def plain(self, i: int) -> bool:
        """Whether the element is a mere part by its tag; unknown and custom ones are, unless their name says more."""
        tag = self.tags[i]
        return tag in _PLAIN or tag not in _SECTIONS and _PARTS.isdisjoint(tag.split("-"))

    def features(self, i: int) -> list[str]:
        """Names of what is seen of a node."""
        if self.sums is None:
            self.sums = [[len(self.texts.get(j, "")), self.links.get(j, 0)] for j in range(len(self.tags))]
            for j in range(len(self.tags) - 1, 0, -1):
                above, own = self.sums[self.parents[j]], self.sums[j]
                above[0] += own[0]
                above[1] += own[1]
        length, linked = self.sums[i]
        tag = self.tags[i]
        out = [] if tag == "div" else [f"word {w}" for w in tag.split("-")] if "-" in tag else [f"tag {tag}"]
        if length:
            out.append(f"links {0 if linked < 0.1 * length else 1 if linked < 0.6 * length else 2}")
        if i not in self.texts and not self.plain(i):
            out.append("named yes" if _ATTRIBUTE.search(self.attributes[i]) else f"named no {self.tags[i]}" if self.tags[i] in ("div", "section") else "named no")
        if self.attributes[i]:
            for a in _ATTRIBUTE.finditer(self.attributes[i]):
                out += [f"word {w.lower()}" for w in _WORD.findall(a[2] or a[3] or a[4] or "")]
        return out


class TreeModel:
    """Potentials by state: of features, and of a child given its parent, by the child's kind."""

    def __init__(self, pages: list[str], smoothing: float = 0.02):
        seen: list[Counter] = [Counter() for _ in STATES]
        moves = [[[1e-5] * len(STATES) for _ in STATES] for _ in range(3)]
        for html in pages:
            page = Page(html)
            states = self.labels(page)
            for i, s in enumerate(states):
                for f in page.features(i):
                    for t in (CONTENT, BOILERPLATE) if s in (CONTENT, BOILERPLATE) and not f.startswith("word ") else (s,):
                        seen[t][f] += 1
                if i:
                    above = states[page.parents[i]]
                    for t in (CONTENT_TOP, CONTENT) if above in (CONTENT_TOP, CONTENT) else (above,):
                        moves[page.kind(i)][t][s] += 1
        self.moves = [[tuple(x / sum(row) for x in row) for row in rows] for rows in moves]
        names = set().union(*seen)
        sizes = Counter(f.split()[0] for f in names)
        totals = {(k, s): sum(n for f, n in seen[s].items() if f.split()[0] == k) for k in sizes for s in STATES}
        self.features: dict[str, tuple[float, ...]] = {}
        for f in names:
            k = f.split()[0]
            p = [(seen[s][f] + smoothing) / (totals[k, s] + smoothing * sizes[k]) for s in STATES]
            self.features[f] = tuple(x / max(p) for x in p)

    @staticmethod
    def labels(page: Page) -> list[int]:
        """States of a labelled page's nodes."""
        inside = [False] * len(page.tags)
        for i in range(1, len(inside)):
            words = page.attributes[i].split()
            inside[i] = "not" not in words and ("main" in words or inside[page.parents[i]] or page.texts.get(i, "").startswith(MAIN_TEXT))
        holds = list(inside)
        for i in range(len(holds) - 1, 0, -1):
            holds[page.parents[i]] |= holds[i]
        states = [CONTAINER]
        for i in range(1, len(inside)):
            above = states[page.parents[i]]
            if inside[i]:
                states.append(CONTENT if above in (CONTENT, CONTENT_TOP) else CONTENT_TOP)
            elif holds[i]:
                states.append(CONTAINER)
            else:
                states.append(BOILERPLATE if above in (BOILERPLATE, BOILERPLATE_TOP) else BOILERPLATE_TOP)
        return states

    def marginals(self, page: Page) -> list[float]:
        """The probability of content of each node, by messages up and then down the tree."""
        n, parents = len(page.tags), page.parents
        seen = self.features
        belief: list[list[float]] = []
        for i in range(n):
            own = [1.0] * len(STATES)
            for f in page.features(i):
                if f in seen:
                    own = [x * y for x, y in zip(own, seen[f], strict=True)]
            belief.append(own)
        up: list[list[float]] = [[]] * n
        for i in range(n - 1, 0, -1):
            v, w, x, y, z = belief[i]
            message = [a * v + b * w + c * x + d * y + e * z for a, b, c, d, e in self.moves[page.kind(i)]]
            top = max(message) or 1.0
            up[i] = message = [m / top + 1e-12 for m in message]
            product = [a * m for a, m in zip(belief[parents[i]], message, strict=True)]
            top = max(product) or 1.0
            belief[parents[i]] = [m / top + 1e-30 for m in product]
        belief[0] = [belief[0][CONTAINER], 0.0, 0.0, 0.0, 0.0]
        out = [0.0] * n
        for i in range(1, n):
            above = [a / m for a, m in zip(belief[parents[i]], up[i], strict=True)]  # without this child's message
            rows = self.moves[page.kind(i)]
            own = [x * sum([a * row[s] for a, row in zip(above, rows, strict=True)]) for s, x in enumerate(belief[i])]
            total = sum(own)
            belief[i] = own = [x / total for x in own] if 0 < total < math.inf else [0.0, 0.0, 0.0, 0.0, 1.0]
            out[i] = own[CONTENT] + own[CONTENT_TOP]
        return out

    def extract(self, html: str) -> str:
        page = Page(html)
        if not page.texts:
            return ""
        content = self.marginals(page)
        return "\n".join([t for i, t in page.texts.items() if content[i] >= 0.5])


_MODEL: list[TreeModel] = []


def trained() -> TreeModel:
    """The model of the labelled pages, trained once a process."""
    if not _MODEL:
        _MODEL.append(TreeModel(labelled_pages()))
    return _MODEL[0]


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            found = [model.extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(frugal(run), TEXT_SCHEMA)
