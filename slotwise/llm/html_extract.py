"""HTML extraction: flat text blocks, judged by a decision tree on their size, link density, neighbours and place.

A page becomes a list of text blocks. Each has its words and link density, those of the blocks before and after, and
whether it stands in an article, in a part of the page that tags name (navigation, footer, form ...) or in an
element whose class, id or role names such a part for sure (advert, comments), or may do so (header, related). A decision tree, trained when the job starts on the
small labelled pages below, tells main text from the rest: in an article what a doubtful name covers counts by its link density.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's block elements, void elements, elements without readable text, and parts of a page.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head noscript template svg select option optgroup datalist button label canvas object audio video map iframe dialog".split())
PART = set("nav footer aside header form menu fieldset dialog".split())
MAIN = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role that name a part of the page beside the article; and those that article parts bear as well.
SURE = re.compile(
    r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|gdpr|comments?|commentlist|disqus|sidebar\w*|nav\w*|breadcrumbs?|footer|masthead|topbar|toolbar|"
    r"share|sharing|newsletter|subscri\w*|signup|popup|login|pagination|pager|contentinfo|complementary"
)
DOUBTFUL = re.compile(r"menus?|notices?|notifications?|alerts?|repl(?:y|ies)|discussion|responses?|side|rail|foot|header|social|related|recommend\w*|modal|overlay|widgets?|search\w*|dialog|copyright|disclaimer|legal|skip")
#: First parts of names that tell a state of the page, and last parts that say no more than "a piece of it".
STATE = set("has with no not without is show shows hide hides hidden enable enabled disable disabled toggle".split())
PIECE = set("area bar block blocks body bottom box btn button buttons col column container content form group head heading icon icons inner item items large left link links list main module outer panel primary right row secondary section slot small text thread title top unit wrap wrapper".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp)\b(?:[^>]*)(?:>|\Z).*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_main", "page_has_main", "in_part", "surely_named", "doubtfully_named", "heading"]


class Named:
    """An element whose own name means another part of the page, and the nearest such element around it. A wrapper of the article is ``void``: its name tells of the layout."""

    __slots__ = ("above", "void", "counts")

    def __init__(self, above: Named | None) -> None:
        self.above, self.void, self.counts = above, False, True


class Root:
    """An outermost article or main element: the names around it, and its words that no name within it covers."""

    __slots__ = ("tag", "sure", "doubtful", "words")

    def __init__(self, tag: str, sure: Named | None, doubtful: Named | None) -> None:
        self.tag, self.sure, self.doubtful, self.words = tag, sure, doubtful, 0


@dataclass(frozen=True)
class Place:
    """Where a block stands: what its open elements say together."""

    tag: str = ""
    silent: bool = False
    main: bool = False
    part: bool = False
    sure: Named | None = None
    doubtful: Named | None = None
    root: Root | None = None
    heading: bool = False
    label: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: Place


class _Open:
    """The open elements, with the places of each tag and of blocks, so that no end tag searches the stack."""

    def __init__(self) -> None:
        self.stack: list[Place] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.but_p: list[int] = []

    def top(self) -> Place:
        return self.stack[-1] if self.stack else Place()

    def push(self, place: Place) -> None:
        n = len(self.stack)
        self.stack.append(place)
        self.at.setdefault(place.tag, []).append(n)
        if place.tag in BLOCK:
            self.blocks.append(n)
            if place.tag != "p":
                self.but_p.append(n)

    def last(self, tag: str) -> int:
        held = self.at.get(tag)
        return held[-1] if held else -1

    def close(self, tag: str, barrier: int = -1) -> None:
        """Closes the last open ``tag`` and what it holds, unless it stands below the barrier."""
        n = self.last(tag)
        if n < 0 or n < barrier:
            return
        while len(self.stack) > n:
            gone = self.stack.pop().tag
            self.at[gone].pop()
            for held in (self.blocks, self.but_p):
                if held and held[-1] == len(self.stack):
                    held.pop()


def _meaning(name: str) -> str:
    """'sure' or 'doubtful' if one of the names in a class, id or role attribute means another part of the page, else ''.

    A name's last part tells what it is ('post-comments'), once parts that only say "a piece" are gone ('comment-list'); a doubtful last part is
    sure with a sure word before it ('cookie-notice'). 'share-price' is no sharing, and 'has-sidebar' or 'comments-open' tell of a state.
    """
    found = ""
    for token in name.split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        while len(parts) > 1 and (parts[-1] in PIECE or parts[-1].isdigit()):
            parts.pop()
        if parts and (len(parts) == 1 or parts[0] not in STATE):
            if SURE.fullmatch(parts[-1]):
                return "sure"
            if DOUBTFUL.fullmatch(parts[-1]):
                if any(SURE.fullmatch(p) for p in parts):
                    return "sure"
                found = "doubtful"
    return found


def _place(tag: str, attributes: str, above: Place, named: list[Named]) -> Place:
    sure, doubtful, label, root = above.sure, above.doubtful, above.label, above.root
    if attributes.strip() and tag not in ("html", "body"):
        found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)]
        label = label or any(name == "data-main" for name, _ in found)
        if tag not in MAIN:
            # the id of a heading is the name of its section
            meaning = _meaning(" ".join(value for name, value in found if name in ("class", "role") or (name == "id" and tag not in HEADING)).lower())
            if meaning == "sure":
                named.append(sure := Named(sure))
            elif meaning:
                named.append(doubtful := Named(doubtful))
    if tag in MAIN and root is None:
        root = Root(tag, sure, doubtful)
    part = above.part or (tag in PART and not (tag == "header" and above.main))
    return Place(tag, above.silent or tag in SILENT, above.main or tag in MAIN, part, sure, doubtful, root, above.heading or tag in HEADING, label)


def _settle(found: list[Block], roots: list[Root], named: list[Named]) -> None:
    """Names count for what they hold, but not for the article that they wrap.

    The largest article (or main) is the page's own if it has as many words as stand outside articles and names; then a name on an element around it is void.
    """
    free = 0
    for b in found:
        root = b.place.root
        if root is not None and not b.place.part and b.place.sure is root.sure:
            root.words += b.words
        elif root is None and not b.place.part and b.place.sure is None:
            free += b.words
    if roots:
        own = max(roots, key=lambda r: r.words)
        if own.words and own.words >= free:
            for name in (own.sure, own.doubtful):
                while name is not None:
                    name.void, name = True, name.above
    for name in named:  # outer elements come first
        name.counts = not name.void or (name.above is not None and name.above.counts)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Tags may be unclosed or cut off; `br` is white space. The time goes with the page's length."""
    out: list[Block] = []
    named: list[Named] = []
    roots: list[Root] = []
    open_ = _Open()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), open_.top()))
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not open_.top().silent:
            piece = page[at : m.start()]
            text.append(piece)
            if open_.at.get("a"):
                linked += len(piece.split())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[0][:4] != "<!--" and m[0][:2] != "<!":
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
        breaks = tag in BLOCK or tag in SILENT
        if breaks:
            flush()
        if m[2]:
            open_.close(tag, -1 if breaks or not open_.blocks else open_.blocks[-1])
            continue
        if tag == "body":
            open_.close("head")
        if tag in BLOCK:
            open_.close("p", open_.but_p[-1] if open_.but_p else -1)
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                open_.close(tag, max(open_.last(x) for x in ("ul", "ol", "dl", "table", "menu")))
        if tag == "a":
            open_.close("a", open_.blocks[-1] if open_.blocks else -1)
        if tag not in VOID and not m[4].endswith("/"):
            place = _place(tag, m[4], open_.top(), named)
            if place.root is not open_.top().root:
                roots.append(place.root)
            open_.push(place)
    if not open_.top().silent:
        text.append(page[at:])
    flush()
    _settle(out, roots, named)
    return out


def features(found: list[Block]) -> np.ndarray:
    """Rows of ``FEATURES``; before the first and after the last block stand empty ones."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    dense = np.array([0, *(b.linked / b.words for b in found), 0], float)
    has_main = float(any(b.place.main for b in found))
    flags = np.array([(b.place.main, has_main, b.place.part, bool(b.place.sure and b.place.sure.counts), bool(b.place.doubtful and b.place.doubtful.counts), b.place.heading) for b in found], float).reshape(n, 6)
    return np.column_stack([words[1:-1], dense[1:-1], words[:-2], dense[:-2], words[2:], dense[2:], flags])


#: Small labelled pages: what stands in an element with data-main is main text; [n] is a run of n words, {n} one of n linked words.
LABELLED = [
    "<nav><ul><li>{1}</li><li>{2}</li><li>{1}</li></ul></nav><div class=ad>[9]</div><article data-main><h1>[6]</h1><p>[40]</p><p>[3]</p><p>[1]</p><p>[90] {2} [20]</p></article><footer>[14]</footer>",
    "<header><a>{2}</a><p>[5]</p></header><main data-main><h2>[4]</h2><p>[25]</p><ul><li>[6]</li><li>[8]</li></ul><p>[2]</p></main><aside><p>[30]</p><p>{5}</p></aside><footer><p>[25]</p></footer>",
    "<div>{1} {1} {2} {1}</div><div data-main><h1>[7]</h1><p>[60]</p><p>[45]</p><p>[12]</p><p>[70]</p></div><div>{3}</div><div>{4}</div><div>[4]</div>",
    "<div class=menu>{2} {2}</div><div data-main><p>[35]</p><p>[50] {3}</p><p>[28]</p></div><div class=comments><p>[30]</p><p>[22]</p><p>[41]</p></div><div id=footer>[12]</div>",
    "<div class='cookie-notice'>[25]</div><article><div data-main><h1>[5]</h1><p>[33]</p></div><div class='advert'>[12]</div><p data-main>[48]</p><section id=comments><p>[27]</p><p>[9]</p></section></article><form><p>[8]</p></form>",
    "<div class=sidebar><p>[40]</p><p>{6}</p></div><main><article data-main><p>[22]</p><blockquote>[18]</blockquote><p>[5]</p><p>[64]</p></article><aside>[20]</aside><nav>{2} {2}</nav></main>",
    "<p>{3}</p><p>{2}</p><p>[3] {2}</p><div data-main><p>[80]</p><p>[15]</p><p>[95]</p></div><p>{2} {2} {2}</p><p>[6]</p>",
    "<table><tr><td>{1}</td><td>{1}</td></tr></table><div data-main><h2>[3]</h2>[120]<p>[66]</p></div><div class='share social'>[4]</div><div class=related>{8} {7}</div><p>[3]</p>",
    "<article data-main><p>[4]</p></article><footer>[11]</footer>",
    "<nav>{2}</nav><article data-main><p>[2]</p><p>[7]</p><p>{5}</p><p>[3]</p></article><footer>[30]</footer>",
    "<article data-main><h1>[9]</h1><p>[9]</p></article><div class=ad>[60]</div><div class=newsletter><p>[35]</p></div><aside><p>[80]</p></aside><footer><p>[70]</p></footer>",
    "<div>{1}</div><div>{1}</div><div data-main><p>[38]</p><p>[41]</p></div><div>{1}</div><div>[2]</div><div>[5] {4}</div>",
    "<main><div class=banner>[50]</div><p data-main>[6]</p><p data-main>[1]</p><form><label>[3]</label>[20]</form></main><header><h1>[5]</h1></header>",
    "<div>{9}</div><div>{12}</div><div>{25}</div><div data-main><h1>[8]</h1><p>[9]</p><p>[12]</p><p>[25]</p><p>[10] {2}</p></div><div>{14}</div><div>{30}</div><div>{9}</div>",
    "<div>{6} {7} [1]</div><div data-main><p>[7]</p><p>[14] {1}</p><p>[6]</p><p>[30]</p></div><div>{11} [1]</div><div>{20} [2]</div>",
    "<article data-main><div class=article-header><h1>[7]</h1><p>[3]</p></div><p>[30]</p><section id=discussion><h2>[1]</h2><p>[45]</p><p>[5]</p></section><section id=legal-notice><p>[12]</p></section></article><footer>[9]</footer>",
    "<article><div data-main><h1>[4]</h1><p>[50]</p><div class=related-work><p>[20]</p><p>[9] {1}</p></div></div><div class=related>{4}</div><div class=related>{7}</div><div class=social>{2}</div><div class=recommended>{9} [1]</div></article>",
    "<article><div data-main><p>[6]</p><p>{4}</p><p>{12}</p><p>[1] {3}</p></div><div class=related><ul><li>{3}</li><li>{6}</li><li>{12}</li></ul></div><div class=search-results>{5}</div></article><div class=notice>[20]</div><div class=header>[6]</div>",
    "<div class=header>[12]</div><div class=alert>[30]</div><main data-main><p>[12]</p><div class=response><p>[30]</p></div><p>[3]</p></main><div class=legal>[25]</div><div class=copyright>[7]</div>",
    "<article><p data-main>[20]</p><aside><p>{5}</p><p>{9}</p></aside><p data-main>{6}</p><div class=comments><p>{2}</p><p>{7}</p><p>[9] {9}</p></div><div class=ad>{8}</div><nav>{3} {2}</nav><form>{4}</form><footer>{6}</footer></article>",
    "<nav>{2}</nav><article data-main><h1>[4]</h1><p>[30]</p><p>[5]</p></article>", "<article data-main><p>[12]</p></article>", "<main data-main><p>[40]</p><p>[2] {3}</p></main>", "<header>{3}</header><main data-main><p>[15]</p><p>{3}</p></main>",
    "<article data-main><p>[20]</p><p>{6}</p><p>[9]</p></article>", "<nav>{3}</nav><article data-main><p>{5}</p><p>[8]</p><p>{6}</p><p>[7]</p><p>{4} [1]</p><p>[12]</p></article><footer>[8]</footer>", "<main data-main><p>[9]</p><ul><li>{5}</li><li>[6]</li><li>{4}</li></ul><p>[11]</p></main>",
    "<article><p data-main>[30]</p><div class=comments>{4}</div><p data-main>[9]</p><div class=ad>{5}</div><p data-main>[12]</p><div class=share>{3}</div><p data-main>[15]</p><div class=related>{6}</div><p data-main>[7]</p></article>",
    "<article><h1 data-main>[5]</h1><div class=ad>{4}</div><p data-main>[30]</p><p data-main>{5}</p><div class=newsletter>{3}</div><div class=related>{5}</div><p data-main>[30]</p><div class=sidebar>{7}</div></article><footer>[6]</footer>",
    "<div>{4}</div><div data-main><p>[20]</p><p>[40]</p></div>", "<div>{3} {4}</div><div>{5}</div><div data-main><p>[33]</p><p>[9]</p><p>[14]</p></div>", "<p data-main>[30]</p>", "<div data-main><h1>[6]</h1><p>[25]</p><p>[12]</p></div>",
    "<article><div data-main><h1>[4]</h1><p>[30]</p><div class=menu><p>[20]</p><p>[9]</p></div><p>[12]</p></div><div class=menu>{3} {2}</div></article><div class=menu>{4} {2}</div>",
    "<div class=menu>{2} {3}</div><article data-main><h1>[3]</h1><div class=menu><h2>[2]</h2><p>[11]</p><p>[25]</p></div><p>[40]</p></article><div class=menu><ul><li>{1}</li><li>{2}</li></ul></div>",
    "<div class=header>{3} [2]</div><div class=notice>[18]</div><div data-main><p>[18]</p><p>[40]</p><p>[11]</p></div><div class=related>[8] {6}</div><div class=disclaimer>[35]</div>",
]


@dataclass(frozen=True)
class Node:
    keep: bool
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 10) -> Node:
    """A decision tree by the Gini index; thresholds are middles of neighbouring values."""
    keep = bool(y.mean() >= 0.5)
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return Node(keep)
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if least <= low.sum() <= len(y) - least:
                cost = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
                if cost < best[0]:
                    best = (cost, f, float(t))
    if best[1] < 0:
        return Node(keep)
    low = x[:, best[1]] <= best[2]
    return Node(keep, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree: Node, row: np.ndarray) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.threshold else tree.high
    return tree.keep


def train(pages: list[str] | None = None, copies: int = 12, seed: int = 2) -> Node:
    """The tree from labelled pages (``LABELLED`` unless given), each several times with other numbers of words, so that sizes count only where they tell."""
    rng = random.Random(seed)
    rows, labels = [], []
    for page in LABELLED if pages is None else pages:
        for copy in range(copies):
            size = lambda n: int(n) if not copy else max(1, round(int(n) * rng.choice([0.1, 0.3, 0.6, 1, 1.5, 3])))  # noqa: B023, E731
            made = re.sub(r"\{(\d+)\}", lambda m: f"<a>{'word ' * size(m[1])}</a>", re.sub(r"\[(\d+)\]", lambda m: "word " * size(m[1]), page))  # noqa: B023
            found = blocks(f"<body>{made}</body>")
            rows.append(features(found))
            labels.extend(b.place.label for b in found)
    return grow(np.vstack(rows), np.array(labels))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract_main_text(pages: DataFrame, html_col: str = "html", training_pages: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text`` (the main blocks of the whole page, joined by an empty line) and ``n_chars``; without the html.

    A null, empty or wholly unreadable page has an empty text. Each row stands for itself, so repeated rows repeat; pages are read whole, in time that goes with
    their length; an empty table stays empty. Columns named ``text`` or ``n_chars`` are replaced.
    """
    tree = train(training_pages)
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])

    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest]
    return pages.select(*rest, html_col).mapInArrow(each, ", ".join([*fields, "text string"])).withColumn("n_chars", F.length("text").cast("long"))
