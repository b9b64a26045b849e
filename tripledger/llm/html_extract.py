"""Main text of web pages by a minimum cut between article and boilerplate.

A page becomes a row of text blocks with the elements that hold them. A classifier gives each block log-odds of being
article text, which become its capacities to the two terminals; blocks next to each other on the page, and blocks with
the same parent, are tied by smoothness edges that weaken with their distance in the tree. Log-odds and ties are of one
scale, so the minimum cut, which labels all blocks at once, keeps a short line amid an article and drops a long line amid links.

The classifier's weights are learnt from all pages of the table, without labels: what authors put in ``article`` or ``main``
elements against what they put in ``nav``, ``footer`` and the like shows how text, links and names differ. The counts
behind it are those of a grid of coarse features, so they are bounded however many pages there are. Where pages show
little, the weights stay near their start values.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*>|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
HINTS = re.compile(r"""\s(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# How elements of the HTML standard are laid out, and names that sites give to their parts.
RAW = frozenset({"script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
UNSEEN = frozenset({"head", "noscript", "template", "svg", "math", "canvas", "object", "select", "button", "datalist", "dialog", "audio", "video"})
IN_HEAD = frozenset({"base", "link", "meta", "noscript", "script", "style", "template", "title"})
BOILER = frozenset({"nav", "header", "footer", "aside", "menu", "search"})
HEADING = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BLOCK = HEADING | BOILER | frozenset({
    "html", "body", "p", "div", "article", "main", "section", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot",
    "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "legend", "center", "hgroup", "form", "hr",
})
ENDS_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ENDS_WITH = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
LAYOUT_HINTS = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended",
    "sidebar", "aside", "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "breadcrumb", "breadcrumbs", "popup", "modal", "overlay", "widget",
    "login", "search", "pagination", "pager", "toolbar", "tags", "copyright", "contentinfo", "complementary", "skip", "legal", "disclaimer", "paywall", "dialog",
})
READER_HINTS = frozenset({"comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reactions"})
ARTICLE_HINTS = frozenset({"article", "content", "main", "post", "entry", "story", "body", "text", "prose"})
#: A name that begins so tells of a state or a neighbour, not of what the element is; what follows "with" likewise.
STATE = frozenset({"has", "no", "not", "is", "with", "without", "hide", "hidden", "show", "can", "js"})

#: Start values of the classifier's weights, as log-odds: constant, length, links, sentence, paragraph, heading, names for layout, names for articles.
START = np.array([-1.2, 0.8, -4.0, 0.8, 0.8, 0.6, -4.5, 1.5])
#: How firmly the weights stay at their start: as if so many blocks had shown them.
FIRMNESS = 20.0
#: What the place of a block adds: inside an article element; outside, where the page has one; in a nav, footer or the like.
INSIDE, OUTSIDE, BOILERPLATE = 2.0, -3.5, -5.0
#: Bounds of log-odds before the place is added, and the smoothness of blocks side by side under one parent; under others it is divided by their distance in the tree.
MOST, TIE = 2.5, 0.9
#: A name for layout counts for nothing on an element that holds more than this share of the page's text outside links.
BULK = 0.6


class Element:
    __slots__ = ("tag", "parent", "depth", "unseen", "boiler", "reader", "article", "hint", "form", "mass", "holds_article")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.unseen = bool(parent and parent.unseen)
        self.boiler = bool(parent and parent.boiler)  # in a nav, footer or the like
        self.reader = bool(parent and parent.reader)
        self.article = bool(parent and parent.article)
        self.form = bool(parent and parent.form)
        self.hint = 0  # -1: a name for layout, 1: one for articles, 2: both
        self.mass = 0
        self.holds_article = False


def names_in(source: str) -> Iterator[list[str]]:
    """The words of each class, id and role of a tag that says what the element is."""
    for m in HINTS.finditer(source):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORDS.findall(name)]
            if words and words[0] not in STATE:
                yield words[: words.index("with")] if "with" in words else words


def opened(tag: str, source: str, parent: Element | None) -> Element:
    e = Element(tag, parent)
    layout = article = reader = False
    if len(source) > len(tag) + 2:
        for words in names_in(source):
            # The first word or the last says what the thing is: cookie-bar, site-footer.
            ends = {words[0], words[-1]}
            reader |= bool(ends & READER_HINTS)
            layout |= bool(ends & LAYOUT_HINTS)
            article |= bool(ends & ARTICLE_HINTS) and not ends & (LAYOUT_HINTS | READER_HINTS)
        if HIDDEN.search(source):
            e.unseen = True
    if tag in UNSEEN:
        e.unseen = True
    if tag in ("html", "body"):
        return e
    e.hint = 2 if layout and article else -1 if layout else 1 if article else 0
    if reader and not article:
        e.reader = True
    if tag in BOILER and not (tag == "header" and e.article):
        e.boiler = True
    elif tag in ("article", "main") and not e.reader and not e.boiler:
        e.article = True
        while parent is not None and not parent.holds_article:
            parent.holds_article = True
            parent = parent.parent
    return e


def beside_control(e: Element) -> None:
    """What stands beside a control is its caption, and so is all in the smallest element around both; an article or a section is no such element."""
    while e.parent is not None and e.tag not in ("form", "article", "main", "section", "body"):
        e.form = True
        if e.tag not in ("p", "li", "td", "span"):
            return
        e = e.parent


class Block:
    __slots__ = ("text", "of", "linked", "teaser")

    def __init__(self, text: str, of: Element, linked: int):
        self.text, self.of, self.linked = text, of, linked
        self.teaser = False  # of an article in a part named for layout, beside a larger one


def blocks(page: str) -> list[Block]:
    """The visible text blocks in page order."""
    found: list[Block] = []
    top = Element("", None)
    at = top
    parts: list[str] = []
    linked = 0
    links = 0  # open anchors

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, at, linked))
            parts, linked = [], 0

    position, size = 0, len(page)
    while position < size:
        m = TOKEN.match(page, position)
        token = m.group()
        position = m.end()
        if token[0] != "<" or len(token) == 1:
            if at.tag == "head" and not token.isspace():  # text ends a head that was left open
                at = at.parent
            if not at.unseen:
                text = html.unescape(token) if "&" in token else token
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        name = NAME.match(token)
        if not name:  # a comment or a declaration
            continue
        tag = name[1].lower()
        if at.tag == "head" and token[1] != "/" and tag not in IN_HEAD:  # and so does an element of the body
            end_block()
            at = at.parent
        if token[1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in UNSEEN:
                e = at
                while e is not top and e.tag != tag:
                    e = e.parent
                if e is not top:
                    end_block()
                    at = e.parent
                elif tag == "p":
                    end_block()
            continue
        if tag in ("select", "textarea"):
            beside_control(at)
        if tag in RAW:
            if not token.endswith("/>"):
                end = re.compile(rf"</{tag}(?=[\s>/])", re.I).search(page, position)
                position = end.start() if end else size
                close = page.find(">", position)
                position = close + 1 if end and close >= 0 else size
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            end_block()
        elif tag in VOID:
            if tag == "input":
                beside_control(at)
        elif tag in BLOCK or tag in UNSEEN:
            end_block()
            if tag in BLOCK:
                if at.tag in HEADING and tag in HEADING:
                    at = at.parent
                e = at
                while e is not top and e.tag != "p" and e.tag not in BLOCK - {"p"}:
                    e = e.parent
                if e.tag == "p":  # a block ends an open paragraph
                    at = e.parent
                if tag in ENDS_ITSELF:
                    e = at
                    while e is not top and e.tag not in ENDS_ITSELF[tag]:
                        if e.tag in ENDS_WITH.get(tag, (tag,)):
                            at = e.parent
                            break
                        e = e.parent
            if not token.endswith("/>") or tag in BLOCK:
                at = opened(tag, token, at)
            links = 0 if tag in ("article", "main", "section", "body") else links
        elif HIDDEN.search(token) and not token.endswith("/>"):  # a hidden inline element
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            if close:
                position = close.end()
    end_block()
    for b in found:
        plain, e = len(b.text) - b.linked, b.of
        while e is not None:
            e.mass += plain
            e = e.parent
    mark_teasers(found)
    return found


def mark_teasers(found: list[Block]) -> None:
    """An article inside an element named for layout is a teaser where another one, not in that element, is larger than all that it holds."""
    around = [list(_up(b.of)) for b in found]
    largest = max((e.mass for chain in around for e in chain if e.tag in ("article", "main")), default=0)
    for b, chain in zip(found, around):
        inner = False
        for e in chain:
            b.teaser |= inner and e.hint == -1 and e.mass < largest
            inner |= e.tag == "article"


def _up(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def form_text(e: Element) -> bool:
    """Whether a block under e belongs to a form: beside a control, or right in a form that is no wrapper of the page."""
    if e.form:
        return True
    while e is not None and e.tag != "form":
        if e.tag in ("article", "main", "p", "blockquote") or e.hint in (1, 2):
            return False
        e = e.parent
    return e is not None


def name_hint(e: Element | None, whole: int) -> int:
    """What the names of the nearest named element say: -1 for layout, 1 for article, 0 for nothing.

    An element that holds most of the page's text, or an article element, is no piece of layout whatever its name.
    """
    inner = None
    while e is not None:
        if e.tag in ("article", "main"):
            return 0
        bulk = e.mass > BULK * whole or e.holds_article
        if e.hint == 1 or (e.hint == 2 and bulk):
            return 1
        if e.hint and not bulk:
            return -1
        inner, e = e, e.parent
    return 0


#: Steps of the grid of features: length by powers of two, links by quarters.
Features = tuple[int, int, bool, bool, bool, int]


def features(b: Block, whole: int) -> Features:
    n = len(b.text)
    length = min(10, int(2 * math.log2(1 + n / 25)))
    sentence = b.text[-1] in ".!?…。！？\"”’)" and " " in b.text
    return length, min(4, round(4 * b.linked / n)), sentence, b.of.tag in ("p", "blockquote", "pre"), b.of.tag in HEADING, name_hint(b.of, whole)


def numbers(f: Features) -> np.ndarray:
    length, links, sentence, paragraph, heading, hint = f
    return np.array([1.0, length / 4, links / 4, sentence, paragraph, heading, hint < 0, hint > 0])


def learnt(grid: dict[tuple[Features, bool], int]) -> np.ndarray:
    """Weights by penalised logistic regression on the grid's counts; both labels weigh the same, ``1000`` blocks at most."""
    totals = [sum(n for (_, k), n in grid.items() if k == want) for want in (False, True)]
    if not all(totals):
        return START
    keys = sorted(grid)
    x, y = np.stack([numbers(f) for f, _ in keys]), np.array([k for _, k in keys], float)
    n = np.array([grid[k] / totals[k[1]] * min(1000, *totals) for k in keys])
    w = START.copy()
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + FIRMNESS * (w - START)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(w)), slope)
        w = w - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    # Signs that no counting may turn round: links and names for layout speak against a block, length for it.
    return np.round(np.where(np.sign(START) * w > 0, w, 0.0), 6)


def shown(found: list[Block]) -> Iterator[tuple[Features, bool]]:
    """The blocks whose label the author's elements show, with their features."""
    whole = sum(len(b.text) - b.linked for b in found)
    for b in found:
        if b.of.article and not b.of.reader and not b.of.boiler and not b.teaser:
            yield features(b, whole), True
        elif b.of.boiler:
            yield features(b, whole), False


def score(b: Block, whole: int, has_article: bool, weights: np.ndarray) -> float:
    """Log-odds that the block is article text."""
    e = b.of
    f = features(b, whole)
    s = float(np.clip(numbers(f) @ weights, -MOST, MOST))
    if b.teaser:
        return min(s, 0.0) - MOST + OUTSIDE
    if f[-1] < 0:
        s = min(s, 0.0) - MOST
    if e.boiler or e.reader or form_text(e):
        return s + BOILERPLATE
    return s + (INSIDE if e.article else OUTSIDE if has_article else 0.0)


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def minimum_cut(scores: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """True for the blocks on the article's side.

    A block whose terminal capacity is above all its ties together is on that terminal's side in every minimum
    cut; such blocks are settled first and their ties become capacities of their neighbours. What is left is cut
    by augmenting shortest paths.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in ties.items():
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    pull, side = list(scores), [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and abs(pull[i]) >= sum(near[i].values()):
            side[i] = pull[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                if side[j] is None:
                    pull[j] += c if side[i] else -c
                    waiting.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return side
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        a, b = (source, i) if pull[i] > 0 else (i, sink)
        room[a][b] = abs(pull[i])
        room[b].setdefault(a, 0.0)
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow
    for i in rest:
        side[i] = i in came
    return side


def ties_of(found: list[Block]) -> dict[tuple[int, int], float]:
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        parent = id(b.of.parent or b.of)
        if i:
            ties[i - 1, i] = TIE / max(1, distance(found[i - 1].of, b.of) - 1)
        if parent in last and last[parent] != i - 1:
            ties[last[parent], i] = TIE / 2
        last[parent] = i
    return ties


def labelled(found: list[Block], weights: np.ndarray = START) -> tuple[list[float], dict[tuple[int, int], float], list[bool]]:
    """A page's log-odds, ties, and the side of each block."""
    whole = sum(len(b.text) - b.linked for b in found)
    has_article = any(b.of.article and not b.of.reader for b in found)
    scores, ties = [score(b, whole, has_article, weights) for b in found], ties_of(found)
    return scores, ties, minimum_cut(scores, ties)


def main_text(page: str | None, weights: np.ndarray = START) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, kept in zip(found, labelled(found, weights)[2]) if kept)


GRID = "length int, links int, sentence boolean, paragraph boolean, heading boolean, hint int, label boolean"


def weights_for(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """The classifier's weights from all pages; at most some 2,000 cells of the grid come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                grid.update(shown(blocks(page.as_py() or "")))
        rows = [(*f, k, n) for (f, k), n in grid.items()]
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64()]
        names = ["length", "links", "sentence", "paragraph", "heading", "hint", "label", "n"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    cells = pages.select(F.col(html_col).alias("html")).mapInArrow(run, GRID + ", n bigint")
    got = cells.groupBy(*[c.split()[0] for c in GRID.split(", ")]).agg(F.sum("n").alias("n")).collect()
    return learnt({(tuple(r)[:6], r["label"]): r["n"] for r in got})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text, empty where a page has none.

    Null html counts as empty. Null and repeated identifiers pass through, a row each; an empty input gives an
    empty result; other columns play no part. Blocks are joined by one line feed; inside a block white space is one space.
    The pages are read twice: once for the classifier's counts, once for the texts.
    """
    weights = weights_for(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(page.as_py(), weights) for page in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")


def op5(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
