"""Operator 12: main text of web pages by minimum-cut labelling of their text blocks.

A page is split into text blocks at the bounds of its block elements. A
classifier scores each block as content or boilerplate: a logistic model of the
block's words, links and kind, plus fixed scores of the elements around it.
The scores are the capacities from the source and to the sink; blocks next to
each other, and blocks of one parent element, are joined by smoothness edges,
stronger the closer they are in the document tree. The maximum flow's minimum
cut tells content from boilerplate. Blocks whose own capacity outweighs all
their edges are decided first and passed on to their neighbours, which leaves
the cut as it is, so the flow runs over the few doubtful blocks alone.

The logistic model is trained here: on the blocks of ``FIT_PAGES`` pages at
most (those of least hash), labelled by the elements around them where these
are plain, as counts of rounded features; a Gaussian prior around
``START_WEIGHTS`` holds it where there are few.

Defined cases: null and empty html, and pages without text, have an empty text;
markup that ends within a tag, comment, script or style loses that part alone;
white space (Unicode's) inside a block becomes one space; rows are returned as
often as they come, whatever their id; an empty table gives an empty result;
only the id, url and html columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices, texts_of

FIT_PAGES = 2000
#: Weights before training, of: constant, log2 of the words, share of linked characters, sentence end, heading, list item.
START_WEIGHTS = (-1.0, 0.6, -4.0, 0.8, 0.5, -0.5)
PRIOR_PRECISION, NEWTON_STEPS = 10.0, 25
#: The text's score is held within this, so that plain elements decide.
TEXT_LIMIT = 3.0
#: Capacities are integers: a score of 1 is this much.
UNIT = 100
#: Smoothness between neighbours with one parent, with one grandparent, and others; and between further children of a parent.
SAME_PARENT, SAME_GRANDPARENT, NEAR, SIBLING = 60, 30, 10, 30

# ---- fixed scores of elements (own choice) ----
TAG_SCORES = {"article": 4.0, "main": 3.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0,
              "noscript": -12.0, "button": -12.0, "select": -12.0, "header": -12.0, "head": -20.0, "svg": -20.0, "template": -20.0, "object": -12.0}
GOOD_NAMES = frozenset("article content entry post story main prose".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead header footer sidebar aside widget related recommended recommendations comment comments commentlist disqus reply replies respond "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social pagination pager toolbar copyright legal hidden search form skip teaser teasers".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
GOOD_NAME_SCORE, BAD_NAME_SCORE, OUTSIDE_SCORE = 2.0, -12.0, -6.0
#: Scores beyond which the elements around a block label it for training.
CONTENT_LABEL, BOILERPLATE_LABEL = 2.0, -6.0

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small span "
                   "strike strong sub sup time tt u var wbr nobr blink output".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that opens ends an open one of these, unless one of the bounds is nearer.
IMPLIED_ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select"}),
                "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}
SCOPE = frozenset("table td th caption html template button object".split())

_MARKUP = re.compile(r"<(?:(!--)|([!?]|/(?=[^a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*))")
_COMMENT_END = re.compile(r"--!?>")
_REST_OF_TAG = re.compile(r"((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>")
_ATTRIBUTE = re.compile(r"([a-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Text blocks of a page and the elements around them."""

    def __init__(self, html: str):
        self.parent, self.tag, self.name_score = [-1], ["#root"], [0.0]
        self.block_level = [True]
        self.texts: list[str] = []
        self.element: list[int] = []  # the nearest block element of each text
        self.linked: list[int] = []
        self.stack, self.open = [0], Counter()
        self.pieces, self.at, self.links, self.in_link = [], 0, 0, 0
        self._read(html)
        self._end_block()

    # -- building --
    def _text(self, raw: str) -> None:
        if "&" in raw:
            raw = unescape(raw)
        if not raw or (not self.pieces and raw.isspace()):
            return
        if not self.pieces:
            self.at = next(e for e in reversed(self.stack) if self.block_level[e])
        self.pieces.append(raw)
        if self.in_link:
            self.links += len(raw)

    def _end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.texts.append(text)
                self.element.append(self.at)
                self.linked.append(self.links)
        self.pieces, self.links = [], 0

    def _pop_to(self, depth: int) -> None:
        """Close the elements from ``depth`` of the stack on."""
        gone = self.stack[depth:]
        if any(self.block_level[e] for e in gone):
            self._end_block()
        for e in gone:
            self.open[self.tag[e]] -= 1
            if self.tag[e] == "a":
                self.in_link -= 1
        del self.stack[depth:]

    def _find(self, tags, bounds) -> int:
        """Depth of the innermost open element of ``tags`` that no element of ``bounds`` hides, or 0."""
        if not any(self.open[t] for t in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[depth]]
            if t in tags:
                return depth
            if t in bounds:
                return 0
        return 0

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            if self.pieces:
                self.pieces.append(" ")
            return
        if tag in ("html", "body"):
            if self.open["head"]:
                self._pop_to(self._find(("head",), ()))
            self._end_block()
            return
        names, bad = 0.0, False
        if "=" in rest or "hidden" in rest:
            names, bad = name_score(rest)
        inline = tag in INLINE and not bad
        if not inline:
            if self.open["head"] and tag in CLOSES_P:
                self._pop_to(self._find(("head",), ()))
            self._end_block()
            if tag in CLOSES_P and (d := self._find(("p",), SCOPE)):
                self._pop_to(d)
            if tag in IMPLIED_ENDS:
                tags, bounds = IMPLIED_ENDS[tag]
                if d := self._find(tags.split(), bounds):
                    self._pop_to(d)
        if tag in VOID:
            return
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.name_score.append(names)
        self.block_level.append(not inline)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1
        self.in_link += tag == "a"

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        if not self.open[tag]:
            return
        if tag in INLINE:  # an inline end does not close the block around it
            for depth in range(len(self.stack) - 1, 0, -1):
                e = self.stack[depth]
                if self.tag[e] == tag:
                    self._pop_to(depth)
                    return
                if self.tag[e] not in INLINE:
                    return
        elif d := self._find((tag,), {"ul", "ol"} if tag == "li" else SCOPE - {tag}):
            self._pop_to(d)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _MARKUP.search(html, at)
            if not m:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at:m.start()])
            comment, bogus, closing, tag = m.groups()
            if comment:
                end = _COMMENT_END.search(html, m.end() - 2)
            elif bogus:
                end = re.compile(">").search(html, m.end())
            else:
                end = _REST_OF_TAG.match(html, m.end())
            if not end:  # the page ends within markup
                return
            at = end.end()
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag in RAW:
                close = _RAW_ENDS[tag].search(html, at)
                if not close:
                    return
                at = close.start()
                if tag not in ("script", "style"):
                    self._end_block()
            elif tag == "plaintext":
                continue
            else:
                self._start(tag, end.group(1))

    # -- scores --
    def element_scores(self) -> np.ndarray:
        """Summed scores of the elements around each element, its own included."""
        holds = [False] * len(self.tag)  # an article lies in it: then its names tell nothing about the article
        own_article = [False] * len(self.tag)
        for e, t in enumerate(self.tag):
            if t in ("article", "main") and self.name_score[e] >= 0:
                own_article[e] = True
                up = self.parent[e]
                while up >= 0 and not holds[up]:
                    holds[up] = True
                    up = self.parent[up]
        has_article = any(own_article)
        words, main_heading = [0] * len(self.tag), [t == "h1" for t in self.tag]
        for text, e in zip(self.texts, self.element):
            words[e] += 1 + text.count(" ")
        for e in range(len(self.tag) - 1, 0, -1):
            words[self.parent[e]] += words[e]
            main_heading[self.parent[e]] |= main_heading[e]
        for e in range(1, len(self.tag)):  # a wrapper of the main heading and most of the words is not what its names say
            holds[e] |= main_heading[e] and 2 * words[e] > words[0]
        score, inside = [0.0] * len(self.tag), [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            up, t = self.parent[e], self.tag[e]
            inside[e] = inside[up] or own_article[e]
            of_tag = TAG_SCORES.get(t, 0.0)
            if t in ("article", "main") and inside[up]:
                of_tag = 0.0  # counted once
            if t == "header" and inside[up]:
                of_tag = 0.0  # an article's own heading
            of_names = self.name_score[e]
            if holds[e] and of_names < 0:
                of_names = 0.0
            score[e] = max(-20.0, score[up] + of_tag + of_names)
        if has_article:
            score = [s if i else s + OUTSIDE_SCORE for s, i in zip(score, inside)]
        return np.array(score)

    def features(self) -> np.ndarray:
        """Rounded features of each block, in the order of START_WEIGHTS."""
        out = np.ones((len(self.texts), len(START_WEIGHTS)))
        for k, (text, e, linked) in enumerate(zip(self.texts, self.element, self.linked)):
            tag = self.tag[e]
            out[k, 1:] = ((1 + text.count(" ")).bit_length(), min(10, 10 * linked // max(1, len(text))) / 10,
                          text[-1] in ".!?…:;", tag in HEADINGS, tag == "li")
        return out

    def edges(self) -> list[tuple[int, int, int]]:
        """(block, block, capacity): neighbours, and following blocks of one parent element."""
        out, last = [], {}
        for k, e in enumerate(self.element):
            up = self.parent[e]
            if k:
                f = self.element[k - 1]
                near = SAME_PARENT if up == self.parent[f] or e == f else SAME_GRANDPARENT if self.parent[up] == self.parent[self.parent[f]] else NEAR
                out.append((k - 1, k, near))
                if last.get(up, k - 1) != k - 1:
                    out.append((last[up], k, SIBLING))
            last[up] = k
        return out


def name_score(attributes: str) -> tuple[float, bool]:
    """Score of an element's class, id and role, and whether it is boilerplate by them."""
    score, bad = 0.0, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            words = {w.lower() for w in _NAMES.findall(value)}
            bad |= not words.isdisjoint(BAD_NAMES)
            if not words.isdisjoint(GOOD_NAMES):
                score = GOOD_NAME_SCORE
        elif name == "role":
            bad |= value.lower() in BAD_ROLES
            if value.lower() in ("main", "article"):
                score = GOOD_NAME_SCORE
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            bad = True
        elif name == "style":
            bad |= bool(_HIDDEN_STYLE.search(value))
    return (BAD_NAME_SCORE, True) if bad else (score, False)


def minimum_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut.

    ``terminal`` is a node's capacity from the source, or to the sink if negative;
    ``edges`` (node, node, capacity) hold both ways.
    """
    n = len(terminal)
    t, near = list(terminal), [Counter() for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] += c
            near[b][a] += c
    weight = [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node that outweighs its edges is decided, and becomes part of its neighbours' capacities
        v = todo.popleft()
        if side[v] is not None or abs(t[v]) < weight[v]:
            continue
        side[v] = t[v] > 0
        for u, c in near[v].items():
            if side[u] is None:
                t[u] += c if side[v] else -c
                weight[u] -= c
                del near[u][v]
                todo.append(u)
    rest = [v for v in range(n) if side[v] is None]
    if rest:
        number = {v: i for i, v in enumerate(rest)}
        reached = _max_flow([t[v] for v in rest], [(number[v], number[u], c) for v in rest for u, c in near[v].items() if v < u])
        for v, r in zip(rest, reached):
            side[v] = r
    return side


def _max_flow(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's maximum flow; which nodes the source still reaches."""
    n = len(terminal)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, forth: int, back: int) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)

    for v, t in enumerate(terminal):
        join(source, v, max(t, 0), 0) if t > 0 else join(v, sink, -t, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[cut] ^ 1]
                del path[cut:]
            while turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(head[v]):
                path.append(e)
                v = to[e]
            elif path:
                v = to[path.pop() ^ 1]
                turn[v] += 1
            else:
                break


def main_text(html: str, weights: np.ndarray) -> str:
    page = Page(html)
    if not page.texts:
        return ""
    around = page.element_scores()[page.element]
    score = np.clip(page.features() @ weights, -TEXT_LIMIT, TEXT_LIMIT) + around
    keep = minimum_cut(np.rint(score * UNIT).astype(int).tolist(), page.edges())
    return " ".join(t for t, k in zip(page.texts, keep) if k)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (label, features) of the blocks that the elements around them label."""
    for b in slices(batches):
        found: Counter = Counter()
        for html in texts_of(b.column(0)):
            page = Page(html.decode())
            if page.texts:
                around = page.element_scores()[page.element]
                for s, x in zip(around.tolist(), page.features().tolist()):
                    if s >= CONTENT_LABEL or s <= BOILERPLATE_LABEL:
                        found[(s > 0, *x[1:])] += 1
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.bool_()), *(pa.array([float(k[c]) for k, _ in rows], pa.float64()) for c in range(1, len(START_WEIGHTS))),
             pa.array([c for _, c in rows], pa.int64())], names=["content", *(f"x{c}" for c in range(1, len(START_WEIGHTS))), "n"])


def train(rows: list[tuple]) -> np.ndarray:
    """Logistic weights by Newton steps from ``(content, x1 .., n)``, with a Gaussian prior around START_WEIGHTS."""
    start = np.array(START_WEIGHTS)
    if not rows:
        return start
    table = np.array(sorted(rows), float)
    y, n = table[:, 0], table[:, -1]
    x = np.column_stack([np.ones(len(table)), table[:, 1:-1]])
    w = start.copy()
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - PRIOR_PRECISION * (w - start)
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + PRIOR_PRECISION * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curvature, gradient), -1, 1)
    return w


def fit_classifier(pages: DataFrame, html_col: str = "html", key_cols: tuple[str, ...] = ("page_id", "url"), fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights of the text score, from at most ``fit_pages`` pages; the driver gets counts of rounded features alone."""
    key = F.xxhash64(*key_cols)
    few = pages.select(key.alias("k")).orderBy("k").limit(fit_pages).agg(F.max("k").alias("k")).first().k
    if few is None:
        return np.array(START_WEIGHTS)
    names = [f"x{c}" for c in range(1, len(START_WEIGHTS))]
    sample = pages.where(key <= few).limit(fit_pages).select(html_col)
    rows = (sample.mapInArrow(_training_rows, "content boolean, " + ", ".join(f"{c} double" for c in names) + ", n long")
            .groupBy("content", *names).agg(F.sum("n").alias("n")).collect())
    return train([tuple(r) for r in rows])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page."""
    from pyspark.sql.pandas.types import to_arrow_type

    if weights is None:
        weights = fit_classifier(pages, html_col, (id_col, url_col))
    kinds = [pages.schema[c].dataType for c in (id_col, url_col)]
    schema = pa.schema([(id_col, to_arrow_type(kinds[0])), (url_col, to_arrow_type(kinds[1])), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h.decode(), weights) for h in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             schema=schema)

    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kinds[0].simpleString()}, `{url_col}` {kinds[1].simpleString()}, text string, n_chars long")


def op12_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
