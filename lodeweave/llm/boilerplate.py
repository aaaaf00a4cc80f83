"""Main body and page furniture, by a tree-structured graphical model of each page.

A page is a tree.  Where its HTML is given, the inner nodes are the DOM's elements, to which the lines of its text are
aligned; otherwise there is one page node.  Below them stand blocks (lines between blank lines, parted again where
running text and short lines meet) and their lines.  Every node is main body or furniture.  Lines carry evidence from a
log-linear model of their words, form, surroundings and elements; edges carry parent-child potentials.  Sum-product
messages pass upward and downward once, which on a tree gives the exact marginal of every line.

Evidence and potentials are trained on a bounded sample of at most ``max_pages`` pages of each table, taken by the hash
of their id.  Their lines are labelled by sure signs: running text and the title are body, as are
short lines that mostly stand over running text wherever they stand; those that stand word for word, numbers and site
names aside, on several sites otherwise, menus, and lines that a word model of labelled examples (see furniture) is
sure of, are furniture.  Lines of any length give evidence and can be either.

Defined cases: null and blank texts have no lines; rows with a null id are left out; a repeated row gives its lines once;
a page of any length is read whole; broken HTML is read as well as can be, and lines it does not hold hang on the page
node; if no page can be labelled the untrained model keeps every line as main body.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.dom import BLOCKS, Node, parse as parse_html
from . import furniture, notices
from .common import map_batches
from .furniture import MENU

BUCKETS = 1 << 14  # of hashed words and word pairs
MAX_LINES = 4000  # of running text that train the word model
LONG = 13  # words from which a line counts as running text

_SEPARATED = re.compile(r"^[^|›»·•]{1,30}(?:\s+[|›»·•]\s+[^|›»·•]{1,30})+$")
_BYLINE = re.compile(r"^(?:by|par|von|por|автор|글|文)\s*:?\s+[A-ZÀ-ÝА-Я]|^(?:updated|published|posted|mis à jour|publié|aktualisiert|veröffentlicht|actualizado|publicado|обновлено)\b.{0,40}\d", re.I)
_STOP = re.compile(r"[.!?。！？…][\"”’»)]*\s*$")
_EAST = re.compile("[぀-鿿가-힣]")
_BULLET = re.compile(r"^(?:[-*•·+]|\d{1,3}[.)])\s+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[|›»>©:@]")


def size_of(line: str) -> int:
    """Number of words; scripts that use few spaces count by characters."""
    n = line.count(" ") + 1
    if line.isascii():
        return n
    return max(n, len(_EAST.findall(line)) // 4)


def is_running(line: str, n: int) -> bool:
    return n >= LONG or (n >= 7 and _STOP.search(line) is not None)


@functools.cache
def bare_model() -> notices.WordModel:
    """Furniture against body lines and prose, by the labelled examples alone."""
    return notices.train([], furniture.EXAMPLES, (*furniture.BODY, *notices.PROSE))


def word_model(lines: list[str]) -> notices.WordModel:
    """The same, with at most MAX_LINES lines of running text of the sample, taken by their hash, as further prose, but
    for what the examples are sure of."""
    bare = bare_model()
    some = sorted((x for x in set(lines) if size_of(x) >= LONG), key=lambda x: (crc32(x.encode()), x))[:MAX_LINES]
    return notices.train([x for x in some if bare(x) < 2.0], furniture.EXAMPLES, (*furniture.BODY, *notices.PROSE))


def seed_label(line: str, title: str, followed: bool, habit: int | None = None, words_of: notices.WordModel | None = None) -> int | None:
    """1: main body, 0: furniture, by sure signs only; None: not sure.

    followed: running text comes next; habit: how a line that stands on several pages stands there (see habits).
    """
    body = _BULLET.sub("", line)
    n = size_of(body)
    if title and line == title:
        return 1
    words = body.lower().replace("|", " ").replace("›", " ").replace("·", " ").split()
    if words and len(words) <= 14 and all(w in MENU for w in words):
        return 0
    score = (words_of or bare_model())(body)
    if n >= LONG:
        return 0 if score > 1.0 or (habit == 0 and score > -1.0) else 1 if score < -1.0 else None
    item = body is not line and n >= 2
    if habit == 1:
        return 1
    if score > (3.0 if item else 1.0):
        return None if followed and n <= 4 else 0  # subheadings may have the words of furniture
    if _BYLINE.search(line):
        return 1
    if _SEPARATED.match(body):
        return 0
    if habit == 0 and not item:
        return 0
    if score > 0.0 and not item:
        return None
    if is_running(line, n) or n >= 4 or (followed and n >= 2) or item:
        return 1
    return None


def habits(pages: list[tuple[Page, list[bool], list[str]]], sites: list[str]) -> dict[str, int]:
    """1 for lines that stand over running text on several pages, as subheadings do; 0 for those that stand on pages of
    three sites or more, mostly not over running text.  pages: with whether each line is running text, and its key."""
    seen, over, on = Counter(), Counter(), {}
    for (_, running, keys), site in zip(pages, sites):
        for i, key in enumerate(keys):
            if len(key) > 3:
                seen[key] += 1
                over[key] += i + 1 < len(running) and running[i + 1]
                on.setdefault(key, set()).add(site)
    return {k: int(over[k] >= 0.7 * n) for k, n in seen.items() if len(on[k]) >= 3 and not 0.4 * n < over[k] < 0.7 * n}


def line_key(line: str, site: str | None) -> str:
    """A line without its numbers and the name of its site; of a short line with a label, only the label."""
    m = _LABEL.match(line)
    key = re.sub(r"\d+", "0", (m.group() if m and size_of(line) < LONG else line).lower())
    return key.replace(site, "#") if site else key


_LABEL = re.compile(r"[^\W\d_][\w'’-]*(?:\s[\w'’-]+){0,2}\s?:(?=\s)")


@dataclass
class Page:
    number: list[int]  # line numbers from 1
    lines: list[str]
    at: list[int]  # node of each line
    parent: list[int]  # of each node, before it in order; -1 for the page
    title: str
    marks: list[tuple[str, ...]] = field(default_factory=list)  # what the elements around each line say


class Dom:
    """The elements of a page that hold text, in order, and their texts."""

    def __init__(self, html: str):
        self.parent, self.of, self.marks = [-1], {}, {}
        self.texts: list[tuple[str, int]] = []
        self._walk(parse_html(html), 0, ())

    def _walk(self, n: Node, node: int, marks: tuple[str, ...]) -> None:
        todo = [(n, node, marks)]
        while todo:  # without recursion, as pages may be nested deeply
            n, node, marks = todo.pop()
            inner = [c for c in n.children if isinstance(c, Node) and c.tag in BLOCKS]
            if inner:
                kids = []
                for c in n.children:
                    if isinstance(c, str):
                        if not c.isspace():
                            self._text(c, node, marks)
                    elif c.tag in BLOCKS:
                        holds = any(isinstance(x, Node) and x.tag in BLOCKS for x in c.children)
                        own = (*marks, *self._said(c))[-8:]
                        if holds:
                            self.parent.append(node)
                            kids.append((c, len(self.parent) - 1, own))
                        else:
                            kids.append((c, node, own))
                    elif c.tag not in ("script", "style", "noscript", "template"):
                        kids.append((c, node, (*marks, *self._said(c))[-8:]))
                todo.extend(reversed(kids))
            elif n.tag not in ("script", "style", "noscript", "template", "head", "title"):
                text = n.text()
                linked = sum(len(c.text()) for c in n.walk() if c.tag == "a")
                self._text(text, node, (*marks, "links") if linked > 0.5 * len(text) else marks)

    @staticmethod
    def _said(n: Node) -> tuple[str, ...]:
        names = re.findall(r"[a-z]+", f"{n.attrs.get('class') or ''} {n.attrs.get('id') or ''} {n.attrs.get('role') or ''}".lower())
        return () if n.tag in ("div", "p") and not names else (f"<{n.tag}>", *(f".{x}" for x in names[:6]))

    def _text(self, text: str, node: int, marks: tuple[str, ...]) -> None:
        for line in text.split("\n"):
            line = " ".join(line.split())
            if line:
                self.of.setdefault(line, []).append(len(self.texts))
                self.texts.append((line, node))
                self.marks[len(self.texts) - 1] = marks

    def find(self, line: str, after: int) -> int | None:
        """The place of a line's text among the texts, the first one from after on, or else the first."""
        places = self.of.get(" ".join(line.split()))
        return None if not places else next((k for k in places if k >= after), places[0])


def parse(text: str, title: str | None, html: str | None = None) -> Page:
    page, fresh, was, held, place = Page([], [], [], [-1], (title or "").strip()), True, None, 0, 0
    dom = Dom(html) if html else None
    if dom:
        page.parent = list(dom.parent)
    inside = len(page.parent)  # nodes from here on are blocks
    for no, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if not s:
            fresh = True
            continue
        node, marks = 0, ()
        if dom:
            found = dom.find(s, place)
            if found is not None:
                node, marks, place = dom.texts[found][1], dom.marks[found], found + 1
        now = is_running(s, size_of(s))
        if fresh or now != was or node != held or len(page.parent) == inside:
            page.parent.append(node)
        fresh, was, held = False, now, node
        page.number.append(no)
        page.lines.append(s)
        page.at.append(len(page.parent) - 1)
        page.marks.append(marks)
    return page


def _bucket(token: str) -> int:
    return crc32(token.encode()) % BUCKETS


class Features:
    """Feature numbers of lines, with a cache of the hashed words."""

    FORM = 64

    def __init__(self) -> None:
        self.words: dict[str, list[int]] = {}

    def of_words(self, line: str) -> list[int]:
        key = re.sub(r"\d+", "0", line.lower())
        got = self.words.get(key)
        if got is None:
            toks = ["^", *_TOKEN.findall(key), "$"]
            base, n = self.FORM, BUCKETS
            got = [base + crc32(x.encode()) % n for x in (*set(toks[1:-1]), *map(" ".join, zip(toks, toks[1:])))]
            if len(self.words) > 100_000:
                self.words.clear()
            self.words[key] = got
        return got

    def of_page(self, page: Page) -> list[list[int]]:
        n = len(page.lines)
        sizes = [size_of(x) for x in page.lines]
        running = [is_running(x, k) for x, k in zip(page.lines, sizes)]
        first = next((i for i in range(n) if sizes[i] >= LONG), n)
        last = next((i for i in range(n - 1, -1, -1) if sizes[i] >= LONG), -1)
        out = []
        for i, line in enumerate(page.lines):
            k = sizes[i]
            f = [min(k, 9) if k < 9 else 9 if k < LONG else 10 if k < 22 else 11]
            if _STOP.search(line):
                f.append(12)
            if line[0] in "-*•·+" or line[0].isdigit():
                f.append(13 if _BULLET.match(line) else 14)
            f.append(15 if i < first else 16 if i > last else 17)
            f.append(18 if i + 1 < n and running[i + 1] else 19 if i + 1 < n else 20)
            f.append(21 if i and running[i - 1] else 22 if i else 23)
            if page.title and line == page.title:
                f.append(24)
            if any(c in line for c in "|›»"):
                f.append(25)
            if page.marks and page.marks[i]:
                f.extend({26 + _bucket(m) % 38 for m in page.marks[i]})
            f.extend(self.of_words(line))
            out.append(f)
        return out


class TreeModel:
    """Line evidence (log odds of main body) and the parent-child potentials of the page tree."""

    def __init__(self, weights: np.ndarray, page_block: np.ndarray, block_line: np.ndarray):
        self.weights, self.page_block, self.block_line = weights, page_block, block_line

    def evidence(self, rows: list[list[int]]) -> np.ndarray:
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(size.sum()))
        words = flat >= Features.FORM
        owner = np.repeat(np.arange(len(rows)), size)
        w = self.weights[flat]
        n_words = np.maximum(1, np.bincount(owner, words, len(rows)))
        return np.bincount(owner, np.where(words, w * 4 / np.sqrt(n_words[owner]), w), len(rows)) + self.weights[-1]

    def marginals(self, rows: list[list[int]], block: np.ndarray, page: np.ndarray) -> np.ndarray:
        """P(main body) of each line of trees of three levels; block: of each line, page: of each block."""
        roots = int(page.max()) + 1
        return self.tree_marginals(rows, block + roots, np.concatenate((np.full(roots, -1), page)))

    def tree_marginals(self, rows: list[list[int]], at: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """P(main body) of each line; at: its node, parent: that of each node, before it in order, or -1.

        Messages go up level by level from the deepest nodes, then down again.
        """
        z = np.clip(self.evidence(rows), -12, 12)
        own = np.stack((-np.logaddexp(0, z), -np.logaddexp(0, -z)), 1)  # log phi(furniture), log phi(body)
        up = np.logaddexp(own[:, None, 0] + self.block_line[None, :, 0], own[:, None, 1] + self.block_line[None, :, 1])  # line to node
        n = len(parent)
        depth = np.zeros(n, np.int64)
        todo = np.flatnonzero(parent >= 0)
        while len(todo):  # parents stand before their children
            new = depth[parent[todo]] + 1
            todo, _ = todo[new != depth[todo]], depth.__setitem__(todo, new)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
        belief = np.stack([np.bincount(at, up[:, s], n) for s in (0, 1)], 1)
        sent = np.zeros((n, 2))
        for nodes in levels[:0:-1]:
            b = belief[nodes]
            sent[nodes] = np.logaddexp(b[:, None, 0] + self.page_block[None, :, 0], b[:, None, 1] + self.page_block[None, :, 1])
            for s in (0, 1):
                belief[:, s] += np.bincount(parent[nodes], sent[nodes, s], n)
        for nodes in levels[1:]:
            down = belief[parent[nodes]] - sent[nodes]  # without the node's own message
            belief[nodes] += np.logaddexp(down[:, 0:1] + self.page_block[0][None], down[:, 1:2] + self.page_block[1][None])
        to_line = belief[at] - up
        from_node = np.logaddexp(to_line[:, 0:1] + self.block_line[0][None], to_line[:, 1:2] + self.block_line[1][None])
        total = own + from_node
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))


def train(pages: list[tuple], rounds: int = 60) -> TreeModel:
    """Fit evidence by regularised logistic regression and potentials by counting, on pages (text, title, html, site).

    html and site may be left out.
    """
    feats, rows, labels = Features(), [], []
    edges, tops = np.ones((2, 2)), np.ones((2, 2))
    parsed, sites = [], []
    for text, title, *more in pages:
        html, site = (*more, None, None)[:2]
        p = parse(text, title, html)
        if not p.lines:
            continue
        running = [is_running(x, size_of(x)) for x in p.lines]
        keys = [line_key(x, site) for x in p.lines]
        sites.append(site or str(len(sites)))  # pages of unknown sites count for themselves
        parsed.append((p, running, keys))
    habit = habits(parsed, sites)
    words = word_model([x for p, _, _ in parsed for x in p.lines])
    for p, running, keys in parsed:
        got = [seed_label(x, p.title, i + 1 < len(running) and running[i + 1], habit.get(keys[i]), words) for i, x in enumerate(p.lines)]
        for f, y in zip(feats.of_page(p), got):
            if y is not None:
                rows.append(f)
                labels.append(y)
        # a node's label is that of most of its lines; edges are counted from node to node and from node to line
        votes = [[0, 0] for _ in p.parent]
        for k, y in zip(p.at, got):
            if y is not None:
                votes[k][y] += 1
        for k in range(len(p.parent) - 1, 0, -1):
            for y in (0, 1):
                votes[p.parent[k]][y] += votes[k][y]
        major = [None if not sum(v) else int(v[1] >= v[0]) for v in votes]
        major[0] = int(votes[0][1] > 0)
        for k in range(1, len(p.parent)):
            if major[k] is not None:
                tops[major[p.parent[k]], major[k]] += 1
        several = Counter(k for k, y in zip(p.at, got) if y is not None)
        for k, y in zip(p.at, got):
            if y is not None and several[k] > 1:
                edges[major[k], y] += 1
    weights = np.zeros(Features.FORM + BUCKETS + 1)
    even = np.log(np.full((2, 2), 0.5))
    if not rows or len(set(labels)) < 2:
        weights[-1] = 4.0
        return TreeModel(weights, even, even)
    model = TreeModel(weights, even, even)
    y = np.array(labels, float)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(size.sum()))
    owner = np.repeat(np.arange(len(rows)), size)
    n_words = np.maximum(1, np.bincount(owner, flat >= Features.FORM, len(rows)))
    value = np.where(flat >= Features.FORM, 4 / np.sqrt(n_words[owner]), 1.0)
    square = np.full(len(weights), 1e-6)
    for _ in range(rounds):  # AdaGrad over the whole sample
        z = np.bincount(owner, weights[flat] * value, len(rows)) + weights[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(flat, g[owner] * value, len(weights)) / len(rows) + 1e-5 * weights
        grad[-1] = g.mean()
        square += grad * grad
        weights -= 0.5 * grad / np.sqrt(square)
    soften = lambda m: np.log((m + 0.02 * m.sum()) / (m + 0.02 * m.sum()).sum(1, keepdims=True))
    model.page_block, model.block_line = soften(tops), soften(edges)
    model.weights = weights.astype(np.float32)
    return model


def classify(model: TreeModel, texts: list[str | None], titles: list[str | None], feats: Features, htmls: list[str | None] | None = None) -> list[tuple[list[int], np.ndarray, list[str]]]:
    """(line numbers, P(main body), lines) for each text."""
    rows, at, parent, spans = [], [], [], []
    for t, title, html in zip(texts, titles, htmls or [None] * len(texts)):
        p = parse(t, title, html) if t and not t.isspace() else None
        if p is None or not p.lines:
            spans.append((0, 0, None))
            continue
        base = len(parent)
        parent.extend(k + base if k >= 0 else -1 for k in p.parent)
        at.extend(k + base for k in p.at)
        start = len(rows)
        rows.extend(feats.of_page(p))
        spans.append((start, len(rows), p))
    if not rows:
        return [([], np.zeros(0), []) for _ in texts]
    prob = model.tree_marginals(rows, np.array(at), np.array(parent))
    return [([], np.zeros(0), []) if p is None else (p.number, prob[a:b], p.lines) for a, b, p in spans]


def _known(pages: DataFrame) -> DataFrame:
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    return pages.select("table_name", "row_id", "title", "text", html.alias("html")).where("row_id is not null")


def label_lines(pages: DataFrame, model_of: TreeModel) -> DataFrame:
    """(table_name, row_id, line_no, p_body) of every line of pages(table_name, row_id, title, text, html) that is not blank."""
    model = pages.sparkSession.sparkContext.broadcast(model_of)

    def run(names, ids, titles, texts, htmls):
        out = {"table_name": [], "row_id": [], "line_no": [], "p_body": []}
        for name, i, (numbers, prob, _) in zip(names, ids, classify(model.value, texts, titles, Features(), htmls)):
            out["table_name"] += [name] * len(numbers)
            out["row_id"] += [i] * len(numbers)
            out["line_no"] += numbers
            out["p_body"] += prob.tolist()
        return out

    return map_batches(_known(pages), "table_name string, row_id bigint, line_no int, p_body double", run)


def furniture_lines(pages: DataFrame, model_of: TreeModel) -> DataFrame:
    return label_lines(pages, model_of).where("p_body < 0.5").select("table_name", "row_id", "line_no")


def main_bodies(pages: DataFrame, model_of: TreeModel) -> DataFrame:
    """(table_name, row_id, body): each page's main body alone; null where nothing is left."""
    model = pages.sparkSession.sparkContext.broadcast(model_of)

    def run(names, ids, titles, texts, htmls):
        got = classify(model.value, texts, titles, Features(), htmls)
        bodies = ["\n".join(x for x, p in zip(lines, prob) if p >= 0.5) or None for _, prob, lines in got]
        return {"table_name": names, "row_id": ids, "body": bodies}

    return map_batches(_known(pages), "table_name string, row_id bigint, body string", run)


def fit(pages: DataFrame, max_pages: int = 1200) -> TreeModel:
    """Train on at most max_pages pages of each table, taken by the hash of their id."""
    have = pages.where("row_id is not null and text is not null")
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    site = F.regexp_extract("site", r"^([^.]*[.])?([^.]+)[.][^.]+$", 2) if "site" in pages.columns else F.lit(None).cast("string")
    sample = []
    for name in sorted(r[0] for r in pages.select("table_name").distinct().collect()):
        own = have.where(F.col("table_name") == name)
        ids = own.select("row_id").distinct().orderBy(F.xxhash64("row_id"), "row_id").limit(max_pages)
        part = own.join(F.broadcast(ids), "row_id", "left_semi").select("row_id", "text", "title", html.alias("html"), site.alias("site")).dropDuplicates(["row_id"]).orderBy("row_id")
        sample += [tuple(r)[1:] for r in part.collect()]
    return train(sample)
