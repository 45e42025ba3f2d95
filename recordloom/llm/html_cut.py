"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks, the text between block-level tags.  A logistic classifier gives each block the log odds of being content,
which become its terminal capacity: to the source for content, to the sink for boilerplate.  Blocks next to each other are joined by
an edge whose capacity grows with the part of their paths in the DOM that they share, and each block by another to the next one with
the same parent.  The minimum cut, found by maximum flow, separates content from boilerplate.

Most blocks are settled before any flow: where a block's terminal capacity exceeds all its edges together, no minimum cut has it on the
other side, so it takes its label and gives its edges to its neighbours' terminals.  This goes on for all pages of a batch at once while
it settles something; what is left of each page goes through Dinic's algorithm.  Capacities are whole numbers.

The classifier is fitted in numpy to at most `sample` pages, those with the smallest hash of their id, whose blocks within article, main and
paragraph are content and those within navigation, header, footer, aside, form and advertising boilerplate.  It sees no tag and no depth,
only text and links of the block and its neighbours, so that it serves pages without such tags too.  Its odds are bounded by MAX_ODDS, below
what edges to agreeing neighbours amount to; n_moved counts the blocks whose label isn't the one that the classifier alone would give.

Defined cases: null or empty html has no blocks and an empty text; unclosed and stray tags are tolerated; comments, scripts, styles, the
head, and noscript and template are no text; a head also ends before the first tag or text that can't stand in one, and a noscript or template
that isn't closed hides nothing; repeated rows and rows without an id are treated like others; an empty table gives an empty result; other columns are not
read.  Of equally good cuts the one with the fewest content blocks among those left to the flow counts; without both kinds of block to fit on,
every block is content.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, slices, small_batches

SAMPLE, SCALE, MAX_ODDS, NEXT, SIBLING, COUNT = 1500, 1000, 4.0, 1.5, 2.0, 11
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<![^<>]*>|[^<]+|<", re.S | re.I)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)(noscript|template|head|body)\b[^<>]*>", re.S | re.I)
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_NEST = _BLOCK - {"br", "hr"}
_LOOSE = frozenset({"p", "li", "dd", "dt", "tr", "td", "th", "option"})
_CONTENT = frozenset({"article", "main", "p"})
_AROUND = frozenset({"nav", "header", "footer", "aside", "form", "menu", "select"})
_ADS = re.compile(r"""(?:class|id|role)\s*=\s*["']?[^"'>]*\b(?:ads?|advert\w*|banner|menu|nav\w*|sidebar|footer|header|promo|cookie\w*|breadcrumbs?|share|social)\b""", re.I)
_MARKS = re.compile(r"[.!?;:,]")


@dataclass
class Block:
    text: str
    linked: int
    path: tuple[int, ...]
    tag: str
    weak: int  # 1 content, 0 boilerplate, -1 not known


def hidden(page: str) -> dict[int, int]:
    """Start and end of each closed noscript and template; one that isn't closed before the head or body ends hides nothing."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    for m in _HIDDEN.finditer(page):
        name = (m.group(3) or "").lower()
        if name in ("noscript", "template") and not m.group(2):
            opened.append((name, m.start()))
        elif name in ("noscript", "template"):
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] == name:
                    ends[opened[i][1]] = m.end()
                    del opened[i:]
                    break
        elif name == "body" or (name == "head" and m.group(2)):
            opened.clear()
    return ends


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, number, whether boilerplate lies around
    parts: list[str] = []
    linked, in_link, number = 0, 0, 0
    ends, until, in_head, in_title = hidden(page or ""), 0, False, False

    def close():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            names = {s[0] for s in stack}
            weak = 0 if any(s[2] for s in stack) else 1 if names & _CONTENT else -1
            out.append(Block(text, min(linked, len(text)), tuple(s[1] for s in stack), stack[-1][0] if stack else "", weak))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page or ""):
        if m.start() < until:
            continue
        until = ends.get(m.start(), 0)
        name = m.group(3)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                if in_head and (in_title or not piece.strip()):
                    continue
                in_head = False  # text can't stand in a head
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())
            continue
        name = name.lower()
        if name == "head" and not m.group(2):
            in_head, in_title = True, False
        elif in_head:
            in_title = not m.group(2) if name == "title" else in_title
            if name in ("head", "html", "body") and m.group(2):
                in_head = False
            elif name not in _HEAD and (not m.group(2) or name == "br"):
                in_head = False
            if in_head:
                continue
        if name == "a":
            in_link = 0 if m.group(2) else 1
        if name not in _BLOCK:
            continue
        close()
        if name not in _NEST:
            continue
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        else:
            if name in _LOOSE and stack and stack[-1][0] == name:
                stack.pop()
            number += 1
            around = bool(stack and stack[-1][2]) or name in _AROUND or bool(m.group(4) and _ADS.search(m.group(4)))
            stack.append((name, number, around))
    close()
    return out


def features(page: list[Block]) -> np.ndarray:
    """Of each block, and the length and share of links of the ones before and after it."""
    own = np.zeros((len(page) + 2, 7))
    for i, b in enumerate(page, 1):
        words, chars = b.text.count(" ") + 1, len(b.text)
        own[i] = (1, np.log1p(words), np.log1p(chars), b.linked / chars, min(1.0, len(_MARKS.findall(b.text)) / words), b.text[-1] in ".!?", min(chars / words, 40) / 10)
    return np.concatenate([own[1:-1], own[:-2, [1, 3]], own[2:, [1, 3]]], axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the log odds by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    if not y.size or y.min() == y.max():
        w[0] = 1.0
        return w
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1.0 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w -= np.linalg.solve(h, g)
    return w


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity)."""
    out: dict[tuple[int, int], int] = {}
    last: dict[tuple[int, ...], int] = {}
    for i, b in enumerate(page):
        if i:
            p, q = page[i - 1].path, b.path
            same = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
            out[i - 1, i] = int(SCALE * NEXT * (same + 1) / (max(len(p), len(q)) + 1))
        parent = b.path[:-1]
        if parent in last:
            key = (last[parent], i)
            out[key] = out.get(key, 0) + int(SCALE * SIBLING)
        last[parent] = i
    return [(a, b, c) for (a, b), c in out.items()]


def max_flow(odds: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut, by Dinic's algorithm."""
    n = len(odds)
    s, t = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def arc(a, b, c, back):
        out[a].append(len(to)), to.append(b), cap.append(c)
        out[b].append(len(to)), to.append(a), cap.append(back)

    for i, o in enumerate(odds):
        if o > 0:
            arc(s, i, o, 0)
        elif o < 0:
            arc(i, t, -o, 0)
    for a, b, c in links:
        arc(a, b, c, c)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and to[e] not in level:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if t not in level:
            return [i in level for i in range(n)]
        at = [0] * (n + 2)
        path, x = [], s
        while True:
            if x == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                path, x = [], s
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if cap[e] and level.get(to[e]) == level[x] + 1:
                    break
                at[x] += 1
            else:
                if not path:
                    break
                e = path.pop()
                x = to[e ^ 1]
                at[x] += 1
                continue
            path.append(e)
            x = to[e]


def label(odds: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum cuts of many graphs, numbered through: graph g has the nodes from bounds[g] to bounds[g + 1]."""
    odds, side = odds.astype(np.int64), np.zeros(odds.size, np.int8)
    while True:
        all_c = np.bincount(a, c, odds.size) + np.bincount(b, c, odds.size)
        settled = (side == 0) & (np.abs(odds) > all_c)
        if not settled.any():
            break
        side[settled] = np.sign(odds[settled])
        for x, y in ((a, b), (b, a)):
            hit = settled[x] & (side[y] == 0)
            np.add.at(odds, y[hit], c[hit] * side[x[hit]])
        open_ = (side[a] == 0) & (side[b] == 0)
        a, b, c = a[open_], b[open_], c[open_]
    left = np.flatnonzero(side == 0)
    if left.size:
        graph = np.searchsorted(bounds, left, "right")
        for g in np.unique(graph):
            nodes = left[graph == g]
            place = {int(x): i for i, x in enumerate(nodes)}
            lo, hi = np.searchsorted(a, bounds[g - 1]), np.searchsorted(a, bounds[g])
            links = [(place[x], place[y], z) for x, y, z in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), c[lo:hi].tolist(), strict=True)]
            side[nodes] = np.where(max_flow(odds[nodes].tolist(), links), 1, -1)
    return side > 0


def content(pages: list[list[Block]], weights: np.ndarray) -> list[list[tuple[bool, bool]]]:
    """For each block of each page, whether it is content, and whether the classifier alone says otherwise."""
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    if not bounds[-1]:
        return [[] for _ in pages]
    x = np.concatenate([features(p) for p in pages])
    odds = np.round(SCALE * np.clip(x @ weights, -MAX_ODDS, MAX_ODDS)).astype(np.int64)
    links = [(a + o, b + o, c) for p, o in zip(pages, bounds[:-1].tolist(), strict=True) for a, b, c in edges(p)]
    e = np.array(sorted(links), np.int64).reshape(-1, 3)
    got = label(odds, e[:, 0], e[:, 1], e[:, 2], bounds)
    both = list(zip(got.tolist(), (got != (odds > 0)).tolist(), strict=True))
    return [both[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _collect(batches):
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])
    for batch in batches:
        rows = []
        for page in batch.column(0).to_pylist():
            own = blocks(page)
            y = np.array([b.weak for b in own], np.int8)
            rows.append((features(own)[y >= 0].tobytes(), y[y >= 0].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, fitted to at most `sample` pages (page_id, html)."""
    own = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "html").alias("h")).where("html is not null")
    table = bounded_sample(own, pages.count(), sample, F.col("h")).select("html").mapInArrow(_collect, "x binary, y binary").toArrow()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), float).reshape(-1, COUNT)
    return fit(x, np.frombuffer(b"".join(table["y"].to_pylist()), np.int8).astype(float))


def _extract(weights: np.ndarray):
    def run(batches):
        for batch in slices(batches, 1, 2_000_000):
            pages = [blocks(p) for p in batch.column(1).to_pylist()]
            marks = content(pages, weights)
            text = ["\n".join(b.text for b, (k, _) in zip(p, m, strict=True) if k) for p, m in zip(pages, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array([len(p) for p in pages], pa.int32()), pa.array([sum(k for k, _ in m) for m in marks], pa.int32()), pa.array([sum(c for _, c in m) for m in marks], pa.int32())], names=["page_id", "text", "n_blocks", "n_content", "n_moved"])

    return run


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, text (content blocks, one a line), n_blocks, n_content, n_moved (blocks that the cut took from the classifier's side to the other)."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract(weights), "page_id bigint, text string, n_blocks int, n_content int, n_moved int")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
