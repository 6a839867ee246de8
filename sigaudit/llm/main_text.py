"""Operator 6: main text of web pages by minimum-cut labelling.

A page's text blocks are the nodes of a graph. A classifier's log odds are capacities to the two terminals. It knows a block's text, its
place and the words in class names around it, and learns what they tell from pages whose tags (article, nav, footer ...) say which part
is which; tags are no features of it. Where a page has such tags they are a second, moderate capacity. Blocks that are next to each
other in page order or in one container are joined by edges that weaken with their distance in the document tree. The minimum cut, found
by augmenting paths, separates content from boilerplate.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, table
from .html_blocks import Block, blocks

#: Pages that the classifier is fitted on, about; the capacity of an edge at distance 0, and what is left of it a step; log odds that a block has at most.
SAMPLE, EDGE, FADE, MOST = 400, 16.0, 0.4, 8.0
#: Pull of the fit towards these weights (fixed values). From the text: bias, log words, link share, sentence end, heading, list item or
#: cell, place in the page, a mark of rights. From the words in names: in a main part, in a frame, in a main part within a frame.
PRIOR = np.array([-0.5, 1.2, -4.0, 1.0, 1.5, -0.5, 0.0, -4.0, 2.0, -6.0, 0.0])
TEXT = 8
#: Capacity of tags and roles: in a main part, in a frame, outside the main part of a page that has one.
TAGS = {"main": 3.0, "frame": -6.0, "outside": -3.0}
ITEMS = frozenset(("li", "td", "th", "dt", "dd"))
RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)
FRAME_STEPS = 2
#: Strength of that pull against the mean loss of a row.
PULL = 0.01


def features(page: list[Block]) -> np.ndarray:
    """A row a block: TEXT columns from the text and its place, and the others from words in names that are nearer than any tag's mark."""
    n = len(page)
    rows = [
        [1.0, np.log1p(b.text.count(" ") + 1) - 2, b.linked / len(b.text), b.text[-1] in ".!?…:;\"'”»)", b.element.tag[:1] == "h" and b.element.tag[1:].isdigit(), b.element.tag in ITEMS, abs(2 * i / n - 1), RIGHTS.search(b.text) is not None,
         *(b.element.part == part and not b.element.sure for part in ("main", "frame", "mixed"))]
        for i, b in enumerate(page)
    ]
    return np.array(rows, float).reshape(-1, len(PRIOR))


def tag_parts(page: list[Block]) -> list[str]:
    """What tags and roles say of each block: "main", "frame", "outside" (of the main part of a page that has one), or "" where they say
    nothing or a word in a name is nearer."""
    marked = any(b.element.part == "main" and b.element.sure for b in page)
    return ["outside" if marked and b.element.part in ("", "mixed") else b.element.part if b.element.sure and b.element.part != "mixed" else "" for b in page]


def weak_labels(page: list[Block]) -> np.ndarray:
    """By tags and roles, 1: in a main part, 0: in a frame, or outside the main part of a page that has one; -1: not known."""
    marked = any(b.element.part == "main" and b.element.sure for b in page)
    outside = lambda b: marked and not _within(b, "main")
    return np.array([1 if part == "main" else 0 if part or outside(b) else -1 for part, b in zip(tag_parts(page), page, strict=True)], int)


def _within(b: Block, part: str) -> bool:
    e = b.element
    while e is not None:
        if e.part == part and e.sure:
            return True
        e = e.parent
    return False


def without_markup(x: np.ndarray) -> np.ndarray:
    """The same rows as of a page whose names tell nothing."""
    return np.where(np.arange(x.shape[1]) < TEXT, x, 0.0)


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a Gaussian prior around PRIOR; the two labels weigh alike. Each row counts twice, with
    the words in names and without, so that the text's weights are learned for pages whose names tell nothing."""
    w = PRIOR.copy()
    if not ((y == 1).any() and (y == 0).any()):
        return w
    x, y = np.concatenate([x, without_markup(x)]), np.concatenate([y, y])
    weight = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum()) * len(y) / 2
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + PULL * (w - PRIOR)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + PULL * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def distance(a: Block, b: Block) -> int:
    """Steps between two blocks' elements in the document tree; the border of a frame counts for FRAME_STEPS more."""
    x, y, n = a.element, b.element, 0
    while x is not y:
        lower = x if x.depth >= y.depth else y
        n += 1 + FRAME_STEPS * (lower.part == "frame" and lower.parent.part != "frame")
        x, y = (x.parent, y) if lower is x else (x, y.parent)
    return n


def edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Links of blocks with their capacities, by distance in the tree: neighbours in page order, a block and the last one before it in
    its container (less the more blocks are between them), and the items of a list or table and the block that leads to them, if their
    markup says the same."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            out.append((i - 1, i, EDGE * FADE ** distance(page[i - 1], b)))
        box = b.element.parent or b.element
        if box in last and last[box] != i - 1:
            out.append((last[box], i, EDGE * FADE ** (1 + i - last[box])))
        near = last.get(box.parent, i - 1)
        if b.element.tag in ITEMS and near != i - 1 and page[near].element.part == b.element.part:
            out.append((near, i, EDGE * FADE ** distance(page[near], b)))
        last[box] = i
    return out


def source_side(odds: np.ndarray, links: list[tuple[int, int, float]]) -> np.ndarray:
    """The nodes on the source's side of a minimum cut: capacity odds from the source where positive, -odds to the sink where negative,
    and links both ways. Paths are augmented from one node at a time; nodes found to reach no sink are done with for good."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    left = np.maximum(odds, 0).tolist()
    drain = np.maximum(-odds, 0).tolist()
    done = np.zeros(n, bool)
    for v in range(n):
        while left[v] > 1e-12 and not done[v]:
            before, queue, end = {v: -1}, deque([v]), -1
            while queue and end < 0:
                u = queue.popleft()
                for w, c in near[u].items():
                    if c > 1e-12 and w not in before and not done[w]:
                        before[w] = u
                        if drain[w] > 1e-12:
                            end = w
                            break
                        queue.append(w)
            if end < 0:
                done[list(before)] = True
                break
            flow, w = min(left[v], drain[end]), end
            while before[w] >= 0:
                flow, w = min(flow, near[before[w]][w]), before[w]
            left[v] -= flow
            drain[end] -= flow
            w = end
            while before[w] >= 0:
                u = before[w]
                near[u][w] -= flow
                near[w][u] = near[w].get(u, 0.0) + flow
                w = u
    return done


def log_odds(page: list[Block], weights: np.ndarray) -> np.ndarray:
    """The classifier's verdict on each block by itself: content where positive."""
    return np.clip(features(page) @ weights, -MOST, MOST)


def capacities(page: list[Block], weights: np.ndarray) -> np.ndarray:
    """To the content's terminal where positive, to the other where negative: the classifier's, and those of tags."""
    return log_odds(page, weights) + np.array([TAGS.get(part, 0.0) for part in tag_parts(page)])


def content(page: list[Block], weights: np.ndarray) -> np.ndarray:
    """Which blocks are on the content's side of the minimum cut."""
    return source_side(capacities(page, weights), edges(page)) if page else np.zeros(0, bool)


def main_text(html: str | None, weights: np.ndarray = PRIOR) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, c in zip(page, content(page, weights), strict=True) if c)


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The text classifier's weights, from the blocks of about sample pages (drawn by a hash of the id) whose elements tell their part."""
    count = pages.count()
    drawn = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < min(1.0, sample / max(count, 1)) * (1 << 20))
    width = len(PRIOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x.as_py() or "") for x in batch.column(0)]
            x = np.concatenate([np.zeros((0, width)), *map(features, found)])
            y = np.concatenate([np.zeros(0, int), *map(weak_labels, found)])
            yield pa.RecordBatch.from_arrays([pa.array(list(x[y >= 0]), pa.list_(pa.float64())), pa.array(y[y >= 0], pa.int32())], ["x", "y"])

    rows = drawn.select(F.col("html").cast("string")).mapInArrow(run, "x array<double>, y int").toPandas()
    return fit_weights(np.array(rows["x"].tolist()).reshape(-1, width), rows["y"].to_numpy(int)) if len(rows) else PRIOR


def extract(pages: DataFrame) -> DataFrame:
    """Per row page_id, url, text (the main text, its blocks joined by newlines; empty if none) and n_chars.

    A null html is an empty page. Ties (a block that the cut may leave on either side) go to boilerplate. Repeated rows give repeated results. An empty table gives no rows. Other columns, whatever their
    names, are not read.
    """
    bound_batches(pages.sparkSession)
    weights = fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
