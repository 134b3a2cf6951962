"""Main text of web pages by a tree-structured graphical model.

Each element of a page is a binary variable: content or not. Its own potential comes from its tag, its class and id words, those of the
elements around it and measures of its text; a potential between parent and child, one for each kind of child, makes neighbours agree as far as training found they do. As the page is
a tree, sum-product messages passed from the leaves to the root and back give exact marginals; the text of elements whose
marginal for content is above a half is the result. Weights are fitted by gradient ascent on the likelihood of labelled
pages, which a generator here lays out at random (page_samples) with every kind of boilerplate known.

Messages are passed for all pages of a batch at once, level by level. Pages are never cut. Null html is empty: empty text, n_chars
0. Broken or unclosed markup is read as far as it goes. Repeated rows are extracted each; an empty table gives no rows; columns
besides those named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, map_arrow
from cairn.llm.html_tree import BLOCK, Page, blocks, parse
from cairn.llm.page_samples import LAYOUTS, samples

# Tags and words in class, id and role that have a weight of their own.
TAGS = (
    "html head title meta link body article main section header footer nav aside div span p a b strong i em u h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th "
    "blockquote pre code figure figcaption img br form input button select option label textarea fieldset time small details summary menu dialog address"
).split()
WORDS = (
    "nav navigation menu header footer sidebar side ad ads advert advertisement sponsor sponsored banner cookie consent notice alert warning promo popup modal overlay share social "
    "comment comments discussion reply respond related recommended widget breadcrumb breadcrumbs search login signup subscribe newsletter form toolbar pagination pager tags copyright legal "
    "replies responses thread disqus feedback reader user review rating vote subscription cta donate sticky gdpr privacy policy tools section list item box panel "
    "article content post entry main body story text page lead intro summary headline title caption author byline meta date top bottom site global complementary contentinfo"
).split()
NUMBERS, EDGES = 12, 3
OWN = len(TAGS) + len(WORDS)
#: Weights of an element's own tag and words, of those of its ancestors, of the numbers, and a constant.
SIZE = 2 * OWN + NUMBERS + 1
MAIN = frozenset(["article", "main"])
_TAG = {t: k for k, t in enumerate(TAGS)}
_WORD = {w: len(TAGS) + k for k, w in enumerate(WORDS)}


class Forest:
    """The elements of several pages as arrays; pages' roots have no parent."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.cumsum(size) - size
        base = np.repeat(self.first, size)
        self.parent = np.concatenate([np.array(p.parent, np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        self.parent = np.where(self.parent >= 0, self.parent + base, -1)
        self.depth = np.concatenate([np.array(p.depth, np.int64) for p in pages]) if pages else self.parent
        self.of = np.repeat(np.arange(len(pages)), size)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1))
        self.levels = np.split(order, cuts)
        # What joins an element to its parent: 0 an inline element, 1 a block without class or id, 2 one with.
        self.edge = np.concatenate([np.array([0 if t not in BLOCK else 1 + bool(m) for t, m in zip(p.tag, p.marks, strict=True)], np.int64) for p in pages]) if pages else self.parent
        self.x_rows, self.x_cols, self.numbers = self._features(pages, size)

    def _features(self, pages: list[Page], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols = [], []
        n = int(size.sum())
        inside = np.zeros(n)  # 1 in an article or main element, -1 outside where the page has one
        chars, links, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        for base, p in zip(self.first.tolist(), pages, strict=True):
            above: list[frozenset[int]] = []  # of each element what its children inherit; most share their parent's set
            for k, t in enumerate(p.tag):
                own = {_WORD[w] for m in p.marks[k] if (w := m.partition(":")[2]) in _WORD}
                if (c := _TAG.get(t)) is not None:
                    own.add(c)
                got = above[p.parent[k]] if k else frozenset()
                cols += own
                cols += [OWN + c for c in got]
                rows += [base + k] * (len(own) + len(got))
                above.append(got if own <= got else got | own)
                inside[base + k] = t in MAIN or (k > 0 and inside[base + p.parent[k]] > 0)
            if inside[base : base + len(p.tag)].any():
                inside[base : base + len(p.tag)] -= inside[base : base + len(p.tag)] == 0
            for node, _, piece in p.text:
                chars[base + node] += len(piece.strip())
                stops[base + node] += piece.count(".") + piece.count(",")
        alone = chars.copy()
        is_link = np.concatenate([np.array([t == "a" for t in p.tag]) for p in pages]) if pages else np.zeros(0, bool)
        in_link = is_link.astype(float)
        for level in self.levels[1:]:
            in_link[level] = np.maximum(in_link[level], in_link[self.parent[level]])
        links = chars * in_link
        for level in self.levels[:0:-1]:
            for a in (chars, links, stops):
                np.add.at(a, self.parent[level], a[level])
        total = np.maximum(chars[self.first][self.of], 1) if n else chars
        place = (np.arange(n) - self.first[self.of]) / np.maximum(size[self.of], 1) if n else chars
        numbers = np.stack([np.log1p(alone) / 5, np.log1p(chars) / 8, links / np.maximum(chars, 1), chars / total, stops / np.maximum(chars, 1) * 20, place, np.minimum(self.depth, 20) / 10, alone == 0, chars == 0, inside > 0, inside < 0, np.minimum(alone, 60) / 60], 1)
        return np.array(rows, np.int64), np.array(cols, np.int64), numbers

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each element's own log-odds of being content."""
        out = self.numbers @ weights[2 * OWN : -1] + weights[-1]
        return out + np.bincount(self.x_rows, weights[self.x_cols], len(out))

    def gradient(self, d: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.x_cols, d[self.x_rows], 2 * OWN), d @ self.numbers, [d.sum()]])

    def marginals(self, score: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: P(content) of each element; and of each element with a parent, the joint distribution (parent, own)."""
        n = len(score)
        own = np.zeros((n, 2))
        own[:, 1] = score
        up = own.copy()  # own potential and what the children say
        said = np.zeros((n, 2))  # what an element says to its parent
        for level in self.levels[:0:-1]:
            own_pair = pair[self.edge[level]]
            said[level] = np.logaddexp(own_pair[:, :, 0] + up[level, :1], own_pair[:, :, 1] + up[level, 1:])
            np.add.at(up, self.parent[level], said[level])
        belief = up.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - said[level]
            full = above[:, :, None] + pair[self.edge[level]] + up[level][:, None, :]
            heard = np.logaddexp(full[:, 0], full[:, 1])
            belief[level] = heard
            full -= np.logaddexp(heard[:, 0], heard[:, 1])[:, None, None]
            joint[level] = np.exp(full)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40))), joint


class TreeModel:
    def __init__(self) -> None:
        self.weights, self.pair = np.zeros(SIZE), np.zeros((EDGES, 2, 2))

    def fit(self, pages: list[Page], labels: list[list[bool]], steps: int = 500, rate: float = 0.08, decay: float = 2e-5) -> TreeModel:
        forest = Forest(pages)
        y = np.concatenate([np.array(x, float) for x in labels])
        child = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((EDGES, 2, 2))
        np.add.at(seen, (forest.edge[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
        theta = np.zeros(SIZE + 4 * EDGES)
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            p, joint = forest.marginals(forest.scores(theta[:SIZE]), theta[SIZE:].reshape(EDGES, 2, 2))
            met = np.stack([joint[child[forest.edge[child] == k]].sum(0) for k in range(EDGES)])
            g = np.concatenate([forest.gradient(y - p), (seen - met).ravel()]) / len(y) - decay * theta
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        self.weights, self.pair = theta[:SIZE], theta[SIZE:].reshape(EDGES, 2, 2)
        return self

    def content(self, pages: list[Page]) -> list[list[bool]]:
        forest = Forest(pages)
        p, _ = forest.marginals(forest.scores(self.weights), self.pair)
        return [x.tolist() for x in np.split(p > 0.5, forest.first[1:])] if pages else []

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(x) for x in sources]
        return [blocks(p, w) for p, w in zip(pages, self.content(pages), strict=True)]


@lru_cache(maxsize=1)
def trained(pages: int = 1200, seed: int = 1, without: tuple[str, ...] = ()) -> TreeModel:
    """The model fitted on `pages` generated labelled pages, of all layouts but those to be held out."""
    trees, labels = [], []
    for source, label in samples(pages, seed, tuple(x for x in LAYOUTS if x not in without)):
        trees.append(parse(source))
        labels.append(label)
        if len(label) != len(trees[-1].tag):
            raise ValueError("a labelled page was read otherwise than it was laid out")
    return TreeModel().fit(trees, labels)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per row of df: id, url, text (empty if there is no content) and n_chars (its code points)."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            text: list[str] = []
            for some in cut(b["html"], 1_000_000):
                text += shared.value.texts([x.decode() for x in some])
            yield {"id": b["id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}

    out = map_arrow(df.selectExpr(f"`{id_col}` id", f"`{url_col}` url", f"`{html_col}` html"), run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
