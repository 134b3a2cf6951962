"""A quality classifier on random-indexing word vectors.

Word vectors: a token falls into one of SLOTS slots and a slot has a sparse ternary index vector; a slot's context vector is the sum of
the index vectors of the tokens near it, over all documents. The sums are integers, taken per task and then by an aggregation
over the slots, so they don't depend on how rows are dealt out, and the table has the same size for any input. A document's
features are the mean of its tokens' vectors, their spread, and how alike neighbours are. A network of two layers, trained here in
numpy by Adam, gives a logit; a temperature fitted on rows that the weights did not see turns it into a probability.

Labels are learned from a sample of at most `learn_rows` labelled rows, those with the smallest hashes; everything else covers all
rows. Only the text is an input of the score.

Nulls and odd cases: a null text is an empty one, whose features are all 0; rows whose label is null don't teach; where a document
has several labels their mean decides (1 from a half up). If there is nothing to learn from, every score is 0.5. Texts are used
whole. Repeated rows are scored each; an empty table gives no rows; columns besides those named aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, map_arrow, row_of, row_type, with_row, worker_cache

SLOTS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
KEPT_TOKENS = 300_000
#: Bytes of text whose tokens' vectors a worker holds at once, or one longer text.
AT_ONCE = 500_000


class Slots(dict):
    """Token -> slot, remembered up to a bound."""

    def __missing__(self, token: bytes) -> int:
        import zlib

        if len(self) >= KEPT_TOKENS:
            self.clear()
        slot = self[token] = zlib.crc32(token) % SLOTS
        return slot


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot: the places of its non-zeros, and their signs."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :NONZERO].astype(np.int32)
    return places, rng.choice(np.array([-1.0, 1.0]), (SLOTS, NONZERO))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all tokens of the texts, and each text's token count."""
    get = worker_cache(("slots",), Slots).__getitem__
    find = TOKEN.findall
    parts = [np.array([get(t) for t in find(x)], np.int32) if x else np.zeros(0, np.int32) for x in texts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([len(p) for p in parts], np.int64)


def context_sums(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """SLOTS x DIM: the summed index vectors of what stands within REACH tokens of a slot's tokens, over all rows."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        places, signs = index_vectors()
        total = np.zeros(SLOTS * DIM)
        for b in batches:
            for some in cut(b["text"], 2_000_000):
                slot, n = tokens(some)
                doc = np.repeat(np.arange(len(n)), n)
                for step in range(1, REACH + 1):
                    same = doc[step:] == doc[:-step]
                    left, right = slot[:-step][same], slot[step:][same]
                    for near, at in ((left, right), (right, left)):
                        base = at.astype(np.int64) * DIM
                        for k in range(NONZERO):
                            total += np.bincount(base + places[near, k], signs[near, k], SLOTS * DIM)
        rows = total.reshape(SLOTS, DIM).astype(np.int64)
        used = np.flatnonzero(rows.any(1))
        yield {"slot": used} | {f"v{k}": rows[used, k] for k in range(DIM)}

    columns = [f"v{k}" for k in range(DIM)]
    sums = map_arrow(df.selectExpr(f"`{text_col}` text"), run, "slot long, " + ", ".join(f"{c} long" for c in columns))
    found = sums.groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # SLOTS rows at most
    out = np.zeros((SLOTS, DIM))
    for k, c in enumerate(columns):
        out[found["slot"].to_numpy(), k] = found[c].to_numpy()
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors less what all share, of length 1."""
    v = sums / np.maximum(np.abs(sums).sum(1, keepdims=True), 1)
    v = v - v[sums.any(1)].mean(0) if sums.any() else v
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 3


def features(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    slot, n = tokens(texts)
    out = np.zeros((len(n), FEATURES), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    first = (np.cumsum(n) - n)[full]
    v = vectors[slot]
    size = n[full][:, None].astype(np.float32)
    mean = np.add.reduceat(v, first) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first) / size - mean * mean, 0))
    alike = np.zeros((len(slot), 2), np.float32)
    alike[:-1, 0] = np.einsum("ij,ij->i", v[:-1], v[1:])
    alike[:-1, 1] = slot[:-1] == slot[1:]
    last = first + n[full] - 1
    alike[last] = 0  # a text's last token has no neighbour behind it
    out[full, :DIM], out[full, DIM : 2 * DIM] = mean, spread
    out[full, 2 * DIM : 2 * DIM + 2] = np.add.reduceat(alike, first) / np.maximum(size - 1, 1)
    out[full, 2 * DIM + 2] = np.log1p(n[full])
    return out


class Network:
    """Features -> tanh layer -> logit -> probability at a temperature."""

    def __init__(self, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        self.shift, self.scale, self.temperature = np.zeros(FEATURES), np.ones(FEATURES), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        return (np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
        """Weights from four fifths of the rows, the temperature from the others."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        held, taught = order[: len(x) // 5], order[len(x) // 5 :]
        x = x.astype(float)
        self.shift, self.scale = x[taught].mean(0), x[taught].std(0) + 1e-6
        z, t = (x - self.shift) / self.scale, y.astype(float)
        m, s, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(taught), max(1, len(taught) // 128)):
                h = np.tanh(z[part] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -40, 40)))
                d = (p - t[part, None]) / len(part)
                back = d @ self.w[2].T * (1 - h * h)
                grads = [z[part].T @ back, back.sum(0), h.T @ d, d.sum(0)]
                step += 1
                for k, g in enumerate(grads):
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        held = held if len(held) else taught
        logit = self.logits(x[held])

        def loss(temperature: float) -> float:
            return float(np.mean(np.logaddexp(0, logit / temperature) - t[held] * logit / temperature))

        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self


def train(df: DataFrame, labels: DataFrame, vectors, id_col: str, text_col: str, label_col: str, learn_rows: int) -> Network | None:
    """The network, from at most learn_rows labelled rows of df that labels holds; None if they don't show both classes."""
    truth = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    ids = truth.orderBy(F.xxhash64(id_col), id_col).limit(learn_rows)
    rows = df.select(id_col, text_col).join(F.broadcast(ids), id_col)  # learn_rows rows at most are broadcast

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = np.concatenate([features(some, vectors.value) for some in cut(b["text"], AT_ONCE)] or [np.zeros((0, FEATURES), np.float32)])
            yield {"id": b["id"], "label": b["label"], "x": list(x)}

    kind = df.schema[id_col].dataType.simpleString()
    found = map_arrow(rows.selectExpr(f"`{id_col}` id", f"`{text_col}` text", "__label label"), run, f"id {kind}, label int, x array<float>")
    # A repeated id may bring more rows than were sampled.
    got = found.orderBy(F.xxhash64("id"), "id", "x").limit(learn_rows).toArrow()
    label = got["label"].to_numpy()
    if len(np.unique(label)) < 2:
        return None
    return Network().fit(got["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES), label)


def quality_scores(df: DataFrame, labels: DataFrame, held_out=None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_rows: int = 20_000, passed: list[str] | None = None) -> DataFrame:
    """One row per row of df: id (or the columns to be passed on, in a struct `__row`), held_out, score (0 to 1, higher: label 1 is likelier) and predicted (score >= threshold).

    held_out: a Column over id_col; labels of rows for which it is true are not learned from.
    """
    spark = df.sparkSession
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    vectors = spark.sparkContext.broadcast(word_vectors(context_sums(df, text_col)))
    network = train(df, labels.where(~held), vectors, id_col, text_col, label_col, learn_rows)
    shared = spark.sparkContext.broadcast(network)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            score = np.concatenate([shared.value.scores(features(some, vectors.value)) if shared.value else np.full(len(some), 0.5) for some in cut(b["text"], AT_ONCE)] or [np.zeros(0)])
            yield row_of(b) | {"id": b["id"], "score": score}

    scored = map_arrow(with_row(df, passed, id=id_col, text=text_col), run, f"{row_type(df, passed)}id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select("__row" if passed else id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
