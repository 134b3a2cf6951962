"""Importance resampling towards a target distribution over hashed features.

A feature is a run of 1 to `most_words` consecutive words of a text, joined by one space; it counts in the bucket that the CRC-32 of
its bytes picks. The gain of a bucket is the logarithm of its share in the target over its share in the documents, in thousandths,
kept as an array of integers; a document's weight is the sum of its features' gains. A document's score adds a Gumbel number that is
drawn from its id, so the highest scores are a sample without replacement whose odds are the weights.

The draw: each task scores its documents and leaves them as sorted runs, cut into blocks and stored in the shared checkpoint folder.
Quantiles of the scores cut them into ranges; a count for each range tells the rank at which it begins and the range in which the draw
ends. Each range's blocks are then merged by a tournament of their runs, which emits ranks and stops after the exact number of
draws; ranges behind it are never shuffled or sorted. A task holds a block of each run.

What goes through the driver: the counts of buckets (`buckets` of them) and of ranges (RANGES at most).

Odd rows: a null or empty text, or one without words, has no features, weight 0, and is not drawn. A null id is hashed as the empty
text and comes behind other ids in ties; rows with one id are drawn each, in order of their number of features if scores tie, and in
any order if they agree in that as well. Long texts are read whole, a stretch at a time. Without documents there are no rows; without
a target every gain is what an empty target gives. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import each, map_arrow, materialise
from cairn.llm.decontamination import TO_WORDS
from cairn.llm.runs import BLOCK, RUN, Tournament, merge

#: Eligible rows of a range, and ranges at most: beyond that, ranges hold more rows, still merged in blocks.
RANGE_ROWS, RANGES = 50_000, 4096
#: Bytes of a text that are split into words at once, and what ends a word.
STRETCH = 1 << 20
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


class Buckets(dict):
    """The bucket of a feature; features that were asked for before are remembered, up to a number."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        at = self[feature] = crc32(feature) % self.buckets
        return at


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, about STRETCH bytes of it at a time."""
    low = 0
    while low < len(text):
        high = min(low + STRETCH, len(text))
        if high < len(text):  # to the end of a word
            gap = GAP.search(text, high)
            high = gap.start() if gap else len(text)
        yield text[low:high].translate(TO_WORDS).split()
        low = high


def features(text: bytes | None, most_words: int, bucket: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """Stretch by stretch: how many words it has, and the buckets of the features that end in it."""
    before: list[bytes] = []
    for words in stretches(text or b""):
        found = [np.fromiter(map(bucket.__getitem__, words), np.int64, len(words))]
        every = before + words
        for n in range(2, most_words + 1):
            ends = range(max(len(before), n - 1), len(every))
            found.append(np.array([bucket[b" ".join(every[e - n + 1 : e + 1])] for e in ends], np.int64))
        yield len(words), np.concatenate(found)
        before = every[max(0, len(every) - most_words + 1) :] if most_words > 1 else []


def bucket_counts(texts: DataFrame, text_col: str = "text", most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of all features of all texts: each task adds up its own, then the tasks' counts are added."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        bucket, n = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in each(b["text"]):
                for _, found in features(text, most_words, bucket):
                    n += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(n)
        yield {"bucket": there.astype(np.int32), "n": n[there]}

    parts = map_arrow(texts.select(F.col(f"`{text_col}`").alias("text")), count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths, from the features of documents and target in it."""
    s_all, t_all = sum(own.values()), sum(target.values())
    share = lambda k: ((target.get(k, 0) + 1) * (s_all + buckets)) / ((own.get(k, 0) + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(share(k))) for k in range(buckets)], np.int64)


def noise(seed: int, name) -> int:
    """A Gumbel number in thousandths, drawn from an id."""
    h = int(sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def order(row: tuple) -> tuple:
    """The key by which rows (id, n_features, weight, score) are drawn: score down, id up, null last."""
    name, n_features, _, score = row
    return (-score, name is None, 0 if name is None else name, n_features)


COLUMNS = ("id", "n_features", "weight", "score")


def scored_runs(docs: DataFrame, gain: np.ndarray, most_words: int, seed: int, at_least: int, kind: str) -> DataFrame:
    """docs (id, text) as blocks of sorted runs: (run, eligible, first, id[], n_features[], weight[], score[]), first being the first score."""
    buckets = len(gain)

    def score(batches: Iterator[dict]) -> Iterator[dict]:
        bucket, task = Buckets(buckets), TaskContext.get().partitionId()
        rows: dict[bool, list[tuple]] = {True: [], False: []}
        made = 0

        def leave(eligible: bool) -> Iterator[dict]:
            nonlocal made
            made += 1
            some = sorted(rows[eligible], key=order) if eligible else rows[eligible]
            for k in range(0, len(some), BLOCK):
                block = some[k : k + BLOCK]
                yield {"run": [(task << 24) + made], "eligible": [eligible], "first": [block[0][3]]} | {c: [[r[i] for r in block]] for i, c in enumerate(COLUMNS)}
            rows[eligible] = []

        for b in batches:
            for name, text in zip(b["id"].to_pylist(), each(b["text"]), strict=True):
                n_words = n_features = weight = 0
                for n, found in features(text, most_words, bucket):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gain[found].sum())
                eligible = n_words >= at_least
                rows[eligible].append((name, n_features, weight, weight + noise(seed, name)))
                if len(rows[eligible]) >= RUN:
                    yield from leave(eligible)
        for eligible in (True, False):
            yield from leave(eligible)

    return map_arrow(docs, score, f"run long, eligible boolean, first long, id array<{kind}>, n_features array<long>, weight array<long>, score array<long>")


def entries(b: dict, k: int) -> list[tuple]:
    """The rows (id, n_features, weight, score) of a block."""
    return list(zip(*(b[c][k].as_py() for c in COLUMNS), strict=True))


def rows_out(rows: list[tuple], ranks: list[int | None]) -> dict:
    return {c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)} | {"rank": ranks}


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, at_least: int = 20, most_words: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank): every document; of those with `at_least` words, `percent` in a hundred are drawn and have a rank.

    target has a column named as text_col.
    """
    count = lambda df: {r["bucket"]: r["n"] for r in bucket_counts(df, text_col, most_words, buckets).collect()}  # noqa: E731  a row for each bucket
    gain = gains(count(docs), count(target), buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    runs = materialise(scored_runs(named, gain, most_words, seed, at_least, kind))
    own = runs.where("eligible")
    draws = percent * (own.agg(F.sum(F.size("score"))).first()[0] or 0) // 100
    below, begin, last = _ranges(own, draws, percent)

    def range_of(scores: np.ndarray) -> np.ndarray:
        return len(below) - np.searchsorted(below, scores, "right")

    def split(batches: Iterator[dict]) -> Iterator[dict]:
        """The parts of each block that the ranges to be merged hold."""
        for b in batches:
            for k in range(len(b["run"])):
                rows = entries(b, k)
                at = range_of(np.array([r[3] for r in rows], np.int64))
                for r in np.unique(at[at <= last]):
                    part = [rows[i] for i in np.flatnonzero(at == r)]
                    yield {"range": [int(r)], "run": [b["run"][k].as_py()], "first": [part[0][3]]} | {c: [[x[i] for x in part]] for i, c in enumerate(COLUMNS)}

    def draw(batches: Iterator[dict]) -> Iterator[dict]:
        """Ranks from where each range begins; behind the last draw, rows without a rank in any order."""

        def blocks(todo: list) -> Iterator[tuple]:
            while todo[0] is not None and todo[0][0] == at:
                _, run, rows = todo[0]
                yield run, [(order(r), r) for r in rows]
                todo[0] = next(stream, None)

        stream = ((b["range"][k].as_py(), b["run"][k].as_py(), entries(b, k)) for b in batches for k in range(len(b["run"])))
        todo = [next(stream, None)]
        while todo[0] is not None:
            at, tree = todo[0][0], Tournament()
            rank, out, mine = begin[at], [], blocks(todo)
            merged = merge(mine, tree)
            while rank < draws and (x := next(merged, None)) is not None:
                rank += 1
                out.append(x[1])
                if len(out) >= BLOCK:
                    yield rows_out(out, [*range(rank - len(out) + 1, rank + 1)])
                    out = []
            yield rows_out(out, [*range(rank - len(out) + 1, rank + 1)])
            merged.close()
            undrawn = [x[1] for x in tree.rest()]
            yield rows_out(undrawn, [None] * len(undrawn))
            for _, some in mine:
                yield rows_out([x[1] for x in some], [None] * len(some))

    def others(batches: Iterator[dict]) -> Iterator[dict]:
        """The rows behind the ranges that were merged, and those that can't be drawn."""
        for b in batches:
            for k in range(len(b["run"])):
                rows = entries(b, k)
                if b["eligible"][k].as_py():
                    at = range_of(np.array([r[3] for r in rows], np.int64))
                    rows = [rows[i] for i in np.flatnonzero(at > last)]
                yield rows_out(rows, [None] * len(rows))

    final = f"id {kind}, n_features long, weight long, score long, rank long"
    out = map_arrow(runs, others, final)
    if draws:
        parts = map_arrow(own, split, "range int, " + runs.drop("eligible").schema.simpleString()[7:-1])
        heads = [F.col("first").desc(), F.get("id", F.lit(0)).asc_nulls_last(), F.get("n_features", F.lit(0))]  # as order() has them
        dealt = parts.repartitionById(last + 1, "range").sortWithinPartitions("range", *heads)
        out = map_arrow(dealt, draw, final).unionByName(out)
    return out.withColumnRenamed("id", id_col)


def _ranges(own: DataFrame, draws: int, percent: int) -> tuple[np.ndarray, list[int], int]:
    """Scores that cut the eligible rows into ranges (ascending; range 0 is the highest), the rows before each range, and the last range to be merged."""
    if not draws:
        return np.zeros(0, np.int64), [], -1
    n = min(RANGES, math.ceil(100 * draws / percent / RANGE_ROWS))
    each_score = own.select(F.explode("score").alias("s"))
    cuts = each_score.agg(F.percentile_approx("s", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    below = np.array(sorted(set(cuts)), np.int64)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        n = np.zeros(len(below) + 1, np.int64)
        for b in batches:
            n += np.bincount(len(below) - np.searchsorted(below, b["score"].flatten().to_numpy(zero_copy_only=False), "right"), minlength=len(n))
        yield {"range": np.arange(len(n), dtype=np.int32), "n": n}

    held = {r["range"]: r["n"] for r in map_arrow(own.select("score"), count, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect()}
    ends = np.cumsum([held.get(k, 0) for k in range(len(below) + 1)])
    return below, [0, *(int(x) for x in ends[:-1])], int(np.searchsorted(ends, draws))
