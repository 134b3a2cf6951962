"""Resampling, exact dedup and clustering against plain versions, and the merge that two of them share."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import centroid_clustering, exact_dedup, importance_resampling, runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1), max_size=12), st.integers(1, 4), st.integers(0, 40))
def test_merge(numbers, size, stop):
    blocks = sorted((r[k : k + size], n) for n, r in enumerate(map(sorted, numbers)) for k in range(0, len(r), size))
    tree, todo = runs.Tournament(), iter([(n, [(x,) for x in b]) for b, n in blocks])
    every = sorted(x for r in numbers for x in r)
    merged = runs.merge(todo, tree)
    first = [x for x, _ in zip((e[0] for e in merged), range(stop), strict=False)]
    merged.close()
    left = [x for x, in tree.rest()] + [x for _, b in todo for x, in b]
    # zip() takes one more from the merge than it gives, where there is one
    taken = every[len(first) : len(first) + 1] if len(every) > stop else []
    assert first == every[:stop] and sorted(left + taken) == every[stop:]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def drawn_by_hand(rows, target, percent, at_least, most, buckets, seed):
    feats = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)) for texts in ([x for _, x in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in feats(x))
        out.append([i, len(feats(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= at_least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in out)))


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, docs, monkeypatch, most):
    """Nulls, empty and long texts, ties, repeated rows, rows of several ranges; blocks and stretches are small here, so that there are many."""
    monkeypatch.setattr(importance_resampling, "RANGE_ROWS", 40)
    dice = random.Random(5)
    rows = [(i, " ".join(f"W{min(dice.randrange(60), dice.randrange(60))}é" for _ in range(dice.choice([0, 19, 20, 21, 50])))) for i in range(260)]
    rows += [(None, None), (7, rows[7][1]), (None, "a b " * 12), (400, "a B-" * 12), (401, None), (402, ""), (403, "ünï " * 30_000 + "x" * 1_500_000)]
    target = ["w1é w2é w3é", None, "", "a b"]
    frame = docs(rows).repartition(5)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for percent in (0, 10, 55, 100):
        got = importance_resampling.resample(frame, goal, percent, most_words=most, buckets=500)
        assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r.rank]) for r in got.collect()) == drawn_by_hand(rows, target, percent, 20, most, 500, 2024)
    assert importance_resampling.resample(docs([]), goal).count() == 0
    alone = importance_resampling.resample(frame, goal.limit(0), 50)
    assert alone.where("rank is not null").count() == alone.where("n_features >= 20").count() // 2


def test_stretches():
    text = ("Ab, cd " * 50 + "é" * 999 + " x").encode()
    small, importance_resampling.STRETCH = importance_resampling.STRETCH, 7
    try:
        assert [w.decode() for some in importance_resampling.stretches(text) for w in some] == words(text.decode())
    finally:
        importance_resampling.STRETCH = small


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, docs, monkeypatch, keep):
    """Nulls, empty and long texts, repeated rows and ids, case, and a text that half of all rows share over many partitions."""
    monkeypatch.setattr(exact_dedup, "BITS", 2)
    dice = random.Random(6)
    rows = [(dice.randrange(500), dice.choice(["hot", "HOT"] * 3 + [f"text {dice.randrange(120)}", f"TEXT {dice.randrange(120)}", "É", "é", "", None])) for _ in range(900)]
    rows += [(None, "hot"), (None, "only null"), (None, "Only null"), (3, "x" * 300_000), (2, "X" * 300_000), (5, "once")]
    got = exact_dedup.exact_duplicates(docs(rows).repartition(19), keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = max if keep == "largest" else min
    want = []
    for t, ids in groups.items():
        k = best([i for i in ids if i is not None], default=None)
        want += [(i, k, len(ids), sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(str, want))
    stays = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in stays) == Counter(sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in stays)
    assert exact_dedup.exact_duplicates(docs([]), keep).count() == 0


def test_a_digest_that_lies():
    """Entries are verified whenever they are combined."""
    keeper = exact_dedup.Keeper("largest")
    with pytest.raises(ValueError, match="different texts"):
        list(keeper.combined(iter([(b"a" * 32, 1, 5, 1, 1, 1), (b"a" * 32, 2, 5, 2, 2, 1)])))
    with pytest.raises(ValueError, match="largest or smallest"):
        exact_dedup.Keeper("any")


def lloyd_by_hand(rows, clusters, rounds, dims, scale=256, seed=2):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in fine]
    cents = [v for _, v in sorted(x, key=lambda r: (sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for k in range(rounds + 1):
        at = [min((dist(v, c), n) for n, c in enumerate(cents)) for _, v in x]
        for n in range(len(cents)) if k < rounds else ():
            own = [v for (_, v), (_, m) in zip(x, at, strict=True) if m == n]
            if own:
                cents[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    inertia = Counter()
    for d, n in at:
        inertia[n] += d
    return sorted(str((i, n, d, inertia[n], inertia.total(), sha256(",".join(map(str, cents[n])).encode()).hexdigest())) for (i, _), (d, n) in zip(x, at, strict=True))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_sort_means(spark, kind):
    """Null, short, long and non-finite vectors, ties, copies, repeated and null ids, a column of a name that is used inside."""
    dice = random.Random(7)
    some = [[dice.choice([-2.0, -1.5, 0.25, 0.5, 3.0]) for _ in range(3)] for _ in range(30)]
    rows = [(i, dice.choice(some)) for i in range(300)] + [(None, some[0]), (None, some[1]), (4, some[2]), (4, some[3])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [float("inf"), 0.0, 0.0]), (906, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, v int")
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for clusters, rounds in ((7, 3), (1, 1), (40, 5), (500, 1)):
        assert plain(centroid_clustering.sort_means(frame, clusters, rounds, dims=3)) == lloyd_by_hand(rows, clusters, rounds, 3)
    assert plain(centroid_clustering.sort_means(frame.limit(0), 7, 2, dims=3)) == []
    assert centroid_clustering.sort_means(frame, 7, 2, dims=9).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sort_means_skips():
    """The scan stops, and what it skips is never as near."""
    dice = np.random.default_rng(1)
    centroids = dice.integers(-300, 300, (50, 8))
    model = centroid_clustering.SortMeans(centroids)
    v = centroids[dice.integers(0, 50, 4000)] + dice.integers(-40, 40, (4000, 8))
    asked = []
    plain = centroid_clustering.SortMeans.squared
    model.squared = lambda a, b: asked.append(len(a)) or plain(a, b)
    full = ((v[:, None] - centroids) ** 2).sum(2)
    at = np.argmin(full, 1)
    who, best = model.nearest(v, at)
    assert (who == at).all() and (best == full.min(1)).all()
    assert sum(asked) < 0.2 * full.size
    assert (model.nearest(v, np.zeros(4000, int))[0] == at).all()


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component is"):
        centroid_clustering.sort_means(frame, 2, 1, dims=2).count()
