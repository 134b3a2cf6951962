import random

import pytest

from cairn.llm import jaccard_join
from cairn.llm.components import connected


def sets_by_hand(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def components_by_hand(rows):
    sets = sets_by_hand(rows)
    top = list(range(len(rows)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                top[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(s), str(least.get(find(k), i) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def test_against_all_pairs(spark, docs):
    rng = random.Random(5)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(n)]
    passage = words(30)
    rows = [(0, None), (1, ""), (2, "one Two"), (3, "one two"), (4, "ONE two three four five"), (None, "one two")]
    for base in range(25):
        text = words(rng.randint(6, 120))
        for _ in range(rng.randint(1, 7)):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words(1))
            rows.append((10 + len(rows), " ".join(copy)))
        rows.append((10 + len(rows), " ".join(words(rng.randint(5, 15)) + passage)))  # all share a passage
    rows += [(900, rows[-1][1]), (900, rows[-1][1])]
    got = jaccard_join.near_duplicates(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_hand(rows)


def test_a_large_group_with_rounds(spark, docs):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        copy = list(base)
        for k in rng.sample(range(60), rng.randint(0, 3)):
            copy[k] = f"x{i}_{k}"
        rows.append((i, " ".join(copy)))
    got = jaccard_join.near_duplicates(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_hand(rows)


def test_rows_without_an_id_link_and_carry_chains(spark, docs):
    """Also where most rows lack one, and one such row is repeated very often."""
    rng = random.Random(8)
    base = [f"c{i}" for i in range(60)]
    rows = [(None if k % 3 else k, " ".join(w if i not in (4 * k, 4 * k + 1) else f"y{k}_{i}" for i, w in enumerate(base))) for k in range(1, 12)]
    chain = [f"d{i}" for i in range(80)]
    rows += [(20 if k == 0 else 21 if k == 5 else None, " ".join(chain[k : k + 60])) for k in range(6)]  # only neighbours but a few apart link
    rows += [(None, " ".join(chain[2:62]))] * 60 + [(None, " ".join(f"z{i}" for i in range(30)))] * 3
    rng.shuffle(rows)
    got = jaccard_join.near_duplicates(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components_by_hand(rows)


def test_names_that_collide(spark, docs, monkeypatch):
    """Where first hashes collide, sets are told apart by the second."""
    real = jaccard_join._names
    some = jaccard_join.shingle_sets([b"a b c d e f"], 5)[0]
    assert jaccard_join._node(some, frozenset()) == real(some)[0] and jaccard_join._node(some, frozenset([real(some)[0]])) == real(some)[1]
    monkeypatch.setattr(jaccard_join, "_names", lambda s: (real(s)[0] % 3, real(s)[1]))
    frame = docs([(i, " ".join(f"w{i}_{k}" for k in range(9))) for i in range(30)])
    rows, _, collided = jaccard_join.describe(frame, "doc_id", "text", 5)
    assert rows.select("node").distinct().count() == 30 and collided == {0, 1, 2}
    monkeypatch.setattr(jaccard_join, "COLLISIONS", 2)
    with pytest.raises(RuntimeError):
        jaccard_join.describe(frame, "doc_id", "text", 5)


def test_long_texts(spark, docs):
    rng = random.Random(9)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(60_000)]
    near = list(base)
    for k in range(0, 60_000, 60):
        near[k] = f"n{k}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(reversed(base)))]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.near_duplicates(docs(rows)).collect()}
    assert got[2][0] == 1 and got[3][0] == 3 and got[1][1] == len(sets_by_hand(rows)[0])


def test_empty_table(spark, docs):
    assert jaccard_join.near_duplicates(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, 201 + k) for k in range(20)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(20)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(200, 221)} == {200} and 100 not in got
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_unfinished_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        connected(chain, rounds=1)
