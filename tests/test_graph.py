import inspect
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import coverage as cov
from cairn.operators import graph, intervals


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, c) for a, b, k, c in rows], "src string, dst string, kind string, conf string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def test_neighbors_with_a_cycle(spark):
    e = edges(spark, ("a", "b", "calls", "exact"), ("b", "a", "calls", "exact"))
    assert [(r.node, r.hop) for r in graph.neighbors(e, seeds(spark, "a"), 5).collect()] == [("b", 1)]


def test_impact(spark):
    e = edges(spark, ("calculate_ratio", "divide", "calls", "exact"), ("run_batch", "divide", "calls", "heuristic"), ("main_pipeline", "calculate_ratio", "calls", "exact"))
    got = {(r.symbol, r.hop) for r in graph.impact(e, seeds(spark, "divide"), 2).collect()}
    assert got == {("divide", 0), ("calculate_ratio", 1), ("run_batch", 1), ("main_pipeline", 2)}
    tests = spark.createDataFrame([("divide", "t1"), ("run_batch", "t2"), ("main_pipeline", "t3"), ("x", "t4")], "symbol string, test string")
    assert graph.impacted_tests(graph.impact(e, seeds(spark, "divide"), 2), tests, ["seed"]).count() == 3


def test_expand_takes_the_best_weakest_of_the_shortest_paths(spark):
    e = edges(spark, ("s", "a", "calls", "heuristic"), ("s", "b", "calls", "exact"), ("a", "t", "calls", "exact"), ("b", "t", "calls", "exact"), ("s", "u", "calls", "heuristic"))
    start = spark.createDataFrame([("s", 1.0)], "seed string, score double")
    got = {r.node: round(r.score, 6) for r in graph.expand(e, start).collect()}
    assert got == {"a": 0.3, "b": 0.5, "t": 0.25, "u": 0.3}


def test_overrides_only_with_the_flag(spark):
    e = edges(spark, ("main", "Shape.draw", "calls", "exact"), ("Square", "Shape", "inherits", "exact"))
    symbols = spark.createDataFrame([("Shape.draw", "method", "Shape"), ("Square.draw", "method", "Square"), ("Shape", "class", ""), ("Square", "class", "")], "qualname string, kind string, parent string")
    start = spark.createDataFrame([("main", 1.0)], "seed string, score double")
    plain = {r.node for r in graph.expand(e, start, graph.ExpandConfig(hops=1), symbols=symbols).collect()}
    more = {r.node for r in graph.expand(e, start, graph.ExpandConfig(hops=1, include_overrides=True), symbols=symbols).collect()}
    assert (plain, more) == ({"Shape.draw"}, {"Shape.draw", "Square.draw"})


def test_waves(spark):
    nodes = spark.createDataFrame([("n1",), ("n2",), ("n3",), ("n4",)], "node string")
    on = spark.createDataFrame([("n3", "n1"), ("n4", "n2"), ("n4", "n3"), ("n4", "unknown")], "node string, on string")
    assert {r.node: r.wave for r in graph.topological_waves(nodes, on).collect()} == {"n1": 1, "n2": 1, "n3": 2, "n4": 3}
    with pytest.raises(graph.CycleError):
        graph.topological_waves(nodes, spark.createDataFrame([("n1", "n2"), ("n2", "n1")], "node string, on string"))


def test_suffixes(spark):
    got = {r.suffix: r.module for r in graph.suffix_index(spark.createDataFrame([("a.b.c",), ("x.b.c",), ("c",)], "module string")).collect()}
    assert got == {"a.b.c": "a.b.c", "x.b.c": "x.b.c", "c": "c", "b.c": None}


def test_best_edges(spark):
    e = edges(spark, ("a", "b", "calls", "ambiguous"), ("a", "b", "calls", "exact"))
    assert [r.conf for r in graph.best_edges(e).collect()] == ["exact"]


def test_coverage(spark):
    chunks = spark.createDataFrame([("shop/cart.py", "Cart.add_item", 1, 5), ("shop/cart.py", "Cart.__init__", 6, 9), ("shop/cart.py", "Cart.__len__", 10, 11), ("tests/test_cart.py", "helper", 1, 3)], "path string, symbol string, start_line int, end_line int")
    tests = spark.createDataFrame([("t::a", "add_item"), ("t::a", "Cart"), ("t::b", "__len__"), ("t::b", "helper")], "test_id string, name string")
    static = {(r.symbol_id, r.test_id) for r in cov.from_names(tests, chunks).collect()}
    assert static == {("shop/cart.py::Cart.add_item", "t::a"), ("shop/cart.py::Cart.__init__", "t::a")}
    ran = spark.createDataFrame([("shop/cart.py", 2, "t::a"), ("shop/cart.py", 7, ""), ("shop/cart.py", 10, "t::b")], "path string, line int, context string")
    dynamic = {(r.symbol_id, r.test_id) for r in cov.from_lines(ran, chunks, F.col("context")).collect()}
    assert dynamic == {("shop/cart.py::Cart.add_item", "t::a"), ("shop/cart.py::Cart.__len__", "t::b")}


def test_overlap_at_the_border(spark):
    gold = spark.createDataFrame([("a", 10, 20)], "path string, start_line int, end_line int")
    for s, e, n in ((1, 9, 0), (20, 25, 1), (5, 30, 1)):
        assert cov.overlaps(gold, spark.createDataFrame([("a", s, e)], "path string, start_line int, end_line int")).count() == n


def test_steps_are_not_cut_short(spark):
    deep = edges(spark, *((f"n{k + 1}", f"n{k}", "inherits", "exact") for k in range(6)))
    assert graph.descendants(deep).count() == graph.descendants(deep, most=6).count() == 21
    with pytest.raises(graph.UnfinishedError):
        graph.descendants(deep, most=3)
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(5)], "node string")
    on = spark.createDataFrame([(f"n{k + 1}", f"n{k}") for k in range(4)], "node string, on string")
    assert graph.topological_waves(nodes, on, most=5).count() == 5
    with pytest.raises(graph.UnfinishedError):
        graph.topological_waves(nodes, on, most=3)


@pytest.mark.parametrize("operator", (graph.descendants, graph.topological_waves))
def test_steps_have_no_bound_of_their_own(operator):
    assert inspect.signature(operator).parameters["most"].default is None


def test_a_long_chain_closes_in_few_rounds(spark, monkeypatch):
    cuts = []
    plain = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    n = 300
    chain = spark.range(n).selectExpr("concat('n', id + 1) AS src", "concat('n', id) AS dst", "'inherits' AS kind", "'exact' AS conf")
    assert graph.descendants(chain).count() == n * (n + 1) // 2
    assert len(cuts) < 22  # two a round
    ring = edges(spark, *((f"n{k}", f"n{(k + 1) % 7}", "inherits", "exact") for k in range(7)))
    assert graph.descendants(ring).count() == 49


def first_by_hand(cls, name, bases, members, seen):
    if cls in seen:
        return None
    seen.add(cls)
    if (cls, name) in members:
        return cls
    return next((o for _, b in sorted(bases.get(cls, ())) if (o := first_by_hand(b, name, bases, members, seen))), None)


def test_members_come_from_the_first_base_depth_first(spark):
    """Random classes with diamonds and cycles against a recursive walk with one set of visited classes."""
    dice = random.Random(9)
    names = [f"c{k}" for k in range(60)]
    bases = {c: [(p, dice.choice(names)) for p in range(dice.choice([0, 1, 2, 3]))] for c in names}
    members = {(dice.choice(names), dice.choice("fgh")) for _ in range(25)}
    asked = [(c, m) for c in names for m in "fgh"]
    got = graph.inherited(
        spark.createDataFrame(asked, "cls string, name string"),
        spark.createDataFrame([(c, p, b) for c, own in bases.items() for p, b in own], "cls string, pos int, base string"),
        spark.createDataFrame(sorted(members), "owner string, name string"),
    )
    want = {(c, m): o for c, m in asked if (o := first_by_hand(c, m, bases, members, set()))}
    assert {(r.cls, r.name): r.owner for r in got.collect()} == want and len(want) > 60


def test_sweeps_against_all_pairs(spark, monkeypatch):
    """Random spans over several blocks: nested, crossing, equal, of no length; lines in and out of them."""
    monkeypatch.setattr(intervals, "BITS", 4)
    dice = random.Random(6)
    span = lambda: (s := dice.randrange(1, 90), s + dice.choice([-1, 0, 3, 10, 60]))
    spans = [(dice.choice("pq"), f"n{dice.randrange(40)}", *span()) for _ in range(70)]
    lines = [(dice.choice("pqr"), dice.randrange(1, 130), dice.choice(["t1", "t2", "t3", None])) for _ in range(200)]
    schema = "path string, name string, start_line int, end_line int"
    held = spark.createDataFrame(spans, schema)
    asked = spark.createDataFrame(lines, "path string, line int, tag string")
    inside = [(p, x, t, n, s, e) for p, x, t in lines for q, n, s, e in spans if p == q and s <= x <= e]
    want = {}
    for p, x, _, n, s, e in inside:
        want[p, x] = min(want.get((p, x), (999,)), (e - s, s, n))
    assert {(r.path, r.line): r.name for r in intervals.innermost(asked, held).collect()} == {k: v[2] for k, v in want.items()}
    got = intervals.spans_of_lines(asked, held).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(p, n, t) for p, _, t, n, _, _ in inside if t}
    other = [(dice.choice("pq"), f"m{k}", *span()) for k in range(12)]
    met = intervals.overlapping(held, spark.createDataFrame(other, schema)).collect()
    assert sorted(tuple(r) for r in met) == sorted((p, n, s, e) for p, n, s, e in spans if any(p == q and max(s, u) <= min(e, v) for q, _, u, v in other if u <= v) and s <= e)


def test_one_hot_path(spark):
    """Ten thousand lines under two thousand spans of one file are swept in the order of their number."""
    spans = spark.range(2000).selectExpr("'hot' AS path", "concat('s', id) AS name", "cast(id AS INT) + 1 AS start_line", "cast(10000 - id AS INT) AS end_line")
    lines = spark.range(1, 10001).selectExpr("'hot' AS path", "cast(id AS INT) AS line", "'t' AS tag")
    got = {r.line: r.name for r in intervals.innermost(lines, spans).collect()}
    assert len(got) == 10_000 and got[1] == "s0" and got[5000] == "s1999" and got[10_000] == "s0" and got[1500] == "s1499"
    assert intervals.spans_of_lines(lines, spans).count() == 2000


def test_members_over_random_cycles(spark, monkeypatch):
    """The owner that a depth-first search finds, whatever the cycles; only questions that lead into a cycle are walked one by one."""
    rng = random.Random(5)
    bases = {g: {c: [rng.randrange(30 * g, c + 3 if c + 3 < 30 * g + 30 and cyclic else max(c, 30 * g + 1)) for _ in range(rng.randrange(4))] if c > 30 * g or cyclic else [] for c in range(30 * g, 30 * g + 30)} for g, cyclic in ((0, False), (1, True), (2, True), (3, True))}
    ways = {c: b for some in bases.values() for c, b in some.items()}
    holds = {(c, n) for c in ways for n in "ab" if rng.random() < 0.12}

    def search(c, name, seen):
        if (c, name) in holds:
            return c
        seen.add(c)
        return next((x for b in ways[c] if b not in seen and (x := search(b, name, seen)) is not None), None)

    want = {(str(c), n, str(x)) for c in ways for n in "ab" if (x := search(c, n, set())) is not None}
    asked = spark.createDataFrame([(str(c), n) for c in ways for n in "ab"], "cls string, name string")
    steps = spark.createDataFrame([(str(c), p, str(b)) for c, some in ways.items() for p, b in enumerate(some)], "cls string, pos int, base string")
    members = spark.createDataFrame([(str(c), n) for c, n in holds], "owner string, name string")
    walked, old = [], graph._walks
    monkeypatch.setattr(graph, "_walks", lambda a, *more: walked.extend(a.collect()) or old(a, *more))
    assert {tuple(r) for r in graph.inherited(asked, steps, members).select("cls", "name", "owner").collect()} == want
    assert walked and all(int(r.cls) >= 30 for r in walked)


def test_only_cycles_and_ways_over_steps_taken_are_walked(spark, monkeypatch):
    """A hundred questions lead into one cycle by their first steps; the way out of it leads over two of their classes, which other ways must go around."""
    ways = {"a": ["b"], "b": ["a", "x"], "x": ["t2", "z"], "t1": ["a"], "t2": ["t1", "y"], "y": [], "z": []}
    ways |= {f"u{k}": ["t1", "z"] for k in range(60)} | {f"v{k}": ["t2", "y"] for k in range(40)}
    holds = {("y", "m"), ("z", "m")}
    steps = spark.createDataFrame([(c, p, b) for c, some in ways.items() for p, b in enumerate(some)], "cls string, pos int, base string")
    walked, old = [], graph._walks
    monkeypatch.setattr(graph, "_walks", lambda a, *more: walked.extend(a.collect()) or old(a, *more))
    got = graph.inherited(spark.createDataFrame([(c, "m") for c in ways], "cls string, name string"), steps, spark.createDataFrame([("y", "m"), ("z", "m")], "owner string, name string"))
    plain = {c: list(enumerate(b)) for c, b in ways.items()}
    want = {c: first_by_hand(c, "m", plain, holds, set()) for c in ways}
    assert {r.cls: r.owner for r in got.collect()} == want and want["u0"] == "y" and want["v0"] == "z"
    assert {r.cls for r in walked} == {"a", "b", "x", "t2"}


def test_overrides_are_sought_from_the_classes_that_have_methods(spark, monkeypatch):
    """Pairs of classes that nobody asks for aren't made; those that are agree with the whole closure, over cycles and long chains."""
    rng = random.Random(5)
    pairs = {(f"n{a}", f"n{rng.randrange(40)}") for a in range(40) for _ in range(2)} | {(f"m{k + 1}", f"m{k}") for k in range(30)}
    e = edges(spark, *((a, b, "inherits", "exact") for a, b in sorted(pairs)))
    symbols = spark.createDataFrame([(f"{c}.run", "method", c) for c in ("n1", "n7", "n30", "m0", "m30")] + [("m29", "class", "")], "qualname string, kind string, parent string")
    asked = graph.classes_of(symbols)
    assert {r.node for r in asked.collect()} == {"n1", "n7", "n30", "m0", "m30"}
    monkeypatch.setattr(graph, "ROUNDS", 2)  # steps double early
    got = graph.ancestors(asked, e).collect()
    whole = graph.descendants(e)
    assert len(got) == len(set(got)) and set(got) == set(whole.join(asked.withColumnRenamed("node", "node_below"), "node_below").select("ancestor", "node_below").collect())
    methods = symbols.select(F.col("qualname").alias("node"))
    assert set(graph.overrides(methods, symbols, graph.ancestors(asked, e)).collect()) == set(graph.overrides(methods, symbols, whole).collect()) != set()
    assert graph.ancestors(asked.limit(0), e).count() == 0
