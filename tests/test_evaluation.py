from pyspark.sql import functions as F

from cairn.operators import evaluation as ev
from cairn.operators import ledger
from cairn.sources import tasks


def test_recall_and_rates(spark):
    evidence = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.9), (1, "a", 0.8)], "q int, path string, score double")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "q int, path string")
    assert abs(ev.recall_files(evidence, gold, 3, ["q"]).first().recall - 2 / 3) < 1e-12
    runs = spark.createDataFrame([(True, True, 1.0), (False, False, 3.0), (None, None, None)], "resolved boolean, regressed boolean, cost double")
    r = runs.agg(ev.resolve_rate(F.col("resolved")).alias("a"), ev.regression_rate(F.col("regressed")).alias("b"), ev.cost_per_resolved(F.col("cost"), F.col("resolved")).alias("c")).first()
    assert (round(r.a, 6), r.b, r.c) == (0.333333, 0.5, 4.0)
    assert runs.where("not resolved").agg(ev.cost_per_resolved(F.col("cost"), F.col("resolved"))).first()[0] is None


def test_a_crash_counts_as_no_recall(spark):
    records = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "rec int, task_id int")
    gold = spark.createDataFrame([(1, "a")], "task_id int, path string")
    evidence = spark.createDataFrame([(1, "a", 1.0)], "rec int, path string, score double")
    assert ev.mean_recall(records, evidence, gold, 5, ["rec"]).first().mean_recall == 0.5


def test_across_runs(spark):
    rows = spark.createDataFrame([("c", 0, True), ("c", 1, False)], "config string, run_idx int, resolved boolean")
    r = ev.across_runs(rows, ev.resolve_rate(F.col("resolved")), ["config"]).first()
    assert (r.mean, r.spread) == (0.5, 0.5)


def test_routing(spark):
    replies = spark.createDataFrame([("t", '{"confidence": 0.92}', True), ("t", '{"confidence": 0.40}', True), ("t", "text", True), ("t", " ", True), ("plan", "x", False)], "task string, content string, require_json boolean")
    got = [(r.tier, r.attempts, r.reason) for r in ledger.route(replies, strong_tasks=("plan",)).collect()]
    assert got == [("cheap", 1, None), ("strong", 2, "low_confidence:0.40<0.75"), ("strong", 2, "invalid_json"), ("strong", 2, "empty_response"), ("strong", 1, None)]
    assert {r.tier for r in ledger.route(replies, enabled=False).collect()} == {"strong"}


def test_costs_and_budget(spark):
    calls = spark.createDataFrame([("small", 1000, 1000), ("other", 1000, 1000)], "model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("small", 0.15, 0.60)], "model string, price_in double, price_out double")
    assert {r.cost for r in ledger.cost_per_million(calls, prices).collect()} == {0.00075}
    assert ledger.Budget.of({"budget": {"loop_cap": 2}}) == ledger.Budget(loops=2) and ledger.Budget.of({}).tokens == 50_000
    steps = spark.createDataFrame([(1, 1, 1, 10, 0.0, 1), (1, 2, 1, 10, 0.0, 1)], "run int, seq int, loops int, tokens int, cost double, calls int")
    cut = ledger.budget_cut(steps, ledger.Budget(loops=2), ["run"], "seq").orderBy("seq").collect()
    assert [r.exceeded for r in cut] == [False, True]


def test_state_folds(spark):
    deltas = spark.createDataFrame([(1, 1, 10, ["a"], None), (1, 2, 25, None, "x"), (1, 3, None, ["b", "c"], None)], "run int, seq int, tokens long, notes array<string>, report string")
    r = ledger.fold_state(deltas, ["run"], "seq", ["tokens"], ["notes"], ["report"]).first()
    assert (r.tokens, r.notes, r.report) == (35, ["a", "b", "c"], "x")
    held = spark.createDataFrame([(1, "c1")], "run int, chunk_id string")
    fresh = ledger.new_evidence(spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (1, "c2", 3)], "run int, chunk_id string, seq int"), held, ["run"], "chunk_id", "seq")
    assert [(r.chunk_id, r.seq) for r in fresh.collect()] == [("c2", 2)]


def test_a_run_is_resumed(spark, tmp_path):
    """A second run computes nothing; errors stay in the result and out of the cache; a changed config is run anew; what failed is run again."""
    asked, path = [], str(tmp_path / "cache")
    broken = {("a", 1)}

    def run(todo):
        rows = todo.collect()
        asked.append(sorted((r.config, r.task_id, r.run_idx) for r in rows))
        made = [(r.config, r.task_id, r.run_idx, r.key, 5 if r.task_id != 3 else 7, 0.0 if r.task_id == 3 else 0.5, "boom" if (r.config, r.task_id) in broken else None) for r in rows]
        return spark.createDataFrame(made, "config string, task_id long, run_idx int, key string, tokens int, cost double, error string")

    grid = ev.grid(spark.createDataFrame([("a",), ("b",)], "config string"), spark.createDataFrame([(1,), (2,), (3,)], "task_id long"), 2)
    first = ev.resume(grid, path, run)
    assert first.count() == 12 and len(asked[0]) == 12 and not first.where("cached").count()
    assert {r.error for r in first.where("task_id = 3").collect()} == {"tokens were used but the cost is 0"}
    again = ev.resume(grid, path, run)
    assert asked[1] == [("a", 1, 0), ("a", 1, 1), ("a", 3, 0), ("a", 3, 1), ("b", 3, 0), ("b", 3, 1)]
    assert again.count() == 12 and again.where("cached").count() == 6
    broken.clear()
    few = grid.where("task_id < 3")
    ev.resume(few, path, run)
    assert asked[2] == [("a", 1, 0), ("a", 1, 1)]
    last = ev.resume(few, path, run)
    assert asked[3] == [] and last.where("cached").count() == 8 and {r.cost for r in last.collect()} == {0.5}
    ev.resume(few, path, run, fingerprint=F.when(F.col("config") == "b", "new").otherwise(""))
    assert {c for c, _, _ in asked[4]} == {"b"} and len(asked[4]) == 4
    ev.resume(few, path, run, use_cache=False)
    assert len(asked[5]) == 8
    assert tasks.cached_records(spark, path).groupBy("key").count().where("count > 1").count() == 0


def test_records_that_share_a_key(spark, tmp_path, monkeypatch):
    """Two runs whose digests meet are both run, cached and read."""
    monkeypatch.setattr(tasks, "record_key", lambda *_: F.lit("0123456789"))
    run = lambda todo: todo.selectExpr("*", "5 as tokens", "0.5d as cost", "cast(null as string) as error")
    grid = ev.grid(spark.createDataFrame([("a",), ("b",)], "config string"), spark.createDataFrame([(1,), (2,), (3,)], "task_id long"), 2)
    path = str(tmp_path / "cache")
    ev.resume(grid.where("task_id = 1 and config = 'a'"), path, run)
    names = lambda rows: sorted((r.config, r.task_id, r.run_idx, r.cached) for r in rows.collect())
    every = [(c, t, r) for c in "ab" for t in (1, 2, 3) for r in (0, 1)]
    assert names(ev.resume(grid, path, run)) == [(*x, x[:2] == ("a", 1)) for x in every]
    assert names(ev.resume(grid, path, run)) == [(*x, True) for x in every]
