"""Composed operators, ordered loading, strict edits, and vector search in several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import composed, evaluation, ledger, vector
from cairn.sources import tasks


def test_navigation_takes_callers_two_hops_away_once(spark):
    edges = spark.createDataFrame([("c", "b", "calls", "exact"), ("b", "a", "calls", "exact"), ("d", "c", "calls", "exact"), ("x", "a", "inherits", "exact")], "src string, dst string, kind string, conf string")
    seeds = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0), (2, "d", 0.25)], "query_id int, symbol string, score double")
    cover = spark.createDataFrame([("c", "t1"), ("d", "t2"), ("z", "t3")], "symbol string, test string")
    pool, tests = composed.navigate(edges, seeds, cover)
    assert sorted(map(tuple, pool.collect())) == [(1, "a", 0.5, 0), (1, "b", 1.0, 0), (1, "c", 0.8, 1), (1, "d", 0.8, 2), (2, "d", 0.25, 0)]
    assert sorted(map(tuple, tests.collect())) == [(1, "t1"), (1, "t2"), (2, "t2")]
    assert composed.navigate(edges, seeds.limit(0))[0].count() == 0


def test_gathering_stops_at_the_budget_and_adds_only_what_is_new(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, None, 4), (2, "a", 1), (3, "a", 1)], "run int, key string, ord int")
    held = spark.createDataFrame([(1, "b")], "run int, key string")
    spent = spark.createDataFrame([(1, 0, 10, 0.0, 1), (2, 3, 10, 0.0, 1)], "run int, loops int, tokens int, cost double, calls int")
    found = composed.gather(rows, held, spent, ledger.Budget(), ["run"], "key", "ord")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1), (3, "a", 1)]
    assert composed.gather(rows, held, spent, None, ["run"], "key", "ord").count() == 3


def test_retrieval_searches_the_queries_that_a_task_names(spark):
    work = spark.createDataFrame([(7, "Fix KeyError in src/a.py: `load` fails")], "task_id int, text string")
    asked = []

    def search(queries, k, by):
        asked.extend(sorted(r.text for r in queries.collect()))
        return spark.createDataFrame([(7, "n1", "bm25", 1.0), (7, "n2", "vector", 0.5)], "task_id int, id string, method string, score double")

    edges = spark.createDataFrame([("n1", "n3", "calls", "exact"), ("n2", "n3", "calls", "heuristic")], "src string, dst string, kind string, conf string")
    held = spark.createDataFrame([(7, "n2")], "task_id int, id string")
    found = composed.retrieve(search, work, edges, held)
    assert {"src/a.py", "KeyError", "load"} <= set(asked)
    assert sorted(map(tuple, found.collect())) == [(7, "n1", "bm25", 1.0), (7, "n3", "graph", 0.5)]


def test_a_query_without_evidence_has_a_context_that_says_so(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = spark.createDataFrame([(1, 2, "b.py", 1, 2, "two"), (1, 1, "a.py", 3, 4, "one")], "query_id int, ord int, path string, start_line int, end_line int, content string")
    shown = dict(map(tuple, composed.prompt_context(asked, rows, ["query_id"]).collect()))
    assert shown == {1: "# File: a.py (lines 3-4)\none\n\n# File: b.py (lines 1-2)\ntwo\n", 2: "# No context retrieved.\n"}


def test_ordered_tasks_name_the_one_that_is_missing(spark):
    ids = spark.createDataFrame([("t2", 0), ("t1", 1)], "task_id string, ord int")
    rows = spark.createDataFrame([("t1", "r"), ("t2", "r"), ("t3", "r")], "instance_id string, repo string")
    assert [r.instance_id for r in tasks.ordered(ids, rows).orderBy("ord").collect()] == ["t2", "t1"]
    with pytest.raises(Exception, match="no such task: t9"):
        tasks.ordered(ids.unionByName(spark.createDataFrame([("t9", 2)], "task_id string, ord int")), rows).collect()


def test_a_strict_edit_without_the_old_text_is_an_error(spark):
    df = spark.createDataFrame([("abcb",)], "t string")
    assert df.select(tx.first_edit(F.col("t"), F.lit("b"), F.lit("X"), strict=True)).first()[0] == "aXcb"
    with pytest.raises(Exception, match="isn't there"):
        df.select(tx.first_edit(F.col("t"), F.lit("z"), F.lit("X"), strict=True)).collect()


def test_top_of_several_blocks_is_that_of_brute_force(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 12))
    m[rng.random(m.shape) < 0.5] = 0
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(60) for j in range(12) if m[i, j]], "id int, bucket int, v double")
    rows = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "id int, vector array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(d)) for q in range(0, 60, 3) for d in np.lexsort((np.arange(60), -np.round(unit @ unit[q], 9)))[:5]}
    asked = rows.where("id % 3 = 0")
    dense = vector.cosine_top(rows, asked, 5, "id", "vector", block_rows=6)
    sparse = vector.sparse_top(cells, cells.where("id % 3 = 0"), 5, dim=12)
    for found in (dense, sparse):
        assert {(r.query_id, r.id) for r in found.collect()} == want
    assert vector.cosine_top(rows, asked.limit(0), 5, "id", "vector").count() == 0


def test_reports_and_vectors_are_written_and_read_again(spark, tmp_path):
    records = spark.createDataFrame([("a", 1, 0, True, False, 1.0, None), ("a", 2, 0, None, None, 2.0, "boom")], "config string, task_id int, run_idx int, resolved boolean, regressed boolean, cost double, error string")
    tasks.write_report(evaluation.config_report(records), records, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/raw")).count() == 2
    assert [r.value for r in spark.read.text(str(tmp_path / "r/table")).collect()] == ["| a | 2 | 1 | 0.500 | 0.000 | 3.000 |"]
    for key in "xy":
        tasks.append_vectors(spark.createDataFrame([(key, [1.0])], "key string, vector array<double>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    with pytest.raises(Exception, match="gold is empty"):
        evaluation.assert_gold(records.limit(0)).collect()


def test_a_search_is_run_once(spark):
    """What a search finds is used many times, by retrieve() and navigate(), and computed once."""
    rows = spark.sparkContext.accumulator(0)
    noted = F.udf(lambda x: rows.add(1) or x, "double").asNondeterministic()
    found = spark.createDataFrame([(1, 10, "bm25", 2.0), (1, 11, "bm25", 1.0), (2, 20, "bm25", 1.0)], "task_id int, id int, method string, score double")
    edges = spark.createDataFrame([(10, 30, "calls", "exact"), (30, 31, "calls", "exact"), (40, 20, "calls", "exact")], "src int, dst int, kind string, conf string")
    tasks = spark.createDataFrame([(1, "Fix `add_item`"), (2, "Fix `total`")], "task_id int, text string")
    held = spark.createDataFrame([(1, 11), (1, 99), (2, 30)], "task_id int, id int")
    got = composed.retrieve(lambda q, k, by: found.withColumn("score", noted("score")), tasks, edges, held)
    assert {(r.task_id, r.id) for r in got.collect()} == {(1, 10), (1, 30), (1, 31), (2, 20), (2, 40)} and rows.value == 3
    seeds = found.select("task_id", F.col("id").alias("symbol"), noted("score").alias("score"))
    pool, _ = composed.navigate(edges, seeds, by="task_id")
    assert {(r.task_id, r.symbol, r.hop) for r in pool.collect()} == {(1, 10, 0), (1, 11, 0), (2, 20, 0), (2, 40, 1)} and rows.value == 6


def test_found_texts_are_not_shuffled_to_hits(spark):
    """What is found goes to the documents, however small Spark is told to take a table for being sent."""
    from cairn.plans import adapters, retrieval

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (retrieval._candidates(spark, "/root/testdata/sf0.001"), adapters.gold(spark, "/root/testdata/sf0.001")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin [id#" not in plan and "SortMergeJoin [doc_id#" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
