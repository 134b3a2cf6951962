"""What agents compose of the other operators: retrieval, navigation, gathering under a budget, open queries, prompt contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import extract_queries
from cairn.operators import graph, ledger
from cairn.operators.common import stored, top


def navigate(edges: DataFrame, seeds: DataFrame, coverage: DataFrame | None = None, hops: int = 2, share: float = 0.8, by: str = "query_id") -> tuple[DataFrame, DataFrame | None]:
    """The pool (by, symbol, score, hop) and the tests (by, test) that cover it, None without coverage (symbol, test).

    seeds: (by, symbol, score). The pool holds the seeds at hop 0, and their callers up to `hops` away, each at its fewest hops, with
    `share` of the group's best seed score. The pool is what rerank() takes, once joined to texts.
    """
    given = stored(seeds.select(by, "symbol", "score"))  # a search, as a rule: not to be run again by each use
    hit = graph.impact(edges, given.select(F.col("symbol").alias("seed")).distinct(), hops).where("hop > 0")
    far = given.select(by, F.col("symbol").alias("seed")).join(hit, "seed").groupBy(by, "symbol").agg(F.min("hop").alias("hop"))
    best = given.groupBy(by).agg((F.lit(share) * F.max("score")).alias("score"))
    grown = far.join(given.select(by, "symbol"), [by, "symbol"], "left_anti").join(best, by)
    pool = given.withColumn("hop", F.lit(0)).unionByName(grown.select(by, "symbol", "score", "hop"))
    return pool, None if coverage is None else graph.impacted_tests(pool, coverage, [by])


def retrieve(search, tasks: DataFrame, edges: DataFrame, held: DataFrame, k: int = 10, config: graph.ExpandConfig = graph.ExpandConfig()) -> DataFrame:
    """(task_id, id, retrieval, score): what a retriever adds to a task's evidence.

    The queries named in a task's text are searched together, the best ids are expanded over the graph, and what the task holds
    already (held: task_id, id) isn't added. tasks: (task_id, text); search(queries, k, by) is that of HybridRetriever, over
    queries (query_id, task_id, text). Nodes of edges are ids.
    """
    asked = tasks.select("task_id", F.posexplode(extract_queries(F.col("text"))).alias("n", "text"))
    asked = asked.select(F.concat_ws("#", F.col("task_id").cast("string"), F.col("n").cast("string")).alias("query_id"), "task_id", "text")
    seeds = stored(search(asked, k, ["task_id"]).select("task_id", "id", F.col("method").alias("retrieval"), "score"))
    found = graph.expand(edges, seeds.select("task_id", F.col("id").alias("seed"), "score"), config, "task_id").withColumnRenamed("node", "id")
    more = top(found, config.max_nodes, ["task_id"], F.round("score", 9).desc(), F.col("id"))
    every = stored(seeds.unionByName(more.select("task_id", "id", F.lit("graph").alias("retrieval"), "score")))
    held = held.select("task_id", "id").join(every.select("id").distinct(), "id", "left_semi")  # far fewer than tasks may hold
    return every.join(held, ["task_id", "id"], "left_anti").withColumn("score", F.round("score", 6))


def within_budget(rows: DataFrame, spent: DataFrame, budget: ledger.Budget | None, by: list[str]) -> DataFrame:
    """Rows of the groups that may go on: all without a budget; a group that spent (by, loops, tokens, cost, calls) says nothing of may."""
    if budget is None:
        return rows
    over = spent.where(ledger.exceeded(F.col("loops"), F.col("tokens"), F.col("cost"), F.col("calls"), budget))
    return rows.join(over.select(*by).distinct(), by, "left_anti")


def gather(rows: DataFrame, held: DataFrame, spent: DataFrame, budget: ledger.Budget | None, by: list[str], key: str, order: str) -> DataFrame:
    """What a round of specialists adds: rows whose key the group doesn't hold, the first of each; none for a group over its budget.

    Evidence goes by chunk id, impacted tests by their name; rows without a key add nothing.
    """
    return ledger.new_evidence(within_budget(rows.where(F.col(key).isNotNull()), spent, budget, by), held, by, key, order)


def open_queries(tasks: DataFrame, nodes: DataFrame, waves: DataFrame, by: list[str], task: str) -> DataFrame:
    """(by, query): descriptions of a task's nodes that aren't completed, wave by wave, joined by ` | `; the task itself if there are none.

    tasks: (by, task); nodes: (by, node, ord, description, status); waves: (node, wave). A row holds one task's nodes.
    """
    todo = nodes.where("status <> 'completed'").join(waves, "node")
    ordered = F.array_sort(F.collect_list(F.struct("wave", "ord", "description")))
    joined = todo.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["description"]), " | ").alias("query"))
    return tasks.join(joined, by, "left").select(*by, F.coalesce("query", F.col(task)).alias("query"))


# The header of an evidence block, and what stands for no evidence.
BLOCK_HEADER = "# File: %s (lines %d-%d)\n%s\n"
NO_CONTEXT = "# No context retrieved.\n"


def prompt_context(queries: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, context): the evidence (by, ord, path, start_line, end_line, content) of each query as text, in order, a header before each.

    A row holds one query's evidence, which a search has limited to its k best.
    """
    block = F.format_string(BLOCK_HEADER, "path", "start_line", "end_line", "content")
    ordered = F.array_sort(F.collect_list(F.struct("ord", block.alias("block"))))
    shown = evidence.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context"))
    return queries.join(shown, by, "left").select(*by, F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))
