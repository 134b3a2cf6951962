"""The steps of a run that need no model: default plans and reports, routing after tests, reflection, and the answer. Each gives deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is said where no component says anything.
FIRST_NODE = ("task_1", "pending", "retriever")
NO_REPORT = "No test report generated."
ERROR_CHARS = 300
NODE = "struct<node_id:string,description:string,dependencies:array<string>,status:string,agent:string>"


def default_plans(tasks: DataFrame, nodes: DataFrame, by: list[str], task: str) -> DataFrame:
    """(by, node) of tasks (by, task) that have no node in nodes (by, ...): one node that is the task itself. Planned tasks add nothing."""
    name, status, agent = map(F.lit, FIRST_NODE)
    node = F.struct(name, F.col(task), F.array().cast("array<string>"), status, agent).cast(NODE).alias("node")
    return tasks.join(nodes.select(*by).distinct(), by, "left_anti").select(*by, node)


def reports(states: DataFrame, tested: DataFrame | None, by: list[str]) -> DataFrame:
    """(by, passed, total_run, failed, error_logs, impacted): the test report of each state (by, impacted).

    tested: (by, passed, total_run, failed, error_logs); None: nothing tests, and every state passes with no test run. A state that
    tested says nothing of has no row, as after a test that gave no report.
    """
    if tested is None:
        return states.select(*by, F.lit(True).alias("passed"), F.lit(0).alias("total_run"), F.array().cast("array<string>").alias("failed"), F.lit("").alias("error_logs"), "impacted")
    return tested.join(states.select(*by, "impacted"), by).select(*by, "passed", "total_run", "failed", "error_logs", "impacted")


def quoted(names: Column) -> Column:
    """Names as Python shows a list of them."""
    inner = lambda n: F.regexp_replace(n, r"\\", r"\\\\")
    one = lambda n: F.when(F.contains(n, F.lit("'")) & ~F.contains(n, F.lit('"')), F.concat(F.lit('"'), inner(n), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.regexp_replace(inner(n), "'", r"\\'"), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(names, one), ", "), F.lit("]"))


def reflect(states: DataFrame, found: DataFrame, by: list[str], said: DataFrame | None = None) -> DataFrame:
    """(by, notes, loop_count): states (by, notes, loop_count) with a note more and one loop more.

    The note is what a reflector said (by, note), without white space around it; where it said nothing, the report's failed tests and the
    first ERROR_CHARS characters of its errors. found: reports; a state without one has no failed tests and no error.
    """
    rows = states.join(found.select(*by, "failed", "error_logs"), by, "left")
    rows = rows.join(said.select(*by, "note"), by, "left") if said is not None else rows.withColumn("note", F.lit(None).cast("string"))
    loop = F.coalesce("loop_count", F.lit(0)) + 1
    own = F.nullif(F.regexp_replace("note", r"^\s+|\s+$", ""), F.lit(""))
    default = F.concat(F.lit("Iteration "), loop.cast("string"), F.lit(": failed tests "), quoted(F.coalesce("failed", F.array().cast("array<string>"))), F.lit(". Error summary: "), F.substring(F.coalesce("error_logs", F.lit("")), 1, ERROR_CHARS))
    return rows.select(*by, F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array(F.coalesce(own, default))).alias("notes"), loop.alias("loop_count"))


def after_test(passed: Column, exceeded: Column) -> Column:
    """`respond` when the tests passed or the budget is spent, else `reflect`; a run without a report hasn't passed."""
    return F.when(F.coalesce(passed, F.lit(False)) | exceeded, "respond").otherwise("reflect")


def answers(states: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """states with passed, total_run, failed and error_logs of their report; one without a report has failed, with no test run."""
    rows = states.join(found.select(*by, "passed", "total_run", "failed", "error_logs"), by, "left")
    none = F.col("passed").isNull()
    return rows.withColumns(
        {
            "passed": F.coalesce("passed", F.lit(False)),
            "total_run": F.coalesce("total_run", F.lit(0)),
            "failed": F.coalesce("failed", F.array().cast("array<string>")),
            "error_logs": F.when(none, NO_REPORT).otherwise(F.col("error_logs")),
        }
    )
