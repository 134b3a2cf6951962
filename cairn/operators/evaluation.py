"""Retrieval and outcome metrics over records of repeated runs. Null outcomes are handled as each metric defines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import mean_and_spread
from cairn.operators.common import cut_lineage, top
from cairn.sources import tasks as sources


def recall_files(evidence: DataFrame, gold: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, recall): unique files ranked by best score, the share of a group's gold paths in its first k; groups without gold are absent."""
    best = evidence.groupBy(*by, "path").agg(F.max("score").alias("score"))
    first = top(best, k, by, F.col("score").desc(), F.col("path")).select(*by, "path", F.lit(1).alias("hit"))
    return gold.select(*by, "path").distinct().join(first, [*by, "path"], "left").groupBy(*by).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def mean_recall(records: DataFrame, evidence: DataFrame, gold: DataFrame, k: int, key: list[str], task: str = "task_id") -> DataFrame:
    """Mean recall over records (key and task): a record without evidence, as after a crash, counts 0; tasks without gold don't count."""
    own = records.join(gold.select(task, "path").distinct(), task).select(*key, "path")
    found = recall_files(evidence, own, k, key)
    return found.agg(F.avg("recall").alias("mean_recall"))


def recall_rows(evidence: DataFrame, gold: DataFrame, k: int, by: list[str], spans: bool = False) -> DataFrame:
    """(by, recall) on the first k evidence rows in their order (ord): the share of gold files, or of gold spans that overlap one."""
    first = top(evidence, k, by, F.col("ord"), rank="__r")
    goal = gold.select(*by, "path", *(("start_line", "end_line") if spans else ())).distinct()
    rows = first.select(*by, "path", F.col("start_line").alias("__s"), F.col("end_line").alias("__e")) if spans else first.select(*by, "path").distinct().withColumn("hit", F.lit(1))
    if spans:
        on = [*by, "path"]
        hit = goal.join(rows, on).where(F.greatest("start_line", "__s") <= F.least("end_line", "__e")).select(*goal.columns).distinct().withColumn("hit", F.lit(1))
        joined = goal.join(hit, goal.columns, "left")
    else:
        joined = goal.join(rows, goal.columns, "left")
    return joined.groupBy(*by).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def assert_gold(gold: DataFrame) -> DataFrame:
    """gold, or an error once read if it has no row."""
    return gold.sparkSession.range(1).join(gold.agg(F.count("*").alias("n")), F.lit(True)).select(F.assert_true(F.col("n") > 0, "gold is empty").alias("ok"))


def resolve_rate(resolved: Column) -> Column:
    """The share resolved; null counts as not."""
    return F.avg(F.coalesce(resolved, F.lit(False)).cast("int"))


def regression_rate(regressed: Column) -> Column:
    """The share regressed of those known."""
    return F.avg(regressed.cast("int"))


def cost_per_resolved(cost: Column, resolved: Column) -> Column:
    """Total cost, failures included, for each resolved; null if none is."""
    n = F.sum(F.coalesce(resolved, F.lit(False)).cast("int"))
    return F.when(n > 0, F.coalesce(F.sum(cost), F.lit(0.0)) / n)


def false_approval_rate(resolved: Column, diffs: Column) -> Column:
    """Of graded answers with a diff, the share that failed."""
    return F.avg(F.when(resolved.isNotNull() & (diffs >= 1), (~resolved).cast("int")))


def attack_success_rate(resolved: Column) -> Column:
    """Of graded attacks, the share that succeeded."""
    return F.avg(resolved.cast("int"))


def across_runs(records: DataFrame, metric: Column, by: list[str], run: str = "run_idx") -> DataFrame:
    """(by, mean, spread) of a metric taken per run: population deviation, runs whose metric is null left out."""
    each = records.groupBy(*by, run).agg(metric.alias("m"))
    return each.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("spread"))


def config_report(records: DataFrame) -> DataFrame:
    """A row per config: tasks, runs, resolve, regression and cost metrics, errors."""
    r = F.col("resolved")
    return records.groupBy("config").agg(
        F.countDistinct("task_id").alias("tasks"),
        F.countDistinct("run_idx").alias("runs"),
        resolve_rate(r).alias("resolve_rate"),
        regression_rate(F.col("regressed")).alias("regression_rate"),
        cost_per_resolved(F.col("cost"), r).alias("cost_per_resolved"),
        F.count("error").alias("errors"),
    )


def report_table(records: DataFrame, recalls: dict[str, DataFrame] | None = None) -> DataFrame:
    """A row per config as a report prints it: tasks, runs, each recall and rate as mean ± spread over runs, and errors.

    recalls: a name and (config, run_idx, recall) for each. Rates are shown as `-` where no run has one, the resolve rate also where
    no record was graded.
    """
    counts = records.groupBy("config").agg(F.countDistinct("task_id").alias("tasks"), F.countDistinct("run_idx").alias("runs"), F.count("error").alias("errors"), F.count("resolved").alias("__graded"))
    r = F.col("resolved")
    rates = {"resolve_rate": (resolve_rate(r), 3), "regression_rate": (regression_rate(F.col("regressed")), 3), "cost_per_resolved": (cost_per_resolved(F.col("cost"), r), 4)}
    shown = {n: (across_runs(records, m, ["config"]), d) for n, (m, d) in rates.items()}
    shown = {n: (across_runs(df, F.avg("recall"), ["config"]), 3) for n, df in (recalls or {}).items()} | shown
    for name, (each, digits) in shown.items():
        counts = counts.join(each.select("config", mean_and_spread(F.col("mean"), F.col("spread"), digits).alias(name)), "config", "left")
    return counts.withColumn("resolve_rate", F.when(F.col("__graded") > 0, F.col("resolve_rate")).otherwise("-")).drop("__graded")


def markdown(report: DataFrame) -> DataFrame:
    """A line of a markdown table for each config of a report."""
    show = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.3f", F.col(c)))
    return report.select("config", F.concat_ws(" | ", F.concat(F.lit("| "), "config"), F.col("tasks").cast("string"), F.col("runs").cast("string"), show("resolve_rate"), show("regression_rate"), F.concat(show("cost_per_resolved"), F.lit(" |"))).alias("line"))


def grid(configs: DataFrame, tasks: DataFrame, repeats: int) -> DataFrame:
    """Every (config, task_id, run_idx) to be run: configs and repeats are stated lists, joined to the task table."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("run_idx")
    return tasks.select("task_id").crossJoin(configs.select("config")).select("config", "task_id", runs)


def checked(records: DataFrame) -> DataFrame:
    """records, whose `error` also says where tokens were used but cost nothing: such a record would look free."""
    free = F.col("error").isNull() & (F.col("tokens") > 0) & (F.coalesce(F.col("cost"), F.lit(0.0)) == 0)
    return records.withColumn("error", F.when(free, "tokens were used but the cost is 0").otherwise(F.col("error")))


#: What names a record. Keys are short digests, so two runs of a large grid may share one: a record is also known by what it is of.
NAMED = ["key", "config", "task_id", "run_idx"]


def resume(grid: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], version: int = 1, fingerprint: Column | None = None, use_cache: bool = True) -> DataFrame:
    """The records of every (config, task_id, run_idx) of the grid: those cached below path, and of the others what `run` makes of them.

    run maps rows of the grid, with their `key`, to rows with columns besides: at least tokens, cost and error. A record with an error is
    part of the result, so it stays in every denominator, but isn't cached: it is run again next time. A record's key is the digest
    of version, config, fingerprint (of the config's settings), task and run, so a changed config is run anew. Only records
    that the cache lacks are run, once, before anything is written; a key that two of them share names both. `cached` says which records were read.

    The cache is partitioned by config and by the first digit of the key, and the partitions that get new records are overwritten
    whole: a write that fails, or is repeated, leaves each as it was or as it should be. A record that has gone from the grid stays.
    """
    spark = grid.sparkSession
    print_ = F.lit("") if fingerprint is None else fingerprint
    keyed = grid.withColumn("key", sources.record_key(F.lit(version), F.col("config"), print_, F.col("task_id"), F.col("run_idx")))
    there = sources.cached_records(spark, path)
    cached = there if use_cache else None
    todo = keyed if cached is None else keyed.join(cached.select(*NAMED), NAMED, "left_anti").select(*keyed.columns)
    new = cut_lineage(checked(run(todo)))
    good = new.where("error is null")
    held = None if cached is None else cut_lineage(cached.join(keyed.select(*NAMED), NAMED, "left_semi").select(*new.columns))  # before its files are replaced
    if not good.isEmpty():
        sources.cache_records(good, there, path, NAMED)
    fresh = new.withColumn("cached", F.lit(False))
    return fresh if held is None else fresh.unionByName(held.withColumn("cached", F.lit(True)))


def control_systems(gold: DataFrame) -> DataFrame:
    """Evidence of the two control systems: `gold` finds every gold file, `none` nothing."""
    return gold.select(F.lit("control_gold").alias("config"), "task_id", "path", F.lit(1.0).alias("score"))
