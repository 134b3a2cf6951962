"""Evaluation tasks and records as tables, and the sinks for records, reports, coverage maps and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.common import cut_lineage

TASK_SCHEMA = "instance_id string, repo string, base_commit string, problem_statement string, patch string, test_patch string, hints_text string"


def task_ids(spark: SparkSession, path: str) -> DataFrame:
    """(task_id) of a text file, a line each; blank lines and those that begin with # are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("task_id")).where("task_id <> '' and not startswith(task_id, '#')")


def tasks(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """JSON-lines tasks; missing fields are ''; only those in ids (task_id) if given."""
    rows = spark.read.schema(TASK_SCHEMA).json(path).na.fill("")
    return rows.join(ids.select(F.col("task_id").alias("instance_id")), "instance_id", "left_semi") if ids is not None else rows


def missing(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids that no task has."""
    return ids.join(rows.select(F.col("instance_id").alias("task_id")), "task_id", "left_anti")


def ordered(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The tasks of ids (task_id, ord), with ord; reading an id that no task has is an error that names it."""
    found = ids.select("ord", "task_id").join(rows, F.col("task_id") == F.col("instance_id"), "left")
    there = F.when(F.col("instance_id").isNull(), F.raise_error(F.concat(F.lit("no such task: "), "task_id"))).otherwise(F.col("ord"))
    return found.select(there.alias("ord"), *rows.columns)


def as_list(column: Column) -> Column:
    """A JSON list in a string as an array."""
    return F.from_json(column, "array<string>")


def record_key(version: Column, system: Column, fingerprint: Column, task: Column, run: Column) -> Column:
    """The ten-digit digest that names a cached record."""
    return F.substring(F.sha2(F.to_json(F.array(*(c.cast("string") for c in (version, system, fingerprint, task, run)))), 256), 1, 10)


def write_records(records: DataFrame, path: str) -> None:
    """Records as JSON, partitioned by config; rows with an error raised by the driver are not kept."""
    records.write.mode("overwrite").partitionBy("config").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _shard(key: str = "key") -> Column:
    return F.substring(key, 1, 1).alias("shard")


def cached_records(spark: SparkSession, path: str) -> DataFrame | None:
    """The records cached below path; None if nothing was cached yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).drop("shard")


def cache_records(new: DataFrame, cached: DataFrame | None, path: str, named: list[str]) -> None:
    """Add records to a cache: each partition (config, shard) that gets some is written again with what it held of other names (key and the like)."""
    parts = new.select("config", _shard()).distinct()
    rows = new
    if cached is not None:
        kept = cached.withColumn("shard", _shard()).join(parts, ["config", "shard"], "left_semi").drop("shard")
        rows = cut_lineage(kept.join(new.select(*named), named, "left_anti").select(*new.columns).unionByName(new))  # before the files read are replaced
    rows.withColumn("shard", _shard()).repartition("config", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "shard").parquet(path)


def write_report(report: DataFrame, records: DataFrame, path: str) -> None:
    """raw records as JSON lines and the report's table rows as text."""
    from cairn.operators.evaluation import markdown

    records.write.mode("overwrite").json(f"{path}/raw")
    markdown(report).orderBy("config").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/table")  # a row per config


def coverage_json(coverage: DataFrame) -> DataFrame:
    """(symbol_id, tests): a symbol's sorted tests as JSON; a row per symbol, so no map of all symbols is gathered."""
    return coverage.groupBy("symbol_id").agg(F.to_json(F.array_sort(F.collect_set("test_id"))).alias("tests"))


def read_coverage_json(rows: DataFrame) -> DataFrame:
    return rows.select("symbol_id", F.explode(F.from_json("tests", "array<string>")).alias("test_id"))


def append_vectors(new: DataFrame, path: str) -> None:
    """New cache rows (key, vector) behind those there."""
    new.write.mode("append").parquet(path)
