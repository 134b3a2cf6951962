"""Spans and coverage: innermost span, overlap, lines to chunks, tests to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import is_test_path, symbol_id
from cairn.operators import intervals


def innermost(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, name): the shortest span (path, name, start_line, end_line) that holds a line; ties by start, then name."""
    return intervals.innermost(lines, spans)


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a (path, start_line, end_line) that overlap a row of b."""
    return intervals.overlapping(a, b)


def executed_lines(rows: DataFrame, root: str) -> DataFrame:
    """rows (file, ...) of coverage data with `path` below root; a relative file is below root already, one outside of root is dropped."""
    base = root.rstrip("/") + "/"
    path = F.when(~F.startswith("file", F.lit("/")), F.col("file")).when(F.startswith("file", F.lit(base)), F.substr("file", F.lit(len(base) + 1)))
    return rows.withColumn("path", F.regexp_replace(path, r"^(?:\./)+", "")).where("path is not null").drop("file")


def from_lines(executed: DataFrame, chunks: DataFrame, context: Column) -> DataFrame:
    """(symbol_id, test_id): executed (path, line) in a symbol's chunk, tests' own files left out, under a named test context."""
    rows = executed.select("path", "line", context.alias("tag")).where("tag <> ''")
    held = intervals.spans_of_lines(rows, chunks.where(F.col("symbol").isNotNull() & ~is_test_path(F.col("path"))).withColumnRenamed("symbol", "name"))
    return held.select(symbol_id(F.col("path"), F.col("name")).alias("symbol_id"), F.col("tag").alias("test_id")).distinct()


def short_name(symbol: Column) -> Column:
    """The last part of a symbol; __init__ stands for its class; other dunders have none."""
    parts = F.split(symbol, r"\.")
    last = F.element_at(parts, -1)
    return F.when((last == "__init__") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).when(~F.startswith(last, F.lit("__")), last)


def from_names(tests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(symbol_id, test_id): a test that mentions a name is linked to every symbol with that short name. tests: (test_id, name)."""
    symbols = chunks.where(F.col("symbol").isNotNull() & ~is_test_path(F.col("path"))).select(short_name(F.col("symbol")).alias("name"), symbol_id(F.col("path"), F.col("symbol")).alias("symbol_id"))
    return tests.join(symbols.where("name is not null").distinct(), "name").select("symbol_id", "test_id").distinct()


def build(chunks: DataFrame, executed: DataFrame | None, tests: DataFrame, context: Column) -> DataFrame:
    """(symbol_id, test_id, source): dynamic where line contexts are given, else static."""
    if executed is not None:
        return from_lines(executed, chunks, context).withColumn("source", F.lit("dynamic"))
    return from_names(tests, chunks).withColumn("source", F.lit("static"))


def merge(*maps: DataFrame) -> DataFrame:
    """The union of coverage maps (symbol_id, test_id)."""
    out = maps[0].select("symbol_id", "test_id")
    for m in maps[1:]:
        out = out.unionByName(m.select("symbol_id", "test_id"))
    return out.distinct()


def stats(coverage: DataFrame) -> DataFrame:
    """One row: covered symbols, distinct tests, mean tests for a symbol."""
    each = coverage.groupBy("symbol_id").agg(F.countDistinct("test_id").alias("n"))
    tests = coverage.select("test_id").distinct().agg(F.count("*").alias("tests"))
    return each.agg(F.count("*").alias("symbols"), F.avg("n").alias("tests_per_symbol")).crossJoin(tests).select("symbols", "tests", "tests_per_symbol")  # one row each


def uncovered(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    return symbols.select("symbol_id").distinct().join(coverage, "symbol_id", "left_anti")


def tests_for(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    return coverage.join(symbols, "symbol_id", "left_semi").select("test_id").distinct()


def symbols_for(tests: DataFrame, coverage: DataFrame) -> DataFrame:
    return coverage.join(tests, "test_id", "left_semi").select("symbol_id").distinct()
