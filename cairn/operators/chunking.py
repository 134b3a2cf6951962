"""Chunks of lines: blank edges, windows, dedent, uncovered runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import SPACE


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) == ""


def dedented(lines: Column) -> Column:
    """Lines less the blanks that all but blank lines begin with; blank lines become empty."""
    lead = F.transform(F.filter(lines, lambda x: ~is_blank(x)), lambda x: F.length(x) - F.length(F.ltrim(x)))
    return F.transform(lines, lambda x: F.when(is_blank(x), "").otherwise(F.substr(x, F.coalesce(F.array_min(lead), F.lit(0)) + 1)))


def windows(spans: DataFrame, size: int = 80) -> DataFrame:
    """Chunks of spans (path, commit, symbol, lines ARRAY, start, end): blank edges stripped, then windows of `size` lines at most.

    Gives chunk_id, path, start_line, end_line, symbol, text, commit. A span of blank lines only gives nothing.
    """
    at = F.filter(F.sequence("start", "end"), lambda i: ~is_blank(F.coalesce(F.get("lines", i - 1), F.lit(""))))
    cut = spans.withColumn("at", at).where(F.size("at") > 0).withColumns({"s": F.array_min("at"), "e": F.array_max("at")})
    part = cut.withColumn("start_line", F.explode(F.sequence("s", "e", F.lit(size)))).withColumn("end_line", F.least(F.col("start_line") + (size - 1), "e"))
    text = F.array_join(dedented(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)), "\n")
    return part.select(F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("chunk_id"), "path", "start_line", "end_line", "symbol", text.alias("text"), "commit")


def document_spans(docs: DataFrame, path: Column, text: Column, commit: Column) -> DataFrame:
    """Each document as one span."""
    lines = F.split(text, "\n")
    return docs.select(path.alias("path"), commit.alias("commit"), F.lit(None).cast("string").alias("symbol"), lines.alias("lines"), F.lit(1).alias("start"), F.size(lines).alias("end"))


def residual_runs(lines: DataFrame, covered: DataFrame) -> DataFrame:
    """Maximal runs of lines (path, line) that no row of covered (path, start_line, end_line) covers: path, start_line, end_line."""
    taken = covered.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    free = lines.join(taken, ["path", "line"], "left_anti")
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return free.withColumn("island", island).groupBy("path", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")
