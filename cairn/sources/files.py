"""Source trees as tables: file listings, contents, literal search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import SPACE, glob_pattern, is_test_path

# Folders that are never read.
IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", "build", "dist")


def _outside(path, names: tuple[str, ...]):
    return ~path.rlike("(^|/)(" + "|".join(n.replace(".", r"\.") for n in names) + ")/")


def tree(spark: SparkSession, root: str, name_glob: str = "*", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, content) of the files below root, read by Spark's binary source: path is relative, content is decoded as UTF-8.

    The name glob and the folder filter apply to the listing, before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*?" + base.split("://")[-1].replace("\\", "/").replace(".", r"\.").replace("+", r"\+") + "/", "")
    named = files.select(relative.alias("path"), "content", "length")
    return named.where(_outside(F.col("path"), ignored))


def matching(paths: DataFrame, glob: str) -> DataFrame:
    """Rows whose path, or the name at its end, matches the glob."""
    pattern = glob_pattern(glob)
    name = F.element_at(F.split("path", "/"), -1)
    return paths.where(name.rlike(f"^{pattern}") | F.col("path").rlike(f"^{pattern}"))


def test_files(paths: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Rows whose path is a Python test file's, outside of the folders that are never read."""
    return paths.where(_outside(F.col("path"), ignored) & F.endswith("path", F.lit(".py")) & is_test_path(F.col("path")))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path) of files whose name or relative path matches the glob, sorted."""
    return matching(tree(spark, root).select("path"), glob).orderBy("path")


def grep(files: DataFrame, needle: str, most: int | None = 50, glob: str | None = None) -> DataFrame:
    """(path, line, snippet) of lines of files (path, text) that contain needle, in order of path and line; `most` rows if given."""
    if not needle:
        return files.sparkSession.createDataFrame([], "path string, line int, snippet string")
    rows = files.where(F.col("path").rlike(f"^{glob_pattern(glob)}")) if glob else files
    lines = rows.where(F.contains("text", F.lit(needle))).select("path", F.posexplode(F.split("text", "\n")).alias("at", "row"))
    found = lines.where(F.contains("row", F.lit(needle))).select("path", (F.col("at") + 1).alias("line"), F.btrim("row", F.lit(SPACE)).alias("snippet"))
    return found.orderBy("path", "line").limit(most) if most else found
