"""Which test framework a source tree uses, and the commands that run its tests: an ordered rule list, the first that holds wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import test_label

# Commands by framework.
COMMANDS = {
    "pytest": ["pytest", "-q"],
    "django": ["python", "manage.py", "test", "--noinput"],
    "unittest": ["python", "-m", "unittest", "discover"],
    "vitest": ["npx", "vitest", "run"],
    "jest": ["npx", "jest"],
    "npm": ["npm", "test", "--"],
}


def detect(files: DataFrame, repo_col: str = "repo") -> DataFrame:
    """(repo, framework, language, base_cmd, test_dirs, test_files) of files (repo, path, text)."""
    path, text = F.col("path"), F.lower(F.coalesce("text", F.lit("")))
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    hidden = path.rlike(r"(^|/)(\.[^/]*|venv|node_modules|__pycache__)(/|$)")
    is_test = path.rlike(r"\.py$") & ~hidden & (path.rlike(r"(^|/)test_[^/]*$") | path.rlike(r"_test\.py$") | path.rlike("(^|/)tests/"))
    pkg = path == "package.json"
    dep = lambda name: (F.get_json_object("text", f"$.dependencies.{name}").isNotNull() | F.get_json_object("text", f"$.devDependencies.{name}").isNotNull() | F.coalesce(F.contains(F.get_json_object("text", "$.scripts.test"), F.lit(name)), F.lit(False)))
    facts = files.groupBy(repo_col).agg(
        has(path.isin("pytest.ini", "conftest.py", "tests/conftest.py", "test/conftest.py")).alias("marked"),
        has((path == "pyproject.toml") & F.contains(text, F.lit("pytest"))).alias("project"),
        has(path.isin("setup.cfg", "tox.ini") & F.contains(text, F.lit("pytest"))).alias("cfg"),
        has(path == "manage.py").alias("django"),
        has(path.rlike(r"^requirements[^/]*\.txt$") & F.contains(text, F.lit("pytest"))).alias("required"),
        has(is_test).alias("tests"),
        has(is_test & (F.contains("text", F.lit("import pytest")) | F.contains("text", F.lit("@pytest.")))).alias("uses_pytest"),
        has(is_test & (F.contains("text", F.lit("import unittest")) | F.contains("text", F.lit("unittest.TestCase")))).alias("uses_unittest"),
        has(pkg & dep("vitest")).alias("vitest"),
        has(pkg & dep("jest")).alias("jest"),
        has(pkg & F.get_json_object("text", "$.scripts.test").isNotNull()).alias("npm"),
        F.array_sort(F.collect_set(F.when(path.rlike("^(tests|test)/"), F.split_part(path, F.lit("/"), F.lit(1))))).alias("test_dirs"),
        F.array_sort(F.collect_set(F.when(is_test, path))).alias("test_files"),
    )
    name = (
        F.when(F.col("marked") | F.col("project") | F.col("cfg"), "pytest")
        .when(F.col("django"), "django")
        .when(F.col("required"), "pytest")
        .when(F.col("tests"), F.when(F.col("uses_pytest") | ~F.col("uses_unittest"), "pytest").otherwise("unittest"))
        .when(F.col("vitest"), "vitest")
        .when(F.col("jest"), "jest")
        .when(F.col("npm"), "npm")
        .otherwise("pytest")
    )
    language = F.when(F.col("framework").isin("vitest", "jest", "npm"), "javascript").otherwise("python")
    commands = F.create_map(*(x for k, v in COMMANDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return facts.withColumn("framework", name).select(repo_col, "framework", language.alias("language"), commands[F.col("framework")].alias("base_cmd"), "test_dirs", "test_files")


def plan(specs: DataFrame, impacted: DataFrame, repo_col: str = "repo") -> DataFrame:
    """(repo, impacted_cmd, full_cmd): the impacted tests (repo, test) first, then all; no impacted tests, no first command."""
    tests = impacted.where(F.trim("test") != "").groupBy(repo_col).agg(F.array_sort(F.collect_set(F.trim("test"))).alias("tests"))
    rows = specs.join(tests, repo_col, "left")
    base = F.when(F.col("framework") == "unittest", F.array(*map(F.lit, ("python", "-m", "unittest")))).otherwise(F.col("base_cmd"))
    labels = F.when(F.col("framework") == "django", F.transform("tests", test_label)).otherwise(F.col("tests"))
    return rows.select(repo_col, F.when(F.col("tests").isNotNull(), F.concat(base, labels)).alias("impacted_cmd"), F.col("base_cmd").alias("full_cmd"))


def command(framework: str, tests: Sequence[str] = ()) -> list[str]:
    """One framework's command, on the driver."""
    cleaned = [t.strip() for t in tests if t.strip()]
    base = COMMANDS[framework]
    return [*(base[:3] if framework == "unittest" and cleaned else base), *cleaned]
