"""Queries: extractors, paths, diffs, logs, replies, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import lexical
from cairn.operators.common import checkpoint_dir
from cairn.plans import adapters as ad
from cairn.plans.registry import query, table
from cairn.sources import files, frameworks, patches, tasks

PATH = "concat(CASE event_id % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'pkg/' ELSE '' END, CASE event_id % 7 WHEN 0 THEN 'test_' WHEN 1 THEN '__init__' ELSE '' END, CASE WHEN event_id % 7 = 1 THEN '' ELSE event_type END, CASE event_id % 3 WHEN 0 THEN '_test.py' WHEN 1 THEN '.py' ELSE '.txt' END)"
PATHS = f"paths AS (SELECT event_id, {ad.sql(PATH)} AS path FROM events)"
BY_FILE = r"regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\.py$')"
BY_DIR = "regexp_matches(path, '(^|/)(tests|test)/')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(PATH).alias("path"))


@query(rf"WITH {PATHS} SELECT event_id, {BY_FILE} OR {BY_DIR} AS is_test_path, {BY_DIR} OR regexp_matches(path, '(^|/)test_[^/]*$') OR regexp_matches(path, '_test\.py$') AS is_test_file, contains(path, 'test') AS names_test FROM paths")
def test_path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("event_id", tx.is_test_path(p).alias("is_test_path"), tx.is_test_file(p).alias("is_test_file"), tx.names_test(p).alias("names_test"))


@query(rf"WITH {PATHS}, m AS (SELECT event_id, replace(regexp_replace(path, '\.py$', ''), '/', '.') AS m FROM paths) SELECT event_id, CASE WHEN m = '__init__' THEN '' ELSE regexp_replace(m, '\.__init__$', '') END AS module FROM m")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("event_id", tx.module_name(F.col("path")).alias("module"))


@query(rf"WITH {PATHS} SELECT event_id, trim(replace(regexp_replace(replace(replace(path || '::x', '::', '.'), '/', '.'), '\.py$', ''), '.py.', '.'), '.') AS label FROM paths")
def test_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("event_id", tx.test_label(F.concat("path", F.lit("::x"))).alias("label"))


LINES = "string_split(html, chr(10))"


@query("WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(l[2:4], chr(10)) AS text, CAST(len(l) AS BIGINT) AS total_lines FROM t")
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.line_slice(F.col("text"), 2, 4).alias("text"), F.size(F.split("text", "\n")).cast("long").alias("total_lines"))


@query(r"""
    WITH l AS (SELECT source || '/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
    SELECT path, CAST(n AS INT) AS line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS snippet FROM l WHERE contains(line, 'the ') ORDER BY path, n LIMIT 50
""")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty matches are what this search returns."""
    return files.grep(table(spark, sf_dir, "documents").select(ad.doc_path().alias("path"), "text"), "the ")


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), ',.;:()[]{{}}')"


FAMILIES = ", ".join("regexp_extract_all(text, '" + p.replace("'", "''") + f"', {g})" for p, g in tx.QUERY_PATTERNS)
EXTRACT = f"""
    WITH issues AS (SELECT event_id, {ad.sql(ad.ISSUE)} AS text FROM events),
    found AS (SELECT event_id, list_filter(list_transform(list_concat({FAMILIES.replace("), regexp", "), list_concat(regexp", 5)}, [split_part(split_part(text, chr(10), 1), '. ', 1)[:100]]){")" * 5}, lambda q: {_clean("q")}), lambda q: length(q) >= 2) AS q FROM issues)
    SELECT event_id, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i)[:8], '~') AS queries FROM found
"""


@query(EXTRACT)
def extract_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(tx.extract_queries(F.expr(ad.ISSUE)), "~").alias("queries"))


@query(rf"WITH issues AS (SELECT event_id, {ad.sql(ad.ISSUE)} AS text, CASE WHEN event_id % 4 = 0 THEN 'given' END AS symbol FROM events) SELECT event_id, coalesce(symbol, regexp_extract(text, '\b(?:def|class)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) AS name FROM issues")
def def_class_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.when(F.col("event_id") % 4 == 0, "given")
    return table(spark, sf_dir, "events").select("event_id", tx.definition_name(F.expr(ad.ISSUE), symbol).alias("name"))


def _n(what: str) -> str:
    return rf"coalesce(TRY_CAST(regexp_extract(log, '([0-9]+)\s+{what}', 1) AS BIGINT), 0)"


@query(rf"""
    WITH logs AS (SELECT l_orderkey, l_linenumber, {ad.sql(ad.LOG)} AS log FROM lineitem),
    f AS (SELECT *, regexp_extract_all(log, '(?m)^\s*FAILED\s+(\S+)', 1) AS ids FROM logs)
    SELECT l_orderkey, l_linenumber, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS failed_ids,
           CASE WHEN {_n("passed")} + {_n("failed")} + {_n("errors?")} = 0 THEN CAST(len(list_distinct(ids)) AS BIGINT) ELSE {_n("passed")} + {_n("failed")} + {_n("errors?")} END AS total,
           {_n("passed")} AS passed, {_n("failed")} + {_n("error")} AS failed FROM f
""")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(ad.LOG).alias("log"))
    facts = logs.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in tx.log_facts(F.col("log")).items()))
    return facts.select("l_orderkey", "l_linenumber", F.array_join("failed_ids", ",").alias("failed_ids"), *(c.alias(n) for n, c in tx.log_results().items()))


FENCE = r"regexp_extract(reply, '(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```', 1)"
REPLIES = rf"""
    replies AS (SELECT event_id, {ad.sql(ad.REPLY)} AS reply FROM events),
    body AS (SELECT *, CASE WHEN {FENCE} <> '' THEN {FENCE} ELSE trim(reply) END AS j FROM replies),
    sure AS (SELECT *, json_valid(j) AND j <> '' AS ok, greatest(0.0, least(1.0, coalesce(TRY_CAST(CASE WHEN json_valid(j) AND j <> '' THEN json_extract_string(j, '$.confidence') END AS DOUBLE), TRY_CAST(regexp_extract(reply, '(?i)"?confidence"?\s*[:=]\s*([01](?:\.[0-9]+)?)', 1) AS DOUBLE), 1.0))) AS confidence FROM body)"""


@query(f"WITH {REPLIES} SELECT event_id, ok AS is_json, round(confidence, 6) AS confidence FROM sure")
def confidence_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.expr(ad.REPLY)
    return table(spark, sf_dir, "events").select("event_id", tx.is_json(r).alias("is_json"), F.round(tx.confidence(r), 6).alias("confidence"))


@query(rf"WITH d AS (SELECT p_partkey, {ad.sql(ad.DIFF)} AS diff FROM part), f AS (SELECT p_partkey, regexp_extract_all(diff, '(?m)^diff --git a/\S+ b/(\S+)', 1) AS l FROM d) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS files FROM f")
def gold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.gold_files(F.expr(ad.DIFF)), ",").alias("files"))


@query(rf"""
    WITH d AS (SELECT p_partkey, string_split({ad.sql(ad.DIFF)}, chr(10)) AS l FROM part), lines AS (SELECT p_partkey, unnest(l) AS line, unnest(range(0, len(l))) AS ord FROM d),
    marked AS (SELECT *, CASE WHEN starts_with(line, '--- ') AND line <> '--- /dev/null' THEN regexp_replace(substr(line, 5), '^[ab]/', '') WHEN starts_with(line, 'diff --git ') THEN regexp_replace(split_part(line, ' ', 3), '^[ab]/', '') END AS p FROM lines),
    seen AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM marked),
    h AS (SELECT p_partkey, ord, path, CAST(regexp_extract(line, '^@@ -([0-9]+)', 1) AS INT) AS s, coalesce(TRY_CAST(regexp_extract(line, '^@@ -[0-9]+,([0-9]+)', 1) AS INT), 1) AS c FROM seen WHERE starts_with(line, '@@ ') AND path IS NOT NULL)
    SELECT p_partkey, CAST(ord AS INT) AS ord, path, s AS start_line, CASE WHEN c = 0 THEN s ELSE s + c - 1 END AS end_line FROM h
""")
def diff_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.gold_spans(table(spark, sf_dir, "part").select("p_partkey", F.expr(ad.DIFF).alias("diff")), "p_partkey")


@query("WITH e AS (SELECT doc_id, text, strpos(text, 'the') AS spot FROM documents) SELECT doc_id, CASE WHEN spot > 0 THEN substr(text, 1, spot - 1) || 'THE' || substr(text, spot + 3) END AS text FROM e")
def apply_first_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_edit(F.col("text"), F.lit("the"), F.lit("THE")).alias("text"))


@query("SELECT doc_id, sha256('m' || chr(0) || text) AS key, source || '/' || doc_id || '@' || lang || ':1-' || n_chars AS citation FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.cache_key(F.lit("m"), F.col("text")).alias("key"), tx.citation(path, F.col("lang"), F.lit(1), F.col("n_chars")).alias("citation"))


DIFF_REPLY = f"CASE WHEN p_partkey % 3 = 0 THEN concat('Here:\\n```diff\\n', {ad.DIFF}, '\\n```') WHEN p_partkey % 3 = 1 THEN concat('Sure ', {ad.DIFF}) ELSE 'no change' END"


@query(rf"WITH r AS (SELECT p_partkey, {ad.sql(DIFF_REPLY)} AS reply FROM part), f AS (SELECT *, regexp_extract(reply, '(?s)```diff\n(.*?)\n```', 1) AS fenced FROM r) SELECT p_partkey, regexp_replace(CASE WHEN fenced <> '' THEN fenced WHEN contains(reply, 'diff --git') THEN substr(reply, strpos(reply, 'diff --git')) ELSE '' END, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS diff FROM f")
def diff_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.diff_block(F.expr(DIFF_REPLY)).alias("diff"))


# In SQL: lines are grouped under the header above them, and a group that begins with `--- ` is a patch.
@query(rf"""
    WITH r AS (SELECT p_partkey, {ad.sql(DIFF_REPLY)} AS reply FROM part), f AS (SELECT *, regexp_extract(reply, '(?s)```diff\n(.*?)```', 1) AS fenced FROM r),
    body AS (SELECT p_partkey, string_split(trim(CASE WHEN fenced <> '' THEN fenced WHEN contains(reply, 'diff --git') THEN substr(reply, strpos(reply, 'diff --git')) END, chr(10)), chr(10)) AS l FROM f),
    lines AS (SELECT p_partkey, unnest(l) AS line, unnest(range(len(l))) AS n FROM body),
    grouped AS (SELECT *, count(*) FILTER (WHERE starts_with(line, 'diff --git ') OR starts_with(line, '--- ')) OVER (PARTITION BY p_partkey ORDER BY n) AS g FROM lines),
    files AS (SELECT p_partkey, g, string_agg(line, chr(10) ORDER BY n) AS diff, min(line) FILTER (WHERE starts_with(line, '+++ ')) AS head FROM grouped GROUP BY p_partkey, g HAVING bool_or(starts_with(line, '--- ')))
    SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY g) - 1 AS INT) AS ord, regexp_replace(substr(head, 5), '^b/', '') AS filepath, diff, 'HEAD' AS base_commit FROM files
""")
def reply_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file's patch in a reply."""
    return patches.patches(table(spark, sf_dir, "part").select("p_partkey", F.expr(DIFF_REPLY).alias("reply")), "p_partkey", "reply")


RAW = (
    "CASE event_id % 4 WHEN 0 THEN concat('{\"content\": \"done ', event_type, '\", \"usage\": {\"prompt_tokens\": ', cast(event_id % 50 AS STRING), ', \"completion_tokens\": 7}, \"confidence\": 0.', cast(event_id % 90 + 10 AS STRING), '}') "
    "WHEN 1 THEN concat('{\"content\": \"\", \"text\": \"', event_type, ' it is\", \"prompt_tokens\": 12, \"cost_usd\": 0.25}') WHEN 2 THEN concat('{\"response\": \"Confidence: 0.', cast(event_id % 90 + 10 AS STRING), '\", \"cost\": 1.5}') ELSE concat('plain ', event_type, ' confidence: 0.5') END"
)


@query(rf"""
    WITH r AS (SELECT event_id, event_type, {ad.sql(RAW)} AS raw FROM events), j AS (SELECT *, CASE WHEN starts_with(raw, '{{') THEN raw ELSE '{{}}' END AS j FROM r),
    c AS (SELECT *, CASE WHEN starts_with(raw, '{{') THEN coalesce(nullif(json_extract_string(j, '$.content'), ''), nullif(json_extract_string(j, '$.text'), ''), nullif(json_extract_string(j, '$.response'), ''), '') ELSE raw END AS content FROM j)
    SELECT event_id, content, CAST(coalesce(json_extract_string(j, '$.prompt_tokens'), json_extract_string(j, '$.usage.prompt_tokens'), CAST(greatest(1, length(event_type) // 4) AS VARCHAR)) AS BIGINT) AS tokens_in,
           CAST(coalesce(json_extract_string(j, '$.completion_tokens'), json_extract_string(j, '$.usage.completion_tokens'), CAST(greatest(1, length(content) // 4) AS VARCHAR)) AS BIGINT) AS tokens_out,
           round(coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), TRY_CAST(regexp_extract(content, '(?i)"?confidence"?\s*[:=]\s*([01](?:\.[0-9]+)?)', 1) AS DOUBLE), 1.0), 6) AS confidence,
           CAST(coalesce(json_extract_string(j, '$.cost_usd'), json_extract_string(j, '$.cost')) AS DOUBLE) AS cost FROM c
""")
def unpack_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = tx.unpacked(F.col("raw"), F.col("event_type"))
    fields["confidence"] = F.round(fields["confidence"], 6)
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(RAW).alias("raw")).select("event_id", *(c.alias(n) for n, c in fields.items()))


@query(r"SELECT doc_id, md5(right(regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 4000)) AS tail FROM documents")
def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.log_tail(F.col("text"))).alias("tail"))


@query("WITH c AS (SELECT doc_id, source AS path, CASE WHEN doc_id % 3 > 0 THEN lang END AS symbol, text FROM documents) SELECT doc_id, md5(coalesce(symbol, '') || ' ' || path || ' ' || text) AS indexed, md5(path || ' ' || coalesce(symbol, '') || chr(10) || text) AS embedded FROM c")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.col("source"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(lexical.chunk_text(*parts)).alias("indexed"), F.md5(lexical.embed_text(*parts)).alias("embedded"))


@query("SELECT p_partkey, p_size || ';' || p_brand AS items FROM part")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('["'), F.col("p_size").cast("string"), F.lit('", "'), F.col("p_brand"), F.lit('"]'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tasks.as_list(text), ";").alias("items"))


# A diff of each document's text: its first line becomes two; its last line is replaced wherever it first stands, as the header's place is
# wrong; then by turns a hunk that can't match, an insertion at a place, no diff at all but a new text, and nothing more.
TEXT_LINES = "split(text, '\\n')"
PATCH = f"""
    CASE WHEN doc_id % 4 = 2 THEN concat('new text ', cast(doc_id AS STRING)) ELSE concat('--- a/f.txt\n+++ b/f.txt\n@@ -1,1 +1,2 @@\n-', element_at({TEXT_LINES}, 1), '\n+first\n+second\n@@ -900000,1 +900001,1 @@ far\n-', element_at({TEXT_LINES}, -1), '\n+last\n',
        CASE WHEN doc_id % 4 = 0 THEN '@@ -3 +3 @@\n-no such line\n+x\n' WHEN doc_id % 4 = 1 THEN '@@ -2,0 +3 @@\n+between\n' ELSE '' END) END
"""


@query(r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), a AS (SELECT doc_id, l[-1] AS z, list_concat(['first', 'second'], l[2:]) AS l FROM l), b AS (SELECT doc_id, l, list_position(l, z) AS p FROM a),
    c AS (SELECT doc_id, p, list_concat(list_concat(l[:p - 1], ['last']), l[p + 1:]) AS l FROM b), d AS (SELECT doc_id, p, CASE WHEN doc_id % 4 = 1 THEN list_concat(list_concat(l[:2], ['between']), l[3:]) ELSE l END AS l FROM c),
    e AS (SELECT doc_id, l, CASE WHEN doc_id % 4 <> 2 AND (doc_id % 4 = 0 OR coalesce(p, 0) = 0) THEN 'a hunk does not match' END AS error FROM d)
    SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'new text ' || doc_id WHEN error IS NULL THEN array_to_string(l, chr(10)) || chr(10) END AS text, error FROM e
""")
def patched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs applied to whole documents: moved, repeated and failing hunks, insertions, and new texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATCH).alias("diff"))
    return docs.select("doc_id", patches.apply_patch("text", "diff").alias("p")).select("doc_id", "p.text", "p.error")


@query(rf"WITH {PATHS} SELECT event_id, path FROM paths WHERE regexp_matches(path, '(^|/)test_[^/]*\.py$') OR path LIKE 'src/%.txt'")
def glob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that one of two globs matches, by name or as a whole."""
    paths = _paths(spark, sf_dir)
    return files.matching(paths, "test_*.py").unionByName(files.matching(paths, "src/*.txt")).distinct()


ODD_PATH = f"concat(CASE event_id % 4 WHEN 0 THEN 'venv/' WHEN 1 THEN 'a/build/' ELSE 'a/rebuild/' END, {PATH})"


@query(rf"WITH paths AS (SELECT event_id, {ad.sql(ODD_PATH)} AS path FROM events) SELECT event_id, path FROM paths WHERE ends_with(path, '.py') AND ({BY_FILE} OR {BY_DIR}) AND event_id % 4 > 1")
def scan_test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files outside of folders that are never read."""
    return files.test_files(table(spark, sf_dir, "events").select("event_id", F.expr(ODD_PATH).alias("path")))


TASK_LINE = "CASE s_suppkey % 4 WHEN 0 THEN concat('  task-', cast(s_suppkey AS STRING), ' ') WHEN 1 THEN concat('# task-', cast(s_suppkey AS STRING)) WHEN 2 THEN '' ELSE concat('task-', cast(s_suppkey AS STRING)) END"
TASK_JSON = "CASE WHEN s_suppkey % 3 = 0 THEN concat('{\"instance_id\": \"task-', cast(s_suppkey AS STRING), '\"}') ELSE concat('{\"instance_id\": \"task-', cast(s_suppkey AS STRING), '\", \"repo\": \"', s_name, '\", \"patch\": \"p', cast(s_nationkey AS STRING), '\"}') END"


@query("SELECT 'task-' || s_suppkey AS instance_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS repo, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'p' || s_nationkey END AS patch, '' AS base_commit FROM supplier WHERE s_suppkey % 4 IN (0, 3)")
def listed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and JSON lines written from suppliers, then read: blank lines and comments go, missing fields are empty."""
    place = f"{checkpoint_dir(spark)}/tasks-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "supplier")
    rows.select(F.expr(TASK_LINE).alias("value")).write.text(f"{place}/ids")
    rows.select(F.expr(TASK_JSON).alias("value")).write.text(f"{place}/tasks")
    return tasks.tasks(spark, f"{place}/tasks", tasks.task_ids(spark, f"{place}/ids")).select("instance_id", "repo", "patch", "base_commit")


# A source tree of each supplier: which files it has tells the framework.
TREE = [
    ("CASE s_suppkey % 8 WHEN 0 THEN 'conftest.py' WHEN 1 THEN 'manage.py' WHEN 2 THEN 'tests/test_a.py' WHEN 3 THEN 'package.json' WHEN 4 THEN 'package.json' WHEN 5 THEN 'pyproject.toml' WHEN 6 THEN 'requirements-dev.txt' ELSE 'readme.md' END",
     "CASE s_suppkey % 8 WHEN 2 THEN 'import unittest' WHEN 3 THEN '{\"devDependencies\": {\"jest\": \"1\"}}' WHEN 4 THEN '{\"scripts\": {\"test\": \"node t.js\"}}' WHEN 5 THEN '[tool.pytest]' WHEN 6 THEN 'pytest==8' ELSE '' END"),
    ("'src/main.py'", "'x = 1'"),
]
FRAMEWORK = "CASE s_suppkey % 8 WHEN 1 THEN 'django' WHEN 2 THEN 'unittest' WHEN 3 THEN 'jest' WHEN 4 THEN 'npm' ELSE 'pytest' END"
BASE = "CASE f WHEN 'django' THEN 'python manage.py test --noinput' WHEN 'unittest' THEN 'python -m unittest discover' WHEN 'jest' THEN 'npx jest' WHEN 'npm' THEN 'npm test --' ELSE 'pytest -q' END"


@query(f"""
    WITH s AS (SELECT s_suppkey AS repo, {FRAMEWORK} AS f FROM supplier)
    SELECT repo, f AS framework, {BASE} AS full_cmd, CASE WHEN repo % 3 > 0 THEN CASE f WHEN 'unittest' THEN 'python -m unittest' ELSE {BASE} END || CASE f WHEN 'django' THEN ' tests.t' || repo || '.x' ELSE ' tests/t' || repo || '.py::x' END END AS impacted_cmd FROM s
""")
def framework_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The framework that each tree's files show, and the commands for its impacted tests and for all."""
    rows = table(spark, sf_dir, "supplier")
    trees = None
    for path, text in TREE:
        one = rows.select(F.col("s_suppkey").alias("repo"), F.expr(path).alias("path"), F.expr(text).alias("text"))
        trees = one if trees is None else trees.unionByName(one)
    specs = frameworks.detect(trees)
    impacted = rows.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("repo"), F.concat(F.lit("tests/t"), F.col("s_suppkey").cast("string"), F.lit(".py::x")).alias("test"))
    plan = frameworks.plan(specs, impacted).join(specs.select("repo", "framework"), "repo")
    return plan.select("repo", "framework", F.array_join("full_cmd", " ").alias("full_cmd"), F.array_join("impacted_cmd", " ").alias("impacted_cmd"))
