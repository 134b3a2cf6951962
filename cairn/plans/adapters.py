"""How the test tables stand in for chunks, queries, edges, coverage, runs and logs; each view in Spark and, below it, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import chunking
from cairn.operators.common import sent
from cairn.plans.registry import table

BLANK = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g') = ''"


def sql_tokens(x: str) -> str:
    parts = r"regexp_extract_all(regexp_replace(regexp_replace(i, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return f"flatten(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda i: list_transform(list_concat(CASE WHEN len({parts}) > 1 THEN [i] ELSE [] END, {parts}), lambda p: lower(p))))"


def doc_path() -> Column:
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    """documents as chunks of five lines."""
    return chunking.windows(chunking.document_spans(table(spark, sf_dir, "documents"), doc_path(), F.col("text"), F.col("lang")), size)


CHUNKS = rf"""
    cut AS (SELECT source || '/' || doc_id || '.txt' AS path, lang AS commit, string_split(text, chr(10)) AS lines FROM documents),
    filled AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: NOT {BLANK.format("lines[i]")}) AS f FROM cut),
    starts AS (SELECT *, list_max(f) AS e, unnest(range(list_min(f), list_max(f) + 1, 5)) AS a FROM filled WHERE len(f) > 0),
    windowed AS (SELECT *, least(a + 4, e) AS z, lines[a:least(a + 4, e)] AS w FROM starts),
    led AS (SELECT *, coalesce(list_min(list_transform(list_filter(w, lambda x: NOT {BLANK.format("x")}), lambda x: length(x) - length(ltrim(x)))), 0) AS lead FROM windowed),
    chunks AS (SELECT path || ':' || a || '-' || z AS chunk_id, path, CAST(a AS INT) AS start_line, CAST(z AS INT) AS end_line, CAST(NULL AS VARCHAR) AS symbol,
                      array_to_string(list_transform(w, lambda x: CASE WHEN {BLANK.format("x")} THEN '' ELSE x[lead + 1:] END), chr(10)) AS text, commit FROM led)
"""

IDENTIFIERS = "concat(p_brand, ' add_item(', p_name, ') HTTPServer2', '_', p_type, ' __init__ _ x', p_size)"


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) with identifiers of every shape, from part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(IDENTIFIERS).alias("text"))


SQL_IDENTIFIERS = f"identifiers AS (SELECT p_partkey AS id, {IDENTIFIERS} AS text FROM part)"

# The same expressions run in both engines.
ISSUE = (
    "concat('Fix ', upper(substr(event_type, 1, 1)), substr(event_type, 2), 'Error in src/mod_', cast(event_id % 17 AS STRING), '.py: `do_', event_type, '` fails. Call shop.Cart.add_item', "
    "CASE WHEN user_id % 3 = 0 THEN ' or \"SymbolGraph\"' WHEN user_id % 3 = 1 THEN ' via HybridRetriever' ELSE ' then retry_count_2' END, '\nMore text. def fn_', cast(user_id AS STRING), '(x): class Late_', event_type)"
)
LOG = (
    "concat('FAILED tests/t_', cast(l_partkey % 7 AS STRING), '.py::test_', cast(l_suppkey AS STRING), ' - x', '\n', CASE WHEN l_returnflag = 'R' THEN concat('FAILED tests/u.py::test_', cast(l_linenumber AS STRING), '\n') ELSE '' END, "
    "CASE WHEN l_returnflag = 'A' THEN '' ELSE concat(cast(l_linenumber AS STRING), ' failed, ', cast(l_partkey % 9 AS STRING), ' passed') END, CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN ', 1 error in 0.2s' ELSE '' END)"
)
REPLY = (
    "CASE WHEN event_id % 6 = 0 THEN concat('{\"confidence\": 0.', cast(event_id % 100 AS STRING), ', \"a\": 1}') WHEN event_id % 6 = 1 THEN concat('```json\n{\"confidence\": 0.', cast(event_id % 10 AS STRING), '}\n```') "
    "WHEN event_id % 6 = 2 THEN concat('Confidence: 0.', cast(event_id % 97 AS STRING), ' I think') WHEN event_id % 6 = 3 THEN '   ' WHEN event_id % 6 = 4 THEN '{bad' ELSE '{\"confidence\": 7}' END"
)
DIFF = (
    "concat('diff --git a/src/', lower(replace(p_brand, '#', '_')), '.py b/src/', lower(replace(p_brand, '#', '_')), '.py\n--- a/src/', lower(replace(p_brand, '#', '_')), '.py\n+++ b/src/', lower(replace(p_brand, '#', '_')), '.py\n@@ -', cast(p_size AS STRING), ',', cast(p_partkey % 4 AS STRING), ' +', "
    "cast(p_size AS STRING), ',5 @@ def f\n-a\n+b\n@@ -90 +91 @@\n', CASE WHEN p_partkey % 2 = 0 THEN concat('diff --git a/t/x.py b/t/y', cast(p_size AS STRING), '.py\n--- /dev/null\n+++ b/t/y.py\n@@ -0,0 +1,2 @@\n+z\n') ELSE '' END)"
)


def sql(expression: str) -> str:
    """An adapter expression in the other engine's words."""
    return expression.replace("\\n", "\n").replace(" AS STRING)", " AS VARCHAR)").replace("'\n", "'" + "\n")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a graph: orders call parts, orders are contained in customers, customers inherit from nations, nations from regions."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    by = lambda c, a, b: F.when(F.col(c) == a, "exact").when(F.col(c) == b, "heuristic").otherwise("ambiguous")
    row = lambda df, src, dst, kind, conf: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), conf.alias("conf"))
    return (
        row(t("lineitem"), name("o:", "l_orderkey"), name("p:", "l_partkey"), "calls", by("l_returnflag", "A", "N"))
        .unionByName(row(t("orders"), name("o:", "o_orderkey"), name("c:", "o_custkey"), "contains", by("o_orderstatus", "F", "O")))
        .unionByName(row(t("customer"), name("c:", "c_custkey"), name("n:", "c_nationkey"), "inherits", by("c_mktsegment", "BUILDING", "MACHINERY")))
        .unionByName(row(t("nation"), name("n:", "n_nationkey"), name("r:", "n_regionkey"), "inherits", F.lit("exact")))
    )


EDGES = """
    edges AS (
        SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, 'calls' AS kind, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'heuristic' ELSE 'ambiguous' END AS conf FROM lineitem
        UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'contains', CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'heuristic' ELSE 'ambiguous' END FROM orders
        UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'inherits', CASE c_mktsegment WHEN 'BUILDING' THEN 'exact' WHEN 'MACHINERY' THEN 'heuristic' ELSE 'ambiguous' END FROM customer
        UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'inherits', 'exact' FROM nation)
"""
RANK = "CASE conf WHEN 'exact' THEN 0 WHEN 'heuristic' THEN 1 ELSE 2 END"


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, test_id): parts and the orders that hold them."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("symbol_id"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("test_id")).distinct()


COVERAGE = "coverage AS (SELECT DISTINCT 'p:' || l_partkey AS symbol_id, 'o:' || l_orderkey AS test_id FROM lineitem)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs: config, task, run, nullable outcomes, cost, diffs, error."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), F.col("user_id").alias("task_id"), (F.col("event_id") % 3).alias("run_idx"), "event_id",
        F.when(k % 5 != 0, k % 2 == 0).alias("resolved"), F.when(k % 7 != 0, k % 3 == 0).alias("regressed"), F.when(k % 13 != 0, F.col("value")).alias("cost"), (k % 4).alias("diffs"), F.when(k % 11 == 0, "boom").alias("error"),
    )


RECORDS = """
    k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    records AS (SELECT event_type AS config, user_id AS task_id, event_id % 3 AS run_idx, event_id, CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS resolved, CASE WHEN k % 7 <> 0 THEN k % 3 = 0 END AS regressed,
                       CASE WHEN k % 13 <> 0 THEN value END AS cost, k % 4 AS diffs, CASE WHEN k % 11 = 0 THEN 'boom' END AS error FROM k)
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as model calls: system and user turns are read, assistant turns written."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    out = F.col("role") == "assistant"
    model = F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("unknown"), F.lit("mock")), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), F.when(out, 0).otherwise(tokens).alias("tokens_in"), F.when(out, tokens).otherwise(0).alias("tokens_out"))


CALLS = """
    calls AS (SELECT conv_id, turn, ['small', 'large', 'unknown', 'mock'][CAST(conv_id % 4 + 1 AS INT)] AS model, CASE WHEN role = 'assistant' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens_in,
                     CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END AS tokens_out FROM conversations)
"""
PRICES = [("small", 0.15, 0.60), ("large", 2.50, 10.00), ("mock", 0.0, 0.0)]
SQL_PRICES = "prices(model, price_in, price_out) AS (VALUES ('small', 0.15, 0.60), ('large', 2.50, 10.00), ('mock', 0, 0))"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


def gold(spark: SparkSession, sf_dir: str, words: int = 8) -> DataFrame:
    """(query_id, path): sources with a document that contains an item's text.

    Candidates share the item's first words: an equi-join of ids on their hash; the texts of candidates are then fetched and compared whole.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    w = F.col("w")
    head = lambda a, i: F.array_join(F.slice(a, i, words - 2), " ")
    # The first word may be glued to what stands before it and the last to what follows, so the words between are keyed.
    keyed = items.select("query_id", F.xxhash64(head(F.split("item", " "), F.lit(2))).alias("key"))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (words - 3))), lambda i: F.xxhash64(head(w, i)))
    spots = docs.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))  # split once
    near = sent(spots.join(keyed, "key").select("doc_id", "query_id").distinct())
    found = docs.join(near, "doc_id").join(items, "query_id").where(F.contains("text", F.col("item")))
    return found.select("query_id", F.col("source").alias("path")).distinct()


GOLD = "gold AS (SELECT DISTINCT item_id AS query_id, source AS path FROM documents d, benchmark b WHERE contains(d.text, b.text))"
