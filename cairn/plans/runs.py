"""Queries: retrieval and outcome metrics, reports, ledgers, budgets, routing, composite pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import evaluation as ev
from cairn.operators import composed, fusion, graph, ledger, orchestrate, rerank, vector
from cairn.operators.common import checkpoint_dir, sent, top
from cairn.plans import adapters as ad
from cairn.plans import retrieval as rt
from cairn.plans.registry import query, table
from cairn.plans.texts import EXTRACT, REPLIES
from cairn.sources import tasks
from cairn.streaming import state

FOUND = f"{rt.TOKENS}, {rt.LUCENE}, {rt.SCORED}, evidence AS (SELECT query_id, d.source AS path, score, rank AS ord FROM {rt.top_sql('scored', 20)} h JOIN documents d ON d.doc_id = h.id), {ad.GOLD}"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's twenty best documents, with their source as path."""
    hits = rt._index(spark, sf_dir).search(rt._items(spark, sf_dir), "item_id", F.col("text"), 20)
    return hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path")), "id").select("query_id", "path", "score", F.col("rank").alias("ord"))


RECALL = """
    best AS (SELECT query_id, path, max(score) AS score FROM evidence GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS r FROM best),
    recall AS (SELECT g.query_id, count(r.path) / count(*) AS recall FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.path = g.path AND r.r <= 5 GROUP BY 1)"""


@query(f"WITH {FOUND}, {RECALL} SELECT query_id, round(recall, 6) AS recall FROM recall")
def recall_unique_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.recall_files(_evidence(spark, sf_dir), ad.gold(spark, sf_dir), 5, ["query_id"])
    return found.select("query_id", F.round("recall", 6).alias("recall"))


@query(f"WITH {FOUND}, {RECALL} SELECT round(avg(recall), 6) AS mean_recall FROM recall")
def mean_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per item; the items' task is the item itself."""
    items = rt._items(spark, sf_dir).select(F.col("item_id").alias("task_id"), F.col("item_id").alias("query_id"))
    goal = ad.gold(spark, sf_dir).withColumnRenamed("query_id", "task_id")
    out = ev.mean_recall(items, _evidence(spark, sf_dir), goal, 5, ["query_id"])
    return out.select(F.round("mean_recall", 6).alias("mean_recall"))


@query(f"""
    WITH {ad.CHUNKS}, goal AS (SELECT path, start_line + 1 AS s, end_line + 2 AS e FROM chunks WHERE start_line % 2 = 1),
    ev AS (SELECT path, start_line AS s, end_line AS e FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line DESC) AS k FROM chunks) WHERE k <= 3),
    hit AS (SELECT DISTINCT g.path, g.s, g.e, EXISTS (SELECT 1 FROM ev WHERE ev.path = g.path AND greatest(ev.s, g.s) <= least(ev.e, g.e)) AS h FROM goal g)
    SELECT path, round(avg(CAST(h AS INT)), 6) AS recall FROM hit GROUP BY path
""")
def recall_rows_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ad.chunks(spark, sf_dir)
    goal = chunks.where("start_line % 2 = 1").select("path", (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 2).alias("end_line"))
    rows = chunks.withColumn("ord", -F.col("start_line")).withColumn("task", F.col("path"))  # each file is a query of its own
    out = ev.recall_rows(rows, goal.withColumn("task", F.col("path")), 3, ["task"], spans=True)
    return out.select(F.col("task").alias("path"), F.round("recall", 6).alias("recall"))


@query(f"""
    WITH {rt.FUSED}, evidence AS (SELECT query_id, h.method, d.source AS path, h.score FROM hits h JOIN documents d ON d.doc_id = h.id WHERE rank <= 10), {ad.GOLD},
    best AS (SELECT query_id, method, path, max(score) AS score FROM evidence GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, path) AS r FROM best),
    each AS (SELECT m.method, g.query_id, count(r.path) / count(*) AS recall FROM gold g CROSS JOIN (VALUES ('bm25'), ('vector')) m(method) LEFT JOIN ranked r ON r.query_id = g.query_id AND r.method = m.method AND r.path = g.path AND r.r <= 5 GROUP BY ALL)
    SELECT method, round(avg(recall), 6) AS recall FROM each GROUP BY method
""")
def recall_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sent(rt._retriever(spark, sf_dir).hits(rt._queries(spark, sf_dir), 10))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path")).join(hits, "id").select("query_id", "method", "path", "score")
    goal = ad.gold(spark, sf_dir).withColumn("method", F.explode(F.array(F.lit("bm25"), F.lit("vector"))))
    return ev.recall_files(rows, goal, 5, ["query_id", "method"]).groupBy("method").agg(F.round(F.avg("recall"), 6).alias("recall"))


RATE = "round(avg(CAST(coalesce(resolved, false) AS INT)), 6)"
COST = "round(coalesce(sum(cost), 0) / nullif(sum(CAST(coalesce(resolved, false) AS INT)), 0), 6)"


def _by_config(spark: SparkSession, sf_dir: str, name: str, metric) -> DataFrame:
    return ad.records(spark, sf_dir).groupBy("config").agg(F.round(metric, 6).alias(name))


@query(f"WITH {ad.RECORDS} SELECT config, {RATE} AS resolve_rate FROM records GROUP BY config")
def resolve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_config(spark, sf_dir, "resolve_rate", ev.resolve_rate(F.col("resolved")))


@query(f"WITH {ad.RECORDS} SELECT config, round(avg(CAST(regressed AS INT)), 6) AS regression_rate FROM records GROUP BY config")
def regression_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_config(spark, sf_dir, "regression_rate", ev.regression_rate(F.col("regressed")))


@query(f"WITH {ad.RECORDS} SELECT config, {COST} AS cost_per_resolved FROM records GROUP BY config")
def cost_per_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_config(spark, sf_dir, "cost_per_resolved", ev.cost_per_resolved(F.col("cost"), F.col("resolved")))


@query(f"WITH {ad.RECORDS} SELECT config, round(avg(CASE WHEN resolved IS NOT NULL AND diffs >= 1 THEN CAST(NOT resolved AS INT) END), 6) AS false_approval FROM records GROUP BY config")
def false_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_config(spark, sf_dir, "false_approval", ev.false_approval_rate(F.col("resolved"), F.col("diffs")))


@query(f"WITH {ad.RECORDS} SELECT config, round(avg(CAST(resolved AS INT)), 6) AS attack_success FROM records GROUP BY config")
def attack_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_config(spark, sf_dir, "attack_success", ev.attack_success_rate(F.col("resolved")))


@query(f"WITH {ad.RECORDS}, each AS (SELECT config, run_idx, avg(CAST(regressed AS INT)) AS m FROM records GROUP BY ALL) SELECT config, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS spread FROM each GROUP BY config")
def across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.across_runs(ad.records(spark, sf_dir), ev.regression_rate(F.col("regressed")), ["config"])
    return out.select("config", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(f"WITH {ad.RECORDS} SELECT config, count(DISTINCT task_id) AS tasks, count(DISTINCT run_idx) AS runs, {RATE} AS resolve_rate, round(avg(CAST(regressed AS INT)), 6) AS regression_rate, {COST} AS cost_per_resolved, count(error) AS errors FROM records GROUP BY config")
def config_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.config_report(ad.records(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("resolve_rate", "regression_rate", "cost_per_resolved")})


@query(f"WITH {ad.RECORDS}, c AS (SELECT DISTINCT config FROM records), t AS (SELECT DISTINCT task_id FROM records) SELECT config, task_id, CAST(run_idx AS INT) AS run_idx FROM c, t, (SELECT unnest(range(0, 3)) AS run_idx)")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = ad.records(spark, sf_dir)
    return ev.grid(records.select("config").distinct(), records.select("task_id").distinct(), 3)


# A run's outcome comes from the customer that its task is; some crash, and some use tokens that cost nothing.
OUTCOME = ["(task_id + run_idx) % 3 = 0 AS resolved", "task_id % 40 AS tokens", "CASE WHEN task_id % 9 = 2 THEN 0.0e0 ELSE round(abs(c_acctbal) / 100, 2) END AS cost", "CASE WHEN (task_id + run_idx) % 11 = 0 THEN 'boom' END AS error"]
# The other engine rounds the product with 100, Spark the decimal that is shown: 67.975 would be 67.97 there and 67.98 here.
OUTCOME_HERE = [x.replace("round(abs(c_acctbal) / 100, 2)", "round(abs(c_acctbal) / 100 * 100) / 100") for x in OUTCOME]
CONFIGS = ["lexical", "dense", "hybrid"]


@query(f"""
    WITH grid AS (SELECT config, c_custkey AS task_id, run_idx, c_acctbal FROM customer, (VALUES {", ".join(f"('{c}')" for c in CONFIGS)}) c(config), (SELECT unnest(range(2)) AS run_idx)),
    ran AS (SELECT config, task_id, run_idx, {", ".join(OUTCOME)} FROM grid),
    checked AS (SELECT * REPLACE (CASE WHEN error IS NULL AND tokens > 0 AND cost = 0 THEN 'tokens were used but the cost is 0' ELSE error END AS error) FROM ran)
    SELECT config, task_id, CAST(run_idx AS INT) AS run_idx, resolved, tokens, cost, error, error IS NULL AND task_id % 2 = 0 AND config <> 'hybrid' AS cached FROM checked
""")
def resumed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of which a part was run before: what is cached is read, what crashed then is run again with the rest."""
    place = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    customers = table(spark, sf_dir, "customer")
    grid = lambda names, rows: ev.grid(spark.createDataFrame([(c,) for c in names], "config string"), rows.select(F.col("c_custkey").alias("task_id")), 2)
    run = lambda todo: todo.join(customers.select(F.col("c_custkey").alias("task_id"), "c_acctbal"), "task_id").selectExpr("config", "task_id", "run_idx", "key", *OUTCOME_HERE)
    ev.resume(grid(CONFIGS[:2], customers.where("c_custkey % 2 = 0")), place, run)
    return ev.resume(grid(CONFIGS, customers), place, run).drop("key")


@query(f"""
    WITH {ad.GOLD}, shown AS (SELECT 'control_gold' AS config, query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS r FROM gold),
    each AS (SELECT c.config, g.query_id, count(s.path) / count(*) AS recall FROM gold g CROSS JOIN (VALUES ('control_gold'), ('control_none')) c(config)
             LEFT JOIN shown s ON s.config = c.config AND s.query_id = g.query_id AND s.path = g.path AND s.r <= 5 GROUP BY ALL)
    SELECT config, avg(recall) AS recall FROM each GROUP BY config
""")
def control_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two controls bound the metric: perfect evidence scores 1 and none scores 0."""
    goal = ad.gold(spark, sf_dir)
    every = goal.withColumn("config", F.explode(F.array(F.lit("control_gold"), F.lit("control_none"))))
    shown = ev.control_systems(goal.withColumnRenamed("query_id", "task_id")).withColumnRenamed("task_id", "query_id")
    return ev.recall_files(shown, every, 5, ["config", "query_id"]).groupBy("config").agg(F.avg("recall").alias("recall"))


PRICED = f"{ad.CALLS}, {ad.SQL_PRICES}, priced AS (SELECT c.*, round((tokens_in * coalesce(price_in, 0.15)::DOUBLE + tokens_out * coalesce(price_out, 0.60)::DOUBLE) / 1000000, 6) AS cost FROM calls c LEFT JOIN prices USING (model))"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cost_per_million(ad.calls(spark, sf_dir), ad.prices(spark))


@query(f"WITH {PRICED} SELECT conv_id, count(*) AS calls, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM priced GROUP BY conv_id")
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage(_priced(spark, sf_dir), ["conv_id"])


@query(f"""
    WITH {PRICED}, run AS (SELECT conv_id, turn, CAST(sum(CASE WHEN tokens_out > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS total_loops, CAST(sum(tokens_in + tokens_out) OVER w AS BIGINT) AS total_tokens, round(sum(cost) OVER w, 6) AS total_cost, CAST(sum(1) OVER w AS BIGINT) AS total_calls
                           FROM priced WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT *, total_loops >= 3 OR total_tokens >= 600 OR total_cost >= 1.0 OR total_calls >= 30 AS exceeded FROM run
""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _priced(spark, sf_dir).select("conv_id", "turn", F.when(F.col("tokens_out") > 0, 1).otherwise(0).alias("loops"), (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), "cost", F.lit(1).alias("calls"))
    return ledger.budget_cut(steps, ledger.Budget(tokens=600), ["conv_id"], "turn").withColumn("total_cost", F.round("total_cost", 6))


@query(rf"""
    WITH {REPLIES}, why AS (SELECT e.event_id, CASE WHEN event_type = 'error' THEN NULL WHEN regexp_replace(reply, '[\x20\x09-\x0D]+', '', 'g') = '' THEN 'empty_response' WHEN event_type <> 'view' AND NOT ok THEN 'invalid_json'
                                             WHEN confidence < 0.75 THEN printf('low_confidence:%.2f<0.75', confidence) END AS reason, event_type = 'error' AS direct FROM sure s JOIN events e USING (event_id))
    SELECT event_id, reason, CASE WHEN direct OR reason IS NOT NULL THEN 'strong' ELSE 'cheap' END AS tier, CASE WHEN reason IS NOT NULL THEN 2 ELSE 1 END AS attempts FROM why
""")
def route_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task"), F.expr(ad.REPLY).alias("content"), (F.col("event_type") != "view").alias("require_json"))
    return ledger.route(replies, strong_tasks=("error",)).select("event_id", "reason", "tier", "attempts")


@query(f"WITH {ad.RECORDS}, each AS (SELECT config, run_idx, avg(CAST(regressed AS INT)) AS m FROM records GROUP BY ALL) SELECT config, printf('%.3f ± %.3f', avg(m), stddev_pop(m)) AS shown FROM each GROUP BY config")
def mean_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.across_runs(ad.records(spark, sf_dir), ev.regression_rate(F.col("regressed")), ["config"])
    return out.select("config", tx.mean_and_spread(F.col("mean"), F.col("spread")).alias("shown"))


@query(f"WITH {ad.CALLS} SELECT conv_id, turn, round(tokens_in / 1000 * 0.15e0 + tokens_out / 1000 * 0.6e0, 8) AS cost FROM calls")
def cost_per_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = ledger.cost_per_thousand(F.col("tokens_in"), F.col("tokens_out"), F.lit(0.15), F.lit(0.6))
    return ad.calls(spark, sf_dir).select("conv_id", "turn", cost.alias("cost"))


@query("SELECT event_id, event_type AS tool FROM events WHERE event_id % 3 IN (0, 1) AND user_id % 2 <> 0")
def allowed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), (F.col("user_id") % 2 == 0).alias("is_write"), F.concat(F.lit("stage"), (F.col("event_id") % 3).cast("string")).alias("stage"))
    return ledger.allowed_tools(tools, ("stage0", "stage1")).select("event_id", "tool")


FOLDED = "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles, coalesce(arg_max(turn, turn) FILTER (WHERE role = 'assistant'), -1) AS last_reply FROM conversations GROUP BY conv_id"
FOLD = {"order": "turn", "add": ["chars", "turns"], "concat": ["roles"], "last": ["last_reply"]}


def _deltas(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.lit(1).cast("long").alias("turns"), F.array("role").alias("roles"), F.when(F.col("role") == "assistant", F.col("turn")).alias("last_reply"))


def _shown_state(folded: DataFrame) -> DataFrame:
    return folded.withColumns({"roles": F.array_join("roles", ","), "last_reply": F.coalesce("last_reply", F.lit(-1))})


@query(FOLDED)
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_state(ledger.fold_state(_deltas(table(spark, sf_dir, "conversations")), ["conv_id"], **FOLD))


@query(FOLDED)
def state_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as a stream of deltas, file by file; what is left when it is read."""
    turns = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/conversations.parquet*")
    place = f"{checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    state.follow_states(_deltas(stream), f"{place}/out", f"{place}/checkpoint", by=["conv_id"], delta="turn", **FOLD).awaitTermination()
    return _shown_state(state.current_states(spark, f"{place}/out", ["conv_id"]))


@query(f"WITH {PRICED} SELECT conv_id, turn, model FROM priced WHERE tokens_in + tokens_out > 0 AND cost = 0")
def free_with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.free_with_tokens(_priced(spark, sf_dir)).select("conv_id", "turn", "model")


@query("WITH fresh AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 40 = 0)) SELECT user_id, event_type, event_id FROM fresh WHERE k = 1")
def dedup_new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ledger.new_evidence(events.select("user_id", "event_type", "event_id"), events.where("event_id % 40 = 0"), ["user_id"], "event_type", "event_id")


@query("SELECT c_custkey AS task_id, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer")
def semi_anti_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("instance_id"))
    return tasks.missing(ids, there).withColumn("found", F.lit(False)).unionByName(ids.join(there, ids["task_id"] == there["instance_id"], "left_semi").withColumn("found", F.lit(True)))


@query(f"WITH {ad.RECORDS}, r AS (SELECT event_id, substr(sha256('[\"v1\",\"' || config || '\",\"fp\",\"' || task_id || '\",\"' || run_idx || '\"]'), 1, 10) AS key FROM records) SELECT * FROM r")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.records(spark, sf_dir).select("event_id", tasks.record_key(F.lit("v1"), F.col("config"), F.lit("fp"), F.col("task_id"), F.col("run_idx")).alias("key"))


@query("WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) SELECT conv_id, turn, md5(text) AS content, conv_id % 2 = 0 AS verified FROM r WHERE k <= 5")
def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "conversations").withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.select("conv_id", "ord", F.col("text").alias("content"), "turn", F.struct("conv_id", "turn").alias("citation"))
    kept = ledger.claims(rows, ["conv_id"], F.col("conv_id") % 2 == 0)
    return kept.select("conv_id", F.col("citation.turn").alias("turn"), F.md5("content").alias("content"), "verified")


# --- composite pipelines ---

GRAPH = "near_edges AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.source = a.source)"


def _next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain within each source: a document calls the one with the next id, if it is of the same source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), "source", F.col("doc_id").alias("to"))
    named = docs.join(other, ["doc_id", "source"])
    return named.select(F.col("doc_id").alias("src"), F.col("to").alias("dst"), F.lit("calls").alias("kind"), F.when(F.col("doc_id") % 3 == 0, "heuristic").otherwise("exact").alias("conf"))


# A task's text names a file and quotes what it is about; the task holds some documents already.
TASK = "concat('Fix `', substr(text, 1, 30), '` in src/mod_', cast(item_id % 7 AS STRING), '.py: ', text)"
_FOUND = EXTRACT[EXTRACT.index("found AS") : EXTRACT.index("SELECT event_id, array_to_string")].rstrip().replace("event_id", "item_id")
ASKED = f"""issues AS (SELECT item_id, {TASK} AS text FROM benchmark), {_FOUND}, named AS (SELECT item_id, list_filter(q, lambda x, i: list_position(q, x) = i)[:8] AS q FROM found),
    asked AS (SELECT item_id || '#' || n AS item_id, text FROM (SELECT item_id, unnest(q) AS text, unnest(range(len(q))) AS n FROM named))"""


# A short query may share no bucket with a document, whose score is then 0.
FUSED_ASKED = rt.FUSED.replace("benchmark", "asked").replace("SELECT qv.id AS query_id, dv.id, sum(qv.v * dv.v) AS score FROM qv JOIN dv USING (bucket) GROUP BY ALL", "SELECT query_id, id, sum(score) AS score FROM (SELECT qv.id AS query_id, dv.id, qv.v * dv.v AS score FROM qv JOIN dv USING (bucket) UNION ALL SELECT q.id, d.id, 0 FROM qv_n q, dv_n d) GROUP BY ALL")


@query(f"""
    WITH RECURSIVE {ASKED}, {FUSED_ASKED}, fused AS (SELECT CAST(split_part(query_id, '#', 1) AS BIGINT) AS task_id, id, sum(1.0e0 / (60 + rank)) AS score, {rt.LABEL} FROM hits GROUP BY 1, 2),
    seeds AS (SELECT task_id, id, score, method FROM {rt.top_sql('fused', 5, 'task_id')}), {GRAPH},
    steps AS (SELECT src AS spot, dst AS nxt, CASE WHEN src % 3 = 0 THEN 1 ELSE 0 END AS r FROM near_edges UNION ALL SELECT dst, src, CASE WHEN src % 3 = 0 THEN 1 ELSE 0 END FROM near_edges),
    walk(seed, node, hop, r) AS (SELECT DISTINCT id, id, 0, 0 FROM seeds UNION SELECT seed, nxt, hop + 1, greatest(walk.r, steps.r) FROM walk JOIN steps ON spot = node WHERE hop < 2),
    short AS (SELECT seed, node, min(hop) AS hop FROM walk GROUP BY ALL), reached AS (SELECT seed, node, hop, min(r) AS r FROM walk JOIN short USING (seed, node, hop) GROUP BY ALL),
    grown AS (SELECT task_id, node AS id, max(score * pow(0.5e0, hop) * CASE r WHEN 0 THEN 1.0e0 ELSE 0.6e0 END) AS score FROM seeds JOIN reached ON seed = id WHERE hop > 0 GROUP BY ALL),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, id) AS k FROM grown WHERE (task_id, id) NOT IN (SELECT (task_id, id) FROM seeds)),
    every AS (SELECT task_id, id, method AS retrieval, round(score, 6) AS score FROM seeds UNION ALL SELECT task_id, id, 'graph', round(score, 6) FROM fresh WHERE k <= 20)
    SELECT * FROM every WHERE id % 17 <> task_id % 17
""")
def retriever_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retriever adds to each task: the queries named in its text searched together, the best expanded over the graph, less what it holds."""
    index = rt._index(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    hybrid = fusion.HybridRetriever(lambda q, k: index.search(q, "query_id", F.col("text"), k), lambda q, k: vector.sparse_top(rt._embedded(spark, sf_dir)[0], vector.hash_embed(q, "query_id", F.col("text")), k))
    tasks_ = rt._items(spark, sf_dir).select(F.col("item_id").alias("task_id"), F.expr(TASK).alias("text"))
    held = tasks_.select("task_id", (F.col("task_id") % 17).alias("slot")).join(docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 17).alias("slot")), "slot")
    return composed.retrieve(hybrid.search, tasks_, _next_edges(spark, sf_dir), held, 5)


NAVIGATED = f"""{rt.TOKENS}, {rt.LUCENE}, {rt.SCORED}, seeds AS (SELECT query_id, id, score / 100.0e0 AS score FROM {rt.top_sql('scored', 5)}), {GRAPH}, base AS (SELECT query_id, max(score) AS top FROM seeds GROUP BY query_id),
    walk(seed, node, hop) AS (SELECT DISTINCT id, id, 0 FROM seeds UNION SELECT seed, src, hop + 1 FROM walk JOIN near_edges ON dst = node WHERE hop < 2),
    hit AS (SELECT query_id, node AS id, min(hop) AS hop FROM seeds JOIN walk ON seed = id GROUP BY ALL),
    pool AS (SELECT query_id, id, score AS base, 0 AS hop FROM seeds UNION ALL SELECT query_id, id, 0.8e0 * top, hop FROM hit JOIN base USING (query_id) WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM seeds))"""


def _navigated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seeds = rt._index(spark, sf_dir).search(rt._items(spark, sf_dir), "item_id", F.col("text"), 5).select("query_id", F.col("id").alias("symbol"), (F.col("score") / 100).alias("score"))
    return composed.navigate(_next_edges(spark, sf_dir), seeds)


@query(f"""
    WITH RECURSIVE {NAVIGATED},
    texts AS (SELECT p.*, b.text AS query, d.source || '/' || d.doc_id || '.txt' AS path, d.text AS content, split_part(d.text, ' ', 1) AS symbol FROM pool p JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = p.id),
    sets AS (SELECT *, {rt.rerank_sql('query')} AS q, {rt.rerank_sql('symbol')} AS s, {rt.rerank_sql('path')} AS p, {rt.rerank_sql('content')} AS c FROM texts),
    final AS (SELECT query_id, id, path, hop, round(greatest(0, base + 0.35e0 * CASE WHEN length(symbol) > 2 AND contains(lower(query), lower(symbol)) THEN 1.0e0 ELSE len(list_intersect(q, s)) / greatest(len(s), 1) END
              + 0.25e0 * (len(list_intersect(q, p)) / greatest(len(p), 1)) + 0.25e0 * (len(list_intersect(q, c)) / greatest(len(q), 1)) - 0.12e0 * hop), 6) AS score FROM sets),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hop, path) AS k FROM final)
    SELECT query_id, id, CAST(hop AS INT) AS hop, CASE hop WHEN 0 THEN 'bm25' ELSE 'graph' END AS retrieval, round(score, 4) AS score FROM ranked WHERE k <= 20
""")
def navigator_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, their callers up to two hops away at 0.8 of the best seed's score, and the twenty best of all of them, reranked together."""
    pool = _navigated(spark, sf_dir)[0]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ad.doc_path().alias("path"), F.col("text").alias("content"), F.split_part("text", F.lit(" "), F.lit(1)).alias("symbol"))
    items = rt._items(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = pool.withColumnRenamed("symbol", "id").join(docs, "id").join(items, "query_id").select("query_id", "query", "symbol", "path", "content", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("score").alias("base_score"), "hop", F.col("id").alias("chunk_id"))
    ranked = rerank.rerank(rows, 20)
    return ranked.select("query_id", F.col("chunk_id").alias("id"), "hop", F.when(F.col("hop") == 0, "bm25").otherwise("graph").alias("retrieval"), F.round("score", 4).alias("score"))


@query(f"WITH RECURSIVE {NAVIGATED} SELECT DISTINCT query_id, d.lang || '/' || d.doc_id % 50 AS test FROM pool JOIN documents d ON d.doc_id = id")
def navigator_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests that cover what a change of the seeds may break; a document is covered by one test."""
    cover = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol"), F.concat("lang", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("test"))
    return graph.impacted_tests(_navigated(spark, sf_dir)[0], cover, ["query_id"])


@query(f"""
    WITH {rt.TOKENS}, {rt.LUCENE}, {rt.SCORED}, best AS (SELECT * FROM {rt.top_sql('scored', 3)}),
    shown AS (SELECT query_id, string_agg('# File: ' || source || ' (lines 1-' || n_chars || ')' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context FROM best JOIN documents ON doc_id = id GROUP BY query_id)
    SELECT item_id AS query_id, md5(coalesce(context, '# No context retrieved.' || chr(10))) AS context FROM benchmark LEFT JOIN shown ON query_id = item_id
""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rt._items(spark, sf_dir)
    hits = rt._index(spark, sf_dir).search(items, "item_id", F.col("text"), 3)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.lit(1).alias("start_line"), F.col("n_chars").alias("end_line"), F.col("text").alias("content"))
    shown = composed.prompt_context(items.select(F.col("item_id").alias("query_id")), hits.join(docs, "id").withColumnRenamed("rank", "ord"), ["query_id"])
    return shown.select("query_id", F.md5("context").alias("context"))


@query("""
    WITH turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
    open_ AS (SELECT conv_id, string_agg('turn ' || turn, ' | ' ORDER BY turn) AS q FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS wave FROM turns) WHERE (conv_id + turn) % 3 <> 0 GROUP BY conv_id)
    SELECT conv_id, coalesce(q, 'conversation ' || conv_id) AS query FROM (SELECT DISTINCT conv_id FROM turns) LEFT JOIN open_ USING (conv_id)
""")
def open_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are tasks, each waiting for the turn before; every third is done already."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    waves = graph.topological_waves(turns.select(name(F.col("turn")).alias("node")), turns.select(name(F.col("turn")).alias("node"), name(F.col("turn") - 1).alias("on")))
    nodes = turns.select("conv_id", name(F.col("turn")).alias("node"), F.col("turn").alias("ord"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("description"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "completed").otherwise("pending").alias("status"))
    tasks_ = turns.select("conv_id", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("task")).distinct()
    return composed.open_queries(tasks_, nodes, waves, ["conv_id"], "task")


@query(f"""
    WITH {PRICED}, spent AS (SELECT conv_id, sum(CASE WHEN tokens_out > 0 THEN 1 ELSE 0 END) AS loops, sum(tokens_in + tokens_out) AS tokens, sum(cost) AS cost, count(*) AS calls FROM priced GROUP BY conv_id),
    fit AS (SELECT conv_id FROM spent WHERE loops < 3 AND tokens < 600 AND cost < 1.0 AND calls < 30)
    SELECT DISTINCT conv_id, role AS chunk_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM fit) AND (conv_id, role) NOT IN (SELECT (conv_id, role) FROM conversations WHERE turn = 0)
""")
def gather_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New evidence of the conversations whose budget isn't spent: the roles that the first turn doesn't hold."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("chunk_id"), F.col("turn").alias("ord"))
    spent = _priced(spark, sf_dir).groupBy("conv_id").agg(F.sum(F.when(F.col("tokens_out") > 0, 1).otherwise(0)).alias("loops"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("calls"))
    return composed.gather(rows, rows.where("ord = 0"), spent, ledger.Budget(tokens=600), ["conv_id"], "chunk_id", "ord").select("conv_id", "chunk_id")


@query(f"WITH {rt.TOKENS}, {rt.LUCENE}, {rt.SCORED} SELECT query_id, h.id AS chunk_id, d.source || '@' || d.lang || ':1-' || d.n_chars AS citation, 'code' AS source_type, 'bm25' AS retrieval, round(score, 6) AS score FROM {rt.top_sql('scored', 5)} h JOIN documents d ON d.doc_id = h.id")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rt._index(spark, sf_dir).search(rt._items(spark, sf_dir), "item_id", F.col("text"), 5)
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), F.col("lang").alias("commit"), F.lit(1).alias("start_line"), F.col("n_chars").alias("end_line"), "text")
    rows = fusion.evidence(hits, chunks, F.lit("bm25"))
    return rows.select("query_id", "chunk_id", tx.citation(F.col("citation.path"), F.col("citation.commit"), F.col("citation.start_line"), F.col("citation.end_line")).alias("citation"), "source_type", "retrieval", "score")


def _metric_sql(name: str, metric: str, digits: int, where: str = "") -> str:
    shown = f"printf('%.{digits}f ± %.{digits}f', avg(m), stddev_pop(m))"
    return f"{name} AS (SELECT config, CASE WHEN avg(m) IS NULL THEN '-' ELSE {shown} END AS {name} FROM (SELECT config, run_idx, {metric} AS m FROM records GROUP BY ALL) GROUP BY config)"


@query(f"""
    WITH {ad.RECORDS}, {_metric_sql('resolve_rate', 'avg(CASE WHEN coalesce(resolved, false) THEN 1 ELSE 0 END)', 3)}, {_metric_sql('regression_rate', 'avg(CAST(regressed AS INT))', 3)},
    {_metric_sql('cost_per_resolved', 'CASE WHEN count(*) FILTER (WHERE resolved) > 0 THEN coalesce(sum(cost), 0) / count(*) FILTER (WHERE resolved) END', 4)},
    counts AS (SELECT config, count(DISTINCT task_id) AS tasks, count(DISTINCT run_idx) AS runs, count(error) AS errors FROM records GROUP BY config)
    SELECT * FROM counts JOIN resolve_rate USING (config) JOIN regression_rate USING (config) JOIN cost_per_resolved USING (config)
""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report prints of each config: rates as mean and spread over runs."""
    return ev.report_table(ad.records(spark, sf_dir))


# Orders as failed runs, with the columns that make a log.
RUN_LOG = ["o_orderkey AS run_id", "o_orderkey % 4 + 1 AS l_linenumber", "o_custkey AS l_partkey", "o_orderkey % 10 AS l_suppkey", "CASE o_orderkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS l_returnflag", "o_orderstatus AS l_linestatus"]
LOGGED = f"logs AS (SELECT run_id, l_linenumber, {ad.sql(ad.LOG)} AS log, l_partkey FROM (SELECT {', '.join(RUN_LOG)} FROM orders)), failed AS (SELECT *, list_filter(regexp_extract_all(log, '(?m)^\\s*FAILED\\s+(\\S+)', 1), lambda x, i: list_position(regexp_extract_all(log, '(?m)^\\s*FAILED\\s+(\\S+)', 1), x) = i) AS ids FROM logs)"


@query(rf"""
    WITH {LOGGED}, said AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 'look at ' || l_partkey END AS note FROM failed)
    SELECT run_id, l_linenumber % 3 + 1 AS loop_count,
           'before' || chr(10) || coalesce(note, 'Iteration ' || (l_linenumber % 3 + 1) || ': failed tests [' || array_to_string(list_transform(ids, lambda x: chr(39) || x || chr(39)), ', ') || ']. Error summary: ' || left(repeat(log, 4), 300)) AS notes FROM said
""")
def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed loop adds to a run's state: a reflector's note, or one made of the failed tests and the first of the errors."""
    by = ["run_id"]
    rows = table(spark, sf_dir, "orders").selectExpr(*RUN_LOG).select(*by, "l_linenumber", "l_partkey", F.expr(ad.LOG).alias("log"))
    states = rows.select(*by, F.array(F.lit("before")).alias("notes"), (F.col("l_linenumber") % 3).alias("loop_count"))
    found = rows.select(*by, tx.failed_tests(F.col("log")).alias("failed"), F.repeat("log", F.lit(4)).alias("error_logs"))
    said = rows.where("l_partkey % 10 < 5").select(*by, F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("  look at "), F.col("l_partkey").cast("string"), F.lit("\n"))).otherwise(" ").alias("note"))
    said = said.unionByName(rows.where("l_partkey % 10 = 5").select(*by, F.concat(F.lit("look at "), F.col("l_partkey").cast("string")).alias("note")))
    return orchestrate.reflect(states, found, by, said).select(*by, "loop_count", F.array_join("notes", "\n").alias("notes"))


@query("""
    WITH c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'task_1|pending|retriever|0|conversation ' || conv_id END AS plan, conv_id % 4 = 1 AS passed, CASE conv_id % 4 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 0 END AS total_run,
           CASE conv_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'E x' ELSE 'No test report generated.' END AS error_logs, CASE WHEN conv_id % 4 = 1 OR conv_id % 7 = 0 THEN 'respond' ELSE 'reflect' END AS next FROM c
""")
def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of tasks that nobody planned, the reports that answers are made of, and where a run goes after its tests."""
    runs = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("task", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    plans = orchestrate.default_plans(runs, runs.where("conv_id % 3 > 0"), ["conv_id"], "task")
    tested = runs.where("conv_id % 4 in (1, 2)").select("conv_id", (F.col("conv_id") % 4 == 1).alias("passed"), F.when(F.col("conv_id") % 4 == 1, 5).otherwise(3).alias("total_run"), F.array().cast("array<string>").alias("failed"), F.when(F.col("conv_id") % 4 == 1, "").otherwise("E x").alias("error_logs"))
    found = orchestrate.reports(runs.withColumn("impacted", F.array("task")), tested, ["conv_id"])
    rows = orchestrate.answers(runs, found, ["conv_id"]).join(plans, "conv_id", "left")
    plan = F.when(F.col("node").isNotNull(), F.concat_ws("|", "node.node_id", "node.status", "node.agent", F.size("node.dependencies").cast("string"), "node.description"))
    return rows.select("conv_id", plan.alias("plan"), "passed", "total_run", "error_logs", orchestrate.after_test(F.col("passed"), F.col("conv_id") % 7 == 0).alias("next"))
