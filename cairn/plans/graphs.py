"""Queries: edges, traversal, expansion, impact, names, spans, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import coverage as cov
from cairn.operators import graph
from cairn.operators.common import top
from cairn.plans import adapters as ad
from cairn.plans.registry import query, table

CONF = "CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'heuristic' ELSE 'ambiguous' END"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation as a seed, with a score."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("seed"), (1.0 / (1 + F.col("n_nationkey"))).alias("score"))


SEEDS = "seeds AS (SELECT 'n:' || n_nationkey AS seed, 1.0e0 / (1 + n_nationkey) AS score FROM nation)"


@query(f"WITH {ad.EDGES} SELECT src, dst, kind, {CONF} AS conf FROM (SELECT src, dst, kind, min({ad.RANK}) AS r FROM edges GROUP BY ALL)")
def best_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_edges(ad.edges(spark, sf_dir))


@query(f"WITH {ad.EDGES} SELECT kind, conf, count(*) AS n FROM edges GROUP BY ALL")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_stats(ad.edges(spark, sf_dir))


@query(f"WITH {ad.EDGES} SELECT kind, conf, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'calls', 'unresolved', count(*) FROM lineitem WHERE l_quantity > 45")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_stats(ad.edges(spark, sf_dir), table(spark, sf_dir, "lineitem").where("l_quantity > 45"))


@query(f"WITH {ad.EDGES} SELECT DISTINCT dst AS symbol, src AS caller FROM edges WHERE kind = 'calls' AND conf IN ('exact', 'heuristic')")
def callers_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers(ad.edges(spark, sf_dir), "heuristic")


@query(f"WITH {ad.EDGES} SELECT DISTINCT src AS symbol, dst AS callee FROM edges WHERE kind = 'calls' AND conf = 'exact'")
def callees_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callees(ad.edges(spark, sf_dir), "exact")


WALK = f"""
    steps AS (SELECT src AS spot, dst AS "to", {ad.RANK} AS r FROM edges WHERE kind IN ('inherits', 'contains') UNION ALL SELECT dst, src, {ad.RANK} FROM edges WHERE kind IN ('inherits', 'contains') AND {{both}}),
    walk(seed, node, hop, r) AS (SELECT seed, seed, 0, 0 FROM seeds UNION SELECT seed, "to", hop + 1, greatest(walk.r, steps.r) FROM walk JOIN steps ON spot = node WHERE hop < 2 AND steps.r <= {{worst}}),
    short AS (SELECT seed, node, min(hop) AS hop FROM walk GROUP BY ALL),
    reached AS (SELECT seed, node, hop, min(r) AS r FROM walk JOIN short USING (seed, node, hop) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {ad.EDGES}, {SEEDS}, {WALK.format(both='true', worst=2)} SELECT seed, node, hop FROM reached WHERE hop > 0")
def bfs_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(ad.edges(spark, sf_dir), _nations(spark, sf_dir), 2, ("inherits", "contains"), "both")


@query(f"""
    WITH RECURSIVE {ad.EDGES}, {SEEDS}, {WALK.format(both='true', worst=1)},
    best AS (SELECT 'n' || CAST(substr(seed, 3) AS INT) % 5 AS topic, node, max(score * pow(0.5e0, hop) * CASE r WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.6e0 ELSE 0.3e0 END) AS score FROM reached JOIN seeds USING (seed) WHERE hop > 0 GROUP BY ALL),
    fresh AS (SELECT * FROM best WHERE (topic, node) NOT IN (SELECT ('n' || CAST(substr(seed, 3) AS INT) % 5, seed) FROM seeds))
    SELECT topic, node, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, node) AS rank FROM fresh) WHERE rank <= 20
""")
def weighted_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = graph.ExpandConfig(kinds=("inherits", "contains"))
    seeds = _nations(spark, sf_dir).withColumn("topic", F.concat(F.lit("n"), (F.substring("seed", 3, 9).cast("int") % 5).cast("string")))
    found = graph.expand(ad.edges(spark, sf_dir), seeds, config, "topic")
    return top(found, config.max_nodes, ["topic"], F.round("score", 9).desc(), F.col("node")).select("topic", "node", F.round("score", 6).alias("score"), "rank")


@query(f"""
    WITH RECURSIVE {ad.EDGES}, {SEEDS}, {WALK.format(both='true', worst=1)},
    best AS (SELECT 'n' || CAST(substr(seed, 3) AS INT) % 5 AS topic, node, max(score * pow(0.5e0, hop) * CASE r WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.6e0 ELSE 0.3e0 END) AS score FROM reached JOIN seeds USING (seed) WHERE hop > 0 GROUP BY ALL),
    fresh AS (SELECT * FROM best WHERE (topic, node) NOT IN (SELECT ('n' || CAST(substr(seed, 3) AS INT) % 5, seed) FROM seeds)),
    held AS (SELECT 'c:' || c_custkey AS node, c_mktsegment || c_custkey % 7 AS chunk_id FROM customer),
    chosen AS (SELECT topic, chunk_id, node, round(score, 6) AS score, row_number() OVER (PARTITION BY topic, chunk_id ORDER BY score DESC, node DESC) AS first FROM fresh JOIN held USING (node))
    SELECT topic, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, node, chunk_id) AS rank FROM chosen WHERE first = 1) WHERE rank <= 10
""")
def expand_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each topic; chunks are shared by customers."""
    seeds = _nations(spark, sf_dir).withColumn("topic", F.concat(F.lit("n"), (F.substring("seed", 3, 9).cast("int") % 5).cast("string")))
    found = graph.expand(ad.edges(spark, sf_dir), seeds, graph.ExpandConfig(kinds=("inherits", "contains")), "topic")
    held = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"), F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("chunk_id"))
    return graph.chunk_evidence(found, held, 10, ["topic"]).select("topic", "chunk_id", "score", "rank")


@query(f"""
    WITH {ad.EDGES}, seeds AS (SELECT 'p:' || p_partkey AS seed FROM part),
    hit AS (SELECT seed, seed AS symbol, 0 AS hop FROM seeds UNION ALL SELECT DISTINCT dst, src, 1 FROM edges WHERE kind = 'calls' AND dst IN (SELECT seed FROM seeds)),
    cover AS (SELECT 'o:' || o_orderkey AS symbol, 'c:' || o_custkey AS test FROM orders)
    SELECT seed, count(DISTINCT symbol) AS symbols, max(hop) AS hops, count(DISTINCT test) AS tests, md5(coalesce(string_agg(DISTINCT test, ',' ORDER BY test), '')) AS digest FROM hit LEFT JOIN cover USING (symbol) GROUP BY seed
""")
def impact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("seed"))
    hit = graph.impact(ad.edges(spark, sf_dir), seeds, 1)
    cover = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("symbol"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("test"))
    tests = graph.impacted_tests(hit, cover, ["seed"]).groupBy("seed").agg(F.count("*").alias("tests"), F.array_join(F.array_sort(F.collect_list("test")), ",").alias("names"))
    size = hit.groupBy("seed").agg(F.count("*").alias("symbols"), F.max("hop").alias("hops"))
    return size.join(tests, "seed", "left").select("seed", "symbols", "hops", F.coalesce("tests", F.lit(0)).alias("tests"), F.md5(F.coalesce("names", F.lit(""))).alias("digest"))


@query(f"""
    WITH RECURSIVE {ad.EDGES}, down(ancestor, node_below) AS (SELECT dst, src FROM edges WHERE kind = 'inherits' UNION SELECT ancestor, src FROM down JOIN edges ON dst = node_below WHERE kind = 'inherits')
    SELECT ancestor, node_below FROM down
""")
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.descendants(ad.edges(spark, sf_dir))


@query("""
    WITH RECURSIVE nodes AS (SELECT DISTINCT conv_id, turn FROM conversations), first AS (SELECT conv_id, turn FROM nodes WHERE (conv_id, turn - 1) NOT IN (SELECT (conv_id, turn) FROM nodes)),
    waves(conv_id, turn, wave) AS (SELECT conv_id, turn, 1 FROM first UNION ALL SELECT w.conv_id, n.turn, wave + 1 FROM waves w JOIN nodes n ON n.conv_id = w.conv_id AND n.turn = w.turn + 1)
    SELECT conv_id || ':' || turn AS node, wave FROM waves
""")
def topo_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    return graph.topological_waves(turns.select(name(F.col("turn")).alias("node")), turns.select(name(F.col("turn")).alias("node"), name(F.col("turn") - 1).alias("on")))


MODULE = "replace(regexp_replace(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/$', ''), '/', '.')"
MODULES = f"modules AS (SELECT DISTINCT {MODULE} AS module FROM pages)"


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.expr(MODULE).alias("module")).distinct()


SUFFIXES = """
    cut AS (SELECT module, string_split(module, '.') AS p FROM modules), proper AS (SELECT module, array_to_string(p[i:], '.') AS suffix FROM (SELECT module, p, unnest(range(2, len(p) + 1)) AS i FROM cut)),
    suffixes AS (SELECT module AS suffix, module FROM modules UNION ALL SELECT suffix, CASE WHEN count(DISTINCT module) = 1 THEN min(module) END FROM proper WHERE suffix NOT IN (SELECT module FROM modules) GROUP BY suffix)"""


@query(f"WITH {MODULES}, {SUFFIXES} SELECT * FROM suffixes")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.suffix_index(_modules(spark, sf_dir))


@query(f"WITH {MODULES}, names AS (SELECT DISTINCT array_to_string(string_split(module, '.')[-2:], '.') AS name FROM modules) SELECT DISTINCT name, module AS qualname FROM names JOIN modules ON module = name OR ends_with(module, '.' || name)")
def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    parts = F.split("module", r"\.")
    names = modules.select(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".").alias("name"))
    return graph.lookup(names, modules.withColumnRenamed("module", "qualname"))


@query(f"WITH {MODULES}, owners AS (SELECT DISTINCT array_to_string(string_split(module, '.')[:i], '.') AS owner FROM modules, (SELECT unnest([2, 3]) AS i)) SELECT module AS qualname, arg_max(owner, length(owner)) AS owner FROM modules JOIN owners ON starts_with(module, owner || '.') GROUP BY module")
def enclosing_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _modules(spark, sf_dir)
    owners = modules.select(F.explode(F.array(*(F.array_join(F.slice(F.split("module", r"\."), 1, k), ".") for k in (2, 3)))).alias("owner"))
    return graph.enclosing(modules.withColumnRenamed("module", "qualname"), owners)


@query("""
    WITH calls AS (SELECT 'c:' || c_custkey AS src, c_nationkey % 9 || left(c_mktsegment, 1) AS method FROM customer), methods AS (SELECT 's:' || s_suppkey AS qualname, s_nationkey % 9 || substr('ABFHM', CAST(s_suppkey % 5 + 1 AS INT), 1) AS method FROM supplier),
    counted AS (SELECT *, count(*) OVER (PARTITION BY method) AS n FROM methods)
    SELECT src, qualname AS dst, CASE n WHEN 1 THEN 'heuristic' ELSE 'ambiguous' END AS conf FROM calls JOIN counted USING (method) WHERE n <= 4
""")
def heuristic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("src"), F.concat((F.col("c_nationkey") % 9).cast("string"), F.left("c_mktsegment", F.lit(1))).alias("method"))
    letter = F.expr("substr('ABFHM', cast(s_suppkey % 5 + 1 as int), 1)")
    methods = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("qualname"), F.concat((F.col("s_nationkey") % 9).cast("string"), letter).alias("method"))
    return graph.heuristic_match(calls, methods)


@query(f"""
    WITH {ad.CHUNKS}, spans AS (SELECT path, chunk_id AS name, start_line, end_line FROM chunks UNION ALL SELECT path, path, 1, len(lines) FROM cut), lines AS (SELECT path, unnest(range(1, len(lines) + 1)) AS line FROM cut),
    held AS (SELECT l.path, line, name, row_number() OVER (PARTITION BY l.path, line ORDER BY end_line - start_line, start_line, name) AS k FROM lines l JOIN spans s ON s.path = l.path AND line BETWEEN start_line AND end_line)
    SELECT path, CAST(line AS INT) AS line, name FROM held WHERE k = 1
""")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(ad.doc_path().alias("path"), F.size(F.split("text", "\n")).alias("n"))
    spans = ad.chunks(spark, sf_dir).select("path", F.col("chunk_id").alias("name"), "start_line", "end_line").unionByName(docs.select("path", F.col("path").alias("name"), F.lit(1).alias("start_line"), F.col("n").alias("end_line")))
    return cov.innermost(docs.select("path", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line")), spans)


@query(f"WITH {ad.CHUNKS} SELECT chunk_id, start_line, end_line FROM chunks c WHERE EXISTS (SELECT 1 FROM chunks g WHERE g.path = c.path AND g.start_line % 3 = 1 AND greatest(c.start_line, g.start_line + 2) <= least(c.end_line, g.end_line + 3))")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ad.chunks(spark, sf_dir)
    gold = chunks.where("start_line % 3 = 1").select("path", (F.col("start_line") + 2).alias("start_line"), (F.col("end_line") + 3).alias("end_line"))
    return cov.overlaps(chunks, gold).select("chunk_id", "start_line", "end_line")


@query(f"""
    WITH {ad.CHUNKS}, named AS (SELECT path, 'sym_' || start_line AS symbol, start_line, end_line FROM chunks), lines AS (SELECT path, unnest(range(1, len(lines) + 1)) AS line FROM cut),
    run AS (SELECT path, line, CASE line % 4 WHEN 0 THEN '' WHEN 1 THEN 't.py::a|run' WHEN 2 THEN 't.py::b[1|2]' ELSE 't.py::c|setup' END AS context FROM lines)
    SELECT DISTINCT n.path || '::' || symbol AS symbol_id, regexp_replace(context, '\\|(run|setup|teardown)$', '') AS test_id FROM run r JOIN named n ON n.path = r.path AND line BETWEEN start_line AND end_line WHERE context <> ''
""")
def line_to_span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ad.chunks(spark, sf_dir).withColumn("symbol", F.concat(F.lit("sym_"), F.col("start_line").cast("string")))
    lines = table(spark, sf_dir, "documents").select(ad.doc_path().alias("path"), F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("line"))
    context = F.expr("CASE line % 4 WHEN 0 THEN '' WHEN 1 THEN 't.py::a|run' WHEN 2 THEN 't.py::b[1|2]' ELSE 't.py::c|setup' END")
    return cov.from_lines(lines, chunks, tx.clean_context(context))


SYMBOL = "CASE p_partkey % 4 WHEN 0 THEN concat('C', cast(p_size AS STRING), '.__init__') WHEN 1 THEN concat('C', cast(p_size AS STRING), '.__len__') WHEN 2 THEN concat('C', cast(p_size AS STRING), '.m', cast(p_partkey % 50 AS STRING)) ELSE concat('f', cast(p_partkey % 90 AS STRING)) END"
FILE = "CASE WHEN p_partkey % 11 = 0 THEN concat('tests/a', cast(p_size AS STRING), '.py') ELSE concat('src/a', cast(p_size AS STRING), '.py') END"
MENTION = "CASE l_linenumber % 3 WHEN 0 THEN concat('C', cast(l_partkey % 50 AS STRING)) WHEN 1 THEN concat('m', cast(l_partkey % 50 AS STRING)) ELSE concat('f', cast(l_partkey % 100 AS STRING)) END"


NAMED = f"""
    WITH syms AS (SELECT {ad.sql(FILE)} AS path, {ad.sql(SYMBOL)} AS symbol FROM part),
    short AS (SELECT path || '::' || symbol AS symbol_id, CASE WHEN split_part(symbol, '.', 2) = '__init__' THEN split_part(symbol, '.', 1) WHEN split_part(symbol, '.', 2) LIKE '\\_\\_%' ESCAPE '\\' THEN NULL WHEN symbol LIKE '%.%' THEN split_part(symbol, '.', 2) ELSE symbol END AS name FROM syms WHERE path NOT LIKE 'tests/%'),
    tests AS (SELECT DISTINCT 't.py::test_' || l_suppkey AS test_id, {ad.sql(MENTION)} AS name FROM lineitem)"""


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, None, DataFrame]:
    chunks = table(spark, sf_dir, "part").select(F.expr(FILE).alias("path"), F.expr(SYMBOL).alias("symbol"))
    tests = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t.py::test_"), F.col("l_suppkey").cast("string")).alias("test_id"), F.expr(MENTION).alias("name")).distinct()
    return chunks, None, tests


@query(f"{NAMED} SELECT DISTINCT symbol_id, test_id FROM tests JOIN short USING (name)")
def name_link_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _, tests = _named(spark, sf_dir)
    return cov.from_names(tests, chunks)


@query(f"WITH {ad.COVERAGE}, each AS (SELECT symbol_id, count(DISTINCT test_id) AS n FROM coverage GROUP BY 1) SELECT count(*) AS symbols, (SELECT count(DISTINCT test_id) FROM coverage) AS tests, round(avg(n), 6) AS tests_per_symbol FROM each")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.stats(ad.coverage(spark, sf_dir)).withColumn("tests_per_symbol", F.round("tests_per_symbol", 6))


@query(f"WITH {ad.COVERAGE}, more AS (SELECT 'p:' || l_partkey AS symbol_id, 's:' || l_suppkey AS test_id FROM lineitem) SELECT symbol_id, test_id FROM coverage UNION SELECT symbol_id, test_id FROM more")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("symbol_id"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("test_id"))
    return cov.merge(ad.coverage(spark, sf_dir), more)


@query("SELECT 'p:' || p_partkey AS symbol_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 35)")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_quantity > 35").select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("symbol_id"))
    return cov.uncovered(table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("symbol_id")), covered)


@query(f"WITH {ad.COVERAGE} SELECT DISTINCT test_id FROM coverage WHERE symbol_id IN (SELECT 'p:' || p_partkey FROM part WHERE p_size < 10)")
def tests_for_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.tests_for(table(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("symbol_id")), ad.coverage(spark, sf_dir))


@query(f"WITH {ad.COVERAGE} SELECT symbol_id, '[' || string_agg('\"' || test_id || '\"', ',' ORDER BY test_id) || ']' AS tests FROM coverage GROUP BY symbol_id")
def coverage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.sources.tasks import coverage_json as as_json

    return as_json(ad.coverage(spark, sf_dir))


@query(f"WITH {ad.COVERAGE} SELECT DISTINCT symbol_id FROM coverage WHERE test_id IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def symbols_for_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("test_id"))
    return cov.symbols_for(tests, ad.coverage(spark, sf_dir))


@query(f"{NAMED} SELECT DISTINCT symbol_id, test_id, 'static' AS source FROM tests JOIN short USING (name)")
def coverage_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without line contexts a coverage map is linked by names."""
    return cov.build(*_named(spark, sf_dir), F.lit(""))


# Customers as classes: each has two bases, so there are diamonds; some bases are larger numbers, so there are cycles.
BASE = ["CASE WHEN c_custkey % 20 = 0 THEN c_custkey + 1 ELSE cast(floor(c_custkey / 2) AS BIGINT) END", "CASE WHEN c_custkey % 7 = 1 THEN 2 * c_custkey ELSE cast(floor(c_custkey / 3) AS BIGINT) END"]
MEMBER = "concat('n', cast(c_nationkey % 3 AS STRING))"
CLASSES = f"""
    cls AS (SELECT c_custkey AS k, 'c' || c_custkey AS cls, CASE WHEN c_mktsegment = 'BUILDING' THEN {MEMBER} END AS member, [{", ".join(BASE)}] AS b FROM customer),
    bases AS (SELECT x.cls, o.pos, y.cls AS base FROM cls x, (VALUES (0), (1)) o(pos) JOIN cls y ON y.k = x.b[o.pos + 1])
"""


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bases (cls, pos, base) and members (owner, name)."""
    rows = table(spark, sf_dir, "customer")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    classes = rows.select(name(F.col("c_custkey")).alias("base"))
    bases = rows.select(name(F.col("c_custkey")).alias("cls"), F.posexplode(F.array(*(F.expr(b) for b in BASE))).alias("pos", "b")).select("cls", "pos", name(F.col("b")).alias("base"))
    members = rows.where("c_mktsegment = 'BUILDING'").select(name(F.col("c_custkey")).alias("owner"), F.expr(MEMBER).alias("name"))
    return bases.join(classes, "base", "left_semi").select("cls", "pos", "base"), members


@query(f"""
    WITH RECURSIVE {CLASSES}, walk(cls, name, spot, route, seen) AS (
        SELECT cls, name, cls, CAST([] AS INT[]), [cls] FROM cls, (VALUES ('n0'), ('n1'), ('n2')) n(name)
        UNION ALL SELECT w.cls, w.name, base, list_append(route, pos), list_append(seen, base) FROM walk w JOIN cls c ON c.cls = w.spot JOIN bases ON bases.cls = w.spot WHERE c.member IS DISTINCT FROM w.name AND NOT list_contains(seen, base))
    SELECT w.cls, w.name, arg_min(spot, route) AS owner FROM walk w JOIN cls c ON c.cls = w.spot WHERE c.member = w.name GROUP BY w.cls, w.name
""")
def method_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members asked of every class, found up its bases in depth-first order, over diamonds and cycles."""
    bases, members = _classes(spark, sf_dir)
    names = F.explode(F.array(*(F.lit(f"n{k}") for k in range(3)))).alias("name")
    return graph.inherited(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cls"), names), bases, members)


@query(f"""
    WITH RECURSIVE {CLASSES}, down(ancestor, node_below) AS (SELECT base, cls FROM bases UNION SELECT ancestor, cls FROM down JOIN bases ON base = node_below)
    SELECT a.cls || '.' || a.member AS node, b.cls || '.' || b.member AS override FROM cls a JOIN down ON ancestor = a.cls JOIN cls b ON b.cls = node_below WHERE a.member = b.member
""")
def method_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method and those of its name on the classes below its own."""
    bases, members = _classes(spark, sf_dir)
    methods = members.select(F.concat_ws(".", "owner", "name").alias("qualname"), F.lit("method").alias("kind"), F.col("owner").alias("parent"))
    below = graph.ancestors(graph.classes_of(methods), bases.select(F.col("cls").alias("src"), F.col("base").alias("dst"), F.lit("inherits").alias("kind")))
    return graph.overrides(methods.select(F.col("qualname").alias("node")), methods, below)


@query(f"""
    WITH {ad.CHUNKS}, named AS (SELECT path, 'sym_' || start_line AS symbol, start_line, end_line FROM chunks), lines AS (SELECT path, unnest(range(1, len(lines) + 1)) AS line FROM cut)
    SELECT DISTINCT n.path || '::' || symbol AS symbol_id, 't' || line % 3 AS test_id FROM lines r JOIN named n ON n.path = r.path AND line BETWEEN start_line AND end_line WHERE line % 5 <> 0
""")
def coverage_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage rows under absolute, relative and foreign paths, mapped to the symbols of their lines."""
    chunks = ad.chunks(spark, sf_dir).withColumn("symbol", F.concat(F.lit("sym_"), F.col("start_line").cast("string")))
    lines = table(spark, sf_dir, "documents").select(ad.doc_path().alias("path"), F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("line"))
    file = F.when(F.col("line") % 5 == 0, F.concat(F.lit("/usr/lib/"), "path")).when(F.col("line") % 2 == 0, F.concat(F.lit("/work/repo/"), "path")).otherwise(F.concat(F.lit("./"), "path"))
    rows = cov.executed_lines(lines.select(file.alias("file"), "line"), "/work/repo/")
    return cov.from_lines(rows, chunks, F.concat(F.lit("t"), (F.col("line") % 3).cast("string")))
