"""Queries: parsed source files and the symbol graph. part and supplier stand in for a tree of Python files, one or more a row; what a
reader of the files must find is derived from the same columns in SQL.

Part k is a module of package shop.g(k mod 13) with a class, methods, a function within a method and a function. It imports its
halves and thirds by alias, by relative names of one and two levels, by a dotted name (a third of which lead nowhere) and by a suffix of
a module's name. The halves' and thirds' classes are its class's bases, so there are diamonds, and cycles from k = 0 on. Some modules
have a namesake in another tree, so the suffix is ambiguous; some files don't parse. Each supplier is a file of tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.adapters import BLANK
from cairn.plans.registry import query, table
from cairn.sources import code

# These expressions run in both engines.
PART = [
    "p_partkey AS k",
    "CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1 ELSE cast(floor(p_partkey / 2) AS BIGINT) END AS a",
    "cast(floor(p_partkey / 3) AS BIGINT) AS b",
    "CASE WHEN p_partkey < 13 THEN p_partkey ELSE p_partkey - 13 END AS c",
    "cast(floor(p_partkey / 5) AS BIGINT) + CASE WHEN p_partkey % 3 = 0 THEN 100000000 ELSE 0 END AS d",
    "concat('use_', cast(p_size AS STRING), '_', substr(p_brand, 7)) AS own",
    "concat('use_', cast(p_size % 50 + 1 AS STRING), '_', cast(cast(substr(p_brand, 7) AS INT) % 25 + 1 AS STRING)) AS other",
    "p_name AS about",
    "CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS checks",
]
SUPPLIER = ["s_suppkey AS j", "s_suppkey * 3 AS e", "concat('use_', cast(s_nationkey + 1 AS STRING), '_', cast(s_suppkey % 25 + 1 AS STRING)) AS other"]


def _at(x: str) -> str:
    """g<package>.m<key>, as an expression."""
    return f"concat('g', cast({x} % 13 AS STRING), '.m', cast({x} AS STRING))"


def _text(lines: str, names: dict[str, str]) -> str:
    """Lines with {names} as one expression."""
    for k, x in names.items():
        lines = lines.replace("{" + k + "}", f"', {x}, '")
    return f"concat('{lines}')"


CLASS = """import json
import shop.{at_a} as up
from .m{c} import make_{c} as made
from ..{at_b} import C{b}
import shop.{at_d}
from {at_a} import C{a} as Base


class C{k}(Base, C{b}):
    \"\"\"{about}.\"\"\"

    def __init__(self, item):
        self.item = item
        self.check(item)

    def {own}(self, x):
        def inner(y):
            return self.check(y)
        up.make_{a}(x)
        shop.{at_d}.make_{d}(x)
        return json.loads(made(inner(x)))
"""
CHECK = """
    def check(self, item):
        return item
"""
MAKE = """

def make_{k}(item):
    x = C{k}(item)
    x.{other}(item)
    helper(item).close()
    return x
"""
TESTS = """from shop.{at_e} import C{e}, make_{e}
from shop import missing


class TestS:
    def helper(self):
        return C{e}(1)

    def test_one(self):
        self.helper().{other}(2)


def test_two():
    assert make_{e}(3)
"""
_NAMES = {x: f"cast({x} AS STRING)" for x in "abcdke"} | {f"at_{x}": _at(x) for x in "abde"} | {x: x for x in ("own", "other", "about")}
MODULE_TEXT = f"concat({_text(CLASS, _NAMES)}, CASE WHEN checks = 1 THEN '{CHECK}' ELSE '' END, {_text(MAKE, _NAMES)})"
TEST_TEXT = _text(TESTS, _NAMES)
FILES = [
    (PART, "part", None, f"concat('shop/', replace({_at('k')}, '.', '/'), '.py')", MODULE_TEXT),
    (PART, "part", "k < 13", "concat('shop/g', cast(k AS STRING), '/__init__.py')", _text("from .m{k} import C{k}\n", _NAMES)),
    (PART, "part", "k = 0", "'shop/__init__.py'", "''"),
    (PART, "part", "k % 40 = 3", f"concat('lib/', replace({_at('k')}, '.', '/'), '.py')", "'def spare(x):\n    return x\n'"),
    (PART, "part", "k % 97 = 5", "concat('shop/bad', cast(k AS STRING), '.py')", "'def (:\n'"),
    (SUPPLIER, "supplier", None, "concat('tests/test_s', cast(j AS STRING), '.py')", TEST_TEXT),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content). Rows are spread before they become files: a table of few row groups would be parsed by as many tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for columns, name in ((PART, "part"), (SUPPLIER, "supplier")):
        rows = table(spark, sf_dir, name).selectExpr(*columns)
        made = ", ".join(f"CASE WHEN {only or 'true'} THEN named_struct('path', {path}, 'content', {text}) END" for _, n_, only, path, text in FILES if n_ == name)
        one = rows.repartition(n, rows.columns[0]).selectExpr(f"explode(filter(array({made}), f -> f is not null)) AS f").select("f.path", "f.content")
        out = one if out is None else out.unionByName(one)
    return out


def _parsed(spark: SparkSession, sf_dir: str, *parts: str, window: int = 80) -> DataFrame:
    return code.parse(files(spark, sf_dir), "c0", window, parts)


SOURCES = f"""
    p AS (SELECT *, 'shop.' || {_at("k")} AS module, 'shop.' || {_at("k")} || '.C' || k AS cls FROM (SELECT {", ".join(PART)} FROM part)),
    t AS (SELECT *, 'tests.test_s' || j AS module FROM (SELECT {", ".join(SUPPLIER)} FROM supplier)),
    sources AS ({" UNION ALL ".join(f"SELECT {path} AS path, {text} AS content FROM {'p' if name == 'part' else 't'} WHERE {only or 'true'}" for _, name, only, path, text in FILES)}),
    named AS (SELECT path, replace(replace(path[:-4], '/__init__', ''), '/', '.') AS module, content FROM sources WHERE path NOT LIKE 'shop/bad%'),
    symbols(module, qualname, local_name, kind, parent, start_line, end_line, signature, docstring, calls, bases) AS (
        SELECT module, cls, 'C' || k, 'class', module, 9, 21 + 3 * checks, 'class C' || k || '(Base, C' || b || ')', about || '.', '', 'Base,C' || b FROM p
        UNION ALL SELECT module, cls || '.__init__', 'C' || k || '.__init__', 'method', cls, 12, 14, 'def __init__(self, item)', '', 'self.check', '' FROM p
        UNION ALL SELECT module, cls || '.' || own, 'C' || k || '.' || own, 'method', cls, 16, 21, 'def ' || own || '(self, x)', '', array_to_string(list_sort(['json.loads', 'made', 'inner', 'up.make_' || a, 'shop.' || {_at("d")} || '.make_' || d]), ','), '' FROM p
        UNION ALL SELECT module, cls || '.' || own || '.inner', own || '.inner', 'function', cls || '.' || own, 17, 18, 'def inner(y)', '', 'self.check', '' FROM p
        UNION ALL SELECT module, cls || '.check', 'C' || k || '.check', 'method', cls, 23, 24, 'def check(self, item)', '', '', '' FROM p WHERE checks = 1
        UNION ALL SELECT module, module || '.make_' || k, 'make_' || k, 'function', module, 24 + 3 * checks, 28 + 3 * checks, 'def make_' || k || '(item)', '', array_to_string(list_sort(['?.close', 'C' || k, 'helper', 'x.' || other]), ','), '' FROM p
        UNION ALL SELECT 'lib.' || {_at("k")}, 'lib.' || {_at("k")} || '.spare', 'spare', 'function', 'lib.' || {_at("k")}, 1, 2, 'def spare(x)', '', '', '' FROM p WHERE k % 40 = 3
        UNION ALL SELECT module, module || '.TestS', 'TestS', 'class', module, 5, 10, 'class TestS', '', '', '' FROM t
        UNION ALL SELECT module, module || '.TestS.helper', 'TestS.helper', 'method', module || '.TestS', 6, 7, 'def helper(self)', '', 'C' || e, '' FROM t
        UNION ALL SELECT module, module || '.TestS.test_one', 'TestS.test_one', 'method', module || '.TestS', 9, 10, 'def test_one(self)', '', '?.' || other || ',self.helper', '' FROM t
        UNION ALL SELECT module, module || '.test_two', 'test_two', 'function', module, 13, 14, 'def test_two()', '', 'make_' || e, '' FROM t)
"""


@query(f"WITH {SOURCES} SELECT * EXCLUDE (module) FROM symbols")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, methods, functions and those inside them, with spans, signatures, calls and bases."""
    rows = code.exploded(_parsed(spark, sf_dir, "symbols"), "symbols")
    return rows.select("qualname", "local_name", "kind", "parent", "start_line", "end_line", "signature", F.coalesce("docstring", F.lit("")).alias("docstring"), F.array_join("calls", ",").alias("calls"), F.array_join("bases", ",").alias("bases"))


@query(rf"""
    WITH {SOURCES}, spans AS (
        SELECT module, CASE kind WHEN 'class' THEN local_name ELSE local_name END AS symbol, start_line AS s,
               CASE WHEN kind <> 'class' THEN end_line WHEN local_name = 'TestS' THEN 5 ELSE 10 END AS e FROM symbols WHERE NOT ends_with(qualname, '.inner')
        UNION ALL SELECT module, NULL, 1, 6 FROM p UNION ALL SELECT module, NULL, 1, 2 FROM t UNION ALL SELECT 'shop.g' || k, NULL, 1, 1 FROM p WHERE k < 13),
    cut AS (SELECT path, symbol, a, least(a + 3, e) AS z, string_split(content, chr(10))[a:least(a + 3, e)] AS w FROM (SELECT module, symbol, e, unnest(range(s, e + 1, 4)) AS a FROM spans) JOIN named USING (module)),
    led AS (SELECT *, list_min(list_transform(list_filter(w, lambda x: NOT {BLANK.format("x")}), lambda x: length(x) - length(ltrim(x)))) AS lead FROM cut)
    SELECT path || ':' || a || '-' || z AS chunk_id, coalesce(symbol, '') AS symbol, 'c0' AS commit, array_to_string(list_transform(w, lambda x: x[lead + 1:]), chr(10)) AS text FROM led
""")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four lines: headers of classes, methods, functions, and what lies outside of them."""
    return code.exploded(_parsed(spark, sf_dir, "chunks", window=4), "chunks").select("chunk_id", F.coalesce("symbol", F.lit("")).alias("symbol"), "commit", "text")


IMPORTS = f"""
    imports(file_module, module, name, alias, level, ord) AS (
        SELECT module, unnest(['json', 'shop.' || {_at("a")}, 'm' || c, {_at("b")}, 'shop.' || {_at("d")}, {_at("a")}]), unnest(['', '', 'make_' || c, 'C' || b, '', 'C' || a]), unnest(['', 'up', 'made', '', '', 'Base']), unnest([0, 0, 1, 2, 0, 0]), unnest(range(6)) FROM p
        UNION ALL SELECT 'shop.g' || k, 'm' || k, 'C' || k, '', 1, 0 FROM p WHERE k < 13
        UNION ALL SELECT module, unnest(['shop.' || {_at("e")}, 'shop.' || {_at("e")}, 'shop']), unnest(['C' || e, 'make_' || e, 'missing']), '', 0, unnest(range(3)) FROM t)
"""


@query(f"WITH {SOURCES}, {IMPORTS} SELECT * REPLACE (CAST(level AS INT) AS level, CAST(ord AS INT) AS ord) FROM imports")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.exploded(_parsed(spark, sf_dir, "imports"), "imports").select("file_module", "module", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("alias", F.lit("")).alias("alias"), "level", "ord")


@query(f"""
    WITH {SOURCES} SELECT 'tests/test_s' || j || '.py::TestS::test_one' AS test_id, array_to_string(list_sort(['self', 'helper', other, 'C' || e]), ',') AS names FROM t
    UNION ALL SELECT 'tests/test_s' || j || '.py::test_two', 'make_' || e FROM t
""")
def code_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests and the names that they mention, those of the class's helpers included."""
    return code.exploded(_parsed(spark, sf_dir, "tests"), "tests").select("test_id", F.array_join("names", ",").alias("names"))


# A call's target is named by step 1 (self, by the first base in depth-first order that has the method) or step 2 (names in scope), if it exists; else methods of the name.
LINKS = f"""
    bases AS (SELECT p.k, o.pos, q.k AS base FROM p, (VALUES (0), (1)) o(pos) JOIN p q ON q.k = CASE o.pos WHEN 0 THEN p.a ELSE p.b END WHERE o.pos = 1 OR p.a % 40 <> 3),
    mro(k, spot, route, seen) AS (SELECT k, k, CAST([] AS INT[]), [k] FROM p
        UNION ALL SELECT m.k, base, list_append(route, pos), list_append(seen, base) FROM mro m JOIN p ON p.k = m.spot JOIN bases ON bases.k = m.spot WHERE p.checks = 0 AND NOT list_contains(seen, base)),
    checked AS (SELECT m.k, arg_min(q.cls, route) || '.check' AS dst FROM mro m JOIN p q ON q.k = m.spot WHERE q.checks = 1 GROUP BY m.k),
    called AS (SELECT qualname AS src, module, unnest(string_split(calls, ',')) AS callee FROM symbols WHERE calls <> ''),
    wanted(src, callee, dst) AS (
        SELECT cls || '.__init__', 'self.check', dst FROM p JOIN checked USING (k) UNION ALL SELECT cls || '.' || own || '.inner', 'self.check', dst FROM p JOIN checked USING (k)
        UNION ALL SELECT module || '.TestS.test_one', 'self.helper', module || '.TestS.helper' FROM t
        UNION ALL SELECT cls || '.' || own, 'up.make_' || a, 'shop.' || {_at("a")} || '.make_' || a FROM p
        UNION ALL SELECT cls || '.' || own, 'made', 'shop.' || {_at("c")} || '.make_' || c FROM p
        UNION ALL SELECT cls || '.' || own, 'shop.' || {_at("d")} || '.make_' || d, 'shop.' || {_at("d")} || '.make_' || d FROM p
        UNION ALL SELECT module || '.make_' || k, 'C' || k, cls || '.__init__' FROM p
        UNION ALL SELECT module || '.TestS.helper', 'C' || e, 'shop.' || {_at("e")} || '.C' || e || '.__init__' FROM t UNION ALL SELECT module || '.test_two', 'make_' || e, 'shop.' || {_at("e")} || '.make_' || e FROM t),
    sure AS (SELECT src, callee, dst FROM wanted WHERE dst IN (SELECT qualname FROM symbols)),
    methods AS (SELECT qualname, split_part(local_name, '.', 2) AS name, count(*) OVER (PARTITION BY split_part(local_name, '.', 2)) AS n FROM symbols WHERE kind = 'method'),
    guessed AS (SELECT src, callee, qualname AS dst, n FROM called JOIN methods ON name = string_split(callee, '.')[-1] WHERE n <= 4 AND (src, callee) NOT IN (SELECT (src, callee) FROM sure) AND callee <> 'json.loads'),
    targets AS (SELECT src, callee, dst, 0 AS r FROM sure UNION ALL SELECT src, callee, dst, CASE n WHEN 1 THEN 1 ELSE 2 END FROM guessed),
    modules AS (SELECT DISTINCT module FROM named),
    links(src, dst, kind, r) AS (
        SELECT src, dst, 'calls', r FROM targets WHERE src <> dst UNION ALL SELECT parent, qualname, 'contains', 0 FROM symbols
        UNION ALL SELECT x.cls, y.cls, 'inherits', 0 FROM bases JOIN p x USING (k) JOIN p y ON y.k = bases.base
        UNION ALL SELECT module, 'shop.' || {_at("a")}, 'imports', 0 FROM p UNION ALL SELECT module, 'shop.' || {_at("b")}, 'imports', 0 FROM p UNION ALL SELECT module, 'shop.' || {_at("c")}, 'imports', 0 FROM p UNION ALL SELECT module, 'shop.' || {_at("d")}, 'imports', 0 FROM p
        UNION ALL SELECT 'shop.g' || k, module, 'imports', 0 FROM p WHERE k < 13 UNION ALL SELECT module, 'shop.' || {_at("e")}, 'imports', 0 FROM t UNION ALL SELECT module, 'shop', 'imports', 0 FROM t)
"""


@query(f"""
    WITH RECURSIVE {SOURCES}, {LINKS} SELECT src, dst, kind, CASE min(r) WHEN 0 THEN 'exact' WHEN 1 THEN 'heuristic' ELSE 'ambiguous' END AS conf
    FROM links WHERE kind <> 'imports' OR (src <> dst AND dst IN (SELECT module FROM modules)) GROUP BY src, dst, kind
""")
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the ladder: self by way of the bases, the module's own names, imports of each form, and methods that only their name tells."""
    return code.SymbolGraph(_parsed(spark, sf_dir, "symbols", "imports")).edge_rows()


@query(f"WITH RECURSIVE {SOURCES}, {LINKS} SELECT src, callee FROM called WHERE (src, callee) NOT IN (SELECT (src, callee) FROM targets)")
def code_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.SymbolGraph(_parsed(spark, sf_dir, "symbols", "imports")).unresolved


@query(f"""
    WITH {SOURCES}, file AS (SELECT module, path FROM named)
    SELECT qualname AS node, path || '::' || local_name AS symbol_id, path || ':' || CASE WHEN ends_with(qualname, '.inner') THEN 16 ELSE start_line END || '-'
           || CASE WHEN kind = 'class' THEN CASE local_name WHEN 'TestS' THEN 5 ELSE 10 END WHEN ends_with(qualname, '.inner') THEN 21 ELSE end_line END AS chunk_id FROM symbols JOIN file USING (module)
""")
def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node of the graph with its id in coverage maps and its chunk; a function within a method has the method's."""
    built = code.SymbolGraph(_parsed(spark, sf_dir, "symbols", "chunks"))
    return built.symbol_ids().join(built.node_chunks(), "node")


@query("SELECT concat('shop/bad', cast(p_partkey AS STRING), '.py') AS path, 'SyntaxError' AS error FROM part WHERE p_partkey % 97 = 5")
def code_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that don't parse, with the error; they give no other rows."""
    return _parsed(spark, sf_dir).where("error is not null").select("path", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))
