import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.sources import code, files, frameworks, patches, tasks
from cairn.streaming import incremental

PACKAGE = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def run(self):\n        return helper()\n",
    "pkg/util.py": "def helper():\n    return 1\n\n\nclass Config:\n    def __init__(self):\n        self.x = helper()\n",
    "pkg/shop.py": "from pkg.base import Base\nfrom . import util\nimport os\n\n\nclass Cart(Base):\n    def add(self):\n        util.helper()\n        return self.run()\n\n    def total(self):\n        self.add()\n        return os.path.join()\n\n\ndef checkout(c):\n    util.Config()\n    c.total()\n    unknown()\n",
}


def parsed(spark, sources, window=80):
    return code.parse(spark.createDataFrame(list(sources.items()), "path string, content string"), "h", window)


def test_symbol_graph(spark):
    g = code.SymbolGraph(parsed(spark, PACKAGE))
    got = {(r.src, r.dst, r.kind, r.conf) for r in g.edges.collect()}
    assert ("pkg.shop.Cart.add", "pkg.base.Base.run", "calls", "exact") in got  # through the base class
    assert ("pkg.shop.Cart.add", "pkg.util.helper", "calls", "exact") in got  # through a relative import
    assert ("pkg.shop.checkout", "pkg.util.Config.__init__", "calls", "exact") in got  # a class call is its constructor
    assert ("pkg.shop.checkout", "pkg.shop.Cart.total", "calls", "heuristic") in got
    assert ("pkg.shop.Cart", "pkg.base.Base", "inherits", "exact") in got
    assert ("pkg.shop", "pkg.base", "imports", "exact") in got and ("pkg.shop", "pkg.util", "imports", "exact") in got
    assert ("pkg.shop", "pkg.shop.Cart", "contains", "exact") in got
    assert {(r.src, r.callee) for r in g.unresolved.collect()} == {("pkg.base.Base.run", "helper"), ("pkg.shop.checkout", "unknown"), ("pkg.shop.Cart.total", "os.path.join")}
    assert {r.node: r.symbol_id for r in g.symbol_ids().collect()}["pkg.shop.Cart.add"] == "pkg/shop.py::Cart.add"
    assert g.node_chunks().count() >= 7


def test_ambiguous_methods(spark):
    source = {"a.py": "class A:\n    def go(self): pass\nclass B:\n    def go(self): pass\ndef caller(x):\n    x.go()\n"}
    calls = {(r.dst, r.conf) for r in code.SymbolGraph(parsed(spark, source)).edges.where("kind = 'calls'").collect()}
    assert calls == {("a.A.go", "ambiguous"), ("a.B.go", "ambiguous")}
    assert code.SymbolGraph(parsed(spark, source), max_ambiguity=1).edges.where("kind = 'calls'").count() == 0


def test_chunks_cover_without_overlap(spark):
    body = "\n".join(f"    x{i} = {i}" for i in range(100))
    source = {"m.py": f"import os\n\n\n@deco\ndef long():\n{body}\n    def inner():\n        call()\n    return x0\n\nX = 1\n", "bad.py": "def (:", "bom.py": "\ufeffY = 2\n"}
    rows = {r.path: r for r in parsed(spark, source, 40).collect()}
    assert rows["bad.py"].error and not rows["bad.py"].chunks
    assert rows["bom.py"].error is None
    spans = [(c.start_line, c.end_line) for c in rows["m.py"].chunks]
    assert spans[0] == (1, 1) and spans[1][0] == 4  # decorators belong to their function
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and max(e - s + 1 for s, e in spans) <= 40
    assert {s.qualname: list(s.calls) for s in rows["m.py"].symbols} == {"m.long": [], "m.long.inner": ["call"]}


def test_tests_are_found(spark):
    source = {"tests/test_c.py": "def test_a():\n    Cart().add()\nclass TestX:\n    def setup_method(self): self.h = helper\n    def test_b(self): total()\n"}
    got = {t.test_id: set(t.names) for t in parsed(spark, source).first().tests}
    assert got["tests/test_c.py::test_a"] == {"Cart", "add"}
    assert {"helper", "total"} <= got["tests/test_c.py::TestX::test_b"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "venv").mkdir()
    (tmp_path / "a/x.py").write_text("one\n two three\n")
    (tmp_path / "venv/y.py").write_text("two")
    (tmp_path / "z.txt").write_text("two")
    assert [r.path for r in files.list_files(spark, str(tmp_path), "*.py").collect()] == ["a/x.py"]
    rows = files.tree(spark, str(tmp_path)).select("path", F.col("content").cast("string").alias("text"))
    assert [(r.path, r.line, r.snippet) for r in files.grep(rows, "two").collect()] == [("a/x.py", 2, "two three"), ("z.txt", 1, "two")]
    assert files.grep(rows, "").count() == 0


DIFF = "--- a/f.py\n+++ b/f.py\n@@ -2,2 +2,3 @@\n b\n-c\n+C\n+D\n@@ -9 +10 @@\n-z\n+Z\n"


def applied_by_hand(text, diff):
    lines, shift, found = text.splitlines(), 0, []
    for row in diff.splitlines():
        head = re.match(patches.HUNK, row)
        if head:
            found.append((int(head[1]) - 1, [], []))
        elif row.startswith("@@"):
            found.append(None)
        elif found and found[-1] and not row.startswith(("---", "+++", "\\")):
            sign, rest = (row[0], row[1:]) if row[:1] in ("-", "+", " ") else (" ", row)
            if sign != "+":
                found[-1][1].append(rest)
            if sign != "-":
                found[-1][2].append(rest)
    if not any(found):
        return None
    for start, old, new in filter(None, found):
        fits = [p for p in [start + shift, *range(len(lines) - len(old) + 1)] if p >= 0 and lines[p : p + len(old)] == old]
        if not fits:
            return None
        lines[fits[0] : fits[0] + len(old)] = new
        shift += len(new) - len(old)
    return "\n".join(lines) + "\n"


def test_patches(spark):
    dice = random.Random(3)
    rows = [("a\nb\nc\nd\nz\n", DIFF), ("a\nb\nc\nz", DIFF), ("q", DIFF), ("", "@@ -0,0 +1 @@\n+x"), (None, "@@ -1 +1 @@\n-x"), ("a\r\nb\u2028c", "@@ -9 +9 @@\n-c\n+d\n"), ("a", "@@ no header\n-a\n+b"), ("a\n\nb", "@@ -2 +2 @@\n\n-b"), ("x", "--- a\n+++ b\n")]
    for _ in range(300):
        letters = [dice.choice("ab-+ @") + dice.choice(["", "x", "--"]) for _ in range(dice.randrange(6))]
        diff = "".join(f"@@ -{dice.randrange(7)},{dice.randrange(3)} +1 @@\n" + "".join(dice.choice(["-", "+", " ", "", "\\"]) + dice.choice([*letters, "ax", "new"]) + "\n" for _ in range(dice.randrange(5))) for _ in range(dice.randrange(1, 4)))
        rows.append(("\n".join(letters), diff))
    got = [r.p for r in spark.createDataFrame(rows, "text string, diff string").coalesce(1).select(patches.apply_patch("text", "diff").alias("p")).collect()]
    want = [applied_by_hand(t or "", d) for t, d in rows]
    assert [p.text for p in got] == want and all((p.error is None) == (w is not None) for p, w in zip(got, want, strict=True))
    assert sum(w is not None for w in want) > 50 and want[0] == "a\nb\nC\nD\nd\nZ\n"
    more = spark.createDataFrame([("q", ""), ("q", None), ("q", "new text"), ("q", "diff --git a/x b/x")], "text string, diff string")
    assert [tuple(r.p) for r in more.coalesce(1).select(patches.apply_patch("text", "diff").alias("p")).collect()] == [(None, "the diff is empty"), (None, "the diff is empty"), ("new text", None), (None, "the diff has no hunk")]


def test_patches_of_replies(spark):
    two = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n--- a/y.py\n+++ /dev/null\n@@ -1 +1 @@\n-a\n+b"
    replies = [f"So:\n```diff\n{two}\n```\nDone.", f"Well, {two}", "prose", None, "diff --git a/z b/z\nmode\ndiff --git a/w b/w\n--- /dev/null\n+++ b/d\\w\n@@ -0,0 +1 @@\n+q"]
    got = patches.patches(spark.createDataFrame(list(enumerate(replies)), "id int, reply string"), "id", "reply", "c").collect()
    assert [(r.id, r.ord, r.filepath) for r in sorted(got)] == [(0, 0, "x.py"), (0, 1, "y.py"), (1, 0, "x.py"), (1, 1, "y.py"), (4, 0, "d/w")]
    assert got[0].diff == two[: two.index("\n--- a/y")] and got[0].base_commit == "c"
    spans = patches.gold_spans(spark.createDataFrame([("t", "--- a/f.py\n+++ b/f.py\n@@ -10,5 +10,6 @@\n@@ -50,0 +51 @@\n")], "task_id string, diff string"))
    assert [(r.path, r.start_line, r.end_line) for r in spans.orderBy("ord").collect()] == [("f.py", 10, 14), ("f.py", 50, 50)]


def test_frameworks(spark):
    rows = [("p", "conftest.py", ""), ("d", "manage.py", ""), ("u", "tests/test_a.py", "import unittest"), ("j", "package.json", '{"devDependencies": {"jest": "1"}}'), ("n", "readme.md", "")]
    specs = frameworks.detect(spark.createDataFrame(rows, "repo string, path string, text string"))
    assert {r.repo: r.framework for r in specs.collect()} == {"p": "pytest", "d": "django", "u": "unittest", "j": "jest", "n": "pytest"}
    plan = frameworks.plan(specs, spark.createDataFrame([("d", "tests/test_v.py::T::test_x")], "repo string, test string"))
    assert {r.repo: r.impacted_cmd for r in plan.collect()}["d"][-1] == "tests.test_v.T.test_x"


def test_tasks(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("t1\n\n# no\n t2 \n")
    (tmp_path / "tasks.jsonl").write_text('{"instance_id": "t1", "repo": "r"}\n{"instance_id": "t9"}\n')
    ids = tasks.task_ids(spark, str(tmp_path / "ids.txt"))
    rows = tasks.tasks(spark, str(tmp_path / "tasks.jsonl"), ids)
    assert [(r.instance_id, r.repo, r.patch) for r in rows.collect()] == [("t1", "r", "")]
    assert [r.task_id for r in tasks.missing(ids, rows).collect()] == ["t2"]


def test_stream_indexes_only_changes(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "doc_id long, text string"
    for batch in ([(1, "add_item"), (2, "total")], [(1, "add_item"), (2, "sum")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = incremental.follow(stream, out, "doc_id", "text", str(tmp_path / "state"))
        query.awaitTermination()
    assert {(r.id, r.term) for r in incremental.current(spark, out).collect()} == {(1, "add_item"), (1, "add"), (1, "item"), (2, "sum")}


def test_few_large_partitions_are_spread(spark):
    """A table of one row group is parsed by as many tasks as there are shuffle partitions, and only the parts asked for are read."""
    from cairn.plans import sources

    assert sources.files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = "import a\ntry:\n    import b\nexcept E:\n    from c import d\nelse:\n    import e\ndef f():\n    import g\n"
    files = spark.createDataFrame([("x.py", source)], "path string, content string")
    only = code.parse(files, "h", parts=("imports",)).first()
    assert [i.module for i in only.imports] == [n.names[0].name if isinstance(n, ast.Import) else n.module for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.Import, ast.ImportFrom))]
    assert (only.symbols, only.chunks, only.tests) == ([], [], [])
    assert code.parse(files, "h").first().imports == only.imports


def test_nodes_need_no_edges(spark):
    """Ids and chunks of nodes come from symbols and chunks alone: no name is resolved for them."""
    files = spark.createDataFrame([("x.py", "class A:\n    def f(self):\n        return self.f()\n")], "path string, content string")
    built = code.SymbolGraph(code.parse(files, "h", parts=("symbols", "chunks")))
    assert {r.node for r in built.symbol_ids().join(built.node_chunks(), "node").collect()} == {"x.A", "x.A.f"}
    assert not {"index", "scope", "bases", "_called", "edges"} & set(vars(built))


def test_files_tables_are_not_sent_whole_to_tasks(spark, tmp_path):
    """What is exploded from files is far more than the optimiser takes their table for; it isn't broadcast."""
    spark.createDataFrame(list(PACKAGE.items()), "path string, content string").write.parquet(str(tmp_path / "files"))
    g = code.SymbolGraph(code.parse(spark.read.parquet(str(tmp_path / "files")), "h"))
    plan = g.symbol_ids().join(g.node_chunks(), "node")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def shuffled(spark, run):
    """Bytes that the stages of run() shuffle."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        some = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [some.apply(i) for i in range(some.size())]

    last = max((x.stageId() for x in stages()), default=-1)
    run()
    return sum(x.shuffleWriteBytes() for x in stages() if x.stageId() > last)


@pytest.mark.parametrize("query", ["code_edges", "code_unresolved"])
def test_what_a_file_knows_itself_is_not_shuffled(spark, query):
    """Calls met imports, own definitions and known names by shuffled strings: some 8 KB for each of these files."""
    from cairn.plans import sources

    of = "/root/testdata/sf0.001"
    n = sources.files(spark, of).count()
    assert shuffled(spark, lambda: getattr(sources, query)(spark, of).write.format("noop").mode("overwrite").save()) < 4000 * n


def test_definitions_of_a_module_in_other_files(spark, monkeypatch):
    """What a file says itself holds only where no other file defines names within its module; the same when every module is a hot one."""
    source = {
        "p/__init__.py": "class m:\n    class C:\n        def late(self): pass\n        def get(self): return self.late()\n",  # p.m.C lies within the module p.m too
        "p/m.py": "class D(C):\n    def run(self):\n        C.get()\n        return self.late()\ndef free():\n    self.get()\n",
        "p/n.py": "def one(): two()\n",
        "p/n/__init__.py": "def two(): one()\n",  # p.n twice
        "q.py": "import p.m\nimport p.n as n\nfrom p import m as C\nfrom p.m import D\nclass E(D):\n    def run(self):\n        self.late()\n        p.m.D()\n        n.two()\n        C.C.get()\n        self.own()\n    def own(self):\n        def deep(): self.own(); self.none()\n        E()\n    def __init__(self): pass\n",
        "__init__.py": "def top(): q()\ndef q(): top()\n",  # the module without a name
    }
    calls = {
        ("p.m.C.get", "p.m.C.late"), ("p.m.D.run", "p.m.C.get"), ("p.m.D.run", "p.m.C.late"), ("p.n.one", "p.n.two"), ("p.n.two", "p.n.one"),
        ("q.E.run", "p.m.C.late"), ("q.E.run", "p.m.D"), ("q.E.run", "p.n.two"), ("q.E.run", "p.m.C.get"), ("q.E.run", "q.E.own"), ("q.E.own.deep", "q.E.own"), ("q.E.own", "q.E.__init__"), ("top", "q"), ("q", "top"),
    }
    for hot in (code.HOT, 0):
        monkeypatch.setattr(code, "HOT", hot)
        g = code.SymbolGraph(parsed(spark, source), include_heuristic=False)
        got = {(r.src, r.dst, r.kind) for r in g.edges.collect()}
        assert {(s, d) for s, d, k in got if k == "calls"} == calls
        assert {(s, d) for s, d, k in got if k == "inherits"} == {("p.m.D", "p.m.C"), ("q.E", "p.m.D")}
        assert g.edges.count() == len(got)
        assert sorted((r.src, r.callee) for r in g.unresolved.collect()) == [("p.m.free", "self.get"), ("q.E.own.deep", "self.none")]
