from pyspark.sql import functions as F

from cairn.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokenize(spark):
    say = lambda t: one(spark, tx.tokenize(F.col("t")), t=t)
    assert say("add_item") == ["add_item", "add", "item"]
    assert say("HTTPServer") == ["httpserver", "http", "server"]
    assert say("x = foo(1)") == ["x", "foo", "1"]
    assert say("__init__ _") == ["init"]
    assert say("") == []


def test_rerank_tokens(spark):
    assert sorted(one(spark, tx.rerank_tokens(F.col("t")), t="addItem x my_var")) == ["add", "item", "my", "my_var", "var"]


def test_extract_queries(spark):
    got = one(spark, tx.extract_queries(F.col("t")), t="ZeroDivisionError in calculator.py: `divide` fails. Call Cart.add")
    assert got[:2] == ["calculator.py", "ZeroDivisionError"]
    assert "divide" in got and "Cart.add" in got and len(got) <= 8


def test_contexts_and_labels(spark):
    assert one(spark, tx.clean_context(F.lit("t.py::test_a|run"))) == "t.py::test_a"
    assert one(spark, tx.clean_context(F.lit("t.py::test_a[1|2]"))) == "t.py::test_a[1|2]"
    assert one(spark, tx.test_label(F.lit("tests/test_views.py::TestView::test_get"))) == "tests.test_views.TestView.test_get"


def test_logs(spark):
    log = "FAILED a.py::t - boom\nFAILED a.py::t\n2 failed, 3 passed, 1 error in 0.1s"
    assert one(spark, tx.failed_tests(F.lit(log))) == ["a.py::t"]
    assert one(spark, tx.log_total(F.lit(log))) == 6
    assert one(spark, tx.log_total(F.lit("FAILED a::b\n FAILED c::d x"))) == 2
    passed, failed = tx.pass_fail(F.lit(log))
    assert (one(spark, passed), one(spark, failed)) == (3, 3)


def test_confidence(spark):
    say = lambda t: one(spark, tx.confidence(F.lit(t)))
    assert say('{"confidence": 0.4}') == 0.4
    assert say('```json\n{"confidence": 0.9}\n```') == 0.9
    assert say("Confidence: 0.3") == 0.3
    assert say('{"confidence": 7}') == 1.0
    assert say("none") == 1.0
    assert one(spark, tx.is_json(F.lit("{bad"))) is False


def test_paths(spark):
    assert one(spark, tx.is_test_path(F.lit("tests/a.txt"))) is True
    assert one(spark, tx.is_test_path(F.lit("pkg/test_a.txt"))) is False
    assert one(spark, tx.is_test_file(F.lit("pkg/test_a.txt"))) is True
    assert one(spark, tx.module_name(F.lit("pkg/__init__.py"))) == "pkg"
    assert one(spark, tx.module_name(F.lit("__init__.py"))) == ""
    assert one(spark, tx.first_edit(F.lit("abab"), F.lit("b"), F.lit("X"))) == "aXab"
    assert one(spark, tx.first_edit(F.lit("abab"), F.lit("z"), F.lit("X"))) is None
    assert one(spark, tx.line_slice(F.lit("a\nb\nc"), 2, 9)) == "b\nc"
    assert one(spark, tx.diff_block(F.lit("x ```diff\n-a\n``` y"))) == "-a"
