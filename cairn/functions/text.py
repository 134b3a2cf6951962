"""Column builders for text and code: tokenisers, extractors, paths, logs and replies. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"

# Patterns and characters that decide what counts as a token, query, test path or log line.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
IDENTIFIER_PART = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
QUERY_PATTERNS = (
    (r"[\w\-./\\]+\.(?:py|json|md|txt|yaml|yml)\b", 0),
    (r"\b[A-Z][a-zA-Z]*(?:Error|Exception|Warning|Fault)\b", 0),
    (r"\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w+)+\b", 0),
    (r"""[`'"]([^`'"]+)[`'"]""", 1),
    (r"\b[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+\b", 0),
    (r"\b[a-z]+(?:_[a-z0-9]+)+\b", 0),
)
QUERY_STRIP = ",.;:()[]{}"
DEFINITION = r"\b(?:def|class)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
TEST_PATH = r"(^|/)(test_[^/]*|[^/]*_test)\.py$"
TEST_DIR = r"(^|/)(tests|test)/"
GOLD_HEADER = r"(?m)^diff --git a/\S+ b/(\S+)"
DIFF_FENCE = r"(?s)```diff\n(.*?)\n```"
COUNTED = r"([0-9]+)\s+"
FAILED_LINE = r"(?m)^\s*FAILED\s+(\S+)"
JSON_FENCE = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"
CONFIDENCE = r"""(?i)"?confidence"?\s*[:=]\s*([01](?:\.[0-9]+)?)"""


def tokenize(text: Column) -> Column:
    """Lower-case identifiers and their parts: add_item -> add_item, add, item; an identifier of one part gives the part only."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda i: F.struct(i.alias("i"), F.regexp_extract_all(i, F.lit(IDENTIFIER_PART), F.lit(0)).alias("p")))
    whole = F.transform(parts, lambda x: F.transform(F.when(F.size(x["p"]) > 1, F.concat(F.array(x["i"]), x["p"])).otherwise(x["p"]), F.lower))
    return F.flatten(whole)


def rerank_tokens(text: Column) -> Column:
    """The set of lower-case tokens of two or more characters, camel case split first, and of their underscore parts."""
    spaced = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    found = F.regexp_extract_all(spaced, F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(F.concat(found, F.flatten(F.transform(found, lambda t: F.split(t, "_")))), lambda t: F.length(t) > 1))


def extract_queries(text: Column, most: int = 8) -> Column:
    """Search queries named in a task's text: paths, errors, dotted names, quotations, CamelCase, snake_case, then its first sentence."""
    families = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in QUERY_PATTERNS]
    sentence = F.btrim(F.split_part(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(". "), F.lit(1)), F.lit(SPACE))
    stripped = F.transform(F.concat(*families, F.array(F.substring(sentence, 1, 100))), lambda q: F.btrim(F.btrim(q, F.lit(SPACE)), F.lit(QUERY_STRIP)))
    return F.slice(F.array_distinct(F.filter(stripped, lambda q: F.length(q) >= 2)), 1, most)


def definition_name(text: Column, symbol: Column | None = None) -> Column:
    """The symbol if given, else the first function or class that the text defines, else ''."""
    found = F.regexp_extract(text, DEFINITION, 1)
    return found if symbol is None else F.when(F.coalesce(symbol, F.lit("")) != "", symbol).otherwise(found)


def gold_files(diff: Column) -> Column:
    """Distinct new paths of a git diff's headers, in order."""
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(GOLD_HEADER), F.lit(1)))


def diff_block(reply: Column) -> Column:
    """The first fenced diff of a reply, else what follows `diff --git`, else ''."""
    fenced = F.regexp_extract(reply, DIFF_FENCE, 1)
    at = F.instr(reply, "diff --git")
    return F.when(fenced != "", F.btrim(fenced, F.lit(SPACE))).when(at > 0, F.btrim(F.substr(reply, at), F.lit(SPACE))).otherwise("")


def _count(log: Column, what: str) -> Column:
    return F.coalesce(F.regexp_extract(log, COUNTED + what, 1).try_cast("long"), F.lit(0))


def failed_tests(log: Column) -> Column:
    """Distinct ids of `FAILED id` lines, in order."""
    return F.array_distinct(F.regexp_extract_all(log, F.lit(FAILED_LINE), F.lit(1)))


def log_facts(log: Column) -> dict[str, Column]:
    """What a test log says, each pattern looked for once: columns to select first, from which log_results() is then made."""
    return {"n_passed": _count(log, "passed"), "n_failed": _count(log, "failed"), "n_errors": _count(log, "errors?"), "failed_ids": failed_tests(log)}


def log_results() -> dict[str, Column]:
    """total, passed and failed (errors included) from the columns of log_facts()."""
    total = F.col("n_passed") + F.col("n_failed") + F.col("n_errors")
    return {"total": F.when(total == 0, F.size("failed_ids").cast("long")).otherwise(total), "passed": F.col("n_passed"), "failed": F.col("n_failed") + F.col("n_errors")}


def log_total(log: Column) -> Column:
    """Tests run: passed, failed and errors; if a log counts none, its distinct FAILED lines."""
    total = _count(log, "passed") + _count(log, "failed") + _count(log, "errors?")
    return F.when(total == 0, F.size(failed_tests(log)).cast("long")).otherwise(total)


def pass_fail(log: Column) -> tuple[Column, Column]:
    """Passed tests; failed tests, errors included."""
    return _count(log, "passed"), _count(log, "failed") + _count(log, "error")


def json_text(reply: Column) -> Column:
    """A reply's fenced JSON if there is a fence, else the whole reply."""
    fenced = F.regexp_extract(reply, JSON_FENCE, 1)
    return F.when(fenced != "", fenced).otherwise(F.btrim(reply, F.lit(SPACE)))


def is_json(reply: Column) -> Column:
    return F.try_parse_json(json_text(reply)).isNotNull()


def confidence(reply: Column) -> Column:
    """The JSON field, else a textual mention, else 1; within 0 and 1."""
    field = F.get_json_object(json_text(reply), "$.confidence").try_cast("double")
    named = F.regexp_extract(reply, CONFIDENCE, 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field, named, F.lit(1.0))))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def unpacked(raw: Column, prompt: Column) -> dict[str, Column]:
    """A model's reply as content, tokens_in, tokens_out, confidence and cost. A JSON object names them, with stand-ins in a fixed order
    (a field that is null counts as missing); any other reply is content itself."""
    is_object = F.startswith(F.btrim(raw, F.lit(SPACE)), F.lit("{")) & F.try_parse_json(raw).isNotNull()
    field = lambda *names: F.coalesce(*(F.get_json_object(F.when(is_object, raw), f"$.{n}") for n in names))
    named = F.coalesce(*(F.nullif(field(n), F.lit("")) for n in ("content", "text", "response")), F.lit(""))
    content = F.when(is_object, named).otherwise(raw)
    tokens = lambda name, text: F.coalesce(field(name, f"usage.{name}").try_cast("long"), estimated_tokens(text))
    return {
        "content": content,
        "tokens_in": tokens("prompt_tokens", prompt),
        "tokens_out": tokens("completion_tokens", content),
        "confidence": F.coalesce(field("confidence").try_cast("double"), confidence(content)),
        "cost": field("cost_usd", "cost").try_cast("double"),
    }


def log_tail(log: Column, most: int = 4000) -> Column:
    """The last characters of a log, white space around it left out."""
    return F.right(F.btrim(log, F.lit(SPACE)), F.lit(most))


def symbol_id(path: Column, symbol: Column) -> Column:
    return F.concat(path, F.lit("::"), symbol)


def citation(path: Column, commit: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s@%s:%d-%d", path, commit, start, end)


def mean_and_spread(mean: Column, spread: Column, digits: int = 3) -> Column:
    return F.when(mean.isNull(), "-").otherwise(F.format_string(f"%.{digits}f ± %.{digits}f", mean, spread))


def clean_context(context: Column) -> Column:
    return F.regexp_replace(context, r"\|(run|setup|teardown)$", "")


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\x00"), text), 256)


def test_label(item: Column) -> Column:
    """path/t.py::x -> path.t.x"""
    dotted = F.regexp_replace(F.regexp_replace(item, "::", "."), r"[/\\]", ".")
    return F.btrim(F.regexp_replace(F.regexp_replace(dotted, r"\.py$", ""), r"\.py\.", "."), F.lit("."))


def is_test_path(path: Column) -> Column:
    """By file name, or by a folder named tests or test."""
    return path.rlike(TEST_PATH) | path.rlike(TEST_DIR)


def is_test_file(path: Column) -> Column:
    """Like is_test_path, but any name that begins with test_ counts."""
    return path.rlike(TEST_DIR) | path.rlike(r"(^|/)test_[^/]*$") | path.rlike(r"_test\.py$")


def names_test(path: Column) -> Column:
    return F.contains(path, F.lit("test"))


def module_name(path: Column) -> Column:
    """Dotted module of a .py path; a package's is its folder's, the root package's ''."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.when(dotted == "__init__", "").otherwise(F.regexp_replace(dotted, r"\.__init__$", ""))


def first_edit(text: Column, old: Column, new: Column, strict: bool = False) -> Column:
    """The text with the first exact occurrence of old replaced; if there is none, null, or with strict an error."""
    at = F.position(old, text)
    done = F.when((at > 0) & (F.length(old) > 0), F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))))
    return F.when(done.isNull(), F.raise_error(F.lit("the old text isn't there"))).otherwise(done) if strict else done


def line_slice(text: Column, start: int | None = None, end: int | None = None) -> Column:
    """Lines start to end, counted from 1 and clamped to what is there."""
    lines = F.split(text, "\n")
    first = max(1, start or 1)
    last = F.least(F.size(lines), F.lit(end)) if end else F.size(lines)
    return F.array_join(F.slice(lines, F.lit(first), F.greatest(F.lit(0), last - (first - 1))), "\n")


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression for rlike."""
    import fnmatch

    return fnmatch.translate(glob).removesuffix(r"\z").removesuffix(r"\Z") + "$"
