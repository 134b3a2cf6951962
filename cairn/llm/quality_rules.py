"""Quality rules: a threshold table compiled into one projection of built-in expressions.

A Rule names a measure and the least and most it may be; measures() holds the expressions, kept() folds the table into one
boolean. Nothing is grouped, joined or run in Python, so each document is judged in the scan's own task, however skewed a source.

Repeated words are found per document: each 8-word window's hash is taken once; only if two are equal are the windows themselves
compared, sorted, and the places they cover counted.

Stop words are asked of texts at least half of whose characters are A-Z or a-z: the list is of languages of that script, and a text
in another one isn't worse for lacking them.

Nulls and odd cases: a null text has no words (all counts 0) and fails the base rule, as an empty one does. Ratios of a document
without words or lines are 0. Texts are measured whole, whatever their length. Rows may repeat; columns besides the two named
aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ASCII_SPACE

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with be as by this are from at or an not "
    "der die und den das von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un une du que est pour qui dans par sur pas plus "
    "el los del se las por con para una su al lo como más"
).split()


class Rule(NamedTuple):
    """A document stays only if `least <= measure <= most`; None: no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Bounds are loose: ordinary prose of any of the languages, short or long, stays well within them.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("upper_share", None, 0.5),
    Rule("dup_line_share", None, 0.5),
    Rule("bar_line_share", None, 0.6),
    Rule("stop_word_share", 0.01, None),  # 1 where the list says nothing about the text's script
)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none if it is null."""
    plain = F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE[1:], " " * 5)
    return F.array_remove(F.split(plain, " "), "")


def _repeated(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(-1, WINDOW - 1))))
    at = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))

    def covered(at: Column) -> Column:
        flagged = F.transform(at, lambda x, k: F.when(F.coalesce(x["w"] == F.get(at, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(at, k + 1)["w"], F.lit(False)), x["i"]))
        places = F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        # Each place adds the words that the place before it hasn't covered.
        return F.aggregate(places, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    exact = F.get(F.transform(F.array(at), covered), F.lit(0))
    some = F.get(F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h)), F.lit(0))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).when(some, exact).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the base counts and the ratios of the threshold table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    length = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, ASCII_SPACE, "")) > 0)
    stop = [*STOP_WORDS, *map(str.capitalize, STOP_WORDS)]
    n = F.size("words").cast("long")
    counted = base.select(
        "id",
        n.alias("n_words"),
        F.length(F.translate(text, ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        F.size(lines).alias("n_lines"),
        (length - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).alias("n_upper"),
        F.size(F.filter(lines, lambda x: F.contains(x, F.lit(" | ")))).alias("n_bar_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).alias("n_stop"),
        (length - F.length(F.regexp_replace(text, r"[A-Za-z]", ""))).alias("n_latin"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.select(
        *("id n_words word_chars n_symbols n_dup_lines n_repeat_words".split()),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_bar_lines", "n_lines").alias("bar_line_share"),
        F.when(2 * F.col("n_latin") < F.col("word_chars"), 1.0).otherwise(share("n_stop", "n_words")).alias("stop_word_share"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one boolean expression over measures()."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.measure) >= F.lit(r.least))
        if r.most is not None:
            out = out & (F.col(r.measure) <= F.lit(r.most))
    return out


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, the base counts, base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measures(df, id_col, text_col).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept")
    )
