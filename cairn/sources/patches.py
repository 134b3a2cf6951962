"""Unified diffs: spans, per-file patches from model replies, and their application to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import SPACE

# The header of a hunk, what ends a line, a fenced diff, and where a reply's diffs begin.
HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FENCED = r"(?s)```diff\n(.*?)```"
FILE_START = r"(?=diff --git |(?<!\w)--- (?:a/|[^\n]+))"


def _plain(path):
    return F.regexp_replace(F.regexp_replace(F.btrim(path, F.lit(SPACE)), "^[ab]/", ""), r"\\", "/")


def gold_spans(diffs: DataFrame, id_col: str = "task_id", diff_col: str = "diff") -> DataFrame:
    """(id, ord, path, start_line, end_line) of a diff's hunks in the old files; a hunk without old lines is its anchor line.

    The path is carried from the last header above: `---`, `diff --git`, or `+++` where no path is known yet.
    """
    lines = diffs.select(F.col(id_col), F.posexplode(F.split(diff_col, "\n")).alias("ord", "line"))
    head = F.col("line")
    old = F.when(F.startswith(head, F.lit("--- ")) & (F.btrim(F.substr(head, F.lit(5)), F.lit(SPACE)) != "/dev/null"), _plain(F.substr(head, F.lit(5))))
    git = F.when(F.startswith(head, F.lit("diff --git ")), _plain(F.try_element_at(F.split(head, r"\s+"), F.lit(3))))
    new = F.when(F.startswith(head, F.lit("+++ ")) & (F.btrim(F.substr(head, F.lit(5)), F.lit(SPACE)) != "/dev/null"), _plain(F.substr(head, F.lit(5))))
    w = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.withColumn("known", F.last(F.coalesce(old, git), ignorenulls=True).over(w)).withColumn("first_new", F.first(F.when(F.col("known").isNull(), new), ignorenulls=True).over(w))
    hunk = seen.withColumn("path", F.coalesce("known", "first_new")).where(head.rlike(HUNK) & F.col("path").isNotNull())
    start = F.regexp_extract(head, HUNK, 1).cast("int")
    count = F.coalesce(F.regexp_extract(head, HUNK, 2).try_cast("int"), F.lit(1))
    return hunk.select(id_col, F.col("ord"), "path", start.alias("start_line"), F.when(count == 0, start).otherwise(start + count - 1).alias("end_line"))


def file_patches(reply: Column) -> Column:
    """array<struct<path, diff>> of the files that a model's reply changes: a fenced diff, else from the first header on; parts without a path are dropped."""
    fence = F.regexp_extract(reply, FENCED, 1)
    from_ = lambda mark: F.substr(reply, F.instr(reply, mark))
    fenced = F.regexp_like(reply, F.lit(FENCED))
    body = F.when(fenced, fence).when(F.contains(reply, F.lit("diff --git")), from_("diff --git")).when(F.contains(reply, F.lit("--- ")) & F.contains(reply, F.lit("+++ ")), from_("--- "))

    def part(text: Column) -> Column:
        heads = F.filter(_lines(text), lambda x: x.rlike(r"^(?:---|\+\+\+) ") & (F.btrim(F.substring(x, 5, 2**31 - 1), F.lit(SPACE)) != "/dev/null"))
        new = F.filter(heads, lambda x: F.startswith(x, F.lit("+++ ")))
        named = F.coalesce(F.get(new, F.lit(0)), F.get(heads, F.lit(0)))
        path = F.btrim(F.substring(named, 5, 2**31 - 1), F.lit(SPACE))
        own = F.when(F.startswith(named, F.lit("+++ ")), F.regexp_replace(path, "^b/", "")).otherwise(F.regexp_replace(path, "^a/", ""))
        return F.struct(F.translate(own, "\\", "/").alias("path"), text.alias("diff"))

    cut = F.transform(F.split(F.btrim(body, F.lit(SPACE)), FILE_START), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.filter(F.transform(F.filter(cut, lambda x: x != ""), part), lambda p: p["path"] != "")


def patches(replies: DataFrame, id_col: str, reply_col: str, commit: str = "HEAD") -> DataFrame:
    """(id, ord, filepath, diff, base_commit): a row for each file's patch in each reply."""
    rows = replies.select(F.col(id_col), F.posexplode(file_patches(F.col(reply_col))).alias("ord", "p"))
    return rows.select(id_col, "ord", F.col("p.path").alias("filepath"), F.col("p.diff").alias("diff"), F.lit(commit).alias("base_commit"))


def _lines(text: Column) -> Column:
    """A text's lines as str.splitlines() has them: a line's end ends it, so the last line isn't followed by an empty one."""
    cut = F.split(text, LINE_END)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def hunks(diff: Column) -> Column:
    """A diff's hunks in order: struct(start, old, new), start being the place of the first old line, from 0.

    A line that begins with @@ ends a hunk, whether or not it is a header. Of a hunk's lines those that begin with `---`, `+++` or a
    backslash say nothing; one without a sign stands for itself in old and new.
    """
    parts = F.filter(F.split(diff, r"(?m)^(?=@@)"), lambda p: p.rlike(HUNK))

    def hunk(part: Column) -> Column:
        every = _lines(part)
        body = F.filter(F.slice(every, F.lit(2), F.size(every)), lambda x: ~x.rlike(r"^(?:---|\+\+\+|\\)"))
        side = lambda other: F.transform(F.filter(body, lambda x: ~F.startswith(x, F.lit(other))), lambda x: F.when(x.rlike("^[-+ ]"), F.substring(x, 2, 2**31 - 1)).otherwise(x))
        return F.struct((F.regexp_extract(part, HUNK, 1).cast("int") - 1).alias("start"), side("+").alias("old"), side("-").alias("new"))

    return F.transform(parts, hunk)


def apply_patch(text: Column | str, diff: Column | str) -> Column:
    """struct(text, error): a file's text after a patch, or why it can't be applied; a diff without any header is the new text.

    A fold over the hunks carries the lines so far, how far earlier hunks have moved what follows, and whether all have matched. A hunk
    goes where it says, moved, or else where its old lines first stand in the text; without old lines it goes to its place, or to the
    end if that is nearer. Null texts and diffs count as empty.
    """
    text, diff = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (text, diff))
    trimmed = F.btrim(diff, F.lit(SPACE))
    state = "struct<lines:array<string>,moved:int,fits:boolean>"

    def step(now: Column, h: Column) -> Column:
        lines, old, new = now["lines"], h["old"], h["new"]
        n, m, said = F.size(lines), F.size(old), h["start"] + now["moved"]
        there = lambda p: F.slice(lines, p + 1, m) == old
        first = F.get(F.filter(F.sequence(F.lit(0), n - m), lambda p: F.when(m == 0, True).otherwise((F.get(lines, p) == F.get(old, F.lit(0))) & there(p))), F.lit(0))
        at = F.when((said >= 0) & there(said), F.least(said, n)).otherwise(F.when(m <= n, first))
        put = F.concat(F.slice(lines, F.lit(1), at), new, F.slice(lines, at + m + 1, n))
        next_ = F.struct(put.alias("lines"), (now["moved"] + F.size(new) - m).alias("moved"), F.lit(True).alias("fits"))
        return F.when(~now["fits"], now).when(at.isNull(), now.withField("fits", F.lit(False))).otherwise(next_).cast(state)

    start = F.struct(_lines(text).alias("lines"), F.lit(0).alias("moved"), F.lit(True).alias("fits")).cast(state)
    found = hunks(diff)
    done = F.aggregate(found, start, step)
    plain = ~F.contains(diff, F.lit("@@")) & ~trimmed.rlike(r"^(?:--- |diff --git)")
    error = F.when(trimmed == "", "the diff is empty").when(plain, F.lit(None)).when(F.size(found) == 0, "the diff has no hunk").when(~done["fits"], "a hunk does not match")
    made = F.when(plain, diff).otherwise(F.concat(F.array_join(done["lines"], "\n"), F.lit("\n")))
    return F.struct(F.when(error.isNull(), made).alias("text"), error.cast("string").alias("error"))
