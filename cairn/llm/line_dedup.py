"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Each line's hash gets a HyperLogLog sketch of the sites it was seen on; sketches
merge in the aggregation, on the map side first, so a line on a third of all rows sends one row a task. Where the estimate is
surely below or above the threshold it decides; lines near the threshold get an exact distinct count of their sites. Of a boilerplate
line the first occurrence (smallest id, then place) stays and all others go, so text that only exists in copies is not lost.
Short lines recur by chance, long ones hardly do: with `long_sites` lines of more than `long_words` words have a threshold of their
own, so a passage whose copies lie mostly on one hot site, and so on few sites in all, is found too.

All of it is built-in expressions and joins. What a join needs is picked first: a filter of fixed size (2 MB of bits, see
common.membership) tells which lines may be near the threshold or flagged, and which documents may lose one, so all other lines and
texts are not shuffled. Flagged lines meet their occurrences in a join salted by document.

Lines are compared without white space at their ends. Blank lines are no lines: they never go. Nulls: a null text has no lines and
stays null; a null site counts as no site; a null id is an id like others. Repeated rows with the same id and text are the same
occurrence, and all keep or lose the same lines. An empty table gives no rows. Further columns are passed on as they are, whatever
their names; columns named n_lines or n_removed are replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ASCII_SPACE, materialise, may_hold, membership

#: 2^LG_K registers: a relative standard error of about 3 %; counts of up to a hundred or so are kept as they are.
LG_K = 10
ERROR = 1.04 / (1 << LG_K) ** 0.5


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(ASCII_SPACE))


def _occurrences(df: DataFrame, id_col: str, text_col: str, site_col: str, long_words: int | None = None) -> DataFrame:
    """A row per line that isn't blank: id, text hash, place, the line's hash, site; with long_words also whether it has more words."""
    more = [] if long_words is None else ["long"]
    long = lambda x: [(F.regexp_count(x, F.lit(r"[\x20\x09-\x0D]+")) >= long_words).alias(c) for c in more]
    lines = F.transform(F.split(text_col, "\n"), _trimmed)
    hashed = F.transform(lines, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), *long(x))))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.col(site_col).alias("site"), F.posexplode(hashed).alias("place", "line"))
    return rows.where("line is not null").select("id", "of", "site", "place", "line.h", "line.g", *(f"line.{c}" for c in more))


def line_spread(occurrences: DataFrame, min_sites: int, long_sites: int | None = None) -> DataFrame:
    """The lines on min_sites sites or more, long ones on long_sites if given: h, g, and where they stand first."""
    need = F.lit(min_sites) if long_sites is None else F.when(F.max("long"), F.lit(long_sites)).otherwise(F.lit(min_sites))
    sketched = occurrences.groupBy("h", "g").agg(
        F.hll_sketch_agg(F.col("site").cast("string"), F.lit(LG_K)).alias("sketch"),
        F.min(F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("of"), F.col("place"))).alias("first"),
        need.alias("need"),
    )
    guessed = sketched.select("h", "g", "first", "need", F.hll_sketch_estimate("sketch").alias("sites"))
    slack = 5 * ERROR * F.col("need") + 1
    wide = materialise(guessed.where(F.col("sites") >= F.col("need") - slack))  # few of all lines, and used three times
    sure = F.col("sites") > F.col("need") + slack
    near = wide.where(~sure).select("h", "g", "first", "need")
    # Only lines near the threshold go on to be counted, a row for each site and task, so a hot line isn't gathered.
    held = occurrences.where("site is not null").where(may_hold(F.col("h"), membership(near, "h"))).select("h", "g", "site")
    exact = held.distinct().join(near, ["h", "g"]).groupBy("h", "g").agg(F.count("*").alias("sites"), F.first("first").alias("first"), F.first("need").alias("need")).where(F.col("sites") >= F.col("need"))
    return wide.where(sure).select("h", "g", "first").unionByName(exact.select("h", "g", "first"))


def dedup_lines(df: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", salts: int = 32, long_sites: int | None = None, long_words: int = 50) -> DataFrame:
    """df with boilerplate lines taken out of text_col, plus n_lines (lines that aren't blank) and n_removed.

    long_sites: the threshold of lines of more than long_words words; None: that of all lines.
    """
    occurrences = _occurrences(df, id_col, text_col, site_col, None if long_sites is None else long_words)
    flagged = materialise(line_spread(occurrences, min_sites, long_sites))
    salted = flagged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = occurrences.where(may_hold(F.col("h"), membership(flagged, "h"))).select("id", "of", "place", "h", "g", F.pmod(F.xxhash64("id", "of"), F.lit(salts)).cast("int").alias("salt"))
    again = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.of") == F.col("of")) & (F.col("first.place") == F.col("place"))
    dropped = held.join(salted, ["h", "g", "salt"]).where(~again).groupBy("id", "of").agg(F.collect_set("place").alias("places"))
    own = materialise(dropped.select(F.struct("id", "of").alias("key"), F.xxhash64("id", "of").alias("at"), "places"))
    # The row goes along in one struct, so no name clashes. Only documents that may lose a line meet their places.
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), key.alias("key"), F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("at"))
    tested = rows.withColumn("met", may_hold(F.col("at"), membership(own, "at")))
    met = tested.where("met").alias("d").join(own.alias("o"), F.col("d.key").eqNullSafe(F.col("o.key")), "left").select("d.row", "o.places")
    joined = met.unionByName(tested.where("not met").select("row", F.lit(None).cast(own.schema["places"].dataType).alias("places")))
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n")
    # The lines are bound to a variable, so that they are split once and not for each line that stays.
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "places"), lambda i: F.get(ls, i))
    kept = F.get(F.transform(F.array(lines), left), F.lit(0))
    n = F.size(F.filter(lines, lambda x: _trimmed(x) != ""))
    return joined.select(
        *((F.when(F.col("places").isNull(), text).otherwise(F.array_join(kept, "\n")) if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns if c not in ("n_lines", "n_removed")),
        F.when(text.isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"),
    )
