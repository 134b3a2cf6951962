"""Lines and spans of files swept in order, so a file of very many spans costs as much as it has events and results, not their product.

Events are dealt by path and block of BLOCK lines, and sorted within; a span is an event of each block that it reaches into. So a file
that holds a third of all lines is swept by as many tasks as it has blocks, and a task holds the spans that are open where it is.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.deploy import ship

BITS = 16
BLOCK = 1 << BITS


def _block(line: str):
    return F.shiftright(F.col(line).cast("long"), BITS)


def _sweep(events: DataFrame, order: list, run: Callable[[str, Iterator[tuple]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """What run(path, events) gives for the events of each path and block in order, as rows of the schema."""
    ship(events.sparkSession)
    columns = [c for c in events.columns if c not in ("path", "block")]
    names = [f.split()[0] for f in schema.split(", ")]

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b["path"], b["block"], *(b[c] for c in columns), strict=True)

        stream = rows()
        first = [next(stream, None)]

        def own(path, block) -> Iterator[tuple]:
            while first[0] is not None and first[0][:2] == (path, block):
                yield first[0][2:]
                first[0] = next(stream, None)

        while first[0] is not None:
            path, block = first[0][:2]
            for out in run(path, own(path, block)):
                yield pd.DataFrame(out, columns=names)

    return events.repartition("path", "block").sortWithinPartitions("path", "block", *order).mapInPandas(swept, schema)


def _chunked(rows: Iterator[tuple], size: int = 10_000) -> Iterator[list[tuple]]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def _spans(spans: DataFrame, name: str) -> DataFrame:
    """(path, block, start, end, name): a row for each block that a span reaches into."""
    rows = spans.where("start_line <= end_line").select("path", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), F.col(name).alias("name"))
    return rows.select("path", F.explode(F.sequence(_block("start"), _block("end"))).alias("block"), "start", "end", "name")


def innermost(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, name): the shortest span (path, name, start_line, end_line) that holds a line; ties by start, then name.

    Upwards, with the open spans in a heap by length; those that have ended leave it when they come to its top.
    """
    opened = _spans(spans, "name").select("path", "block", F.greatest("start", F.shiftleft("block", BITS)).alias("at"), F.lit(0).alias("kind"), "start", "end", "name")
    asked = lines.select("path", F.col("line").cast("long").alias("at")).where("path is not null and at is not null").distinct()
    asked = asked.select("path", _block("at").alias("block"), "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("name"))

    def run(path: str, events: Iterator[tuple]) -> Iterator[list[tuple]]:
        def found() -> Iterator[tuple]:
            heap: list[tuple] = []
            for at, kind, start, end, name in events:
                if kind == 0:
                    heappush(heap, (end - start, start, name, end))
                    continue
                while heap and heap[0][3] < at:
                    heappop(heap)
                if heap:
                    yield path, at, heap[0][2]

        return _chunked(found())

    kind = lines.schema["line"].dataType.simpleString()
    return _sweep(opened.unionByName(asked), ["at", "kind"], run, "path string, line long, name string").withColumn("line", F.col("line").cast(kind))


def spans_of_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, name, tag): the spans (path, name, start_line, end_line) that hold a line (path, line, tag) of a tag, each pair once.

    Downwards, with each tag's nearest line behind, the last seen in front: a span takes tags from the front as long as they lie
    within it, so no pair is looked at that isn't one.
    """
    opened = _spans(spans, "name").select("path", "block", F.greatest("start", F.shiftleft("block", BITS)).alias("at"), F.lit(1).alias("kind"), "end", "name", F.lit("").alias("tag"))
    tagged = lines.where("path is not null and line is not null and tag is not null").select("path", F.col("line").cast("long").alias("at"), "tag").distinct()
    tagged = tagged.select("path", _block("at").alias("block"), "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("end"), F.lit("").alias("name"), "tag")

    def run(path: str, events: Iterator[tuple]) -> Iterator[list[tuple]]:
        def found() -> Iterator[tuple]:
            near: OrderedDict[str, int] = OrderedDict()
            for at, kind, end, name, tag in events:
                if kind == 0:
                    near[tag] = at
                    near.move_to_end(tag)
                    continue
                for t in reversed(near):
                    if near[t] > end:
                        break
                    yield path, name, t

        return _chunked(found())

    return _sweep(opened.unionByName(tagged), [F.col("at").desc(), "kind"], run, "path string, name string, tag string").distinct()


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a (path, start_line, end_line) that overlap a row of b.

    A span meets one of b if the furthest end of those that start no later than it ends lies behind its start: a running greatest end,
    within blocks, and over the blocks before from one row for each block.
    """
    ends = b.where("start_line <= end_line").select("path", F.col("start_line").cast("long").alias("at"), F.col("end_line").cast("long").alias("far"))
    ends = ends.groupBy("path", "at").agg(F.max("far").alias("far")).withColumn("block", _block("at"))
    blocks = ends.groupBy("path", "block").agg(F.max("far").alias("far"))
    asked = a.where("start_line <= end_line").select("path", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("at")).distinct().withColumn("block", _block("at"))
    before = blocks.withColumn("own", F.lit(True)).unionByName(asked.select("path", "block").distinct().select("path", "block", F.lit(None).cast("long").alias("far"), F.lit(False).alias("own")))
    w = Window.partitionBy("path").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    carried = before.withColumn("carried", F.max("far").over(w)).groupBy("path", "block").agg(F.max("carried").alias("carried"))
    events = ends.select("path", "block", "at", F.lit(0).alias("kind"), "far", F.lit(None).cast("long").alias("start")).unionByName(asked.select("path", "block", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("far"), "start"))
    running = Window.partitionBy("path", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("reach", F.max("far").over(running)).where("kind = 1").join(carried, ["path", "block"]).where(F.greatest("reach", "carried") >= F.col("start"))
    keys = met.select("path", F.col("start").alias("__s"), F.col("at").alias("__e"))
    on = (a["path"] == keys["path"]) & (a["start_line"] == F.col("__s")) & (a["end_line"] == F.col("__e"))
    return a.join(keys, on, "left_semi")
