"""An index that follows a stream of documents (an extension: the batch operators over Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions.text import tokenize


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the SHA-256 by which a change is known."""
    return docs.withColumn("sha256", F.sha2(F.col(text_col), 256)).withColumn("id", F.col(id_col))


def follow(stream: DataFrame, path: str, id_col: str, text_col: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's postings of new or changed documents below path.

    Batches are written under their number, so a batch that is run again after a failure replaces what it wrote. A document
    whose id and digest were indexed by an earlier batch is skipped.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = digests(batch, id_col, text_col).dropDuplicates(["id", "sha256"])
        known = _known(spark, path, number)
        fresh = rows if known is None else rows.join(known, ["id", "sha256"], "left_anti")
        terms = fresh.select("id", "sha256", F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("id", "sha256", "term").agg(F.count("*").alias("tf"))
        terms.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        fresh.select("id", "sha256", F.size(tokenize(F.col(text_col))).cast("long").alias("dl")).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known(spark, path: str, before: int) -> DataFrame | None:
    """(id, sha256) of the batches before, if there are any."""
    if before == 0:
        return None
    return spark.read.parquet(f"{path}/documents").where(F.col("batch") < before).select("id", "sha256").distinct()


def current(spark, path: str) -> DataFrame:
    """The postings of each document's last version."""
    docs = spark.read.parquet(f"{path}/documents")
    last = docs.groupBy("id").agg(F.max_by("sha256", "batch").alias("sha256"))
    return spark.read.parquet(f"{path}/postings").join(last, ["id", "sha256"]).select("id", "term", "tf")


def fold_usage(deltas: DataFrame, ts: str, by: list[str], counters: list[str], late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Additive counters per window of event time, with a watermark for late rows."""
    return deltas.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(*(F.sum(c).alias(c) for c in counters))
