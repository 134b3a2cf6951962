"""BM25 top-k over postings in blocks that know their greatest impact.

Documents are dealt into slots of a few that are alike; a block is what one term has in one slot: its postings, how many, and the greatest impact
(BM25 without idf) of any. So a frequent term is split into as many blocks as there are slots that hold it, and for a query the sum of
its terms' block maxima bounds the score of every document in a slot.

A search takes two passes. The first scores the slots with the highest bounds whole, and the k-th best of these scores is the
query's threshold: no document of the result can lie below it. The second reads the blocks of those other slots only whose bound reaches
it. The result is that of full scoring.

The index is stored as tables that are bucketed and sorted by what searches join on (maxima by term, postings by term and slot), so a loaded
index is never shuffled: only query terms are. Each version is a folder of its own, named by a manifest, so a search that runs while
documents are merged in still reads whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import tokenize
from cairn.operators.common import checkpoint_dir, cut_lineage, stored, top
from cairn.operators.lexical import query_terms

#: Documents of a slot at most, about, if all were of one kind; less where there are many kinds.
SLOT_DOCS = 32
#: How far below the threshold a bound may lie: ranks go by scores rounded to nine places.
SLACK = 1e-6


class BlockIndex:
    """Blocks (term, slot, n, most, postings) of a table of texts; search() answers many queries at once."""

    def __init__(self, spark: SparkSession, path: str, maxima: DataFrame, blocks: DataFrame, docs: int, k1: float, b: float):
        self.spark, self.path, self.maxima, self.blocks, self.docs, self.k1, self.b = spark, path, maxima, blocks, docs, k1, b

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: Column, path: str | None = None, **options) -> BlockIndex:
        """An index of documents with unique ids below path, or in the checkpoint folder."""
        return cls._write(docs.sparkSession, path, cls._counted(docs, id_col, text), **options)

    @staticmethod
    def _counted(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
        """(id, dl, terms): each document's tokens and counted terms (term, tf). Texts are shuffled by id and tokenised once."""
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        words = docs.select(F.col(id_col).alias("id"), text.alias("text")).repartition(n, "id").select("id", tokenize(F.col("text")).alias("words"))
        rows = words.select("id", F.coalesce(F.array_size("words"), F.lit(0)).cast("long").alias("dl"), F.explode_outer("words").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        return rows.groupBy("id", "dl").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms"))

    @classmethod
    def _write(cls, spark: SparkSession, path: str | None, docs: DataFrame, k1: float = 1.5, b: float = 0.75, buckets: int = 16) -> BlockIndex:
        path = path or f"{checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}"
        # Documents whose most frequent terms are the same are of one language or kind, and share slots: so most slots lack most terms.
        kind = F.array_max(F.transform("terms", lambda t: F.struct(t["tf"], t["term"])))["term"]
        docs = stored(docs.withColumn("kind", kind))
        lengths = docs.select("id", "dl")
        n, mean = lengths.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        slot = F.xxhash64("kind", F.pmod(F.xxhash64("id"), F.lit(max(1, n // SLOT_DOCS)))).alias("slot")
        tf, dl = F.col("tf"), F.col("dl")
        impact = F.lit(k1 + 1) * tf / (tf + k1 * (1 - b + b * dl / mean)) if mean else F.lit(0.0)
        # Whole documents go to their slots: what one term has in one slot is gathered there without another shuffle.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = docs.select(slot, "id", "dl", "terms").repartition(parts, "slot").select("slot", "id", "dl", F.inline("terms")).select("term", "slot", F.struct("id", "tf", "dl", impact.alias("impact")).alias("p"))
        blocks = dealt.groupBy("term", "slot").agg(F.collect_list("p").alias("postings"))  # of a slot's documents
        version = uuid.uuid4().hex
        blocks.select("term", "slot", "postings").write.bucketBy(buckets, "term", "slot").sortBy("term", "slot").option("path", f"{path}/{version}/blocks").saveAsTable(f"blocks_{version}")
        counted = spark.table(f"blocks_{version}").select("term", "slot", F.size("postings").cast("long").alias("n"), F.array_max("postings.impact").alias("most"))
        counted.write.bucketBy(buckets, "term").sortBy("term", "slot").option("path", f"{path}/{version}/maxima").saveAsTable(f"maxima_{version}")
        lengths.write.parquet(f"{path}/{version}/lengths")
        kind = lengths.schema["id"].dataType.simpleString()
        manifest = spark.createDataFrame([(version, buckets, n, k1, b, kind)], "version string, buckets int, docs long, k1 double, b double, kind string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return cls(spark, path, spark.table(f"maxima_{version}"), spark.table(f"blocks_{version}"), n, k1, b)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        """The index below path as it was last written, also in a session that knows nothing of its tables."""
        m = spark.read.parquet(f"{path}/manifest").first()
        place = f"{path}/{m.version}".replace("'", "\\'")
        entry = f"struct<id:{m.kind},tf:bigint,dl:bigint,impact:double>"
        for name, columns, by in (("blocks", f"term string, slot bigint, postings array<{entry}>", "term, slot"), ("maxima", "term string, slot bigint, n bigint, most double", "term")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{m.version} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY (term, slot) INTO {m.buckets} BUCKETS LOCATION '{place}/{name}'")
        return cls(spark, path, spark.table(f"maxima_{m.version}"), spark.table(f"blocks_{m.version}"), m.docs, m.k1, m.b)

    def merge(self, docs: DataFrame, id_col: str, text: Column) -> BlockIndex:
        """The index with documents added, or put in the place of those of their ids; a new version below the same path."""
        m = self.spark.read.parquet(f"{self.path}/manifest").first()
        new = cut_lineage(docs.select(F.col(id_col).alias("id")).distinct())
        held = self.blocks.select("term", F.inline("postings")).groupBy("id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        empty = self.spark.read.parquet(f"{self.path}/{m.version}/lengths").where("dl = 0").select("id", "dl", F.array().cast(held.schema["terms"].dataType).alias("terms"))
        rows = held.unionByName(empty).join(new, "id", "left_anti").unionByName(self._counted(docs, id_col, text))
        return self._write(self.spark, self.path, rows, self.k1, self.b, m.buckets)

    def weights(self) -> DataFrame:
        """(term, df, idf), the idf being ln(1 + (n - df + .5) / (df + .5)); from the maxima alone, in their own buckets."""
        df = self.maxima.groupBy("term").agg(F.sum("n").alias("df"))
        return df.select("term", "df", F.log1p((self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def _bounds(self, terms: DataFrame) -> DataFrame:
        """(query_id, slot, bound, n): what no document of the slot can exceed, and how many postings it takes to know their scores."""
        found = terms.join(self.maxima, "term")
        return found.groupBy("query_id", "slot").agg(F.sum(F.col("w") * F.col("most")).alias("bound"), F.sum("n").alias("n"))

    def _scores(self, terms: DataFrame, slots: DataFrame) -> DataFrame:
        """(query_id, id, score) of all documents of the slots (query_id, slot)."""
        asked = slots.select("query_id", "slot").join(terms, "query_id")
        hits = asked.join(self.blocks, ["term", "slot"]).select("query_id", "w", F.inline("postings"))
        return hits.groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))

    def search(self, queries: DataFrame, id_col: str, text: Column, k: int = 10) -> DataFrame:
        """(query_id, id, score, rank) of each query's k best; ties by id."""
        terms, first, second, seen = self.plan(queries, id_col, text, k)
        scored = seen.unionByName(self._scores(terms, second))
        return top(scored, k, ["query_id"], F.round("score", 9).desc(), F.col("id"))

    def plan(self, queries: DataFrame, id_col: str, text: Column, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """What search() does: (query_id, term, w), the slots (query_id, slot, bound, n) of the first pass and of the second, and the first's scores."""
        terms = cut_lineage(query_terms(queries, id_col, text).join(self.weights(), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")))
        bounds = cut_lineage(self._bounds(terms))
        first = cut_lineage(top(bounds, max(2, k), ["query_id"], F.col("bound").desc(), F.col("slot")).drop("rank"))
        seen = cut_lineage(self._scores(terms, first))
        least = top(seen, k, ["query_id"], F.col("score").desc(), F.col("id")).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        threshold = least.where(F.col("found") == k).select("query_id", (F.col("least") - SLACK).alias("least"))
        rest = bounds.join(first.select("query_id", "slot"), ["query_id", "slot"], "left_anti").join(threshold, "query_id", "left")
        return terms, first, rest.where("least is null or bound >= least").drop("least"), seen
