"""Rank fusion of lexical and dense hits, and the projection to evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import is_test_file
from cairn.operators.common import top


def ranked(hits: DataFrame) -> DataFrame:
    """hits (query_id, method, id, score) with their rank in query and method; ties by id."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "method").orderBy(F.round("score", 9).desc(), "id")))


def known(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose id is a chunk's."""
    return hits.join(chunks.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")


def rrf(hits: DataFrame, by: list[str], k: int = 10, rrf_k: int = 60, lexical: float = 1.0, dense: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion within each group of `by`: (by, id, score, method, rank), the k best; ties by id.

    hits: (query_id, method, id, rank) and the columns of `by`; method is bm25 or vector. The label is that of the better rank, bm25 on a tie.
    """
    weight = F.when(F.col("method") == "bm25", lexical).otherwise(dense)
    fused = hits.groupBy(*by, "id").agg(
        F.sum(weight / (rrf_k + F.col("rank"))).alias("score"),
        F.min(F.when(F.col("method") == "bm25", F.col("rank"))).alias("lex"),
        F.min(F.when(F.col("method") == "vector", F.col("rank"))).alias("den"),
    )
    label = F.when(F.col("den").isNotNull() & (F.col("lex").isNull() | (F.col("den") < F.col("lex"))), "vector").otherwise("bm25")
    named = fused.select(*by, "id", "score", label.alias("method"))
    return top(named, k, by, F.round("score", 9).desc(), F.col("id"))


def single_mode(hits: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The best score of each id over a group's queries; the k best ids."""
    best = hits.groupBy(*by, "id").agg(F.max("score").alias("score"))
    return top(best, k, by, F.round("score", 9).desc(), F.col("id"))


def evidence(hits: DataFrame, chunks: DataFrame, method: Column, source: Column | None = None) -> DataFrame:
    """Hits as evidence: chunk_id, a nested citation, content, source_type, retrieval, score."""
    kind = source if source is not None else F.when(is_test_file(F.col("path")), "test").otherwise("code")
    joined = hits.join(chunks, hits["id"] == chunks["chunk_id"])
    cited = F.struct("path", "commit", "start_line", "end_line").alias("citation")
    return joined.select(*(c for c in hits.columns if c not in ("id", "method", "score")), "chunk_id", cited, F.col("text").alias("content"), kind.alias("source_type"), method.alias("retrieval"), F.round("score", 6).alias("score"))


class HybridRetriever:
    """Lexical and dense indexes fused by reciprocal ranks; modes hybrid, bm25 and vector."""

    def __init__(self, lexical, dense, mode: str = "hybrid", rrf_k: int = 60, w_lexical: float = 1.0, w_dense: float = 1.0, candidate_k: int = 50):
        self.lexical, self.dense, self.mode = lexical, dense, mode
        self.rrf_k, self.w_lexical, self.w_dense, self.candidate_k = rrf_k, w_lexical, w_dense, candidate_k

    def hits(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, method, id, score, rank) of both indexes; each index is a function (queries, k) -> (query_id, id, score, rank)."""
        lex = self.lexical(queries, k).withColumn("method", F.lit("bm25"))
        return lex.unionByName(self.dense(queries, k).withColumn("method", F.lit("vector")))

    def search(self, queries: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
        """The k best ids per query, or per group of queries if `by` names columns of queries (then joined by query_id)."""
        by = by or ["query_id"]
        if self.mode != "hybrid":
            found = (self.lexical if self.mode == "bm25" else self.dense)(queries, k)
            return single_mode(self._grouped(found, queries, by), by, k).withColumn("method", F.lit(self.mode))
        return rrf(self._grouped(self.hits(queries, self.candidate_k), queries, by), by, k, self.rrf_k, self.w_lexical, self.w_dense)

    @staticmethod
    def _grouped(found: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
        return found if by == ["query_id"] else found.join(queries.select("query_id", *by), "query_id")
