"""Feature-based reranking of candidate chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import rerank_tokens
from cairn.operators.common import top


@dataclass(frozen=True)
class RerankConfig:
    symbol_boost: float = 0.35
    path_boost: float = 0.25
    content_boost: float = 0.25
    hop_decay: float = 0.12
    least_score: float = 0.0


def rerank_score(config: RerankConfig = RerankConfig()) -> Column:
    """From query, symbol, path, content, base_score and hop; expects the token sets q_tok, s_tok, p_tok and c_tok beside them."""
    share = lambda a, of: F.size(F.array_intersect("q_tok", a)) / F.greatest(F.size(of), F.lit(1))
    named = (F.length("symbol") > 2) & F.contains(F.lower("query"), F.lower("symbol"))
    symbol = F.when(F.coalesce(named, F.lit(False)), 1.0).otherwise(share("s_tok", "s_tok"))
    total = F.col("base_score") + config.symbol_boost * symbol + config.path_boost * share("p_tok", "p_tok") + config.content_boost * share("c_tok", "q_tok") - config.hop_decay * F.greatest("hop", F.lit(0))
    return F.when(F.size("q_tok") == 0, F.col("base_score")).otherwise(F.round(F.greatest(total, F.lit(0.0)), 6))


def rerank(candidates: DataFrame, k: int = 10, config: RerankConfig = RerankConfig(), by: str = "query_id") -> DataFrame:
    """candidates (by, query, symbol, path, content, start_line, end_line, base_score, hop, chunk_id) scored; the k best of each group.

    Of rows with the same path and lines the highest base score stays.
    """
    first = Window.partitionBy(by, "path", "start_line", "end_line").orderBy(F.col("base_score").desc(), "hop", "chunk_id")
    one = candidates.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    sets = {"q_tok": "query", "s_tok": "symbol", "p_tok": "path", "c_tok": "content"}
    scored = one.withColumns({t: rerank_tokens(F.coalesce(F.col(c), F.lit(""))) for t, c in sets.items()}).withColumn("score", rerank_score(config))
    return top(scored.where(F.col("score") >= config.least_score).drop(*sets), k, [by], F.col("score").desc(), F.col("hop"), F.col("path"), F.col("start_line"))
