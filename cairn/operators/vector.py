"""Vector search: feature-hashing embeddings, norms, cosine top-k and the embedding cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cairn.deploy import ship
from cairn.functions.text import cache_key, tokenize
from cairn.operators.common import cut_lineage, top

DIM = 384
#: Vectors that meet a block of queries at once.
TILE = 1024


def token_weights(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, token, w): 1 + ln(tf) of each distinct token."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokenize(text)).alias("token")).groupBy("id", "token").agg((1 + F.log(F.count("*").cast("double"))).alias("w"))


def md5_bucket(token: Column, dim: int = DIM) -> tuple[Column, Column]:
    """Bucket and sign from the first 15 hex digits of the MD5, which any SQL engine computes alike."""
    h = F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long")
    return F.pmod(h, F.lit(dim)).cast("int"), F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, 1.0).otherwise(-1.0)


@F.pandas_udf(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sign", T.DoubleType())]))
def blake2b_bucket(token: pd.Series) -> pd.DataFrame:
    """Bucket (8-byte BLAKE2b, big-endian, modulo DIM) and sign (top bit): a hash that no built-in function offers."""
    from hashlib import blake2b

    h = [int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "big") for t in token]
    return pd.DataFrame({"bucket": [x % DIM for x in h], "sign": [1.0 if x >> 63 else -1.0 for x in h]})


def hash_embed(docs: DataFrame, id_col: str, text: Column, dim: int = DIM, mode: str = "md5") -> DataFrame:
    """Sparse unit vectors (id, bucket, v). mode blake2b hashes each distinct token once; it needs dim 384."""
    return embed_weights(token_weights(docs, id_col, text), dim, mode)


def embed_postings(postings: DataFrame, dim: int = DIM, mode: str = "md5") -> DataFrame:
    """hash_embed of texts whose tokens are counted already, as (term, id, tf); where these lie by id nothing is shuffled in mode md5."""
    return embed_weights(postings.select("id", F.col("term").alias("token"), (1 + F.log(F.col("tf").cast("double"))).alias("w")), dim, mode)


def embed_weights(weights: DataFrame, dim: int = DIM, mode: str = "md5") -> DataFrame:
    """Sparse unit vectors (id, bucket, v) of weighted tokens (id, token, w)."""
    if mode == "blake2b":
        ship(weights.sparkSession)
        hashed = weights.select("token").distinct().select("token", blake2b_bucket("token").alias("h")).select("token", "h.bucket", "h.sign")
        weights = weights.join(hashed, "token")
    else:
        bucket, sign = md5_bucket(F.col("token"), dim)
        weights = weights.select("id", "w", bucket.alias("bucket"), sign.alias("sign"))
    sums = weights.groupBy("id", "bucket").agg(F.sum(F.col("w") * F.col("sign")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))  # of as many cells as there are buckets
    return sums.withColumn("norm", norm).select("id", "bucket", (F.col("v") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("v"))


def dense(sparse: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vector) from (id, bucket, v)."""
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", "v")))
    grouped = sparse.groupBy("id").agg(cells.alias("m"))
    return grouped.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)).cast("float")).alias("vector"))


def cells(sparse: DataFrame) -> DataFrame:
    """(id, vector) from (id, bucket, v): a vector is a struct of the arrays `at` and `v`, of at most as many cells as there are buckets."""
    grouped = sparse.groupBy("id").agg(F.collect_list(F.struct("bucket", "v")).alias("c"))
    return grouped.select("id", F.struct(F.col("c.bucket").alias("at"), F.col("c.v").alias("v")).alias("vector"))


def sparse_top(docs: DataFrame, queries: DataFrame, k: int = 10, dim: int = DIM) -> DataFrame:
    """cosine_top of vectors given as (id, bucket, v): cells are put into a block's matrix by the task that reads them."""
    return cosine_top(cells(docs), cells(queries), k, "id", "vector", dim=dim)


def normalised(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.arrays_zip(vector.alias("x"), F.transform(vector, lambda _: F.when(norm == 0, 1.0).otherwise(norm)).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, dim: int = DIM) -> DataFrame:
    """(query_id, id, score, rank): each query's k nearest of all vectors, itself included; ties by id.

    Vectors are arrays, or the structs that cells() makes, of `dim` places. Queries go to the tasks in blocks of about block_rows
    rows; each Arrow batch of vectors meets a block in one matrix product and sends on only its own k best per query, so what is
    shuffled is k rows for each query and batch. With several blocks each block's rows are checkpointed and its broadcast is dropped
    before the next, so the driver holds one block at a time.
    """
    spark = vectors.sparkSession
    ship(spark)
    sparse = isinstance(vectors.schema[vector_col].dataType, T.StructType)
    parts = (F.col(f"{vector_col}.at").alias("at"), F.col(f"{vector_col}.v").alias("v")) if sparse else (F.col(vector_col).alias("v"),)
    rows = queries.select(F.col(id_col).alias("q"), *parts).where("v is not null")
    given = vectors.select(F.col(id_col).alias("id"), *parts).where("v is not null")
    n = -(-rows.count() // block_rows) or 1
    schema = f"query_id {queries.schema[id_col].dataType.simpleString()}, id {vectors.schema[id_col].dataType.simpleString()}, score double"

    def matrix(b: pd.DataFrame) -> np.ndarray:
        if not sparse:
            return _unit(np.stack(b["v"]).astype(float))
        m = np.zeros((len(b), dim))
        m[np.repeat(np.arange(len(b)), b["at"].str.len().to_numpy(int)), np.concatenate(b["at"].to_numpy())] = np.concatenate(b["v"].to_numpy())
        return _unit(m)

    out = None
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("q"), F.lit(n)) == block).orderBy("q").toPandas()  # about block_rows rows
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part["q"].to_numpy(), matrix(part)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for b in batches:
                if not len(b):
                    continue
                for at in range(0, len(b), TILE):
                    tile = b[at : at + TILE]
                    yield pd.DataFrame(dict(zip(("query_id", "id", "score"), best(ids, tile["id"].to_numpy(), q, matrix(tile), k), strict=True)))

        found = given.mapInPandas(run, schema)
        if n > 1:
            found = cut_lineage(top(found, k, ["query_id"], F.round("score", 9).desc(), F.col("id")).drop("rank"))
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top(out, k, ["query_id"], F.round("score", 9).desc(), F.col("id"))


def best(query_ids: np.ndarray, ids: np.ndarray, q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of each query's k best by scores rounded to nine places, then id. Only what reaches the k-th best is sorted."""
    score = q @ v.T
    shown = np.round(score, 9)
    k = min(k, len(ids))
    least = np.partition(shown, len(ids) - k, axis=1)[:, len(ids) - k]
    row, column = np.nonzero(shown >= least[:, None])
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place[column], -shown[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    row, column = row[keep], column[keep]
    return query_ids[row], ids[column], score[row, column]


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True) if m.size else np.ones((len(m), 1))
    return m / np.where(norm == 0, 1, norm)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Distinct (key, text) that the cache, a table keyed by `key`, has no vector of."""
    keyed = texts.select(cache_key(F.lit(model), F.col(text_col)).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def through_cache(texts: DataFrame, cache: DataFrame, model: str, embed, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, vector) of every distinct text, and the new cache rows; embed maps (key, text) to (key, vector)."""
    new = embed(cache_misses(texts, cache, model, text_col)).select("key", "vector")
    wanted = texts.select(cache_key(F.lit(model), F.col(text_col)).alias("key")).distinct()
    return wanted.join(cache.unionByName(new), "key"), new


class VectorIndex:
    """A table of vectors; search() answers many queries at once."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.vectors, self.id_col, self.vector_col = vectors, id_col, vector_col

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return cosine_top(self.vectors, queries, k, self.id_col, self.vector_col)
