"""Vector search by cells: nearest centroids, radii, and the triangle inequality.

Vectors are scaled to length 1, so that cosine and distance order alike. Centroids are fitted by Lloyd's rounds on a bounded sample
(`sample` vectors, those with the smallest hashes), then every vector is put into the cell of its nearest centroid, and the table is
stored in the order of cells, with each cell's radius. A zero vector has no direction: such rows are a cell of their own, which is always
read.

A search takes two passes. The first looks into each query's `probe` nearest cells; the k-th best distance found is its
threshold. A vector of a cell is no nearer to the query than the centroid's distance less the cell's radius, so the exact way reads those
other cells only in which this bound is within the threshold. The short way (exact=False) stops after the first pass; its recall is
measured, not promised.

Queries go to the tasks in blocks of `block_rows`; vectors are not shuffled, and only k rows for each query and task's batch are sent on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.deploy import ship
from cairn.operators.common import checkpoint_dir, cut_lineage, top
from cairn.operators.vector import _unit, best

#: The cell of vectors of length 0.
ZERO = -1
#: What a bound may be off by in floating point.
SLACK = 1e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def fit(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample of unit vectors, the first ones being spread over it."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        at = _distances(sample, centroids).argmin(1)
        n = np.bincount(at, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, at, sample)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


class CellIndex:
    """A table (cell, id, v) with centroids and radii; search() answers many queries at once."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, radii: np.ndarray, id_col: str, vector_col: str):
        self.table, self.centroids, self.radii, self.id_col, self.vector_col = table, centroids, radii, id_col, vector_col

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", path: str | None = None, cells: int | None = None, sample: int = 20_000) -> CellIndex:
        """The index of all vectors of one length, below path or in the checkpoint folder; by default about sqrt(n) cells, 4096 at most."""
        spark = vectors.sparkSession
        ship(spark)
        path = path or f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null")
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()  # a bounded sample
        some = _unit(np.stack(some["v"]).astype(float)) if len(some) else np.zeros((0, 1))
        some = some[some.any(1)]
        centroids = fit(some, cells or min(4096, max(1, int(rows.count() ** 0.5)))) if len(some) else some
        shared = spark.sparkContext.broadcast(centroids)

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = _unit(np.stack(b["v"]).astype(float))
                    d = _distances(v, shared.value)
                    at = d.argmin(1)
                    zero = ~v.any(1)
                    yield pd.DataFrame({"cell": np.where(zero, ZERO, at), "id": b["id"], "v": list(v), "far": np.where(zero, 0.0, d[np.arange(len(v)), at])})

        if len(centroids):
            dealt = rows.mapInPandas(put, f"cell int, id {rows.schema['id'].dataType.simpleString()}, v array<double>, far double")
        else:
            dealt = rows.select(F.lit(ZERO).alias("cell"), "id", F.transform("v", lambda x: x.cast("double")).alias("v"), F.lit(0.0).alias("far"))
        # By id as well, so a cell that holds very many vectors is split.
        dealt.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(path)
        table = spark.read.parquet(path)
        radii = np.zeros(len(centroids))
        for r in table.where(F.col("cell") >= 0).groupBy("cell").agg(F.max("far").alias("r")).collect():  # a row for each cell
            radii[r["cell"]] = r["r"]
        return cls(table.drop("far"), centroids, radii, id_col, vector_col)

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None, exact: bool = True, block_rows: int = 1024) -> DataFrame:
        """(query_id, id, score, rank): each query's k nearest by cosine; ties by id.

        Exact, or as good as `probe` cells are: by default half of all, which vectors without clusters need for a recall of 0.9. The
        exact way starts with 4.
        """
        probe = probe or (4 if exact else -(-len(self.centroids) // 2))
        rows = queries.select(F.col(self.id_col).alias("q"), F.col(self.vector_col).alias("v")).where("v is not null")
        spark: SparkSession = rows.sparkSession
        n = -(-rows.count() // block_rows) or 1
        order = [F.round("score", 9).desc(), F.col("id")]
        schema = f"query_id {rows.schema['q'].dataType.simpleString()}, id {self.table.schema['id'].dataType.simpleString()}, score double"
        out = spark.createDataFrame([], schema)
        for block in range(n):
            part = rows.where(F.pmod(F.xxhash64("q"), F.lit(n)) == block).orderBy("q").toPandas()  # about block_rows rows
            if not len(part):
                continue
            q = _unit(np.stack(part["v"]).astype(float))
            far = _distances(q, self.centroids) if len(self.centroids) else np.zeros((len(q), 0))
            near = np.zeros_like(far, bool)
            np.put_along_axis(near, far.argsort(1, kind="stable")[:, :probe], True, 1)
            first = cut_lineage(top(self._within(part["q"].to_numpy(), q, near, True, k, schema), k, ["query_id"], *order).drop("rank"))
            out = out.unionByName(first)
            if exact:
                got = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).toPandas()  # a row for each of the block's queries
                least = part["q"].map(dict(zip(got["query_id"], got["s"], strict=True))).to_numpy(float, na_value=np.nan)
                # Unit vectors of a cosine c are sqrt(2 - 2c) apart; a query without a threshold, or of length 0, looks everywhere.
                reach = np.where(np.isnan(least) | ~q.any(1), np.inf, np.sqrt(np.maximum(2 - 2 * least, 0)) + SLACK)
                more = (far - self.radii <= reach[:, None]) & ~near
                out = out.unionByName(self._within(part["q"].to_numpy(), q, more, False, k, schema)) if more.any() else out
        return top(out, k, ["query_id"], *order)

    def _within(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, zero: bool, k: int, schema: str) -> DataFrame:
        """(query_id, id, score): the k best of each batch for each query, among the cells that it wants, and the zero vectors if asked."""
        spark = self.table.sparkSession
        shared = spark.sparkContext.broadcast((ids, q, wanted))
        cells = [int(c) for c in np.flatnonzero(wanted.any(0))] + [ZERO] * zero

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, wanted = shared.value
            for b in batches:
                for cell, own in b.groupby("cell", sort=False):
                    who = np.arange(len(q)) if cell == ZERO else np.flatnonzero(wanted[:, cell])
                    if len(who):
                        found = best(ids[who], own["id"].to_numpy(), q[who], np.stack(own["v"]), k)
                        yield pd.DataFrame(dict(zip(("query_id", "id", "score"), found, strict=True)))

        return self.table.where(F.col("cell").isin(cells)).mapInPandas(run, schema)
