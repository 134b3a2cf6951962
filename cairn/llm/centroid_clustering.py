"""Lloyd's rounds by sort-means, exact in whole numbers.

A vector's components are scaled and floored to integers. In each round the centroids are ordered by their distance from each
centroid. A vector starts at the centroid that it was assigned to and scans the others in that one's order; beyond twice its distance
from that one, strictly, none can be nearer or as near, and the scan stops. Ties go to the smaller number. Distances are squared and
compared as integers: a centroid lies beyond if its squared distance from the start exceeds four times the vector's.

Vectors are never shuffled: a round reads them with their last assignment, assigns them, writes them to the shared checkpoint folder,
and adds up each task's own sums before those of all tasks; the table of the round before is then deleted. What goes through the
driver are the centroids and their sums, `clusters` rows of `dims` numbers, and each task holds the distances between all centroids.

Odd rows: a vector that is null, has another number of components, or a null, NaN or infinite one among them is left out. A null id is
hashed as the empty text. Rows with one id count each; of equal hashes the smaller vector comes first. With fewer vectors than
clusters there are as many clusters as vectors; without any there are no rows. An empty cluster keeps its centroid. A component whose
integer is 2^27 or more, either way, is an error, as distances would not fit. Other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import delete, map_arrow, shared_dir

#: Integers from here on are refused: squared distances of as many as 128 of them are below 2^63.
TOO_LARGE = 1 << 27


def whole(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that count, as arrays of int."""
    x = F.col(f"`{vector_col}`")
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def integer(c: Column) -> Column:
        n = F.floor(F.lit(float(scale)) * c.cast("double"))
        return F.when(F.abs(n) < TOO_LARGE, n.cast("int")).otherwise(F.raise_error(F.lit(f"a component is {TOO_LARGE} or more")).cast("int"))

    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.when(fine, x).alias("x")).where("x is not null").select("id", F.transform("x", integer).alias("v"))


def seeds(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()  # as many as there are clusters
    return np.array([r["v"] for r in first], np.int64)


class SortMeans:
    """Centroids, and of each one the others in order of their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = np.array([self.squared(centroids, c) for c in centroids])
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    @staticmethod
    def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and its squared distance, from the centroid that it was at."""
        who, best = at.astype(np.int64), np.zeros(len(v), np.int64)
        for a in np.unique(at):
            mine = np.flatnonzero(at == a)
            start = self.squared(v[mine], self.centroids[a])
            far = np.argsort(-start, kind="stable")  # those that scan furthest come first, so at each step the first so many go on
            mine, start = mine[far], start[far]
            x, near, to = v[mine], start.copy(), np.full(len(mine), a)
            for c in self.order[a]:
                go = int(np.searchsorted(-4 * start, -self.apart[a, c], "right"))
                if not go:
                    break
                if c == a:
                    continue
                d = self.squared(x[:go], self.centroids[c])
                less = (d < near[:go]) | ((d == near[:go]) & (c < to[:go]))
                near[:go][less] = d[less]
                to[:go][less] = c
            who[mine], best[mine] = to, near
        return who, best


def matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assign(table: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(id, v, cluster, distance) of a table (id, v, cluster)."""
    dims = centroids.shape[1]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model = SortMeans(centroids)
        for b in batches:
            who, best = model.nearest(matrix(b["v"], dims), b["cluster"].to_numpy(zero_copy_only=False))
            yield {"id": b["id"], "v": b["v"], "cluster": who.astype(np.int32), "distance": best}

    return map_arrow(table.select("id", "v", "cluster"), run, f"id {kind}, v array<int>, cluster int, distance long")


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; an empty one stays."""
    k, dims = centroids.shape

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v, who = matrix(b["v"], dims), b["cluster"].to_numpy(zero_copy_only=False)
            for c in np.unique(who):
                total[c] += v[who == c].sum(0)
            n += np.bincount(who, minlength=k)
        there = np.flatnonzero(n)
        yield {"cluster": there.astype(np.int32), "n": n[there], "total": total[there].tolist()}

    parts = map_arrow(assigned.select("v", "cluster"), add, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # clusters * dims rows
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def sort_means(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that counts, after so many rounds and a last assignment."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    place = f"{shared_dir(spark)}/sort-means-{uuid.uuid4().hex}"
    whole(vectors, dims, scale, id_col, vector_col).withColumn("cluster", F.lit(0)).write.parquet(f"{place}/0")
    table = spark.read.parquet(f"{place}/0")
    centroids = seeds(table, clusters, seed)
    k = 0
    while len(centroids) and k <= rounds:
        k += 1
        assign(table, centroids, kind).write.parquet(f"{place}/{k}")
        delete(spark, f"{place}/{k - 1}")
        table = spark.read.parquet(f"{place}/{k}")
        if k <= rounds:
            centroids = moved(table, centroids)
    spread = {r["cluster"]: int(r["total"]) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()} if k else {}
    named = [(c, spread.get(c, 0), sum(spread.values()), sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    distance = F.col("distance") if k else F.lit(None).cast("long").alias("distance")
    out = table.select(F.col("id").alias(id_col), "cluster", distance).join(F.broadcast(about), "cluster")  # a row for each cluster
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
