"""Stored vectors in cells, for exact nearest neighbours by cosine that leave out whole cells.

Vectors are kept at length 1 in the cell of their nearest centroid (k-means on a sample of at most SAMPLE, assignment of all), each cell
with the greatest angle between its centroid and a vector of it. No vector of a cell is nearer to a query than the query's angle to the
centroid less that radius. A search looks through the FIRST cells by this bound, and then through those whose bound reaches the k-th best
so far. The result is exact whatever the cells are; how much is left out depends on how far the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import Generations, stored

SAMPLE, MOST_CELLS, FIRST = 10_000, 256, 1
SLACK = 2e-6  # similarities are told apart to six places
SLICE, BLOCK, ROWS = 16_384, 16_384, 256  # vectors and queries that meet in one task, queries of one product


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame, key: str) -> DataFrame:
    """key, u: embeddings at length 1; null and zero ones, and those with null, NaN or infinite components, are left out."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    own = vectors.filter(sound).select(key, e.alias("e")).withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e")))).filter("norm > 0")
    return own.select(key, F.transform("e", lambda x: x / F.col("norm")).alias("u"))


def _nearest(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Queries of a block against a slice of a cell, ROWS queries at a time as a product of matrices. What may be among the k nearest by six places is measured
    anew, component by component in their order, as Spark's dot does it."""
    matrix = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if vectors.num_rows and queries.num_rows:
        u, q, floor = matrix(vectors, "u"), matrix(queries, "q"), queries.column("floor").to_numpy()
        for at in range(0, len(q), ROWS):
            near = q[at : at + ROWS] @ u.T
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
            row, col = np.nonzero(near >= np.maximum(least, floor[at : at + ROWS])[:, None] - SLACK)
            exact = np.zeros(len(row))
            for d in range(u.shape[1]):
                exact += q[at + row, d] * u[col, d]
            found.append((at + row, col, exact))
    row, col, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": queries.column("query_id").take(pa.array(row)), "id": vectors.column("id").take(pa.array(col)), "near": pa.array(exact)})


class VectorCells:
    """Generations of `cells` (cell, centroid, radius, n) and `vectors` (id, u, cell), these in buckets by cell."""

    def __init__(self, spark: SparkSession, root: str, cells: int = 32):
        if not 1 <= cells <= MOST_CELLS:
            raise ValueError(f"1 to {MOST_CELLS} cells")
        self.store, self.cells = Generations(spark, root), cells

    def build(self, vectors: DataFrame) -> int:
        """vectors(id, embedding), ids distinct, all of one length → how many are held."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        units = stored(unit(vectors, "id"), "units")
        n = units.count()
        sample = units if n <= SAMPLE else units.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (SAMPLE << 20) // n)
        centres = KMeans(k=self.cells, seed=1, maxIter=10, featuresCol="v").fit(sample.select(array_to_vector("u").alias("v"))).clusterCenters() if n >= self.cells else []
        centres = [c / np.linalg.norm(c) for c in centres if np.linalg.norm(c) > 0] or [np.eye(1, len(units.first().u) if n else 1)[0]]
        matrix = np.array(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = batch.column("u").flatten().to_numpy().reshape(batch.num_rows, -1) @ matrix.T
                angle = np.arccos(np.clip(near.max(1, initial=-1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.argmax(1), pa.int32()), pa.array(angle, pa.float64())], ["id", "u", "cell", "angle"])

        kind = dict(units.dtypes)["id"]
        placed = stored(units.mapInArrow(assign, f"id {kind}, u array<double>, cell int, angle double"), "placed")
        known = self.store.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centroid array<double>")
        cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(known, "cell")
        self.store.swap({"cells": self.store.write_shadow("cells", cells.coalesce(1)), "vectors": self.store.write_buckets("vectors", placed.select("id", "u", "cell"), "cell")})
        return n

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """queries(query_id, embedding) → query_id, id, confidence (cosine to six places), rank: the k nearest, ties by id."""
        return self.searched(queries, k)[0]

    def searched(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The k nearest, and for each query how many vectors were compared (query_id, compared, held)."""
        cells, vectors = self.store.current("cells"), self.store.current("vectors")
        asked = stored(unit(queries, "query_id").withColumnRenamed("u", "q"), "queries")
        angle = F.acos(F.least(F.greatest(dot(F.col("q"), F.col("centroid")), F.lit(-1.0)), F.lit(1.0)))
        # cells are at most MOST_CELLS rows
        near = asked.join(F.broadcast(cells)).select("query_id", "cell", "n", F.cos(F.greatest(angle - F.col("radius"), F.lit(0.0))).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
        near = stored(near.withColumn("place", F.row_number().over(order)), "bounds")
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id"))).filter(F.col("rank") <= k)

        sizes = cells.select("cell", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
        blocks = max(1, -(-asked.count() // BLOCK))
        dealt = vectors.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        held = dealt.select("id", "u", "cell", "slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        ids, query_ids = dict(vectors.dtypes)["id"], dict(asked.dtypes)["query_id"]

        def within(chosen: DataFrame) -> DataFrame:
            """chosen(query_id, cell, floor): the k nearest of a cell's vectors, and those within SLACK of the k-th, unless they are under the floor."""
            wanted = chosen.select("query_id", "cell", "floor").join(asked, "query_id").join(F.broadcast(sizes), "cell")
            wanted = wanted.select("query_id", "q", "floor", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
            place = ["cell", "slice", "block"]
            pairs = held.groupBy(*place).cogroup(wanted.groupBy(*place)).applyInArrow(lambda v, q: _nearest(v, q, k), f"query_id {query_ids}, id {ids}, near double")
            return best(pairs.select("query_id", "id", F.round("near", 6).alias("confidence")))

        first = stored(within(near.filter(F.col("place") <= FIRST).withColumn("floor", F.lit(-2.0))), "first")
        floor = first.filter(F.col("rank") == k).select("query_id", F.col("confidence").alias("floor"))
        more = near.filter(F.col("place") > FIRST).join(floor, "query_id", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(-2.0)) - SLACK)
        more = stored(more.select("query_id", "cell", "n", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "more")
        found = best(first.drop("rank").unionByName(within(more).drop("rank")))
        compared = near.filter(F.col("place") <= FIRST).select("query_id", "n").union(more.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("compared"))
        return found.select("query_id", "id", "confidence", "rank"), compared.join(F.broadcast(cells.agg(F.sum("n").alias("held"))))
