"""Exact nearest neighbours by cosine, centroids, and representatives of containers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions import vectors as V

#: Queries of a batch that go to the workers at once, and rows that are compared with them at once.
QUERY_BLOCK, ROWS = 4096, 512


def knn(vectors: DataFrame, query: Sequence[float], n: int, candidates: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """id_col and similarity of the n nearest; ties by id. Candidates are joined before the ranking, so none is lost."""
    inside = vectors if candidates is None else vectors.join(candidates.select(id_col), id_col, "left_semi")
    scored = inside.select(id_col, V.cosine(F.col("v"), V.literal(query)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(n)


def knn_batch(vectors: DataFrame, queries: DataFrame, n: int, id_col: str = "vec_id", v_col: str = "v") -> DataFrame:
    """For each query (id_col, v_col) its n nearest other vectors: query, id_col, similarity, rank from 1.

    Queries go to the workers in blocks of QUERY_BLOCK. A partition keeps n rows for each query at most, so that
    the final ranking shuffles queries x partitions x n rows, never all pairs.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    found = None
    cursor = queries.select(id_col, v_col).orderBy(id_col).toLocalIterator()
    while block := [row for _, row in zip(range(QUERY_BLOCK), cursor, strict=False)]:
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], float)
        length = np.linalg.norm(q, axis=1, keepdims=True)
        q = q / np.where(length == 0, 1, length)

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best_s, best_i = np.empty((len(q), 0)), np.empty((len(q), 0), ids.dtype)
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                own = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
                size = np.linalg.norm(v, axis=1)
                s = q @ (v / np.where(size == 0, 1, size)[:, None]).T
                s[ids[:, None] == own[None, :]] = -np.inf
                s, i = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(own, (len(q), len(own)))])
                order = np.lexsort((i, -s))[:, :n]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            there = best_s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best_s.shape)[there]), pa.array(best_i[there]), pa.array(best_s[there])], ["query", id_col, "similarity"])

        part = vectors.select(id_col, "v").mapInArrow(nearest, f"query {kind}, {id_col} {kind}, similarity double")
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select(F.col(id_col).alias("query"), id_col, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def duplicates(vectors: DataFrame, query: Sequence[float], least: float = 0.9, n: int = 5) -> DataFrame:
    """Of the n nearest, those that are at least this similar."""
    return knn(vectors, query, n).where(F.col("similarity") >= least)


def centroids(vectors: DataFrame, container: str = "label") -> DataFrame:
    """container, v: the mean by dimension; partial sums by (container, dimension), no list of members."""
    each = vectors.select(container, F.posexplode("v").alias("dim", "x")).groupBy(container, "dim").agg(F.avg("x").alias("x"))
    return each.groupBy(container).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))


def representatives(vectors: DataFrame, k: int = 10, container: str = "label", id_col: str = "vec_id") -> DataFrame:
    """container, id_col, rank: the k members nearest to their container's centroid."""
    means = centroids(vectors, container).withColumnRenamed("v", "centroid")
    scored = vectors.join(F.broadcast(means) if means.limit(10_001).count() <= 10_000 else means, container).select(container, id_col, V.cosine(F.col("v"), F.col("centroid")).alias("similarity"))
    order = Window.partitionBy(container).orderBy(F.desc("similarity"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def aggregates(vectors: DataFrame, level: str, k: int = 10, container: str = "label", id_col: str = "vec_id") -> DataFrame:
    """level, container, member_ids (the representatives in order), member_count (of all members)."""
    members = representatives(vectors, k, container, id_col).groupBy(container).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", id_col))), lambda s: s[id_col]).alias("member_ids"))
    return vectors.groupBy(container).agg(F.count("*").alias("member_count")).join(members, container).select(F.lit(level).alias("level"), F.col(container).alias("container"), "member_ids", "member_count")
