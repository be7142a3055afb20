"""Exact top-k by inner product: a kNN join over Voronoi cells.

Vectors are grouped by their nearest pivot. Pivots are rows of the table, so the
k best scores of a query among them bound its k-th best score from below; and
a cell's radius bounds from above what its members can score. Queries are put
together by cell into groups of at most ``GROUP`` rows; for every group and cell
the bounds give the least distance from the pivot that a member must have to
matter to any query of the group, and only such members are sent to it. Cells
are cut into parts of about ``PART`` rows, each (group, part) is solved by one
matrix product, and the parts' best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import tune
from .shared import stored

#: Pivots are this many rows at most, those of the smallest hashes of their ids.
PIVOTS = 128
GROUP, PART = 1024, 4096
SCALE, EVERY, K = 1024, 100, 10
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): scaled and floored vectors. Rows whose id or vector is null, or whose vector holds a null, a NaN or an infinity, take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(F.col("x").isNotNull() & sound, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(F.lit(float(SCALE)) * e).cast("double")).alias("v"))


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; sums beyond a long stop at its ends."""
    if q.size == 0 or x.size == 0 or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**52:
        return (q @ x.T).astype(np.int64)
    whole = [[int(e) for e in row] for row in x.tolist()]
    top = (1 << 63) - 1
    return np.array([[max(-top - 1, min(top, sum(int(a) * b for a, b in zip(row, y, strict=True)))) for y in whole] for row in q.tolist()], np.int64).reshape(len(q), len(x))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each row's cell and its distance from the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (pivots**2).sum(1)
        for batch in batches:
            x = matrix(batch.column(1))
            cell = np.argmin(own - 2 * (x @ pivots.T), axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, cell int, far double")


def search(rows: DataFrame, queries: DataFrame, k: int, pivots_most: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for rows and queries of one length."""
    spark = rows.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots_most).collect()  # at most PIVOTS rows
    if not got or not len(got[0].v):
        # vectors without components all score 0, so the smallest ids win; at most k + 1 of them can matter
        few = rows.orderBy("vec_id").limit(k + 1).withColumnRenamed("vec_id", "other").select("other")
        pairs = queries.select(F.col("vec_id").alias("query_id")).join(F.broadcast(few), F.col("query_id") != F.col("other"))
        return ranked(pairs.select("query_id", F.col("other").alias("vec_id"), F.lit(0).cast("long").alias("score")), k)
    pivots = np.array([r.v for r in got])
    names = np.array([r.vec_id for r in got], np.int64)
    cells = assign(rows, pivots)
    # one row for each pivot
    radius, parts_of = np.full(len(pivots), -1.0), [1] * len(pivots)
    for r in cells.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r.cell], parts_of[r.cell] = r.far, -(-r.n // PART)

    # queries of near cells come together: cells in the order of their pivots' projection on the longest axis of the pivots
    axis = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0] if len(pivots) > 1 else np.ones(pivots.shape[1])
    order = np.argsort(np.argsort(pivots @ axis)).astype(float).tolist()
    asked = assign(queries, pivots).withColumn("order", F.get(F.array(*map(F.lit, order)), F.col("cell")))
    n = asked.count()
    groups = max(1, -(-n // GROUP))
    if groups > 1:
        asked = asked.repartitionByRange(groups, "order", "vec_id")
    asked = asked.select("vec_id", "v", F.spark_partition_id().alias("group") if groups > 1 else F.lit(0).alias("group"))
    asked = stored(asked, "knn-queries")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every group and cell, the least distance from the pivot at which a member can still matter."""
        for batch in batches:
            q, own = matrix(batch.column(1)), batch.column(0).to_numpy()
            if not len(q):
                continue
            to_pivot = q @ pivots.T
            others = np.where(own[:, None] == names[None, :], -np.inf, to_pivot)
            least = np.partition(others, -k, axis=1)[:, -k] if len(names) >= k else np.full(len(q), -np.inf)
            size = np.maximum(np.sqrt((q**2).sum(1)), 1e-12)
            need = (least[:, None] - to_pivot) / size[:, None]
            need = need - SLACK * (np.abs(need) + 1)
            group = batch.column(2).to_numpy()
            for g in np.unique(group):
                low = need[group == g].min(0)
                low = np.where(np.isfinite(low), low, -1.0)
                on = np.flatnonzero((radius >= 0) & (low <= radius))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), g, np.int32)), pa.array(on.astype(np.int32)), pa.array(low[on])], names=["group", "cell", "least"])

    near = asked.mapInArrow(bounds, "group int, cell int, least double").groupBy("group", "cell").agg(F.min("least").alias("least"))
    near = near.withColumn("parts", F.get(F.array(*map(F.lit, parts_of)), F.col("cell")))
    parts = near.join(cells, "cell").where(F.col("far") >= F.col("least"))
    parts = parts.select("group", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    sent = near.select("group", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sent = sent.join(asked, "group").select("group", "cell", "part", "vec_id", "v").toDF("group_q", "cell_q", "part_q", "vec_id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(x):
            a, b = matrix(left.column("v").combine_chunks()), matrix(right.column("v").combine_chunks())
            order = np.argsort(x, kind="stable")
            x, b = x[order], b[order]
            for i in range(0, len(q), 256):
                s = dots(a[i : i + 256], b)
                for j in range(len(s)):
                    other = np.flatnonzero(x != q[i + j])
                    best = other[np.argsort(-s[j][other], kind="stable")[:k]]
                    out["query_id"].append(np.full(len(best), q[i + j]))
                    out["vec_id"].append(x[best])
                    out["score"].append(s[j][best])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    local = sent.groupBy("group_q", "cell_q", "part_q").cogroup(parts.groupBy("group", "cell", "part")).applyInArrow(lambda a, b: solve(a, b), "query_id long, vec_id long, score long")
    return ranked(local, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. A query meets at most k rows of each part."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """The k highest inner products of every query with other rows.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; a row is a
    candidate for a query if its id differs and its vector has the same length.
    Ties go to the smaller id; rows of a repeated id are candidates each, and of a
    repeated query id the smallest vector asks. Only ``vec_id`` and ``embedding``
    are read. An empty table gives no rows.
    """
    rows = usable(vectors)
    sizes = [r.n for r in rows.select(F.size("v").alias("n")).distinct().collect()]  # the lengths of vectors, one as a rule
    out = None
    for n in sizes:
        own = rows if len(sizes) == 1 else rows.where(F.size("v") == n)
        asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
        piece = search(own, asked, k, pivots)
        out = piece if out is None else out.unionByName(piece)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
      FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
