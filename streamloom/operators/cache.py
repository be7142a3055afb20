"""Blocks of a node's cache, and the coalescing of reads from an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fold import fold
from ..registry import query
from ..sources.tables import objects, records, sql

#: A cache releases or merges blocks only beyond these numbers of blocks.
MOST_BLOCKS, MERGE_FROM = 64, 8


def parts(spark: SparkSession, d: str) -> DataFrame:
    """node_id, block_id, stream_id, start_off, end_off, size: the streams of each cache block (40 events) of a node, which has 16 streams. Every seventh block is missing."""
    r = records(spark, d).withColumn("block_id", F.expr("event_id div 40")).where("block_id % 7 <> 3")
    g = r.groupBy(F.expr("stream_id div 16").alias("node_id"), "block_id", "stream_id")
    return g.agg(F.min("off").alias("start_off"), (F.max("off") + 1).alias("end_off"), F.sum("len").alias("size"))


FREE = """+ b AS (SELECT stream_id // 16 AS node_id, event_id // 40 AS block_id, CAST(sum(len) AS BIGINT) AS size FROM records WHERE event_id // 40 % 7 <> 3 GROUP BY ALL),
w AS (SELECT *, bool_and(block_id % 11 <> 9) OVER o AS all_free, sum(size) OVER (PARTITION BY node_id) - sum(size) OVER o + size AS held, count(*) OVER (PARTITION BY node_id) - row_number() OVER o + 1 AS blocks FROM b WINDOW o AS (PARTITION BY node_id ORDER BY block_id))
SELECT node_id, block_id, size FROM w WHERE all_free AND (held > 900 OR blocks > 64)"""


@query("cache_free", sql(FREE, "records"))
def cache_free(spark: SparkSession, d: str, capacity: int = 1000) -> DataFrame:
    """Free blocks released from the oldest on while the cache is beyond nine tenths of its capacity or its number of blocks.

    What is held falls from block to block, so that the released ones are a
    prefix and each block's case is decided by running sums.
    """
    node = Window.partitionBy("node_id")
    upto = node.orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    b = parts(spark, d).groupBy("node_id", "block_id").agg(F.sum("size").alias("size")).select(
        "*",
        F.min(F.col("block_id") % 11 != 9).over(upto).alias("all_free"),
        (F.sum("size").over(node) - F.sum("size").over(upto) + F.col("size")).alias("held"),
        (F.count("*").over(node) - F.count("*").over(upto) + 1).alias("blocks"),
    )
    return b.where(F.col("all_free") & ((F.col("held") > capacity // 10 * 9) | (F.col("blocks") > MOST_BLOCKS))).select("node_id", "block_id", "size")


def merge_step(state: dict | None, row: dict, most: int) -> tuple[dict, dict]:
    """A free block joins the one before it if both together are small and no stream of theirs has a gap; the first block in use ends it."""
    ends = {s["stream_id"]: s["end_off"] for s in row["streams"]}
    if state is None:
        state = {"grp": 0, "size": row["size"], "ends": ends, "blocks": row["blocks"], "free": row["free"]}
    else:
        going = state["free"] and row["free"] and state["blocks"] > MERGE_FROM
        whole = all(state["ends"].get(s["stream_id"], s["start_off"]) == s["start_off"] for s in row["streams"])
        if going and whole and state["size"] + row["size"] < most:
            state = {**state, "size": state["size"] + row["size"], "ends": state["ends"] | ends, "blocks": state["blocks"] - 1}
        else:
            state = {"grp": state["grp"] + 1, "size": row["size"], "ends": ends, "blocks": state["blocks"], "free": going}
    return state, {"node_id": row["node_id"], "block_id": row["block_id"], "grp": state["grp"]}


@query("cache_merge")
def cache_merge(spark: SparkSession, d: str, most: int = 800) -> DataFrame:
    """Which blocks of each node's cache become one. A merged block holds at most ``most`` bytes, which bounds the state."""
    streams = F.array_sort(F.collect_list(F.struct("stream_id", "start_off", "end_off"))).alias("streams")
    b = parts(spark, d).groupBy("node_id", "block_id").agg(F.sum("size").alias("size"), streams)
    b = b.withColumn("blocks", F.count("*").over(Window.partitionBy("node_id"))).withColumn("free", F.col("block_id") % 11 != 9)
    return fold(b, "node_id", ["block_id"], lambda: None, lambda s, r: merge_step(s, r, most), "node_id long, block_id long, grp long")


COALESCE = """+ b AS (SELECT object_id, stream_id, size, sum(size) OVER (PARTITION BY object_id ORDER BY stream_id) - size AS pos FROM objects),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY stream_id) AS rn FROM b WHERE stream_id % 5 <> 2),
f AS (SELECT object_id, stream_id, rn, pos + size AS e, size AS s, CAST(0 AS BIGINT) AS run FROM k WHERE rn = 1 UNION ALL
SELECT object_id, stream_id, rn, pos + size, CASE WHEN cut THEN size ELSE s + size END, CASE WHEN cut THEN run + 1 ELSE run END FROM (SELECT k.*, f.s, f.run, k.pos <> f.e OR f.s + k.size >= 120 AS cut FROM f JOIN k ON k.object_id = f.object_id AND k.rn = f.rn + 1))
SELECT object_id, stream_id, run FROM f"""


def coalesce_step(state: tuple[int, int, int | None], row: dict, most: int) -> tuple[tuple[int, int, int], dict]:
    """A read ends at a gap of positions, and before the block that would bring it to the greatest size; a block beyond it is read alone."""
    run, size, end = state
    if end is not None and (row["pos"] != end or size + row["size"] >= most):
        run, size = run + 1, 0
    return (run, size + row["size"], row["pos"] + row["size"]), {"object_id": row["object_id"], "stream_id": row["stream_id"], "run": run}


@query("read_coalesce", sql(COALESCE, "objects", recursive=True))
def read_coalesce(spark: SparkSession, d: str, most: int = 120) -> DataFrame:
    """Wanted blocks of an object, adjacent ones in one read."""
    upto = Window.partitionBy("object_id").orderBy("stream_id").rowsBetween(Window.unboundedPreceding, 0)
    b = objects(spark, d).select("object_id", "stream_id", "size", (F.sum("size").over(upto) - F.col("size")).alias("pos")).where("stream_id % 5 <> 2")
    return fold(b, "object_id", ["pos"], lambda: (0, 0, None), lambda s, r: coalesce_step(s, r, most), "object_id long, stream_id long, run long")
