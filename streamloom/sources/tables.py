"""The log's relations, derived from the input tables by fixed formulas.

A stream is a user of ``events``; its records are the user's events in the order
of event_id, with dense offsets from 0. ``SQL`` holds the same formulas as common
table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, off, event_id, ts_ms, body, header_type, len."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, d, "events").select(
        F.col("user_id").alias("stream_id"),
        (F.row_number().over(order) - 1).cast("long").alias("off"),
        "event_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000").alias("ts_ms"),
        F.col("props").alias("body"),
        F.col("event_type").alias("header_type"),
        (F.octet_length("props") + F.octet_length("event_type")).cast("long").alias("len"),
    )


def streams(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, name, start_off, end_off, node_id, epoch, closed."""
    u = F.col("user_id")
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("end_off")).select(
        u.alias("stream_id"), F.concat(F.lit("/users/"), u.cast("string")).alias("name"), (u % 7).alias("start_off"), "end_off", (u % 4).cast("int").alias("node_id"), (u % 3).alias("epoch"), (u % 5 == 0).alias("closed")
    )


def objects(spark: SparkSession, d: str) -> DataFrame:
    """One row for each object (500 events) and stream in it: object_id, stream_id, start_off, end_off, size, data_ts_ms, kind."""
    r = records(spark, d).withColumn("object_id", F.expr("event_id div 500"))
    g = r.groupBy("object_id", "stream_id").agg(F.min("off").alias("start_off"), (F.max("off") + 1).alias("end_off"), F.sum("len").alias("size"), F.max("ts_ms").alias("data_ts_ms"))
    return g.withColumn("kind", F.when(F.col("object_id") % 3 == 0, "stream").otherwise("stream_set"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Four nodes of different weight: node_id, epoch, http_address, slots."""
    return spark.range(4).select(F.col("id").cast("int").alias("node_id"), (F.col("id") + 10).alias("epoch"), F.when(F.col("id") < 3, F.concat(F.lit("http://node-"), F.col("id").cast("string"))).otherwise("").alias("http_address"), (4 - F.col("id")).alias("slots"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Producer attempts with retries, gaps, stale and new epochs: stream_id, rn, epoch, seq."""
    r = records(spark, d)
    e, o = F.col("event_id"), F.col("off")
    block, seq, none = F.expr("off div 20"), o % 20, F.lit(None).cast("struct<n:int,epoch:bigint,seq:bigint>")

    def one(n: int, on, epoch, s):
        return F.when(on, F.struct(F.lit(n).alias("n"), epoch.alias("epoch"), s.cast("long").alias("seq"))).otherwise(none)

    each = F.array(one(0, e % 50 != 7, block, seq), one(1, e % 10 == 3, block, seq), one(2, (e % 10 == 5) & (o >= 20), block - 1, seq), one(3, e % 97 == 1, block + 1, F.lit(5)))
    rows = r.select("stream_id", "event_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("a"))
    rn = F.row_number().over(Window.partitionBy("stream_id").orderBy("event_id", "a.n")).cast("long")
    return rows.select("stream_id", rn.alias("rn"), F.col("a.epoch").alias("epoch"), F.col("a.seq").alias("seq"))


SQL = {
    "records": "records AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS off, event_id, epoch_us(ts) // 1000 AS ts_ms, props AS body, event_type AS header_type, CAST(strlen(props) + strlen(event_type) AS BIGINT) AS len FROM events)",
    "streams": "streams AS (SELECT user_id AS stream_id, '/users/' || user_id AS name, user_id % 7 AS start_off, count(*) AS end_off, CAST(user_id % 4 AS INTEGER) AS node_id, user_id % 3 AS epoch, user_id % 5 = 0 AS closed FROM events GROUP BY user_id)",
    "objects": "objects AS (SELECT event_id // 500 AS object_id, stream_id, min(off) AS start_off, max(off) + 1 AS end_off, CAST(sum(len) AS BIGINT) AS size, max(ts_ms) AS data_ts_ms, CASE WHEN (event_id // 500) % 3 = 0 THEN 'stream' ELSE 'stream_set' END AS kind FROM records GROUP BY ALL)",
    "nodes": "nodes AS (SELECT CAST(i AS INTEGER) AS node_id, i + 10 AS epoch, CASE WHEN i < 3 THEN 'http://node-' || i ELSE '' END AS http_address, 4 - i AS slots FROM range(4) t(i))",
    "attempts": "attempts AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY event_id, n) AS rn, epoch, seq FROM (SELECT stream_id, event_id, 0 AS n, off // 20 AS epoch, off % 20 AS seq FROM records WHERE event_id % 50 <> 7 UNION ALL SELECT stream_id, event_id, 1, off // 20, off % 20 FROM records WHERE event_id % 10 = 3 UNION ALL SELECT stream_id, event_id, 2, off // 20 - 1, off % 20 FROM records WHERE event_id % 10 = 5 AND off >= 20 UNION ALL SELECT stream_id, event_id, 3, off // 20 + 1, 5 FROM records WHERE event_id % 97 = 1))",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """The statement with the named relations before it."""
    if not names:
        return body
    need = [n for n in SQL if n in names or (n == "records" and {"objects", "attempts"} & set(names))]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(SQL[n] for n in need)}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().lstrip('+')}"
