"""Tailing and exactly-once appends as Structured Streaming jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import FSM, decide
from ..registry import query
from ..sources.tables import attempts, records, sql


def folder(spark: SparkSession) -> str:
    """A folder of its own under spark.checkpoint.dir; where that is unset, in the warehouse, or on a local master in a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.gettempdir() if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tail-{uuid.uuid4().hex}"


def drained(stream: DataFrame, out: str) -> None:
    """Runs a stream over all that is there, into a table; offsets and outputs are in checkpoints, so a rerun adds nothing twice."""
    q = stream.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@query("tail_follow", sql("SELECT stream_id, off, body FROM records", "records"))
def tail_follow(spark: SparkSession, d: str) -> DataFrame:
    """Records as a file stream, followed until all are read."""
    out = folder(spark)
    rows = records(spark, d).select("stream_id", "off", "body")
    rows.write.parquet(out + "/source")
    drained(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(out + "/source"), out)
    return spark.read.schema(rows.schema).parquet(out + "/data")


@query("resume_by_offset", sql("SELECT stream_id, off, body, count(*) OVER (PARTITION BY stream_id, off) AS times FROM records", "records"))
def resume_by_offset(spark: SparkSession, d: str) -> DataFrame:
    """A follower that stops and is started again: it goes on at the offsets in its checkpoint, so that what came meanwhile is read and nothing twice."""
    out = folder(spark)
    rows = records(spark, d).select("stream_id", "off", "body")
    for part in ("off % 3 = 0", "off % 3 = 1", "off % 3 = 2"):
        rows.where(part).write.mode("append").parquet(out + "/source")
        drained(spark.readStream.schema(rows.schema).parquet(out + "/source"), out)
    return spark.read.schema(rows.schema).parquet(out + "/data").withColumn("times", F.count("*").over(Window.partitionBy("stream_id", "off")))


class Producers(StatefulProcessor):
    """The producer rule over (epoch, last sequence) of each stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("producer", "epoch long, seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        # the attempts of one micro-batch, which holds a bounded part of a stream: in their order
        part = pd.concat(list(rows)).sort_values("rn")
        out = []
        for rn, epoch, seq in zip(part.rn, part.epoch, part.seq, strict=True):
            state, decision = decide(state, int(epoch), int(seq))
            out.append((int(key[0]), int(rn), decision))
        if state is not None:
            self.state.update(state)
        yield pd.DataFrame(out, columns=["stream_id", "rn", "decision"])

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DECISIONS = "stream_id long, rn long, decision string"


@query("dedup_stream", sql(FSM + " SELECT stream_id, rn, decision FROM f", "records", "attempts", recursive=True))
def dedup_stream(spark: SparkSession, d: str, parts: int = 3) -> DataFrame:
    """The producer rule as a stateful stream, with its state in RocksDB: the attempts arrive in some micro-batches one after another, each with a bounded part of every stream, and the state goes from one to the next."""
    out = folder(spark)
    rows = attempts(spark, d)
    most = rows.agg(F.max("rn")).first()[0] or 0
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(parts):
            rows.where((F.col("rn") > most * k // parts) & (F.col("rn") <= most * (k + 1) // parts)).write.mode("append").parquet(out + "/source")
            stream = spark.readStream.schema(rows.schema).parquet(out + "/source").groupBy("stream_id")
            drained(stream.transformWithStateInPandas(Producers(), DECISIONS, "Append", "None"), out)
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(DECISIONS).parquet(out + "/data")


@query("windowed_counts", sql("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS day_ms, event_type, count(*) AS n FROM events GROUP BY ALL"))
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts as a tumbling window over event time, by a stream whose result is written whole after each of its micro-batches."""
    out = folder(spark)
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.timestamp_millis(ms).alias("ts"), "event_type")
    e.write.parquet(out + "/source")
    day = F.expr("unix_millis(ts) div 86400000 * 86400000").alias("day_ms")
    counts = spark.readStream.schema(e.schema).parquet(out + "/source").groupBy(day, "event_type").agg(F.count("*").alias("n"))
    write = lambda df, _: df.write.mode("overwrite").parquet(out + "/data")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day_ms long, event_type string, n long").parquet(out + "/data")


@query("late_records", sql("SELECT event_id, stream_id, off FROM records WHERE event_id % 20 <> 9", "records"))
def late_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that come out of order or again: those behind the watermark are dropped, and a second copy within it too. Every twentieth comes a year late, some come twice."""
    out = folder(spark)
    r = records(spark, d).select("event_id", "stream_id", "off", F.timestamp_millis("ts_ms").alias("ts"))
    late = F.col("event_id") % 20 == 9
    old = r.where(late).withColumn("ts", F.col("ts") - F.expr("INTERVAL 365 DAYS"))
    for part in (r.where(~late), r.where(~late & (F.col("event_id") % 10 == 4)), old):
        part.write.mode("append").parquet(out + "/source")
        stream = spark.readStream.schema(r.schema).parquet(out + "/source").withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
        drained(stream.select("event_id", "stream_id", "off"), out)
    return spark.read.schema("event_id long, stream_id long, off long").parquet(out + "/data")
