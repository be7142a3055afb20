"""Counts, placements, orders and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import nodes, objects, read, records, sql, streams


@query("cluster_overview", sql("SELECT (SELECT count(*) FROM streams) AS streams, (SELECT count(DISTINCT object_id) FROM objects) AS objects, (SELECT count(*) FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off <= s.start_off) AS destroyed, (SELECT count(*) FROM streams WHERE stream_id % 17 = 3) AS transfers", "streams", "objects"))
def cluster_overview(spark: SparkSession, d: str) -> DataFrame:
    """Counts of streams, objects, objects that wait for deletion, and pending moves."""
    s, o = streams(spark, d), objects(spark, d)
    dead = o.join(s.select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off <= s").agg(F.count("*").alias("destroyed"))
    one = s.agg(F.count("*").alias("streams"), F.count_if(F.col("stream_id") % 17 == 3).alias("transfers"))
    return one.crossJoin(o.agg(F.countDistinct("object_id").alias("objects"))).crossJoin(dead).select("streams", "objects", "destroyed", "transfers")  # three single rows


@query("node_counts", sql("SELECT node_id, count(*) FILTER (NOT closed) AS opening, count(*) FILTER (closed) AS placed FROM nodes LEFT JOIN streams USING (node_id) GROUP BY node_id", "nodes", "streams"))
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    """Open and closed streams of each node."""
    return nodes(spark, d).select("node_id").join(streams(spark, d), "node_id", "left").groupBy("node_id").agg(F.count_if(~F.col("closed")).alias("opening"), F.count_if("closed").alias("placed"))


@query("stream_detail", sql("SELECT s.stream_id, name, s.start_off, s.end_off, closed, count(o.object_id) AS n_objects, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM streams s LEFT JOIN objects o ON o.stream_id = s.stream_id GROUP BY ALL", "streams", "objects"))
def stream_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every stream's state, with the number and bytes of its objects."""
    o = objects(spark, d).groupBy("stream_id").agg(F.count("*").alias("n_objects"), F.sum("size").alias("bytes"))
    return streams(spark, d).join(o, "stream_id", "left").select("stream_id", "name", "start_off", "end_off", "closed", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("objects_count", sql("SELECT kind, count(DISTINCT object_id) AS n FROM objects GROUP BY kind", "objects"))
def objects_count(spark: SparkSession, d: str) -> DataFrame:
    """Objects of each kind."""
    return objects(spark, d).groupBy("kind").agg(F.countDistinct("object_id").alias("n"))


@query("prepared_count", sql("SELECT count(*) AS n FROM events WHERE event_id % 3 = 0"))
def prepared_count(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are prepared and not yet committed."""
    return read(spark, d, "events").agg(F.count_if(F.col("event_id") % 3 == 0).alias("n"))


@query("stream_sizes", sql("SELECT object_id, stream_id, size FROM objects", "objects"))
def stream_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each stream in each sealed block."""
    return objects(spark, d).select("object_id", "stream_id", "size")


SCORE = "SELECT node_id, (count(s.stream_id) * 1000) // slots AS score FROM nodes LEFT JOIN streams s USING (node_id) GROUP BY node_id, slots"


@query("place_stream", sql(f"SELECT node_id, score FROM ({SCORE}) ORDER BY score, node_id LIMIT 1", "nodes", "streams"))
def place_stream(spark: SparkSession, d: str) -> DataFrame:
    """The node with the least load for its slots, ties to the lowest id."""
    n = nodes(spark, d).join(streams(spark, d).select("node_id", "stream_id"), "node_id", "left").groupBy("node_id", "slots").agg(F.count("stream_id").alias("k"))
    return n.withColumn("score", F.expr("k * 1000 div slots")).agg(F.min(F.struct("score", "node_id")).alias("m")).select("m.node_id", "m.score")


@query("dispersion", sql("+ n AS (SELECT object_id, count(DISTINCT stream_id) AS k FROM objects GROUP BY 1), t AS (SELECT stream_id, CAST(sum(k) AS BIGINT) AS total FROM objects JOIN n USING (object_id) GROUP BY 1) SELECT stream_id, total FROM t ORDER BY total, stream_id LIMIT 1", "objects"))
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    """The stream whose objects hold the fewest streams between them."""
    o = objects(spark, d)
    n = o.groupBy("object_id").agg(F.countDistinct("stream_id").alias("k"))
    t = o.join(n, "object_id").groupBy("stream_id").agg(F.sum("k").alias("total"))
    return t.agg(F.min(F.struct("total", "stream_id")).alias("m")).select("m.stream_id", "m.total")


DIGITS = "CASE WHEN ms < 1000 THEN ms ELSE ms // CAST(pow(10, length(CAST(ms AS VARCHAR)) - 3) AS BIGINT) * CAST(pow(10, length(CAST(ms AS VARCHAR)) - 3) AS BIGINT) END"


@query("latency_percentiles", sql(f"+ l AS (SELECT header_type, ts_ms - lag(ts_ms) OVER (PARTITION BY stream_id ORDER BY off) AS ms FROM records), h AS (SELECT header_type, {DIGITS} AS ms FROM l WHERE ms IS NOT NULL) SELECT header_type, CAST(quantile_disc(ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(ms, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(ms, 0.99) AS BIGINT) AS p99, CAST(quantile_disc(ms, 0.999) AS BIGINT) AS p999, max(ms) AS max FROM h GROUP BY header_type", "records"))
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the time between a stream's records, to three digits: so a histogram has at most 900 values for each power of ten, whatever the number of records."""
    lag = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("stream_id").orderBy("off"))
    unit = F.pow(F.lit(10.0), F.length(F.col("gap").cast("string")) - 3).cast("long")
    gaps = records(spark, d).select("header_type", lag.alias("gap")).where("gap IS NOT NULL")
    gaps = gaps.select("header_type", F.when(F.col("gap") < 1000, F.col("gap")).otherwise(F.floor(F.col("gap") / unit).cast("long") * unit).alias("ms"))
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)").cast("long")
    return gaps.groupBy("header_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), p(0.999).alias("p999"), F.max("ms").alias("max"))


@query("throughput", sql("+ g AS (SELECT ts_ms // 3600000 AS hour, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes, count(*) - lag(count(*)) OVER (ORDER BY ts_ms // 3600000) AS delta, 3600 AS seconds FROM records GROUP BY 1), a AS (SELECT CAST(NULL AS BIGINT) AS hour, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS delta, greatest((max(ts_ms) - min(ts_ms)) // 1000, 1) AS seconds FROM records) SELECT hour, n, bytes, delta, n / CAST(seconds AS DOUBLE) AS rec_s, bytes / 1048576.0 / CAST(seconds AS DOUBLE) AS mib_s FROM (SELECT * FROM g UNION ALL SELECT * FROM a)", "records").replace("bytes / 1048576.0 /", "CAST(bytes AS DOUBLE) / CAST(1048576 AS DOUBLE) /"))
def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Records and bytes for each hour with their rates and the change from the hour before, and those of the whole (hour null)."""
    r = records(spark, d)
    g = r.groupBy(F.expr("ts_ms div 3600000").alias("hour")).agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))
    g = g.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("hour"))).withColumn("seconds", F.lit(3600).cast("long"))  # a row for each hour
    none = F.lit(None).cast("long")
    a = r.agg(F.count("*").alias("n"), F.sum("len").alias("bytes"), F.greatest(F.expr("(max(ts_ms) - min(ts_ms)) div 1000"), F.lit(1)).alias("seconds")).select(none.alias("hour"), "n", "bytes", none.alias("delta"), "seconds")
    seconds = F.col("seconds").cast("double")
    return g.unionByName(a).select("hour", "n", "bytes", "delta", (F.col("n") / seconds).alias("rec_s"), (F.col("bytes").cast("double") / F.lit(1048576.0) / seconds).alias("mib_s"))


BUCKETS = (1, 10, 50, 100, 200, 500)
OPERATION = "CASE WHEN event_type IN ('click', 'view') THEN 'read' ELSE 'write' END"


@query("op_metrics", f"WITH e AS (SELECT {OPERATION} AS op_type, event_type AS op_name, CASE user_id % 3 WHEN 0 THEN 'queue' WHEN 1 THEN 'run' ELSE 'total' END AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value FROM events), b AS (SELECT unnest([{', '.join(map(str, BUCKETS))}]) AS le) SELECT op_type, op_name, stage, status, le, count(*) FILTER (value <= le) AS n FROM e, b GROUP BY ALL")
def op_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Latency histograms by type, name, stage and status of operations: how many took at most each bound."""
    i = F.col("user_id") % 3
    e = read(spark, d, "events").groupBy(F.expr(OPERATION).alias("op_type"), F.col("event_type").alias("op_name"), F.when(i == 0, "queue").when(i == 1, "run").otherwise("total").alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    g = e.agg(F.array(*[F.struct(F.lit(b).alias("le"), F.count_if(F.col("value") <= b).alias("n")) for b in BUCKETS]).alias("h"))
    return g.select("op_type", "op_name", "stage", "status", F.inline("h"))


MERGE = "+ o AS (SELECT *, CASE WHEN lag(end_off) OVER (PARTITION BY stream_id ORDER BY start_off) = start_off THEN 0 ELSE 1 END AS cut FROM objects WHERE object_id % 4 <> 2), g AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id ORDER BY start_off) AS island FROM o), m AS (SELECT stream_id, min(start_off) AS start_off, max(end_off) AS end_off, CAST(sum(size) AS BIGINT) AS size FROM g GROUP BY stream_id, island), u AS (SELECT o.stream_id, count(*) AS n FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off > s.start_off AND NOT EXISTS (SELECT 1 FROM m WHERE m.stream_id = o.stream_id AND m.start_off <= o.start_off AND m.end_off >= o.end_off) GROUP BY 1)"


@query("range_merge", sql(MERGE + " SELECT m.*, coalesce(n, 0) AS uncovered FROM m LEFT JOIN u USING (stream_id)", "objects", "streams"))
def range_merge(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous output ranges of each stream made one, and how many of its living source blocks no range covers: any of them fails the round. Some outputs are missing."""
    w = Window.partitionBy("stream_id").orderBy("start_off")
    all_ = objects(spark, d)
    o = all_.where("object_id % 4 <> 2").withColumn("cut", F.when(F.lag("end_off").over(w) == F.col("start_off"), 0).otherwise(1))
    g = o.withColumn("island", F.sum("cut").over(w))
    m = g.groupBy("stream_id", "island").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.sum("size").alias("size")).drop("island")
    alive = all_.join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off > s")
    a, b = alive.alias("a"), m.alias("b")
    bare = a.join(b, (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("b.start_off") <= F.col("a.start_off")) & (F.col("b.end_off") >= F.col("a.end_off")), "left_anti")
    n = bare.groupBy("stream_id").agg(F.count("*").alias("uncovered"))
    return m.join(n, "stream_id", "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))


@query("contiguity_check", sql("SELECT stream_id, start_off FROM (SELECT *, lag(end_off) OVER (PARTITION BY stream_id ORDER BY start_off) AS p FROM objects WHERE object_id % 4 <> 2) WHERE p <> start_off", "objects"))
def contiguity_check(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that do not begin where the one before ends."""
    w = Window.partitionBy("stream_id").orderBy("start_off")
    return objects(spark, d).where("object_id % 4 <> 2").withColumn("p", F.lag("end_off").over(w)).where("p <> start_off").select("stream_id", "start_off")


@query("sort_blocks", sql("SELECT stream_id, start_off, object_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_off, object_id) AS pos FROM objects", "objects"))
def sort_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in the order of stream and start."""
    w = Window.partitionBy("stream_id").orderBy("start_off", "object_id")
    return objects(spark, d).select("stream_id", "start_off", "object_id", F.row_number().over(w).cast("long").alias("pos")).orderBy("stream_id", "start_off")


@query("newest_first_cap", sql("SELECT object_id, data_ts_ms, (SELECT count(DISTINCT event_id // 5) > 500 FROM records) AS remaining FROM (SELECT event_id // 5 AS object_id, max(ts_ms) AS data_ts_ms FROM records GROUP BY 1 ORDER BY data_ts_ms DESC, object_id LIMIT 500)", "records"))
def newest_first_cap(spark: SparkSession, d: str, most: int = 500) -> DataFrame:
    """The newest objects, of five records each here, and whether there are more: one more row tells."""
    o = records(spark, d).groupBy(F.expr("event_id div 5").alias("object_id")).agg(F.max("ts_ms").alias("data_ts_ms"))
    top = o.orderBy(F.desc("data_ts_ms"), "object_id").limit(most + 1)  # the cap is the feature
    w = Window.partitionBy(F.lit(0))
    return top.withColumn("k", F.row_number().over(w.orderBy(F.desc("data_ts_ms"), "object_id"))).withColumn("remaining", F.count("*").over(w) > most).where(F.col("k") <= most).drop("k")


@query("peek_destroyed", sql("SELECT user_id AS object_id, min(event_id) AS place FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY place LIMIT 25"))
def peek_destroyed(spark: SparkSession, d: str, most: int = 25) -> DataFrame:
    """The head of a queue in which a second marking keeps the first place."""
    return read(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("object_id")).agg(F.min("event_id").alias("place")).orderBy("place").limit(most)


@query("fetch_after", sql("SELECT event_id AS idx, props AS payload FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100"))
def fetch_after(spark: SparkSession, d: str, after: int = 500, limit: int = 100) -> DataFrame:
    """A bounded page of the log behind an index."""
    return read(spark, d, "events").where(F.col("event_id") > after).select(F.col("event_id").alias("idx"), F.col("props").alias("payload")).orderBy("idx").limit(limit)


@query("last_idx", sql("SELECT greatest(coalesce(max(event_id), 0), 777) AS idx FROM events"))
def last_idx(spark: SparkSession, d: str) -> DataFrame:
    """The greatest index of the log or of the snapshot, 777 here."""
    return read(spark, d, "events").agg(F.greatest(F.coalesce(F.max("event_id"), F.lit(0)), F.lit(777)).cast("long").alias("idx"))


@query("expire_prepared", sql("SELECT count(*) AS expired FROM events WHERE event_id * 7 % 1000 <= 300"))
def expire_prepared(spark: SparkSession, d: str) -> DataFrame:
    """How many prepared objects are past their deadline."""
    return read(spark, d, "events").where("event_id * 7 % 1000 <= 300").agg(F.count("*").alias("expired"))


@query("dedup_objects", sql("SELECT object_id, min(stream_id) AS stream_id FROM objects GROUP BY object_id", "objects"))
def dedup_objects(spark: SparkSession, d: str) -> DataFrame:
    """The first occurrence of each object."""
    return objects(spark, d).groupBy("object_id").agg(F.min("stream_id").alias("stream_id"))


LIVENESS = "SELECT user_id AS node_id, arg_max(event_type, event_id) <> 'error' AS serving, bool_or(event_type = 'signup' AND event_id % 3 <> 0) AS registered FROM events GROUP BY 1"


def liveness(spark: SparkSession, d: str) -> DataFrame:
    """Every user as a node: serving, unless the last that was heard of it is an error, and registered, if it ever gave an address."""
    given = (F.col("event_type") == "signup") & (F.col("event_id") % 3 != 0)
    return read(spark, d, "events").groupBy(F.col("user_id").alias("node_id")).agg((F.max_by("event_type", "event_id") != "error").alias("serving"), F.bool_or(given).alias("registered"))


@query("health", f"SELECT node_id, 200 AS status, 'ok' AS body FROM ({LIVENESS})")
def health(spark: SparkSession, d: str) -> DataFrame:
    """A process that answers is healthy, whether or not it is ready."""
    return liveness(spark, d).select("node_id", F.lit(200).alias("status"), F.lit("ok").alias("body"))


@query("ready", f"SELECT node_id, serving, registered, serving AND registered AS ready, CASE WHEN serving AND registered THEN 200 ELSE 503 END AS status FROM ({LIVENESS})")
def ready(spark: SparkSession, d: str) -> DataFrame:
    """Ready is what serves and is registered."""
    both = F.col("serving") & F.col("registered")
    return liveness(spark, d).select("node_id", "serving", "registered", both.alias("ready"), F.when(both, 200).otherwise(503).alias("status"))


WEIGHTS = "r AS (SELECT user_id AS node_id, event_id, event_id % 3 = 0 AS registers, event_id * 31 % 997 AS epoch FROM events), a AS (SELECT *, max(CASE WHEN registers THEN epoch END) OVER (PARTITION BY node_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM r), b AS (SELECT *, CASE WHEN registers THEN CASE WHEN at IS NULL OR epoch >= at THEN 'registered' ELSE 'fenced' END WHEN at IS NULL THEN 'not_registered' WHEN event_id % 5 = 2 THEN 'epoch_mismatch' ELSE 'set' END AS result FROM a)"


@query("set_slots", f"WITH {WEIGHTS} SELECT node_id, event_id, result, coalesce(last_value(CASE WHEN result = 'set' THEN event_id % 9 END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY event_id), 1) AS slots FROM b".replace(" AS at ", " AS cur ").replace(" at ", " cur ").replace(">= at ", ">= cur "))
def set_slots(spark: SparkSession, d: str) -> DataFrame:
    """A node's weight changed at its current epoch, between its registrations: another epoch, and a node that isn't registered, change nothing."""
    order = Window.partitionBy("node_id").orderBy("event_id")
    e = F.col("event_id")
    r = read(spark, d, "events").select(F.col("user_id").alias("node_id"), "event_id", (e % 3 == 0).alias("registers"), (e * 31 % 997).alias("epoch"))
    r = r.withColumn("cur", F.max(F.when(F.col("registers"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    registration = F.when(F.col("cur").isNull() | (F.col("epoch") >= F.col("cur")), "registered").otherwise("fenced")
    result = F.when(F.col("registers"), registration).when(F.col("cur").isNull(), "not_registered").when(e % 5 == 2, "epoch_mismatch").otherwise("set")
    r = r.withColumn("result", result)
    slots = F.last(F.when(F.col("result") == "set", e % 9), ignorenulls=True).over(order)
    return r.select("node_id", "event_id", "result", F.coalesce(slots, F.lit(1)).alias("slots"))


@query("retry_delay", sql("SELECT event_id, CASE WHEN event_id % 8 < 6 THEN least(100 * CAST(pow(2, event_id % 8) AS BIGINT), 2000) END AS ms FROM events"))
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    """Doubled for each attempt up to a cap; none after the last."""
    n = F.col("event_id") % 8
    return read(spark, d, "events").select("event_id", F.when(n < 6, F.least(F.lit(100) * F.pow(F.lit(2.0), n).cast("long"), F.lit(2000).cast("long"))).alias("ms"))


# What errors of the object store end an operation; all others are tried again.
ABORT = ("not_found", "invalid_format", "ordering_violation", "codec", "timeout", "not_modified", "invalid_path", "already_exists", "precondition", "not_supported", "not_implemented", "permission_denied", "unauthenticated", "unknown_configuration_key")
RETRY = ("io", "generic", "join_error")
KINDS = ABORT + RETRY
KIND_SQL = f"[{', '.join(repr(k) for k in KINDS)}]"


@query("retry_class", f"SELECT event_id, {KIND_SQL}[event_id % {len(KINDS)} + 1] AS kind, CASE WHEN event_id % {len(KINDS)} < {len(ABORT)} THEN 'abort' ELSE 'retry' END AS class FROM events")
def retry_class(spark: SparkSession, d: str) -> DataFrame:
    """What follows an error, by its kind."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    return read(spark, d, "events").select("event_id", kind.alias("kind"), F.when(kind.isin(*ABORT), "abort").otherwise("retry").alias("class"))


@query("upload_rate", sql("+ b AS (SELECT stream_id, off, event_id, len * 1000000 AS size, coalesce((ts_ms - lag(ts_ms) OVER (PARTITION BY stream_id ORDER BY off)) % 40000, 50) AS elapsed FROM records), r AS (SELECT *, event_id % 17 = 3 OR elapsed <= 100 AS unlimited, size * 1000 // least(elapsed, 20000) AS rate FROM (SELECT *, greatest(elapsed, 1) AS e FROM b) WHERE elapsed > 0 UNION ALL SELECT *, 1, true, 0 FROM b WHERE elapsed = 0) SELECT stream_id, off, unlimited, CASE WHEN NOT unlimited THEN max(CASE WHEN NOT unlimited THEN rate END) OVER (PARTITION BY stream_id ORDER BY off) END AS pace FROM r", "records").replace(" FROM (SELECT *, greatest(elapsed, 1) AS e FROM b) WHERE elapsed > 0 UNION ALL SELECT *, 1, true, 0 FROM b WHERE elapsed = 0)", " FROM (SELECT stream_id, off, event_id, size, greatest(elapsed, 1) AS elapsed FROM b))"))
def upload_rate(spark: SparkSession, d: str) -> DataFrame:
    """The pace of uploads: the greatest rate so far of a block's size over its age, at most 20 s; forced ones, and those of blocks no older than 100 ms, are unlimited and don't count."""
    order = Window.partitionBy("stream_id").orderBy("off")
    age = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(order)) % 40000, F.lit(50))
    b = records(spark, d).select("stream_id", "off", "event_id", (F.col("len") * 1000000).alias("size"), F.greatest(age, F.lit(1)).alias("elapsed"))
    b = b.withColumn("unlimited", (F.col("event_id") % 17 == 3) | (F.col("elapsed") <= 100)).withColumn("rate", F.expr("size * 1000 div least(elapsed, 20000)"))
    pace = F.max(F.when(~F.col("unlimited"), F.col("rate"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return b.select("stream_id", "off", "unlimited", F.when(~F.col("unlimited"), pace).alias("pace"))


@query("feature_level", "SELECT event_id, event_id % 4 AS level, CASE event_id % 4 WHEN 1 THEN 'V0' WHEN 2 THEN 'V1' END AS version FROM events")
def feature_level(spark: SparkSession, d: str) -> DataFrame:
    """The version that a feature level stands for; other levels stand for none."""
    level = F.col("event_id") % 4
    return read(spark, d, "events").select("event_id", level.alias("level"), F.when(level == 1, "V0").when(level == 2, "V1").alias("version"))
