"""Lookups that play the role of joins, and filters on the log's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import nodes, objects, read, records, sql, streams


def overlaps(df: DataFrame, start, end) -> DataFrame:
    """Half-open ranges that meet."""
    return df.where((F.col("end_off") > start) & (F.col("start_off") < end))


GET = "SELECT o.stream_id, object_id, o.start_off, o.end_off, row_number() OVER (PARTITION BY o.stream_id ORDER BY o.start_off, CASE WHEN kind = 'stream_set' THEN 0 ELSE 1 END, object_id) AS rn FROM objects o JOIN streams s ON o.stream_id = s.stream_id AND o.end_off > s.start_off + 5 AND o.start_off < s.start_off + 25"


def found(spark: SparkSession, d: str, kinds: tuple[str, ...], limit: int) -> DataFrame:
    """Each stream's objects of some kinds that overlap the asked range, up to a limit."""
    s = streams(spark, d).select("stream_id", (F.col("start_off") + 5).alias("a"), (F.col("start_off") + 25).alias("b"))
    o = objects(spark, d).where(F.col("kind").isin(*kinds)).join(s, "stream_id").where((F.col("end_off") > F.col("a")) & (F.col("start_off") < F.col("b")))
    order = Window.partitionBy("stream_id").orderBy("start_off", F.when(F.col("kind") == "stream_set", 0).otherwise(1), "object_id")
    return o.withColumn("rn", F.row_number().over(order).cast("long")).where(F.col("rn") <= limit).select("stream_id", "object_id", "start_off", "end_off", "rn")


@query("get_objects", sql(f"SELECT * FROM ({GET}) WHERE rn <= 3", "objects", "streams"))
def get_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that overlap each stream's asked range, by start, stream-set objects first: an equi-join on the stream with the range as residual."""
    return found(spark, d, ("stream_set", "stream"), 3)


@query("get_stream_objects", sql(f"SELECT * FROM ({GET} WHERE kind = 'stream') WHERE rn <= 2", "objects", "streams"))
def get_stream_objects(spark: SparkSession, d: str) -> DataFrame:
    """As ``get_objects``, of stream objects alone."""
    return found(spark, d, ("stream",), 2)


@query("index_find", sql("+ b AS (SELECT o.*, row_number() OVER w AS rn, CAST(sum(size) OVER w AS BIGINT) AS cum, first_value(size) OVER w AS head FROM objects o WHERE end_off > 12 WINDOW w AS (PARTITION BY stream_id ORDER BY start_off)) SELECT stream_id, object_id, start_off, size FROM b WHERE rn = 1 OR cum - head - size < 120", "objects"))
def index_find(spark: SparkSession, d: str, at: int = 12, budget: int = 120) -> DataFrame:
    """The block that holds an offset and those after it, until a byte budget in which the first block isn't charged."""
    w = Window.partitionBy("stream_id").orderBy("start_off")
    b = objects(spark, d).where(F.col("end_off") > at)
    b = b.withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum("size").over(w)).withColumn("head", F.first("size").over(w))
    return b.where((F.col("rn") == 1) | (F.col("cum") - F.col("head") - F.col("size") < budget)).select("stream_id", "object_id", "start_off", "size")


@query("asof_object", sql("SELECT r.stream_id, r.off, o.object_id FROM records r ASOF JOIN objects o ON r.stream_id = o.stream_id AND r.off >= o.start_off", "records", "objects"))
def asof_object(spark: SparkSession, d: str) -> DataFrame:
    """The range with the greatest start that isn't past the offset: both sides in one order, the last start carried on. No join, so no blow-up by range."""
    asks = records(spark, d).select("stream_id", "off", F.lit(None).cast("long").alias("object_id"), F.lit(1).alias("side"))
    starts = objects(spark, d).select("stream_id", F.col("start_off").alias("off"), "object_id", F.lit(0).alias("side"))
    w = Window.partitionBy("stream_id").orderBy("off", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = starts.unionByName(asks).withColumn("object_id", F.last("object_id", ignorenulls=True).over(w))
    return out.where("side = 1 AND object_id IS NOT NULL").select("stream_id", "off", "object_id")


@query("name_lookup", sql("SELECT n.name, s.stream_id FROM (SELECT name FROM streams UNION ALL SELECT name || '/none' FROM streams) n LEFT JOIN streams s USING (name)", "streams"))
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stream of every name; unknown names have none."""
    s = streams(spark, d).select("name", "stream_id")
    return s.select("name").union(s.select(F.concat("name", F.lit("/none")))).join(s, "name", "left")


@query("reverse_lookup", sql("SELECT r.stream_id, r.off, name FROM records r JOIN streams USING (stream_id)", "records", "streams"))
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The name of every record's stream."""
    return records(spark, d).select("stream_id", "off").join(streams(spark, d).select("stream_id", "name"), "stream_id")


@query("get_streams", sql("SELECT event_id AS pos, stream_id, name FROM (SELECT event_id, user_id + event_id % 3 * 1000000 AS asked FROM events WHERE event_id % 3 < 2) JOIN streams ON stream_id = asked", "streams").replace(" WHERE event_id % 3 < 2", ""))
def get_streams(spark: SparkSession, d: str) -> DataFrame:
    """Many streams in the order of the asking list, one for each event; missing ones, two of three, are skipped."""
    asked = read(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") + F.col("event_id") % 3 * 1000000).alias("stream_id"))
    return asked.join(streams(spark, d).select("stream_id", "name"), "stream_id").select("pos", "stream_id", "name")


@query("opening_streams", sql("SELECT node_id, stream_id, epoch FROM streams WHERE NOT closed", "streams"))
def opening_streams(spark: SparkSession, d: str, node: int | None = None) -> DataFrame:
    """The streams that are open on each node, or on one."""
    s = streams(spark, d).where(~F.col("closed"))
    return (s if node is None else s.where(F.col("node_id") == node)).select("node_id", "stream_id", "epoch")


@query("server_objects", sql("SELECT DISTINCT object_id % 4 AS node_id, object_id FROM objects WHERE kind = 'stream_set'", "objects"))
def server_objects(spark: SparkSession, d: str, node: int | None = None) -> DataFrame:
    """The set objects that each node, or one, committed."""
    o = objects(spark, d).where("kind = 'stream_set'").select((F.col("object_id") % 4).alias("node_id"), "object_id").distinct()
    return o if node is None else o.where(F.col("node_id") == node)


LIVE = "live AS (SELECT DISTINCT object_id FROM objects WHERE object_id % 5 <> 2)"


def live(spark: SparkSession, d: str) -> DataFrame:
    """The objects that are committed."""
    return objects(spark, d).where("object_id % 5 <> 2").select("object_id").distinct()


@query("object_exists", sql(f"+ {LIVE}, k AS (SELECT object_id FROM live UNION SELECT DISTINCT event_id // 500 + 5 FROM events WHERE event_id % 7 = 3 AND event_id // 500 % 4 = 1) SELECT i AS object_id, i IN (SELECT object_id FROM k) AS there FROM (SELECT DISTINCT event_id // 250 AS i FROM events)", "objects"))
def object_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether objects are there, committed or prepared: asked for twice as many ids as there are."""
    e = read(spark, d, "events")
    prepared = e.where("event_id % 7 = 3 AND event_id div 500 % 4 = 1").select((F.expr("event_id div 500") + 5).alias("object_id"))
    known = live(spark, d).union(prepared).distinct().withColumn("there", F.lit(True))
    asked = e.select(F.expr("event_id div 250").alias("object_id")).distinct()
    return asked.join(known, "object_id", "left").select("object_id", F.coalesce("there", F.lit(False)).alias("there"))


@query("index_prune", sql(f"+ {LIVE} SELECT object_id, stream_id, start_off FROM objects WHERE object_id IN (SELECT object_id FROM live)", "objects"))
def index_prune(spark: SparkSession, d: str) -> DataFrame:
    """Index entries whose object lives."""
    return objects(spark, d).join(live(spark, d), "object_id", "left_semi").select("object_id", "stream_id", "start_off")


@query("redundant_commit", sql(f"+ {LIVE} SELECT o.object_id, count(*) AS n, bool_and(l.object_id IS NOT NULL) AS redundant FROM objects o LEFT JOIN live l ON l.object_id = o.object_id GROUP BY o.object_id", "objects"))
def redundant_commit(spark: SparkSession, d: str) -> DataFrame:
    """Whether all of a commit's objects are there already."""
    flagged = live(spark, d).withColumn("there", F.lit(True))
    return objects(spark, d).join(flagged, "object_id", "left").groupBy("object_id").agg(F.count("*").alias("n"), F.every(F.coalesce("there", F.lit(False))).alias("redundant"))


@query("node_address", sql("SELECT stream_id, nullif(http_address, '') AS address FROM streams LEFT JOIN nodes USING (node_id)", "streams", "nodes"))
def node_address(spark: SparkSession, d: str) -> DataFrame:
    """The address of each stream's node, if it has one."""
    s = streams(spark, d).join(F.broadcast(nodes(spark, d)), "node_id", "left")  # four rows
    return s.select("stream_id", F.nullif("http_address", F.lit("")).alias("address"))


OWNER = "SELECT stream_id, CASE WHEN stream_id % 17 = 3 THEN (node_id + 1) % 4 WHEN NOT closed AND http_address <> '' THEN node_id ELSE -1 END AS owner FROM streams JOIN nodes USING (node_id)"


@query("owner_of", sql(f"SELECT stream_id, CAST(owner AS INTEGER) AS owner FROM ({OWNER})", "streams", "nodes"))
def owner_of(spark: SparkSession, d: str) -> DataFrame:
    """Who serves a stream: a pending transfer's target, else the node that has it open and is known by address, else this node (-1)."""
    s = streams(spark, d).join(F.broadcast(nodes(spark, d)), "node_id")
    moving = F.col("stream_id") % 17 == 3
    owner = F.when(moving, (F.col("node_id") + 1) % 4).when(~F.col("closed") & (F.col("http_address") != ""), F.col("node_id")).otherwise(-1)
    return s.select("stream_id", owner.cast("int").alias("owner"))


ROUTED = f"q AS (SELECT o.stream_id, owner, name, CASE o.stream_id % 7 WHEN 1 THEN 'PUT' WHEN 4 THEN 'OPTIONS' ELSE 'GET' END AS method, CASE WHEN o.stream_id % 11 = 6 THEN '/' ELSE name END AS path, CASE o.stream_id % 3 WHEN 0 THEN 'seq=' || start_off WHEN 1 THEN '' END AS query, o.stream_id % 29 = 12 AS broken, nullif(http_address, '') AS address FROM ({OWNER}) o JOIN streams s USING (stream_id) LEFT JOIN nodes n ON n.node_id = owner)"


@query("route", sql(f"+ {ROUTED}, r AS (SELECT *, CASE WHEN path = '/' OR method IN ('PUT', 'OPTIONS') THEN 200 WHEN broken THEN 503 WHEN owner < 0 OR address IS NULL THEN 200 ELSE 307 END AS status FROM q) SELECT stream_id, method, status, CASE WHEN status = 307 THEN address || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS location FROM r", "streams", "nodes"))
def route(spark: SparkSession, d: str) -> DataFrame:
    """Where requests go: creations, options and the root are served here, as is what no other node is known to have; others are redirected with their path and query, and an owner that can't be found is a 503."""
    i = F.col("stream_id")
    s = streams(spark, d).join(owner_of(spark, d), "stream_id").join(F.broadcast(nodes(spark, d).select(F.col("node_id").alias("owner"), "http_address")), "owner", "left")  # four rows
    q = s.select("stream_id", "owner", F.when(i % 7 == 1, "PUT").when(i % 7 == 4, "OPTIONS").otherwise("GET").alias("method"), F.when(i % 11 == 6, "/").otherwise(F.col("name")).alias("path"), F.when(i % 3 == 0, F.concat(F.lit("seq="), F.col("start_off").cast("string"))).when(i % 3 == 1, "").alias("query"), (i % 29 == 12).alias("broken"), F.nullif("http_address", F.lit("")).alias("address"))
    here = (F.col("path") == "/") | F.col("method").isin("PUT", "OPTIONS")
    status = F.when(here, 200).when(F.col("broken"), 503).when((F.col("owner") < 0) | F.col("address").isNull(), 200).otherwise(307)
    location = F.concat("address", "path", F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""))
    return q.withColumn("status", status).select("stream_id", "method", "status", F.when(F.col("status") == 307, location).alias("location"))


@query("overlap_predicate", sql("SELECT object_id, stream_id FROM objects WHERE end_off > 7 AND start_off < 9", "objects"))
def overlap_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Objects that meet the offsets [7, 9)."""
    return overlaps(objects(spark, d), 7, 9).select("object_id", "stream_id")


@query("kv_prefix", sql("SELECT name AS key, end_off AS value FROM streams WHERE name LIKE '/users/2%'", "streams"))
def kv_prefix(spark: SparkSession, d: str, prefix: str = "/users/2") -> DataFrame:
    """Keys with a prefix, and their values."""
    return streams(spark, d).where(F.col("name").startswith(prefix)).select(F.col("name").alias("key"), F.col("end_off").alias("value"))


EXPIRY = "+ e AS (SELECT stream_id, CASE WHEN stream_id % 3 = 0 THEN 0 ELSE max(ts_ms) END AS deadline FROM records GROUP BY stream_id), n AS (SELECT CAST(avg(max_ts) AS BIGINT) AS now FROM (SELECT max(ts_ms) AS max_ts FROM records))"


@query("expired_filter", sql(EXPIRY + " SELECT stream_id FROM e WHERE NOT (deadline > 0 AND 1706400000000 > deadline)", "records"))
def expired_filter(spark: SparkSession, d: str, now: int = 1706400000000) -> DataFrame:
    """Streams whose deadline, if they have one, isn't past."""
    e = records(spark, d).groupBy("stream_id").agg(F.max("ts_ms").alias("m")).withColumn("deadline", F.when(F.col("stream_id") % 3 == 0, 0).otherwise(F.col("m")))
    return e.where(~((F.col("deadline") > 0) & (F.lit(now) > F.col("deadline")))).select("stream_id")


@query("expire_stream", sql(EXPIRY + ", x AS (SELECT stream_id FROM e WHERE deadline > 0 AND 1706400000000 > deadline), a AS (SELECT stream_id, max(off) + 1 AS waits FROM records WHERE event_id % 3 = 1 GROUP BY 1) SELECT s.stream_id, s.name AS key_removed, (SELECT count(*) FROM objects o WHERE o.stream_id = s.stream_id AND kind = 'stream') AS destroyed, a.waits IS NOT NULL AS touched, coalesce(a.waits, 0) = s.end_off AS woken FROM x JOIN streams s USING (stream_id) LEFT JOIN a USING (stream_id)", "records", "streams", "objects"))
def expire_stream(spark: SparkSession, d: str) -> DataFrame:
    """What happens to streams past their deadline when they are next touched: their entry is removed, their stream objects are destroyed, and readers that wait at their tails wake."""
    gone = streams(spark, d).select("stream_id", "name", "end_off").join(expired_filter(spark, d), "stream_id", "left_anti")
    o = objects(spark, d).where("kind = 'stream'").groupBy("stream_id").agg(F.count("*").alias("destroyed"))
    a = records(spark, d).where("event_id % 3 = 1").groupBy("stream_id").agg((F.max("off") + 1).alias("waits"))
    r = gone.join(o, "stream_id", "left").join(a, "stream_id", "left")
    return r.select("stream_id", F.col("name").alias("key_removed"), F.coalesce("destroyed", F.lit(0)).alias("destroyed"), F.col("waits").isNotNull().alias("touched"), (F.coalesce("waits", F.lit(0)) == F.col("end_off")).alias("woken"))


@query("trim_filter", sql("SELECT o.object_id, o.stream_id FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off > s.start_off", "objects", "streams"))
def trim_filter(spark: SparkSession, d: str) -> DataFrame:
    """Blocks with records behind their stream's start; those of unknown streams are dead."""
    return objects(spark, d).join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where(F.col("end_off") > F.col("s")).select("object_id", "stream_id")


@query("object_filter", sql("+ o AS (SELECT object_id, CAST(sum(size) AS BIGINT) AS size, object_id % 4 = 0 AS composite FROM objects GROUP BY object_id) SELECT object_id, composite, NOT composite AS minor, composite OR size >= 9000 AS major_v1 FROM o", "objects"))
def object_filter(spark: SparkSession, d: str, least: int = 9000) -> DataFrame:
    """Which objects each level of compaction takes: composites wait for the major one, which leaves small plain ones alone."""
    o = objects(spark, d).groupBy("object_id").agg(F.sum("size").alias("size"))
    composite = F.col("object_id") % 4 == 0
    return o.select("object_id", composite.alias("composite"), (~composite).alias("minor"), (composite | (F.col("size") >= least)).alias("major_v1"))


WAIT = "+ w AS (SELECT p.stream_id, p.off, p.off + 2 AS wait_off, p.ts_ms, q.ts_ms AS came, closed, end_off FROM records p JOIN streams USING (stream_id) LEFT JOIN records q ON q.stream_id = p.stream_id AND q.off = p.off + 2), o AS (SELECT *, CASE WHEN came IS NULL AND closed THEN 'closed' WHEN came - ts_ms BETWEEN 0 AND 36000000 THEN 'data' ELSE 'timeout' END AS outcome FROM w)"


def waiting(spark: SparkSession, d: str, timeout_ms: int) -> DataFrame:
    """Readers that wait behind each record for the one that brings the next offset beyond theirs: an equi-join on that record."""
    r = records(spark, d).select("stream_id", "off", "ts_ms")
    p = r.withColumn("wait_off", F.col("off") + 2).join(streams(spark, d).select("stream_id", "closed"), "stream_id")
    w = p.join(r.select("stream_id", F.col("off").alias("wait_off"), F.col("ts_ms").alias("at")), ["stream_id", "wait_off"], "left")
    data = (F.col("at") - F.col("ts_ms")).between(0, timeout_ms)
    return w.withColumn("outcome", F.when(F.col("at").isNull() & F.col("closed"), "closed").when(data, "data").otherwise("timeout"))


@query("waiters", sql(WAIT + " SELECT stream_id, wait_off, outcome FROM o", "records", "streams"))
def waiters(spark: SparkSession, d: str, timeout_ms: int = 36_000_000) -> DataFrame:
    """Woken by data beyond the awaited offset or by the end of the stream, else by the time-out."""
    return waiting(spark, d, timeout_ms).select("stream_id", "wait_off", "outcome")


@query("long_poll", sql(WAIT + " SELECT stream_id, wait_off, CASE WHEN outcome = 'data' THEN 200 ELSE 204 END AS status, CASE WHEN outcome = 'data' THEN wait_off + 1 ELSE wait_off END AS next, outcome = 'closed' AS closed FROM o", "records", "streams"))
def long_poll(spark: SparkSession, d: str, timeout_ms: int = 36_000_000) -> DataFrame:
    """The answer to a reader at the tail: what came, or nothing with the same place to go on from."""
    data = F.col("outcome") == "data"
    return waiting(spark, d, timeout_ms).select("stream_id", "wait_off", F.when(data, 200).otherwise(204).alias("status"), F.when(data, F.col("wait_off") + 1).otherwise(F.col("wait_off")).alias("next"), (F.col("outcome") == "closed").alias("closed"))
