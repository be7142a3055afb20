"""Bounded reads, listings and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fold import fold
from ..registry import query
from ..sources.tables import objects, records, sql, streams

MAX_BYTES, MAX_RECORDS = 200, 10


def in_stream():
    return Window.partitionBy("stream_id").orderBy("off")


def page(df: DataFrame, max_bytes: int, max_records: int) -> DataFrame:
    """The byte and count budget, per stream: stop before a record that would pass the bytes unless it is the first with any, and after the budget is met; 0 is no limit."""
    cum = F.sum("len").over(in_stream().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("rn", F.row_number().over(in_stream())).withColumn("cum", cum).withColumn("prev", F.col("cum") - F.col("len"))
    keep = F.lit(True)
    if max_records:
        keep &= F.col("rn") <= max_records
    if max_bytes:
        keep &= (F.col("prev") < max_bytes) & ((F.col("prev") == 0) | (F.col("cum") <= max_bytes))
    return df.where(keep).drop("rn", "cum", "prev")


PAGE = "SELECT *, row_number() OVER w AS rn, CAST(sum(len) OVER w AS BIGINT) AS cum FROM {0} WINDOW w AS (PARTITION BY stream_id ORDER BY off)"
KEEP = f"rn <= {MAX_RECORDS} AND cum - len < {MAX_BYTES} AND (cum - len = 0 OR cum <= {MAX_BYTES})"


@query("read_range", sql(f"+ r AS (SELECT records.* FROM records JOIN streams USING (stream_id) WHERE off >= start_off + 5), p AS ({PAGE.format('r')}), q AS (SELECT * FROM p WHERE {KEEP}) SELECT stream_id, off, body, max(off) OVER (PARTITION BY stream_id) + 1 AS next_off, max(off) OVER (PARTITION BY stream_id) + 1 = end_off AS up_to_date, closed FROM q JOIN streams USING (stream_id)", "records", "streams"))
def read_range(spark: SparkSession, d: str) -> DataFrame:
    """Records of every stream from a start, within the budget, with where to go on."""
    s = streams(spark, d)
    r = records(spark, d).join(s.select("stream_id", "start_off", "end_off", "closed"), "stream_id").where(F.col("off") >= F.col("start_off") + 5)
    q = page(r, MAX_BYTES, MAX_RECORDS).withColumn("next_off", F.max("off").over(Window.partitionBy("stream_id")) + 1)
    return q.select("stream_id", "off", "body", "next_off", (F.col("next_off") == F.col("end_off")).alias("up_to_date"), "closed")


@query("read_page_budget", sql(f"+ p AS ({PAGE.format('records')}) SELECT stream_id, off, len FROM p WHERE {KEEP}", "records"))
def read_page_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every stream under the byte and record budget."""
    return page(records(spark, d), MAX_BYTES, MAX_RECORDS).select("stream_id", "off", "len")


def cache_appends(spark: SparkSession, d: str) -> DataFrame:
    """What reaches the tail caches: most appends in order, some missing, and some older ones again."""
    r = records(spark, d).where("event_id % 29 <> 7").select("stream_id", "event_id", "len", F.when(F.col("event_id") % 13 == 5, F.greatest(F.col("off") - 3, F.lit(0))).otherwise(F.col("off")).alias("off"))
    return r


def tail_window(appends: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """What each stream's tail cache holds: an append below the expected offset is ignored, one beyond it begins the window anew, and the oldest go while there are too many or, but for a last one, too many bytes."""
    order = Window.partitionBy("stream_id").orderBy("event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    expected = F.max(F.col("off") + 1).over(before)
    r = appends.withColumn("expected", expected).where("expected IS NULL OR off >= expected")
    r = r.withColumn("begun", F.sum(F.coalesce(F.col("off") > F.col("expected"), F.lit(False)).cast("int")).over(order))
    r = r.withColumn("last", F.max("begun").over(Window.partitionBy("stream_id"))).where("begun = last")
    newest = Window.partitionBy("stream_id").orderBy(F.desc("off"))
    r = r.withColumn("k", F.row_number().over(newest)).withColumn("bytes", F.sum("len").over(newest))
    return r.where((F.col("k") <= max_records) & ((F.col("bytes") <= max_bytes) | (F.col("k") == 1))).select("stream_id", "off", "len")


#: The budget of the queries: as the tail of a whole server, 4,096 records and 4 MiB, but small enough to bite.
TAIL_RECORDS, TAIL_BYTES = 16, 260
TAIL = f"a AS (SELECT stream_id, event_id, len, CASE WHEN event_id % 13 = 5 THEN greatest(off - 3, 0) ELSE off END AS off FROM records WHERE event_id % 29 <> 7), x AS (SELECT *, max(off + 1) OVER (PARTITION BY stream_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM a), y AS (SELECT *, sum(CASE WHEN off > expected THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY event_id) AS begun FROM x WHERE expected IS NULL OR off >= expected), z AS (SELECT *, row_number() OVER w AS k, sum(len) OVER w AS bytes FROM y WHERE begun = (SELECT max(begun) FROM y m WHERE m.stream_id = y.stream_id) WINDOW w AS (PARTITION BY stream_id ORDER BY off DESC)), t AS (SELECT stream_id, off, len FROM z WHERE k <= {TAIL_RECORDS} AND (bytes <= {TAIL_BYTES} OR k = 1))"


@query("tail_cache", sql(f"+ {TAIL} SELECT * FROM t", "records"))
def tail_cache(spark: SparkSession, d: str, max_records: int = TAIL_RECORDS, max_bytes: int = TAIL_BYTES) -> DataFrame:
    """The records that each stream's tail cache holds after all appends."""
    return tail_window(cache_appends(spark, d), max_records, max_bytes)


@query("tail_read", sql(f"+ {TAIL}, p AS ({PAGE.format('t')}) SELECT stream_id, off, len FROM p WHERE {KEEP}", "records"))
def tail_read(spark: SparkSession, d: str) -> DataFrame:
    """A bounded read over the tail caches."""
    return page(tail_cache(spark, d), MAX_BYTES, MAX_RECORDS)


FETCH = "s.start_off + 10 - CASE WHEN s.stream_id % 5 = 2 THEN 12 ELSE 0 END AS since, s.start_off + 20 + CASE WHEN s.stream_id % 7 = 3 THEN 100000 ELSE 0 END AS until"


@query("stream_fetch", sql(f"+ q AS (SELECT stream_id, s.start_off, least(end_off - 4, end_off) AS confirm, {FETCH} FROM streams s) SELECT q.stream_id, CASE WHEN since < q.start_off OR until > confirm THEN 'out_of_range' ELSE 'ok' END AS result, o.object_id, o.start_off, o.end_off FROM q LEFT JOIN objects o ON o.stream_id = q.stream_id AND o.end_off > since AND o.start_off < until AND NOT (since < q.start_off OR until > confirm)", "streams", "objects"))
def stream_fetch(spark: SparkSession, d: str) -> DataFrame:
    """A fetch of [since, until) of every stream: batches that overlap it, those that straddle it whole; a range that begins before the stream or ends beyond what is confirmed is refused."""
    s = streams(spark, d)
    q = s.select("stream_id", F.col("start_off").alias("low"), (F.col("end_off") - 4).alias("confirm"), (F.col("start_off") + 10 - F.when(F.col("stream_id") % 5 == 2, 12).otherwise(0)).alias("since"), (F.col("start_off") + 20 + F.when(F.col("stream_id") % 7 == 3, 100000).otherwise(0)).alias("until"))
    q = q.withColumn("fine", (F.col("since") >= F.col("low")) & (F.col("until") <= F.col("confirm")))
    o = objects(spark, d).select(F.col("stream_id").alias("sid"), "object_id", "start_off", "end_off")
    r = q.join(o, (F.col("stream_id") == F.col("sid")) & F.col("fine") & (F.col("end_off") > F.col("since")) & (F.col("start_off") < F.col("until")), "left")
    return r.select("stream_id", F.when(F.col("fine"), "ok").otherwise("out_of_range").alias("result"), "object_id", "start_off", "end_off")


@query("direct_read", sql("+ b AS (SELECT stream_id, object_id, start_off, end_off, size, CAST(sum(size) OVER (PARTITION BY object_id ORDER BY stream_id) - size AS BIGINT) AS pos FROM objects) SELECT b.stream_id, object_id, pos, size FROM b JOIN streams s USING (stream_id) WHERE b.start_off <= s.start_off + 10 AND b.end_off > s.start_off + 10", "objects", "streams"))
def direct_read(spark: SparkSession, d: str) -> DataFrame:
    """The place in its object of the block that holds the tenth record of every stream, read without a cache."""
    w = Window.partitionBy("object_id").orderBy("stream_id")
    b = objects(spark, d).withColumn("pos", F.sum("size").over(w) - F.col("size"))
    s = streams(spark, d).select("stream_id", (F.col("start_off") + 10).alias("at"))
    return b.join(s, "stream_id").where("start_off <= at AND end_off > at").select("stream_id", "object_id", "pos", "size")


STITCHED = "h AS (SELECT r.stream_id, off, start_off, end_off, 30 - r.stream_id % 3 AS cut FROM records r JOIN streams s USING (stream_id) WHERE off >= start_off AND NOT (off < 30 - r.stream_id % 3 AND event_id % 61 = 8)), v AS (SELECT *, off <> lag(off, 1, start_off - 1) OVER (PARTITION BY stream_id ORDER BY off) + 1 AS hole FROM h)"


@query("stitched_read", sql(f"+ {STITCHED} SELECT stream_id, off, CASE WHEN off < cut THEN 'cold' ELSE 'hot' END AS tier, bool_or(hole) OVER (PARTITION BY stream_id) AS broken FROM v", "records", "streams"))
def stitched_read(spark: SparkSession, d: str) -> DataFrame:
    """The block cache's head up to where the log cache begins, and its tail, one after another; then the check that every offset follows the one before, without which the stream's read is refused. Some blocks lack a record."""
    cut = 30 - F.col("stream_id") % 3
    r = records(spark, d).join(streams(spark, d).select("stream_id", "start_off"), "stream_id").where(F.col("off") >= F.col("start_off"))
    cold = r.where((F.col("off") < cut) & (F.col("event_id") % 61 != 8)).withColumn("tier", F.lit("cold"))
    both = cold.unionByName(r.where(F.col("off") >= cut).withColumn("tier", F.lit("hot")))
    w = Window.partitionBy("stream_id")
    hole = F.col("off") != F.coalesce(F.lag("off").over(w.orderBy("off")), F.col("start_off") - 1) + 1
    return both.withColumn("hole", hole).select("stream_id", "off", "tier", F.bool_or("hole").over(w).alias("broken"))


@query("fast_read", sql("SELECT s.stream_id, CASE WHEN s.start_off + since < cut THEN 'needs_cold' ELSE 'ok' END AS result, count(r.off) AS n FROM (SELECT *, 30 - stream_id % 3 AS cut, stream_id % 4 * 10 AS since FROM streams) s LEFT JOIN records r ON r.stream_id = s.stream_id AND r.off >= s.start_off + since AND s.start_off + since >= cut GROUP BY ALL", "records", "streams"))
def fast_read(spark: SparkSession, d: str) -> DataFrame:
    """Reads that answer from the log cache or fail, rather than touch the cold tier."""
    since, cut = F.col("start_off") + F.col("stream_id") % 4 * 10, 30 - F.col("stream_id") % 3
    s = streams(spark, d).select("stream_id", since.alias("since"), (since >= cut).alias("fine"))
    r = records(spark, d).select(F.col("stream_id").alias("sid"), "off")
    g = s.join(r, (F.col("stream_id") == F.col("sid")) & F.col("fine") & (F.col("off") >= F.col("since")), "left").groupBy("stream_id", "fine").agg(F.count("off").alias("n"))
    return g.select("stream_id", F.when(F.col("fine"), "ok").otherwise("needs_cold").alias("result"), "n")


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """Records of which some are missing."""
    return records(spark, d).where(F.col("event_id") % 11 != 4)


def islands(df: DataFrame) -> DataFrame:
    """Each record with the first and last offset of its contiguous run, and those of the run at the end of its stream."""
    run = df.withColumn("k", F.col("off") - F.row_number().over(in_stream()))
    w = Window.partitionBy("stream_id", "k")
    return run.withColumn("low", F.min("off").over(w)).withColumn("high", F.max("off").over(w) + 1).withColumn("tail", F.max("low").over(Window.partitionBy("stream_id")))


ISLAND = "g AS (SELECT * FROM records WHERE event_id % 11 <> 4), i AS (SELECT *, off - row_number() OVER (PARTITION BY stream_id ORDER BY off) AS k FROM g), l AS (SELECT *, min(off) OVER (PARTITION BY stream_id, k) AS low, max(off) OVER (PARTITION BY stream_id, k) + 1 AS high FROM i), t AS (SELECT stream_id, max(low) AS tail FROM l GROUP BY 1)"
ASKED = "q AS (SELECT r.stream_id, r.off AS since, r.off + 1 + r.event_id % 40 AS until FROM records r)"


@query("log_cache_get", sql(f"+ {ISLAND}, {ASKED}, f AS (SELECT q.*, tail, high, (SELECT max(high) FROM l m WHERE m.stream_id = q.stream_id) AS last FROM q JOIN t USING (stream_id) LEFT JOIN l ON l.stream_id = q.stream_id AND l.off = q.since) SELECT stream_id, since, until, CASE WHEN high >= until THEN 'hit' WHEN tail < until AND tail > since AND last >= until THEN 'tail' WHEN tail < until AND tail > since THEN 'short_tail' ELSE 'miss' END AS kind, CASE WHEN high >= until THEN until - since WHEN tail < until AND tail > since THEN least(until, last) - tail ELSE 0 END AS n FROM f", "records"))
def log_cache_get(spark: SparkSession, d: str) -> DataFrame:
    """Ranges asked of a cache with gaps: all of it, if it lies in one run; else what the run at the end has of the range's right part; nothing, if only the left part or none is there."""
    r = islands(gappy(spark, d))
    runs = r.select("stream_id", "off", "high")
    ends = r.groupBy("stream_id").agg(F.max("low").alias("tail"), F.max("high").alias("last"))
    q = records(spark, d).select("stream_id", F.col("off").alias("since"), (F.col("off") + 1 + F.col("event_id") % 40).alias("until"))
    f = q.join(ends, "stream_id").join(runs.withColumnRenamed("off", "since"), ["stream_id", "since"], "left")
    right = (F.col("tail") < F.col("until")) & (F.col("tail") > F.col("since"))
    kind = F.when(F.col("high") >= F.col("until"), "hit").when(right & (F.col("last") >= F.col("until")), "tail").when(right, "short_tail").otherwise("miss")
    n = F.when(F.col("high") >= F.col("until"), F.col("until") - F.col("since")).when(right, F.least("until", "last") - F.col("tail")).otherwise(0)
    return f.select("stream_id", "since", "until", kind.alias("kind"), n.cast("long").alias("n"))


@query("snapshot_read", sql(f"+ {ISLAND} SELECT l.stream_id, off, body FROM l JOIN t USING (stream_id) WHERE low = tail", "records"))
def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """What is in memory of each stream: the records of its last contiguous run."""
    return islands(gappy(spark, d)).where("low = tail").select("stream_id", "off", "body")


@query("batch_search", sql("+ q AS (SELECT stream_id, off FROM records WHERE event_id % 2 = 0) SELECT q.stream_id, q.off, o.object_id FROM q LEFT JOIN objects o ON o.stream_id = q.stream_id AND o.start_off = q.off", "records", "objects"))
def batch_search(spark: SparkSession, d: str) -> DataFrame:
    """The batch that begins at an offset, for every other record; an offset inside a batch is a miss."""
    o = objects(spark, d).select("stream_id", F.col("start_off").alias("off"), "object_id")
    return records(spark, d).where("event_id % 2 = 0").select("stream_id", "off").join(o, ["stream_id", "off"], "left")


BLOCK_READS = "a AS (SELECT stream_id, off // 4 AS k, min(off) AS since, max(off) + 1 AS until, min(event_id % 9) AS seek FROM records GROUP BY ALL), n AS (SELECT *, since + CASE WHEN seek = 0 THEN 1 ELSE 0 END AS ask, lag(until, 1, 0) OVER (PARTITION BY stream_id ORDER BY k) AS expected FROM a)"


@query("block_cache_read", sql(f"+ {BLOCK_READS} SELECT n.stream_id, k, ask, ask = expected AS sequential, string_agg(r.body, '' ORDER BY r.off) AS body FROM n LEFT JOIN records r ON r.stream_id = n.stream_id AND r.off >= ask AND r.off < until AND ask = expected GROUP BY ALL", "records"))
def block_cache_read(spark: SparkSession, d: str) -> DataFrame:
    """A reader's reads of four records one after another: each must begin where the one before ended, and one that seeks elsewhere is refused."""
    r = records(spark, d)
    a = r.groupBy("stream_id", F.expr("off div 4").alias("k")).agg(F.min("off").alias("since"), (F.max("off") + 1).alias("until"), F.min(F.col("event_id") % 9).alias("seek"))
    a = a.withColumn("ask", F.col("since") + F.when(F.col("seek") == 0, 1).otherwise(0)).withColumn("expected", F.lag("until", 1, 0).over(Window.partitionBy("stream_id").orderBy("k")))
    a = a.withColumn("sequential", F.col("ask") == F.col("expected"))
    rows = r.select("stream_id", F.expr("off div 4").alias("k"), "off", "body")
    g = a.join(rows, ["stream_id", "k"]).groupBy("stream_id", "k", "ask", "sequential").agg(F.array_sort(F.collect_list(F.when(F.col("off") >= F.col("ask"), F.struct("off", "body")))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x["body"]), "")
    return g.select("stream_id", "k", "ask", "sequential", F.when(F.col("sequential") & (F.size("b") > 0), body).alias("body"))


@query("object_scan", sql("+ b AS (SELECT object_id, stream_id, start_off, end_off, size, CAST(sum(size) OVER (PARTITION BY object_id ORDER BY stream_id) - size AS BIGINT) AS pos FROM objects), f AS (SELECT object_id, CAST(sum(size) AS BIGINT) AS index_pos, 36 * count(*) AS index_size FROM objects GROUP BY 1) SELECT b.object_id, b.stream_id, r.off, b.pos, f.index_pos, f.index_size, r.body FROM b JOIN f USING (object_id) JOIN records r ON r.stream_id = b.stream_id AND r.off >= b.start_off AND r.off < b.end_off", "records", "objects"))
def object_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whole objects read: the footer gives the place and size of the index, its entries of 36 bytes the streams' blocks, and these the records."""
    o = objects(spark, d)
    b = o.withColumn("pos", F.sum("size").over(Window.partitionBy("object_id").orderBy("stream_id")) - F.col("size"))
    footer = o.groupBy("object_id").agg(F.sum("size").alias("index_pos"), (F.count("*") * 36).alias("index_size"))
    r = records(spark, d).select(F.col("stream_id").alias("sid"), "off", "body")
    at = (F.col("stream_id") == F.col("sid")) & (F.col("off") >= F.col("start_off")) & (F.col("off") < F.col("end_off"))
    return b.join(footer, "object_id").join(r, at).select("object_id", "stream_id", "off", "pos", "index_pos", "index_size", "body")


@query("composite_scan", sql("SELECT object_id // 4 AS composite_id, object_id, stream_id, start_off, end_off FROM objects WHERE object_id // 4 = 1 AND kind = 'stream'", "objects"))
def composite_scan(spark: SparkSession, d: str) -> DataFrame:
    """Blocks through a composite object's list of components."""
    o = objects(spark, d)
    parts = o.select(F.expr("object_id div 4").alias("composite_id"), "object_id").distinct().where("composite_id = 1")
    return parts.join(o.where("kind = 'stream'"), "object_id").select("composite_id", "object_id", "stream_id", "start_off", "end_off")


@query("wal_get_range", sql("SELECT object_id AS epoch, start_off, stream_id FROM objects WHERE (object_id > 2 OR object_id = 2 AND start_off >= 5) AND (object_id < 4 OR object_id = 4 AND start_off < 9)", "objects"))
def wal_get_range(spark: SparkSession, d: str) -> DataFrame:
    """Records between two positions, which compare by epoch and then offset."""
    at = F.struct(F.col("object_id"), F.col("start_off"))
    low, high = (F.struct(F.lit(a).cast("long").alias("object_id"), F.lit(b).cast("long").alias("start_off")) for a, b in ((2, 5), (4, 9)))
    return objects(spark, d).where((at >= low) & (at < high)).select(F.col("object_id").alias("epoch"), "start_off", "stream_id")


def wal_keys(spark: SparkSession, d: str) -> DataFrame:
    """A listing: keys of the second form, which name a log object's range, of the first, which name its start alone, and foreign ones; with the objects' sizes."""
    s = streams(spark, d)
    n, text = F.col("node_id").cast("string"), lambda c: F.col(c).cast("string")
    front = F.concat(F.upper(F.md5(n.cast("binary"))), F.lit("/_kafka_c/"), n, F.lit("/"), text("epoch"), F.lit("/wal/"), text("start_off"))
    kind = F.col("stream_id") % 6
    key = F.when(kind == 0, front).when(kind == 1, F.concat(F.lit("tmp/"), text("stream_id"))).when(kind == 2, F.concat(front, F.lit("-x"))).when(kind == 3, F.concat(F.lit("a/b/c/"), text("stream_id"))).otherwise(F.concat(front, F.lit("-"), text("end_off")))
    return s.select("stream_id", key.alias("key"), (F.col("end_off") * 10 + 60).alias("size"))


def wal_objects(keys: DataFrame) -> DataFrame:
    """epoch, start_off, end_off and key of a listing's log objects; foreign keys are skipped. The end of the first form follows from the size, less the object's header."""
    parts = F.split("key", "/")
    k = keys.where(F.size(parts) >= 3).select("key", "size", F.try_element_at(parts, F.size(parts) - 2).alias("e"), F.split(F.element_at(parts, -1), "-", 2).alias("o"))
    digits = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))
    start = digits(F.col("o")[0])
    end = F.when(F.size("o") == 2, digits(F.try_element_at("o", F.lit(2)))).otherwise(start + F.col("size") - OBJECT_HEADER)
    return k.select(digits(F.col("e")).alias("epoch"), start.alias("start_off"), end.alias("end_off"), "key").dropna()


#: Bytes of a log object's header in its first form.
OBJECT_HEADER = 40
KEYS_SQL = "k AS (SELECT stream_id, epoch, start_off, end_off, end_off * 10 + 60 AS size, upper(md5(CAST(node_id AS VARCHAR))) || '/_kafka_c/' || node_id || '/' || epoch || '/wal/' || start_off AS front FROM streams)"


@query("wal_discover", sql(f"+ {KEYS_SQL} SELECT epoch, start_off, CASE WHEN stream_id % 6 = 0 THEN start_off + size - {OBJECT_HEADER} ELSE end_off END AS end_off, CASE WHEN stream_id % 6 = 0 THEN front ELSE front || '-' || end_off END AS key FROM k WHERE stream_id % 6 IN (0, 4, 5)", "streams"))
def wal_discover(spark: SparkSession, d: str) -> DataFrame:
    """The log objects of a listing."""
    return wal_objects(wal_keys(spark, d))


@query("head", sql("SELECT name, stream_id, start_off, end_off, closed, CASE WHEN stream_id % 2 = 0 THEN 'application/json' ELSE 'text/plain' END AS content_type FROM streams", "streams"))
def head(spark: SparkSession, d: str) -> DataFrame:
    """What a head request tells of every stream."""
    return streams(spark, d).select("name", "stream_id", "start_off", "end_off", "closed", F.when(F.col("stream_id") % 2 == 0, "application/json").otherwise("text/plain").alias("content_type"))


@query("list_streams", sql("+ l AS (SELECT name, end_off, row_number() OVER (ORDER BY name) AS k FROM streams WHERE name LIKE '/users/1%' AND name > '/users/10' AND stream_id % 6 <> 2) SELECT name, end_off, (SELECT count(*) > 20 FROM l) AS has_more FROM l WHERE k <= 20", "streams"))
def list_streams(spark: SparkSession, d: str, prefix: str = "/users/1", after: str = "/users/10", limit: int = 20) -> DataFrame:
    """A page of names by prefix after a name, without expired streams; one more row tells whether there are more."""
    s = streams(spark, d).where(F.col("name").startswith(prefix) & (F.col("name") > after) & (F.col("stream_id") % 6 != 2))
    top = s.select("name", "end_off").orderBy("name").limit(limit + 1)  # a page is the feature
    more = Window.partitionBy(F.lit(0))
    return top.withColumn("k", F.row_number().over(more.orderBy("name"))).withColumn("has_more", F.count("*").over(more) > limit).where(F.col("k") <= limit).drop("k")


@query("stdin_records", sql("SELECT event_id // 64 AS batch, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1"))
def stdin_records(spark: SparkSession, d: str, size: int = 64) -> DataFrame:
    """Lines put into batches of a fixed number."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.expr(f"event_id div {size}").alias("batch")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props").cast("long")).alias("bytes"))


def paged(state: tuple[int, int, int], row: dict) -> tuple[tuple[int, int, int], dict]:
    number, size, count = state
    if count and (count >= MAX_RECORDS or size >= MAX_BYTES or (size > 0 and size + row["len"] > MAX_BYTES)):
        number, size, count = number + 1, 0, 0
    return (number, size + row["len"], count + 1), {"stream_id": row["stream_id"], "off": row["off"], "page": number}


PAGES = sql(f"+ p AS (SELECT stream_id, off, len AS size, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS page FROM records WHERE off = 0 UNION ALL SELECT r.stream_id, r.off, CASE WHEN n >= {MAX_RECORDS} OR size >= {MAX_BYTES} OR (size > 0 AND size + len > {MAX_BYTES}) THEN len ELSE size + len END, CASE WHEN n >= {MAX_RECORDS} OR size >= {MAX_BYTES} OR (size > 0 AND size + len > {MAX_BYTES}) THEN 1 ELSE n + 1 END, CASE WHEN n >= {MAX_RECORDS} OR size >= {MAX_BYTES} OR (size > 0 AND size + len > {MAX_BYTES}) THEN page + 1 ELSE page END FROM p JOIN records r ON r.stream_id = p.stream_id AND r.off = p.off + 1) SELECT stream_id, off, page FROM p", "records", recursive=True)


@query("paginate", PAGES)
def paginate(spark: SparkSession, d: str) -> DataFrame:
    """Bounded reads one after another until the end of every stream."""
    return fold(records(spark, d).select("stream_id", "off", "len"), "stream_id", ["off"], lambda: (0, 0, 0), paged, "stream_id long, off long, page long")


@query("catch_up_read", PAGES.replace("SELECT stream_id, off, page FROM p", "SELECT stream_id, page, min(off) AS since, max(off) + 1 AS next_off, CAST(count(*) AS BIGINT) AS n, max(off) + 1 = (SELECT count(*) FROM records m WHERE m.stream_id = p.stream_id) AS up_to_date FROM p GROUP BY stream_id, page"))
def catch_up_read(spark: SparkSession, d: str) -> DataFrame:
    """A follower that is far behind: its reads, where each goes on, and the one that finds it up to date."""
    p = paginate(spark, d).groupBy("stream_id", "page").agg(F.min("off").alias("since"), (F.max("off") + 1).alias("next_off"), F.count("*").alias("n"))
    return p.withColumn("up_to_date", F.col("next_off") == F.max("next_off").over(Window.partitionBy("stream_id")))


IDLE = 36_000_000


def reader_step(state: dict[int, int], row: dict) -> tuple[dict[int, int], dict]:
    """Readers by where they go on, with their last use: a read goes to the one at its start, which moves to its end, or to a new one. Readers at the same place are one, and idle ones go."""
    now, start = row["ts_ms"], row["since"]
    live = {k: v for k, v in state.items() if now - v <= IDLE}
    reused = start in live
    live.pop(start, None)
    live[start + 1] = now
    return live, {"stream_id": row["stream_id"], "off": row["off"], "since": start, "reused": reused, "readers": len(live)}


READERS = f"""+ q AS MATERIALIZED (SELECT stream_id, off, ts_ms, CASE WHEN event_id % 5 = 2 THEN greatest(off - 2, 0) ELSE off END AS since FROM records),
f AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS off, CAST(0 AS BIGINT) AS since, false AS reused, CAST(0 AS BIGINT) AS readers, MAP(CAST([] AS BIGINT[]), CAST([] AS BIGINT[])) AS m FROM q UNION ALL
SELECT stream_id, off, since, reused, CAST(cardinality(m) AS BIGINT), m FROM (SELECT stream_id, off, since, map_contains(live, since) AS reused, map_from_entries(list_append(list_filter(map_entries(live), lambda e: e.key <> since AND e.key <> since + 1), {{'key': since + 1, 'value': ts_ms}})) AS m
FROM (SELECT q.*, map_from_entries(list_filter(map_entries(f.m), lambda e: q.ts_ms - e.value <= {IDLE})) AS live FROM f JOIN q ON q.stream_id = f.stream_id AND q.off = f.off + 1)))
SELECT stream_id, off, since, reused, readers FROM f WHERE off >= 0"""


@query("reader_registry", sql(READERS, "records", recursive=True))
def reader_registry(spark: SparkSession, d: str) -> DataFrame:
    """Which reads are served by a reader that is there already, and how many each stream has; a reader lives for a time after its last use, so the state is of the readers in use."""
    since = F.when(F.col("event_id") % 5 == 2, F.greatest(F.col("off") - 2, F.lit(0))).otherwise(F.col("off"))
    rows = records(spark, d).select("stream_id", "off", "ts_ms", since.alias("since"))
    return fold(rows, "stream_id", ["off"], dict, reader_step, "stream_id long, off long, since long, reused boolean, readers long")
