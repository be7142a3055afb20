"""Greedy segmentation: cuts whose accumulator begins anew at each cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fold import fold
from ..registry import query
from ..sources.tables import objects, records, sql, streams


def cut_after(limit: int) -> Callable:
    """A segment ends after the row that brings it to the limit."""

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], dict]:
        segment, size = state
        size += row["len"]
        out = {"stream_id": row["stream_id"], "off": row["off"], "segment": segment}
        return ((segment + 1, 0) if size >= limit else (segment, size)), out

    return step


def cut_before(limit: int, count: int, strict: bool) -> Callable:
    """A segment ends before the row that would bring it beyond the limit, or at its number of rows."""

    def step(state: tuple[int, int, int], row: dict) -> tuple[tuple[int, int, int], dict]:
        segment, size, n = state
        over = size + row["len"] > limit if strict else size + row["len"] >= limit
        if n and (over or n >= count):
            segment, size, n = segment + 1, 0, 0
        return (segment, size + row["len"], n + 1), {"stream_id": row["stream_id"], "off": row["off"], "segment": segment}

    return step


SCHEMA = "stream_id long, off long, segment long"


def recursive(first: str, cut: str, size: str, n: str) -> str:
    """The oracle of a greedy cut: one step for each record of a stream."""
    return sql(f"+ f AS (SELECT stream_id, off, {first} AS segment, len AS size, CAST(1 AS BIGINT) AS n FROM records WHERE off = 0 UNION ALL SELECT r.stream_id, r.off, CASE WHEN {cut} THEN segment + 1 ELSE segment END, CASE WHEN {cut} THEN len ELSE {size} END, CASE WHEN {cut} THEN 1 ELSE {n} END FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1) SELECT stream_id, off, segment FROM f", "records", recursive=True)


ZERO = "CAST(0 AS BIGINT)"


@query("block_cut", recursive(ZERO, "size >= 64", "size + len", "n + 1"))
def block_cut(spark: SparkSession, d: str, limit: int = 64) -> DataFrame:
    """A block ends behind the record that brings it to its size."""
    return fold(records(spark, d).select("stream_id", "off", "len"), "stream_id", ["off"], lambda: (0, 0), cut_after(limit), SCHEMA)


def seal_step(state: tuple, row: dict, size: int, streams: int, span: int) -> tuple[tuple, dict]:
    """A cache block is full at its size or number of streams, and sealed too before a record that would spread a stream's offsets beyond the span."""
    block, held, starts = state
    first = starts.get(row["stream_id"])
    if held >= size or len(starts) >= streams or (first is not None and row["off"] + 1 - first > span):
        block, held, starts = block + 1, 0, {}
    starts = {**starts, row["stream_id"]: starts.get(row["stream_id"], row["off"])}
    return (block, held + row["len"], starts), {"stream_id": row["stream_id"], "off": row["off"], "block": block}


SEALED = """+ k AS MATERIALIZED (SELECT *, stream_id // 10 AS writer, row_number() OVER (PARTITION BY stream_id // 10 ORDER BY event_id) AS rn FROM records),
f AS (SELECT writer, rn, stream_id, off, CAST(0 AS BIGINT) AS block, len AS held, MAP([stream_id], [off]) AS starts FROM k WHERE rn = 1 UNION ALL
SELECT writer, rn, stream_id, off, CASE WHEN cut THEN block + 1 ELSE block END, CASE WHEN cut THEN len ELSE held + len END, CASE WHEN cut THEN MAP([stream_id], [off]) WHEN map_contains(starts, stream_id) THEN starts ELSE map_concat(starts, MAP([stream_id], [off])) END
FROM (SELECT k.*, f.block, f.held, f.starts, f.held >= 300 OR cardinality(f.starts) >= 5 OR coalesce(k.off + 1 - map_extract(f.starts, k.stream_id)[1] > 6, false) AS cut FROM f JOIN k ON k.writer = f.writer AND k.rn = f.rn + 1)) SELECT stream_id, off, block FROM f"""


@query("log_block_seal", sql(SEALED, "records", recursive=True))
def log_block_seal(spark: SparkSession, d: str, size: int = 300, streams: int = 5, span: int = 6) -> DataFrame:
    """The cache blocks of each writer, which has ten streams: its records in the order of their arrival. The state holds a block's streams, at most ``streams``."""
    rows = records(spark, d).select(F.expr("stream_id div 10").alias("writer"), "event_id", "stream_id", "off", "len")
    return fold(rows, "writer", ["event_id"], lambda: (0, 0, {}), lambda s, r: seal_step(s, r, size, streams, span), "stream_id long, off long, block long")


def bulk_step(state: tuple[int, int, int], row: dict, batch: int, align: int) -> tuple[tuple, dict]:
    """A bulk is sealed before a record that would bring it beyond the alignment, and behind one that brings it beyond the batch; the next one begins at the next multiple of the alignment."""
    bulk, base, size = state
    need = row["len"] + 24
    up = lambda x: -(-x // align) * align
    if need + size > align:
        bulk, base, size = bulk + 1, up(base + size), 0
    out = {"stream_id": row["stream_id"], "off": row["off"], "bulk": bulk, "place": base + size}
    size += need
    return ((bulk + 1, up(base + size), 0) if size > batch else (bulk, base, size)), out


UP = "(({0}) + 255) // 256 * 256"
BULKS = f"""+ f AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS off, CAST(0 AS BIGINT) AS bulk, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS nb, CAST(0 AS BIGINT) AS nbase, CAST(0 AS BIGINT) AS nsize FROM records UNION ALL
SELECT stream_id, off, b, base + s, CASE WHEN s + need > 200 THEN b + 1 ELSE b END, CASE WHEN s + need > 200 THEN {UP.format("base + s + need")} ELSE base END, CASE WHEN s + need > 200 THEN 0 ELSE s + need END
FROM (SELECT r.stream_id, r.off, r.len + 24 AS need, CASE WHEN r.len + 24 + nsize > 256 THEN nb + 1 ELSE nb END AS b, CASE WHEN r.len + 24 + nsize > 256 THEN {UP.format("nbase + nsize")} ELSE nbase END AS base, CASE WHEN r.len + 24 + nsize > 256 THEN 0 ELSE nsize END AS s FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1)) SELECT stream_id, off, bulk, place FROM f WHERE off >= 0"""


@query("wal_bulk", sql(BULKS, "records", recursive=True))
def wal_bulk(spark: SparkSession, d: str, batch: int = 200, align: int = 256) -> DataFrame:
    """Each record's bulk and place in the log; in production 8 MiB a batch, aligned to 64 MiB."""
    return fold(records(spark, d).select("stream_id", "off", "len"), "stream_id", ["off"], lambda: (0, 0, 0), lambda s, r: bulk_step(s, r, batch, align), "stream_id long, off long, bulk long, place long")


@query("group_by_limit", recursive(ZERO, "size + len >= 120 OR n >= 6", "size + len", "n + 1"))
def group_by_limit(spark: SparkSession, d: str, limit: int = 120, count: int = 6) -> DataFrame:
    """Groups that end before the record that would bring them to the size, or at their number of records."""
    return fold(records(spark, d).select("stream_id", "off", "len"), "stream_id", ["off"], lambda: (0, 0, 0), cut_before(limit, count, False), SCHEMA)


def linger_step(state: tuple, row: dict, most: int, size: int, linger: int) -> tuple[tuple, dict]:
    """A producer's batch is sent at its number of records, its bytes, or when its first record has lingered."""
    batch, n, held, until = state
    if n and (n >= most or held >= size or row["ts_ms"] > until):
        batch, n, held = batch + 1, 0, 0
    until = until if n else row["ts_ms"] + linger
    return (batch, n + 1, held + row["len"], until), {"stream_id": row["stream_id"], "off": row["off"], "batch": batch}


LINGER = """+ f AS (SELECT stream_id, off, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, len AS held, ts_ms + 36000000 AS until FROM records WHERE off = 0 UNION ALL
SELECT stream_id, off, CASE WHEN cut THEN batch + 1 ELSE batch END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN len ELSE held + len END, CASE WHEN cut THEN ts_ms + 36000000 ELSE until END FROM (SELECT r.*, batch, n, held, until, n >= 5 OR held >= 66 OR r.ts_ms > until AS cut FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1)) SELECT stream_id, off, batch FROM f"""


@query("producer_batch", sql(LINGER, "records", recursive=True))
def producer_batch(spark: SparkSession, d: str, most: int = 5, size: int = 66, linger: int = 36_000_000) -> DataFrame:
    """What a producer sends together; in production 500 records, 1 MiB and 5 ms."""
    return fold(records(spark, d).select("stream_id", "off", "len", "ts_ms"), "stream_id", ["off"], lambda: (0, 0, 0, 0), lambda s, r: linger_step(s, r, most, size, linger), "stream_id long, off long, batch long")


def submit_step(state: list[int], row: dict, cap: int, most: int, behind: int) -> tuple[list[int], dict]:
    """Refused while more is unconfirmed than the cap, or when too large; a record is confirmed ``behind`` submissions after its own."""
    held, size = sum(state), row["len"] + 24
    result = "over_capacity" if held > cap else "too_large" if size > most else "accepted"
    return [*state, size if result == "accepted" else 0][-behind:], {"stream_id": row["stream_id"], "off": row["off"], "result": result, "unconfirmed": held}


SUBMIT = """+ f AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS off, '' AS result, CAST(0 AS BIGINT) AS held, CAST([0, 0, 0, 0] AS BIGINT[]) AS q FROM records UNION ALL
SELECT stream_id, off, result, held, list_append(q[2:], CASE WHEN result = 'accepted' THEN size ELSE 0 END) FROM (SELECT *, CASE WHEN held > 115 THEN 'over_capacity' WHEN size > 40 THEN 'too_large' ELSE 'accepted' END AS result FROM (SELECT r.stream_id, r.off, r.len + 24 AS size, q, CAST(list_sum(q) AS BIGINT) AS held FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1))) SELECT stream_id, off, result, held AS unconfirmed FROM f WHERE off >= 0"""


@query("wal_submit", sql(SUBMIT, "records", recursive=True))
def wal_submit(spark: SparkSession, d: str, cap: int = 115, most: int = 40, behind: int = 4) -> DataFrame:
    """What becomes of records that are submitted to the log; in production at most 64 MiB each."""
    rows = records(spark, d).select("stream_id", "off", "len")
    return fold(rows, "stream_id", ["off"], lambda: [0] * behind, lambda s, r: submit_step(s, r, cap, most, behind), "stream_id long, off long, result string, unconfirmed long")


GROUPS = "+ o AS (SELECT *, CASE WHEN lag(end_off) OVER w = start_off THEN 0 ELSE 1 END AS cut FROM objects WHERE object_id % 3 <> 1 WINDOW w AS (PARTITION BY stream_id ORDER BY start_off)), g AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY stream_id ORDER BY start_off) AS BIGINT) AS grp FROM o)"


def grouped(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("start_off")
    o = objects(spark, d).where("object_id % 3 <> 1").withColumn("cut", F.when(F.lag("end_off").over(w) == F.col("start_off"), 0).otherwise(1))
    return o.withColumn("grp", F.sum("cut").over(w))


@query("group_by_offset", sql(GROUPS + " SELECT stream_id, start_off, grp FROM g", "objects"))
def group_by_offset(spark: SparkSession, d: str) -> DataFrame:
    """A group ends where a stream's offsets leave a gap."""
    return grouped(spark, d).select("stream_id", "start_off", "grp")


@query("index_from_groups", sql(GROUPS + " SELECT stream_id, grp, min(start_off) AS start_off, max(end_off) - min(start_off) AS delta, CAST(sum(end_off - start_off) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS size, CAST(sum(sum(size)) OVER (PARTITION BY stream_id ORDER BY grp) - sum(size) AS BIGINT) AS pos FROM g GROUP BY stream_id, grp", "objects"))
def index_from_groups(spark: SparkSession, d: str) -> DataFrame:
    """An index entry for each group, with its running position in the stream's blocks."""
    g = grouped(spark, d).groupBy("stream_id", "grp").agg(F.min("start_off").alias("start_off"), (F.max("end_off") - F.min("start_off")).alias("delta"), F.sum(F.col("end_off") - F.col("start_off")).alias("n"), F.sum("size").alias("size"))
    return g.withColumn("pos", F.sum("size").over(Window.partitionBy("stream_id").orderBy("grp")) - F.col("size"))


@query("ranges_from_groups", sql(GROUPS + " SELECT stream_id, min(start_off) AS start_off, max(end_off) AS end_off, CAST(sum(size) AS BIGINT) AS size FROM g GROUP BY stream_id, grp", "objects"))
def ranges_from_groups(spark: SparkSession, d: str) -> DataFrame:
    """One range for each contiguous run."""
    return grouped(spark, d).groupBy("stream_id", "grp").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.sum("size").alias("size")).drop("grp")


def regroup(most_bytes: int, most_objects: int, part: int, most_parts: int, span: int) -> Callable:
    """Contiguous objects put together up to a size, a number of objects and of parts, and a span of offsets."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        group, size, n, parts, first, end = state
        more = -(-row["size"] // part)
        if n and (row["start_off"] != end or size + row["size"] > most_bytes or n >= most_objects or parts + more > most_parts or row["end_off"] - first > span):
            group, size, n, parts = group + 1, 0, 0, 0
        first = first if n else row["start_off"]
        return (group, size + row["size"], n + 1, parts + more, first, row["end_off"]), {"stream_id": row["stream_id"], "start_off": row["start_off"], "grp": group}

    return step


def objects_recursive(where: str, cut: str) -> str:
    """The oracle of a greedy cut over each stream's objects."""
    k = f"k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_off) AS rn FROM objects WHERE {where})"
    step = f"SELECT k.*, f.grp, f.s, f.n, {cut} AS cut FROM f JOIN k ON k.stream_id = f.stream_id AND k.rn = f.rn + 1"
    return f"+ {k}, f AS (SELECT stream_id, start_off, rn, end_off AS e, size AS s, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS grp FROM k WHERE rn = 1 UNION ALL SELECT stream_id, start_off, rn, end_off, CASE WHEN cut THEN size ELSE s + size END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN grp + 1 ELSE grp END FROM ({step}))"


MERGED = """+ k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_off) AS rn, (size + 29) // 30 AS more FROM objects WHERE object_id % 7 <> 1),
f AS (SELECT stream_id, start_off, rn, end_off AS e, size AS s, CAST(1 AS BIGINT) AS n, more AS parts, start_off AS first, CAST(0 AS BIGINT) AS grp FROM k WHERE rn = 1 UNION ALL SELECT stream_id, start_off, rn, end_off, CASE WHEN cut THEN size ELSE s + size END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN more ELSE parts + more END, CASE WHEN cut THEN start_off ELSE first END, CASE WHEN cut THEN grp + 1 ELSE grp END
FROM (SELECT k.*, f.grp, f.s, f.n, f.parts, f.first, k.start_off <> f.e OR f.s + k.size > 200 OR f.n >= 4 OR f.parts + k.more > 7 OR k.end_off - f.first > 12 AS cut FROM f JOIN k ON k.stream_id = f.stream_id AND k.rn = f.rn + 1)) SELECT stream_id, start_off, grp FROM f"""


@query("merge_groups", sql(MERGED, "objects", recursive=True))
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a stream's objects that become one each; in production up to 5,000 objects and 10,000 parts."""
    rows = objects(spark, d).where("object_id % 7 <> 1").select("stream_id", "start_off", "end_off", "size")
    return fold(rows, "stream_id", ["start_off"], lambda: (0, 0, 0, 0, 0, None), regroup(200, 4, 30, 7, 12), "stream_id long, start_off long, grp long")


def reindex(most_bytes: int, most_records: int, span: int) -> Callable:
    """Index entries put together up to a size, a number of records and a span of offsets, whether or not they are contiguous."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        entry, size, n, first, place = state
        count = row["end_off"] - row["start_off"]
        if size == 0 or size + row["size"] > most_bytes or n + count > most_records or row["end_off"] - first > span:
            entry, size, n, first = entry + (size > 0), 0, 0, row["start_off"]
        out = {"stream_id": row["stream_id"], "entry": entry, "start_off": row["start_off"], "end_off": row["end_off"], "place": place, "size": row["size"]}
        return (entry, size + row["size"], n + count, first, place + row["size"]), out

    return step


REINDEXED = """+ k AS MATERIALIZED (SELECT o.*, row_number() OVER (PARTITION BY stream_id ORDER BY o.start_off) AS rn FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off > s.start_off AND object_id % 7 <> 1),
f AS (SELECT stream_id, rn, CAST(0 AS BIGINT) AS entry, start_off, end_off, CAST(0 AS BIGINT) AS place, size, size AS s, end_off - start_off AS n, start_off AS first FROM k WHERE rn = 1 UNION ALL SELECT stream_id, rn, CASE WHEN cut THEN entry + 1 ELSE entry END, start_off, end_off, place, size, CASE WHEN cut THEN size ELSE s + size END, CASE WHEN cut THEN end_off - start_off ELSE n + end_off - start_off END, CASE WHEN cut THEN start_off ELSE first END
FROM (SELECT k.*, f.entry, f.s, f.n, f.first, f.place + f.size AS place, f.s + k.size > 150 OR f.n + k.end_off - k.start_off > 9 OR k.end_off - f.first > 14 AS cut FROM f JOIN k ON k.stream_id = f.stream_id AND k.rn = f.rn + 1))
SELECT stream_id, entry, min(start_off) AS start_off, max(end_off) - min(start_off) AS delta, CAST(sum(end_off - start_off) AS BIGINT) AS n, min(place) AS place, CAST(sum(size) AS BIGINT) AS size FROM f GROUP BY stream_id, entry"""


@query("index_regroup", sql(REINDEXED, "objects", "streams", recursive=True))
def index_regroup(spark: SparkSession, d: str) -> DataFrame:
    """The index of merged objects: an entry for several blocks, without those before the stream's start; in production up to 1 MiB each."""
    live = objects(spark, d).where("object_id % 7 <> 1").join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off > s")
    rows = fold(live.select("stream_id", "start_off", "end_off", "size"), "stream_id", ["start_off"], lambda: (0, 0, 0, 0, 0), reindex(150, 9, 14), "stream_id long, entry long, start_off long, end_off long, place long, size long")
    g = rows.groupBy("stream_id", "entry").agg(F.min("start_off").alias("start_off"), (F.max("end_off") - F.min("start_off")).alias("delta"), F.sum(F.col("end_off") - F.col("start_off")).alias("n"), F.min("place").alias("place"), F.sum("size").alias("size"))
    return g.select("stream_id", "entry", "start_off", "delta", "n", "place", "size")


@query("cache_stage", sql(objects_recursive("true", "f.s + k.size > 300") + " SELECT stream_id, start_off AS off, grp AS segment FROM f", "objects", recursive=True))
def cache_stage(spark: SparkSession, d: str, cache: int = 300) -> DataFrame:
    """A stream's plan split into stages that fit the cache."""
    rows = objects(spark, d).select("stream_id", F.col("start_off").alias("off"), F.col("size").alias("len"))
    return fold(rows, "stream_id", ["off"], lambda: (0, 0, 0), cut_before(cache, 1 << 31, True), SCHEMA)


def queue_step(state: tuple, row: dict, most: int, takes: int) -> tuple[tuple, dict]:
    """The flusher takes what is queued when it is free, up to a number; what comes while it writes waits for the next row."""
    number, began, n = state
    if n == 0 or row["ts_ms"] > began or n >= most:
        number, began, n = number + (n > 0), max(row["ts_ms"], began + takes), 0
    return (number, began, n + 1), {"stream_id": row["stream_id"], "off": row["off"], "row": number, "written_ms": began + takes}


QUEUED = """+ f AS (SELECT stream_id, off, CAST(0 AS BIGINT) AS row, greatest(ts_ms, 50000000) AS began, CAST(1 AS BIGINT) AS n FROM records WHERE off = 0 UNION ALL SELECT stream_id, off, CASE WHEN cut THEN row + 1 ELSE row END, CASE WHEN cut THEN greatest(ts_ms, began + 50000000) ELSE began END, CASE WHEN cut THEN 1 ELSE n + 1 END FROM (SELECT r.*, f.row, f.began, f.n, r.ts_ms > f.began OR f.n >= 3 AS cut FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1)) SELECT stream_id, off, row, began + 50000000 AS written_ms FROM f"""


@query("group_commit", sql(QUEUED, "records", recursive=True))
def group_commit(spark: SparkSession, d: str, most: int = 3, takes: int = 50_000_000) -> DataFrame:
    """Which log row each stream's queued commands are written with, and when; in production up to 256 a row."""
    return fold(records(spark, d).select("stream_id", "off", "ts_ms"), "stream_id", ["off"], lambda: (0, 0, 0), lambda s, r: queue_step(s, r, most, takes), "stream_id long, off long, row long, written_ms long")


@query("wal_confirm_in_order", sql("SELECT stream_id, CAST(coalesce(min(off) FILTER (event_id % 23 = 9), max(off) + 1) AS BIGINT) AS confirm FROM records GROUP BY stream_id", "records"))
def wal_confirm_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Work ends out of order; confirmed is the prefix without an unfinished piece. A minimum, so no stream is gathered."""
    undone = F.min(F.when(F.col("event_id") % 23 == 9, F.col("off")))
    return records(spark, d).groupBy("stream_id").agg(F.coalesce(undone, F.max("off") + 1).alias("confirm"))


@query("commit_order", sql("+ m AS (SELECT stream_id, min(off) FILTER (event_id % 23 = 9) AS unfinished, min(off) FILTER (event_id % 41 = 6) AS broken FROM records GROUP BY 1) SELECT r.stream_id, off, CASE WHEN off >= unfinished AND (broken IS NULL OR unfinished < broken) THEN 'waiting' WHEN off = broken THEN 'failed' WHEN off > broken THEN 'poisoned' ELSE 'committed' END AS result FROM records r JOIN m USING (stream_id)", "records"))
def commit_order(spark: SparkSession, d: str) -> DataFrame:
    """Uploads end in any order and are committed in that of their seals: behind one that is unfinished all wait, and behind the first failure all are poisoned."""
    r = records(spark, d)
    first = lambda condition: F.min(F.when(condition, F.col("off")))
    m = r.groupBy("stream_id").agg(first(F.col("event_id") % 23 == 9).alias("unfinished"), first(F.col("event_id") % 41 == 6).alias("broken"))
    waits = (F.col("off") >= F.col("unfinished")) & (F.col("broken").isNull() | (F.col("unfinished") < F.col("broken")))
    result = F.when(waits, "waiting").when(F.col("off") == F.col("broken"), "failed").when(F.col("off") > F.col("broken"), "poisoned").otherwise("committed")
    return r.join(m, "stream_id").select("stream_id", "off", result.alias("result"))


@query("upload_plan", sql("+ s AS (SELECT object_id, stream_id, size, count(*) OVER (PARTITION BY object_id) AS k FROM objects) SELECT object_id, stream_id, CASE WHEN k = 1 OR size >= 80 THEN 'stream' ELSE 'stream_set' END AS target FROM s", "objects"))
def upload_plan(spark: SparkSession, d: str, split: int = 80) -> DataFrame:
    """A sealed block's only stream, and streams of the split size, get an object of their own; the others share one."""
    o = objects(spark, d).withColumn("k", F.count("*").over(Window.partitionBy("object_id")))
    return o.select("object_id", "stream_id", F.when((F.col("k") == 1) | (F.col("size") >= split), "stream").otherwise("stream_set").alias("target"))


WRITES = "w AS (SELECT *, stream_id + CASE WHEN stream_id % 13 = 4 THEN 20 ELSE 0 END AS place FROM objects), l AS (SELECT *, stream_id >= coalesce(max(stream_id) OVER (PARTITION BY object_id ORDER BY place, stream_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS legal FROM w)"


@query("object_writer", sql(f"+ {WRITES} SELECT object_id, stream_id, legal, CASE WHEN legal THEN CAST(sum(CASE WHEN legal THEN size ELSE 0 END) OVER (PARTITION BY object_id ORDER BY place, stream_id) - size AS BIGINT) END AS pos, CASE WHEN legal THEN end_off - start_off END AS delta, CAST(sum(CASE WHEN legal THEN size ELSE 0 END) OVER (PARTITION BY object_id) AS BIGINT) AS index_pos, count(*) FILTER (legal) OVER (PARTITION BY object_id) * 36 AS index_size FROM l", "objects"))
def object_writer(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written to objects, with their index entries and the footer's: a stream below one written before is refused and changes nothing. Some streams come late."""
    w = Window.partitionBy("object_id")
    order = w.orderBy("place", "stream_id")
    b = objects(spark, d).withColumn("place", F.col("stream_id") + F.when(F.col("stream_id") % 13 == 4, 20).otherwise(0))
    legal = F.col("stream_id") >= F.coalesce(F.max("stream_id").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("legal", legal).withColumn("size", F.when(F.col("legal"), F.col("size")).otherwise(0))
    pos = F.when(F.col("legal"), F.sum("size").over(order) - F.col("size"))
    return b.select("object_id", "stream_id", "legal", pos.alias("pos"), F.when(F.col("legal"), F.col("end_off") - F.col("start_off")).alias("delta"), F.sum("size").over(w).alias("index_pos"), (F.count_if("legal").over(w) * 36).alias("index_size"))
