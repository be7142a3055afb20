"""Retention, compaction planning and clean-up."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.wire import be, joined, number, part, times
from ..registry import query
from ..sources.tables import objects, read, records, sql, streams


@query("trim", sql("SELECT stream_id, greatest(start_off, least(20, end_off - 3, end_off)) AS start_off FROM streams", "streams"))
def trim(spark: SparkSession, d: str, to: int = 20) -> DataFrame:
    """A request clamped between the start and what is confirmed and committed."""
    return streams(spark, d).select("stream_id", F.greatest("start_off", F.least(F.lit(to), F.col("end_off") - 3, "end_off")).alias("start_off"))


DELETES = "q AS (SELECT stream_id, stream_id % 4 = 1 AS late FROM streams UNION ALL SELECT stream_id + 1000000, false FROM streams WHERE stream_id % 9 = 2), r AS (SELECT q.stream_id, CASE WHEN s.stream_id IS NULL THEN 'missing' WHEN NOT closed THEN 'not_closed' WHEN late THEN 'expired_epoch' ELSE 'ok' END AS result FROM q LEFT JOIN streams s USING (stream_id))"


@query("delete_stream", sql(f"+ {DELETES} SELECT r.stream_id, result, object_id FROM r LEFT JOIN objects o ON o.stream_id = r.stream_id AND result = 'ok' AND kind = 'stream'", "objects", "streams"))
def delete_stream(spark: SparkSession, d: str) -> DataFrame:
    """Deletions, and the stream objects that they mark; set objects wait for compaction. A stream must be closed, at exactly the asked epoch; one that is missing is a success."""
    s = streams(spark, d)
    known = s.select("stream_id", "closed", (F.col("stream_id") % 4 == 1).alias("late"), F.lit(True).alias("there"))
    foreign = s.where("stream_id % 9 = 2").select((F.col("stream_id") + 1000000).alias("stream_id"), F.lit(None).cast("boolean").alias("closed"), F.lit(False).alias("late"), F.lit(False).alias("there"))
    result = F.when(~F.col("there"), "missing").when(~F.col("closed"), "not_closed").when(F.col("late"), "expired_epoch").otherwise("ok")
    r = known.unionByName(foreign).select("stream_id", result.alias("result"))
    o = objects(spark, d).where("kind = 'stream'").select("stream_id", "object_id", F.lit("ok").alias("result"))
    return r.join(o, ["stream_id", "result"], "left").select("stream_id", "result", "object_id")


FORCED = "b AS (SELECT r.*, event_id // 500 AS object_id FROM records r WHERE event_id % 11 <> 4), l AS (SELECT b.* FROM b JOIN streams s USING (stream_id) WHERE off >= s.start_off), i AS (SELECT *, off - row_number() OVER (PARTITION BY object_id, stream_id ORDER BY off) AS run FROM l)"


@query("force_split", sql(f"+ {FORCED} SELECT object_id, stream_id, min(off) AS start_off, max(off) + 1 AS end_off, CAST(sum(len) AS BIGINT) AS size FROM i GROUP BY object_id, stream_id, run", "records", "streams"))
def force_split(spark: SparkSession, d: str) -> DataFrame:
    """Each set object taken apart: a stream object for every contiguous run of a stream's living records in it. Some records are missing."""
    r = records(spark, d).where("event_id % 11 <> 4").withColumn("object_id", F.expr("event_id div 500"))
    live = r.join(streams(spark, d).select("stream_id", "start_off"), "stream_id").where("off >= start_off").drop("start_off")
    run = F.col("off") - F.row_number().over(Window.partitionBy("object_id", "stream_id").orderBy("off"))
    return live.withColumn("run", run).groupBy("object_id", "stream_id", "run").agg(F.min("off").alias("start_off"), (F.max("off") + 1).alias("end_off"), F.sum("len").alias("size")).drop("run")


COMPACTABLE = "+ s AS (SELECT stream_id FROM objects WHERE kind = 'stream_set' GROUP BY 1 HAVING count(DISTINCT object_id) > 1) SELECT DISTINCT object_id FROM objects WHERE kind = 'stream_set' AND stream_id IN (SELECT stream_id FROM s)"


@query("compactable", sql(COMPACTABLE, "objects"))
def compactable(spark: SparkSession, d: str) -> DataFrame:
    """Objects that share a stream with another."""
    o = objects(spark, d).where("kind = 'stream_set'")
    shared = o.groupBy("stream_id").agg(F.min("object_id").alias("a"), F.max("object_id").alias("b")).where("a < b").select("stream_id")
    return o.join(shared, "stream_id", "left_semi").select("object_id").distinct()


def plan_blocks(blocks: Iterable[tuple[int, int, int, int]], split: int) -> list[tuple[int, int, int, str]]:
    """(stream, start, end, kind) of outputs from (stream, start, end, size) in order: a gap, or at a stream's end a size beyond the split size, makes a stream object; the rest is compacted. An overlap is an error."""
    out: list[tuple[int, int, int, str]] = []
    run: list[int] | None = None  # stream, start, end, size

    def close(gap: bool) -> None:
        if run is not None:
            out.append((run[0], run[1], run[2], "split" if gap or run[3] > split else "compact"))

    for stream, start, end, size in blocks:
        if run is not None and run[0] == stream:
            if start < run[2]:
                raise ValueError(f"blocks of stream {stream} overlap at {start}")
            if start == run[2]:
                run[2], run[3] = end, run[3] + size
                continue
            close(True)
        else:
            close(False)
        run = [stream, start, end, size]
    close(False)
    return out


RUNS = "c AS (SELECT *, CASE WHEN lag(end_off) OVER w = start_off THEN 0 ELSE 1 END AS cut FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY start_off)), g AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id ORDER BY start_off) AS island FROM c), r AS (SELECT stream_id, island, min(start_off) AS start_off, max(end_off) AS end_off, CAST(sum(size) AS BIGINT) AS size FROM g GROUP BY ALL) SELECT stream_id, start_off, end_off, size, CASE WHEN lead(island) OVER (PARTITION BY stream_id ORDER BY island) IS NOT NULL OR size > 60 THEN 'split' ELSE 'compact' END AS kind FROM r"


def plan_runs(b: DataFrame, split: int) -> DataFrame:
    """The same plan over tables: contiguous runs by window, and what follows them decides their kind."""
    w = Window.partitionBy("stream_id").orderBy("start_off")
    b = b.withColumn("cut", F.when(F.lag("end_off").over(w) == F.col("start_off"), 0).otherwise(1)).withColumn("island", F.sum("cut").over(w))
    r = b.groupBy("stream_id", "island").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.sum("size").alias("size"))
    more = F.lead("island").over(Window.partitionBy("stream_id").orderBy("island"))
    return r.withColumn("kind", F.when(more.isNotNull() | (F.col("size") > split), "split").otherwise("compact")).drop("island")


@query("compact_plan", sql(f"+ b AS (SELECT * FROM objects WHERE kind = 'stream_set'), {RUNS}", "objects"))
def compact_plan(spark: SparkSession, d: str, split: int = 60) -> DataFrame:
    """The plan of all set objects."""
    return plan_runs(objects(spark, d).where("kind = 'stream_set'"), split)


ROUND = f"""+ a AS (SELECT o.*, max(data_ts_ms) OVER (PARTITION BY object_id) AS made FROM objects o WHERE kind = 'stream_set'), l AS (SELECT a.* FROM a JOIN streams s USING (stream_id) WHERE a.end_off > s.start_off),
t AS (SELECT DISTINCT object_id, made FROM a WHERE 1706700000000 - made < 1728000000 ORDER BY made DESC, object_id LIMIT 500), b AS (SELECT l.* FROM l JOIN t USING (object_id)), {RUNS}
UNION ALL SELECT stream_id, start_off, end_off, size, 'force_split' FROM l WHERE 1706700000000 - made >= 1728000000"""


@query("compact_round", sql(ROUND, "objects", "streams"))
def compact_round(spark: SparkSession, d: str, now_ms: int = 1_706_700_000_000, age_ms: int = 1_728_000_000, most: int = 500, split: int = 60) -> DataFrame:
    """What one round writes: dead blocks are dropped, each live run of an old object becomes a stream object, and of the others the newest ``most`` are planned."""
    o = objects(spark, d).where("kind = 'stream_set'")
    made = o.groupBy("object_id").agg(F.max("data_ts_ms").alias("made"))
    live = o.join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off > s").drop("s")
    old = F.lit(now_ms) - F.col("made") >= age_ms
    newest = made.where(~old).orderBy(F.desc("made"), "object_id").limit(most)
    forced = live.join(made.where(old), "object_id").select("stream_id", "start_off", "end_off", "size", F.lit("force_split").alias("kind"))
    return plan_runs(live.join(newest, "object_id", "left_semi"), split).unionByName(forced)


@query("physical_merge", sql("SELECT stream_id, count(*) AS blocks, min(greatest(o.start_off, s.start_off)) AS start_off, max(o.end_off) AS end_off, CAST(sum(size) AS BIGINT) AS size FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off > s.start_off AND kind = 'stream' GROUP BY stream_id", "objects", "streams"))
def physical_merge(spark: SparkSession, d: str) -> DataFrame:
    """Live blocks of a stream's objects rewritten as one."""
    o = objects(spark, d).where("kind = 'stream'").join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off > s")
    return o.groupBy("stream_id").agg(F.count("*").alias("blocks"), F.min(F.greatest("start_off", "s")).alias("start_off"), F.max("end_off").alias("end_off"), F.sum("size").alias("size"))


@query("composite_merge", sql("SELECT stream_id, string_agg(CAST(object_id AS VARCHAR), ',' ORDER BY start_off) AS parts FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off > s.start_off AND kind = 'stream' GROUP BY stream_id".replace("ORDER BY start_off", "ORDER BY o.start_off"), "objects", "streams"))
def composite_merge(spark: SparkSession, d: str) -> DataFrame:
    """Live components linked without copying."""
    o = objects(spark, d).where("kind = 'stream'").join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off > s")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start_off", "object_id"))), lambda x: x["object_id"].cast("string"))
    return o.groupBy("stream_id").agg(F.array_join(parts, ",").alias("parts"))


@query("cleanup_expired", sql("SELECT o.object_id, o.stream_id, (row_number() OVER (PARTITION BY o.stream_id ORDER BY o.start_off) - 1) // 1000 AS request FROM objects o JOIN streams s USING (stream_id) WHERE o.end_off <= s.start_off", "objects", "streams"))
def cleanup_expired(spark: SparkSession, d: str, most: int = 1000) -> DataFrame:
    """Objects wholly before their stream's start, and the request, of up to a thousand, that removes each."""
    gone = objects(spark, d).join(streams(spark, d).select("stream_id", F.col("start_off").alias("s")), "stream_id").where("end_off <= s")
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("start_off"))
    return gone.withColumn("k", place.cast("long") - 1).select("object_id", "stream_id", F.expr(f"k div {most}").alias("request"))


COMPOSITES = "c AS (SELECT stream_id, object_id // 4 AS composite_id, min(start_off) AS a, max(end_off) AS b, CAST(sum(size) AS BIGINT) AS size FROM objects GROUP BY ALL), l AS (SELECT c.*, s.start_off FROM c JOIN streams s USING (stream_id) WHERE b > s.start_off), f AS (SELECT stream_id, arg_min(composite_id, a) AS composite_id, arg_min(greatest(start_off - a, 0) * size // (b - a), a) AS dead FROM l GROUP BY stream_id)"


@query("cleanup_v1", sql(f"+ {COMPOSITES} SELECT * FROM f WHERE dead > 10", "objects", "streams"))
def cleanup_v1(spark: SparkSession, d: str, most: int = 10) -> DataFrame:
    """Each stream's first living composite, if more of its bytes are dead than the bound, by linear estimate; in production 512 MiB."""
    c = objects(spark, d).groupBy("stream_id", F.expr("object_id div 4").alias("composite_id")).agg(F.min("start_off").alias("a"), F.max("end_off").alias("b"), F.sum("size").alias("size"))
    live = c.join(streams(spark, d).select("stream_id", "start_off"), "stream_id").where("b > start_off")
    first = live.withColumn("dead", F.expr("greatest(start_off - a, 0L) * size div (b - a)")).groupBy("stream_id").agg(F.min_by(F.struct("composite_id", "dead"), "a").alias("f"))
    return first.select("stream_id", "f.composite_id", "f.dead").where(F.col("dead") > most)


QUEUE = "q AS (SELECT user_id AS object_id, min(event_id) AS place, CASE WHEN arg_max(event_id % 3, event_id) = 0 THEN 'keep_data' ELSE 'delete' END AS op FROM events WHERE event_type = 'error' GROUP BY 1), k AS (SELECT * FROM q ORDER BY place LIMIT 100)"


def destroyed(spark: SparkSession, d: str) -> DataFrame:
    """The queue of objects marked destroyed: a second marking changes the operation and keeps the place."""
    e = read(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("object_id")).agg(F.min("event_id").alias("place"), F.max_by(F.col("event_id") % 3, "event_id").alias("last"))
    return e.select("object_id", "place", F.when(F.col("last") == 0, "keep_data").otherwise("delete").alias("op"))


@query("object_clean", sql(f"WITH {QUEUE} SELECT object_id, op, op = 'delete' AS data_deleted, row_number() OVER (ORDER BY CASE WHEN op = 'delete' THEN 1 ELSE 0 END, place) AS pos FROM k"))
def object_clean(spark: SparkSession, d: str, limit: int = 100, most: int = 2000) -> DataFrame:
    """The head of the queue cleaned: first those whose data stays, which only leave the catalogue, then those whose data is deleted. A bounded batch is the feature."""
    head = destroyed(spark, d).orderBy("place").limit(min(limit, most))
    return head.select("object_id", "op", (F.col("op") == "delete").alias("data_deleted"), F.row_number().over(Window.orderBy((F.col("op") == "delete").cast("int"), "place")).cast("long").alias("pos"))  # at most ``most`` rows


@query("clean_destroyed", sql(f"WITH {QUEUE} SELECT object_id, place, op FROM q WHERE object_id NOT IN (SELECT object_id FROM k)"))
def clean_destroyed(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the queue behind a cleaning."""
    return destroyed(spark, d).join(object_clean(spark, d).select("object_id"), "object_id", "left_anti")


def evict_once(ids: list[int], at: int, keep: int) -> tuple[int, list[int], int]:
    """The entry that a stream's sparse index gives up next, what is left, and where it goes on: round and round, but for the first entry and the last ``keep``, which go when nothing else is there."""
    if len(ids) == 1:
        i = 0
    elif len(ids) <= 1 + keep:
        i = 1
    else:
        i = 1 if at % len(ids) == 0 or at >= len(ids) - keep else at
        at = i + 1
    return ids[i], ids[:i] + ids[i + 1 :], at


def evictions(ids: pd.Series, keep: int) -> pd.Series:
    """For each stream the order in which all its entries would go."""
    out = []
    for own in ids:
        left, at, order = list(own), 0, []
        while left:
            gone, left, at = evict_once(left, at, keep)
            order.append(gone)
        out.append(order)
    return pd.Series(out)


EVICTED = f"""+ k AS (SELECT object_id * 10 + (off % 10) AS id, stream_id, off FROM (SELECT event_id // 500 AS object_id, stream_id, off FROM records WHERE off % 3 = 0)),
l AS (SELECT stream_id, list(id ORDER BY off) AS ids FROM k GROUP BY 1),
f AS (SELECT stream_id, ids, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS gone, CAST(len(ids) AS BIGINT) AS had FROM l UNION ALL
SELECT stream_id, list_concat(ids[1:i], ids[i + 2:]), CASE WHEN n > 3 THEN i + 1 ELSE pos END, j + 1, ids[i + 1], had FROM (SELECT *, CAST(len(ids) AS BIGINT) AS n, CASE WHEN len(ids) = 1 THEN 0 WHEN len(ids) <= 3 THEN 1 WHEN pos % len(ids) = 0 OR pos >= len(ids) - 2 THEN 1 ELSE pos END AS i FROM f WHERE len(ids) > 0)),
o AS (SELECT stream_id, j, gone, CASE WHEN j <= had - 3 THEN 0 ELSE 1 END AS phase, CASE WHEN j <= had - 3 THEN j ELSE j - greatest(had - 3, 0) END AS round FROM f WHERE j > 0),
r AS (SELECT *, row_number() OVER (ORDER BY phase, round, stream_id) AS place FROM o) SELECT stream_id, j, gone AS evicted, place FROM r WHERE place <= (SELECT sum(had) FROM (SELECT DISTINCT stream_id, had FROM f)) * 6 // 10"""


@query("sparse_evict", sql(EVICTED, "records", recursive=True))
def sparse_evict(spark: SparkSession, d: str, keep: int = 2) -> DataFrame:
    """Which entries the sparse indexes of all streams lose, to keep four tenths: round by round one of each stream that has more than its first and last ones, and when none has, one of each.

    A stream's own order needs its index alone, of a bounded size; the rounds are
    counted, and only their counts and the last round's streams are put in order.
    """
    e = records(spark, d).where("off % 3 = 0").select("stream_id", "off", (F.expr("event_id div 500") * 10 + F.col("off") % 10).alias("id"))
    ids = e.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "id"))), lambda x: x["id"]).alias("ids"))
    order = F.pandas_udf(lambda s: evictions(s, keep), "array<long>")
    o = ids.select("stream_id", F.size("ids").cast("long").alias("had"), F.posexplode(order("ids")).alias("j", "evicted")).withColumn("j", (F.col("j") + 1).cast("long"))
    spare = F.col("had") - 1 - keep
    o = o.withColumn("phase", (F.col("j") > spare).cast("int")).withColumn("round", F.when(F.col("phase") == 0, F.col("j")).otherwise(F.col("j") - F.greatest(spare, F.lit(0))))
    rounds = o.groupBy("phase", "round").agg(F.count("*").alias("n"))
    before = rounds.select("phase", "round", (F.sum("n").over(Window.orderBy("phase", "round")) - F.col("n")).alias("before"))  # a row for each round, at most the size of an index
    total = ids.agg(F.floor(F.sum(F.size("ids").cast("long")) * 6 / 10).alias("most"))
    o = o.join(F.broadcast(before), ["phase", "round"]).join(F.broadcast(total))  # a single row
    o = o.where("before < most").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("phase", "round").orderBy("stream_id")))
    return o.where("place <= most").select("stream_id", "j", "evicted", "place")


@query("sparse_compact", sql("SELECT stream_id, object_id, start_off, end_off FROM objects WHERE object_id >= 4 UNION ALL SELECT stream_id, 1000, min(start_off), max(end_off) FROM objects WHERE object_id < 4 GROUP BY stream_id", "objects"))
def sparse_compact(spark: SparkSession, d: str) -> DataFrame:
    """Entries of consumed objects replaced by that of the new one."""
    o = objects(spark, d)
    new = o.where("object_id < 4").groupBy("stream_id").agg(F.lit(1000).cast("long").alias("object_id"), F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"))
    return o.where("object_id >= 4").select("stream_id", "object_id", "start_off", "end_off").unionByName(new)


INDEXED = "o AS (SELECT *, object_id // 4 AS grp FROM objects), g AS (SELECT grp, count(DISTINCT object_id) = 4 AS whole FROM o GROUP BY 1), x AS (SELECT stream_id, object_id, start_off, end_off FROM o JOIN g USING (grp) WHERE NOT (whole AND object_id % 4 < 3) UNION ALL SELECT stream_id, 1000000 + grp, min(start_off), max(end_off) FROM o JOIN g USING (grp) WHERE whole AND object_id % 4 < 3 GROUP BY stream_id, grp)"


@query("range_index_update", sql(f"+ {INDEXED} SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_off) AS place FROM x", "objects"))
def range_index_update(spark: SparkSession, d: str) -> DataFrame:
    """Every stream's range index after all commits: each adds an entry to the indexes of its streams, and a compacting one, behind every fourth, replaces those of its three sources by its own, in the order of offsets."""
    o = objects(spark, d).withColumn("grp", F.expr("object_id div 4"))
    whole = o.groupBy("grp").agg((F.countDistinct("object_id") == 4).alias("whole"))
    o = o.join(whole, "grp").withColumn("source", F.col("whole") & (F.col("object_id") % 4 < 3))
    new = o.where("source").groupBy("stream_id", "grp").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off")).select("stream_id", (F.col("grp") + 1000000).alias("object_id"), "start_off", "end_off")
    both = o.where("NOT source").select("stream_id", "object_id", "start_off", "end_off").unionByName(new)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("stream_id").orderBy("start_off")).cast("long"))


def hex_of(e: str, n: int = 16) -> str:
    return f"lpad(upper(to_hex({e})), {n}, '0')"


@query("index_codec", sql(f"+ {INDEXED} SELECT stream_id, {hex_of('stream_id')} || {hex_of('count(*)', 8)} || string_agg({hex_of('start_off')} || {hex_of('end_off')} || {hex_of('object_id')}, '' ORDER BY start_off) AS wire, count(*) AS n, min(start_off) AS first_off, max(end_off) AS last_off FROM x GROUP BY stream_id", "objects"))
def index_codec(spark: SparkSession, d: str) -> DataFrame:
    """Range indexes as they are kept in a node's index object, a stream's number, its count of entries, and the entries; and what reading them back gives."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("start_off", "end_off", "object_id"))), lambda e: F.concat(*(be(e[c], 8) for c in ("start_off", "end_off", "object_id"))))
    g = range_index_update(spark, d).groupBy("stream_id").agg(own.alias("e"))
    data = F.col("data")
    g = g.select(F.concat(be(F.col("stream_id"), 8), be(F.size("e"), 4), joined(F.col("e"))).alias("data"))
    n = number(part(data, F.lit(8), 4))
    at = lambda i: number(part(data, 12 + 24 * (i - 1), 8))
    last = F.array_max(F.transform(times(n), lambda i: number(part(data, 12 + 24 * (i - 1) + 8, 8))))
    return g.select(number(part(data, F.lit(0), 8)).alias("stream_id"), F.hex(data).alias("wire"), n.alias("n"), at(F.lit(1)).alias("first_off"), last.alias("last_off"))


WAL = "w AS (SELECT object_id % 8 AS node, object_id, object_id // 8 * 10 AS a, object_id // 8 * 10 + CASE WHEN object_id % 21 = 17 THEN 9 ELSE 10 END AS b FROM (SELECT DISTINCT event_id // 50 AS object_id FROM events))"


def wal(spark: SparkSession, d: str) -> DataFrame:
    """The log objects of nodes: node, object_id, and the range [a, b); some end early."""
    i, place = F.col("object_id"), F.expr("object_id div 8") * 10
    return read(spark, d, "events").select(F.expr("event_id div 50").alias("object_id")).distinct().select((i % 8).alias("node"), "object_id", place.alias("a"), (place + F.when(i % 21 == 17, 9).otherwise(10)).alias("b"))


@query("wal_trim_skip", sql(f"WITH {WAL}, l AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY node ORDER BY a) = a THEN 0 ELSE 1 END AS cut FROM w WHERE b > 25), g AS (SELECT *, sum(cut) OVER (PARTITION BY node ORDER BY a) AS island FROM l) SELECT node, object_id, a, b FROM g WHERE island = 1"))
def wal_trim_skip(spark: SparkSession, d: str, trim_to: int = 25) -> DataFrame:
    """Of each node's log, from the first object beyond the trim point, the contiguous run."""
    w = Window.partitionBy("node").orderBy("a")
    live = wal(spark, d).where(F.col("b") > trim_to).withColumn("cut", F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1))
    return live.withColumn("island", F.sum("cut").over(w)).where("island = 1").select("node", "object_id", "a", "b")


@query("zombie_overlap", sql("+ w AS (SELECT stream_id // 10 AS node, stream_id, epoch, start_off, end_off FROM streams), f AS (SELECT node, arg_min(stream_id, (epoch, start_off, stream_id)) AS first, min((epoch, start_off, stream_id)).epoch AS e, arg_min(end_off, (epoch, start_off, stream_id)) AS b FROM (SELECT *, epoch AS x FROM w) GROUP BY node), z AS (SELECT f.node, first FROM f WHERE EXISTS (SELECT 1 FROM w WHERE w.node = f.node AND w.epoch <> f.e AND w.start_off < f.b)) SELECT w.node, w.stream_id, w.epoch, w.stream_id IN (SELECT first FROM z) AS dropped FROM w".replace("min((epoch, start_off, stream_id)).epoch", "min(epoch)"), "streams"))
def zombie_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Which objects of each node's log are a fenced writer's: the first in the order of epoch and start, if it reaches into one of another epoch. Only that first one is ever looked at, as in the log itself."""
    w = streams(spark, d).select(F.expr("stream_id div 10").alias("node"), "stream_id", "epoch", "start_off", "end_off")
    first = w.groupBy("node").agg(F.min(F.struct("epoch", "start_off", "stream_id", "end_off")).alias("f"))
    met = w.join(first, "node").where((F.col("epoch") != F.col("f.epoch")) & (F.col("f.end_off") > F.col("start_off")))
    gone = met.select("node", F.col("f.stream_id").alias("stream_id"), F.lit(True).alias("gone")).distinct()
    return w.join(gone, ["node", "stream_id"], "left").select("node", "stream_id", "epoch", F.coalesce("gone", F.lit(False)).alias("dropped"))


OVER = """+ b AS (SELECT * FROM objects WHERE kind = 'stream_set'), c AS (SELECT *, CASE WHEN lag(end_off) OVER w = start_off THEN 0 ELSE 1 END AS cut FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY start_off)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id ORDER BY start_off) AS island FROM c),
r AS (SELECT stream_id, island, CASE WHEN lead(island) OVER (PARTITION BY stream_id ORDER BY island) IS NOT NULL OR sum(size) > 60 THEN 1 ELSE 0 END AS split FROM g GROUP BY stream_id, island),
p AS (SELECT *, coalesce(sum(split) OVER (ORDER BY stream_id, island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS builder FROM r),
m AS (SELECT object_id, stream_id, split, builder FROM g JOIN p USING (stream_id, island)), k AS (SELECT object_id, count(DISTINCT (split, builder)) AS refs FROM m GROUP BY 1),
s AS (SELECT builder, count(*) AS blocks, sum(refs) AS refs FROM m JOIN k USING (object_id) WHERE split = 1 GROUP BY 1),
n AS (SELECT object_id, count(*) AS streams FROM m WHERE split = 0 GROUP BY 1), t AS (SELECT stream_id, sum(streams) AS dispersion FROM m JOIN n USING (object_id) WHERE split = 0 GROUP BY 1)
SELECT DISTINCT 'split' AS kind, object_id FROM m WHERE split = 1 AND builder = (SELECT builder FROM s ORDER BY blocks, refs, builder LIMIT 1) UNION ALL SELECT DISTINCT 'compact', object_id FROM m WHERE split = 0 AND stream_id = (SELECT stream_id FROM t ORDER BY dispersion, stream_id LIMIT 1)"""


def builders(spark: SparkSession, d: str, split: int) -> DataFrame:
    """object_id, stream_id, split and builder: the output that each block of a plan goes to.

    Between two splits all compacted runs share an output, so outputs are
    numbered by the splits before them: counted within ranges of 1,024 streams,
    and over the ranges' sums, so that no task has all runs.
    """
    w = Window.partitionBy("stream_id").orderBy("start_off")
    b = objects(spark, d).where("kind = 'stream_set'").withColumn("cut", F.when(F.lag("end_off").over(w) == F.col("start_off"), 0).otherwise(1)).withColumn("island", F.sum("cut").over(w))
    more = F.lead("island").over(Window.partitionBy("stream_id").orderBy("island"))
    r = b.groupBy("stream_id", "island").agg(F.sum("size").alias("size")).withColumn("split", (more.isNotNull() | (F.col("size") > split)).cast("int")).withColumn("range", F.expr("stream_id div 1024"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = r.groupBy("range").agg(F.sum("split").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("range").orderBy("stream_id", "island").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("inner", F.coalesce(F.sum("split").over(inner), F.lit(0))).join(ranges, "range")
    return b.join(r.select("stream_id", "island", "split", (F.col("base") + F.col("inner")).alias("builder")), ["stream_id", "island"]).select("object_id", "stream_id", "split", "builder")


STATS = OVER[: OVER.index("SELECT DISTINCT 'split' AS kind")]


@query("compaction_stats", sql(STATS + " SELECT k.object_id, refs AS outputs, (SELECT sum(n) FROM (SELECT count(DISTINCT stream_id) AS n FROM m WHERE split = 0 GROUP BY builder)) AS streams_in_sets, (SELECT count(DISTINCT builder) FROM m WHERE split = 1) AS stream_objects FROM k", "objects"))
def compaction_stats(spark: SparkSession, d: str, split: int = 60) -> DataFrame:
    """How many outputs of a plan each object goes to, and of the plan itself the streams in its set objects and its stream objects."""
    m = builders(spark, d, split)
    refs = m.select("object_id", "split", "builder").distinct().groupBy("object_id").agg(F.count("*").alias("outputs"))
    sets = m.where("split = 0").groupBy("builder").agg(F.countDistinct("stream_id").alias("n")).agg(F.sum("n").alias("streams_in_sets"))
    splits = m.where("split = 1").agg(F.countDistinct("builder").alias("stream_objects"))
    return refs.join(F.broadcast(sets)).join(F.broadcast(splits))  # single rows


@query("add_objects_to_remove", sql(OVER, "objects"))
def add_objects_to_remove(spark: SparkSession, d: str, split: int = 60) -> DataFrame:
    """What a plan beyond its limits leaves out: the objects of the split of fewest blocks, then fewest references, or those of the least dispersed stream."""
    m = builders(spark, d, split)
    refs = m.select("object_id", "split", "builder").distinct().groupBy("object_id").agg(F.count("*").alias("refs"))
    s = m.where("split = 1").join(refs, "object_id").groupBy("builder").agg(F.count("*").alias("blocks"), F.sum("refs").alias("refs"))
    least = s.agg(F.min(F.struct("blocks", "refs", "builder")).alias("x")).select(F.col("x.builder").alias("builder"), F.lit(1).alias("split"))
    c = m.where("split = 0")
    t = c.join(c.groupBy("object_id").agg(F.count("*").alias("streams")), "object_id").groupBy("stream_id").agg(F.sum("streams").alias("dispersion"))
    close = t.agg(F.min(F.struct("dispersion", "stream_id")).alias("x")).select("x.stream_id")
    one = m.join(F.broadcast(least), ["builder", "split"], "left_semi").select(F.lit("split").alias("kind"), "object_id")
    return one.distinct().union(c.join(F.broadcast(close), "stream_id", "left_semi").select(F.lit("compact").alias("kind"), "object_id").distinct())


@query("compaction_schedule", sql("SELECT t.tick, s.stream_id, CASE WHEN t.tick % 6 = 0 THEN 'major' ELSE 'minor' END AS level FROM streams s JOIN range(1, 13) t(tick) ON t.tick * 600 - s.stream_id * 7 >= 60 WHERE NOT closed", "streams"))
def compaction_schedule(spark: SparkSession, d: str, ticks: int = 12) -> DataFrame:
    """A sweep of the open streams every ten minutes, each sixth a major one; streams opened (here at 7 seconds times their id) under 60 seconds ago wait."""
    tick = F.explode(F.expr(f"sequence(1L, {ticks}L)")).alias("tick")
    s = streams(spark, d).where("NOT closed").select("stream_id", tick).where("tick * 600 - stream_id * 7 >= 60")
    return s.select("tick", "stream_id", F.when(F.col("tick") % 6 == 0, "major").otherwise("minor").alias("level"))
