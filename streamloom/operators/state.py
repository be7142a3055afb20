"""Keyed state machines: idempotent producers, conditional appends, lifetimes, key-value writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fold import fold
from ..registry import query
from ..sources.tables import attempts, read, records, sql, streams


def decide(state: tuple[int, int] | None, epoch: int, seq: int) -> tuple[tuple[int, int] | None, str]:
    """The producer rule: (epoch, last sequence) before, and what becomes of an attempt."""
    if state is None or epoch > state[0]:
        return ((epoch, 0), "accepted") if seq == 0 else (state, "invalid_epoch_seq")
    if epoch < state[0]:
        return state, "stale_epoch"
    if seq <= state[1]:
        return state, "duplicate"
    if seq == state[1] + 1:
        return (epoch, seq), "accepted"
    return state, "sequence_gap"


def producer_step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int] | None, dict]:
    state, decision = decide(state, row["epoch"], row["seq"])
    return state, {"stream_id": row["stream_id"], "rn": row["rn"], "decision": decision}


RULE = "CASE WHEN {e} IS NULL OR a.epoch > {e} THEN CASE WHEN a.seq = 0 THEN 'accepted' ELSE 'invalid_epoch_seq' END WHEN a.epoch < {e} THEN 'stale_epoch' WHEN a.seq <= {s} THEN 'duplicate' WHEN a.seq = {s} + 1 THEN 'accepted' ELSE 'sequence_gap' END"
FIRST, NEXT = RULE.format(e="CAST(NULL AS BIGINT)", s="0"), RULE.format(e="f.e", s="f.s")
FSM = f"+ a AS MATERIALIZED (SELECT * FROM attempts), f AS (SELECT stream_id, rn, {FIRST} AS decision, CASE WHEN seq = 0 THEN epoch END AS e, CASE WHEN seq = 0 THEN seq END AS s FROM a WHERE rn = 1 UNION ALL SELECT stream_id, rn, decision, CASE WHEN decision = 'accepted' THEN ae ELSE e END, CASE WHEN decision = 'accepted' THEN aseq ELSE s END FROM (SELECT a.stream_id, a.rn, {NEXT} AS decision, f.e, f.s, a.epoch AS ae, a.seq AS aseq FROM f JOIN a ON a.stream_id = f.stream_id AND a.rn = f.rn + 1))"


@query("producer_fsm", sql(FSM + " SELECT stream_id, rn, decision FROM f", "records", "attempts", recursive=True))
def producer_fsm(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every producer's attempt."""
    return fold(attempts(spark, d), "stream_id", ["rn"], lambda: None, producer_step, "stream_id long, rn long, decision string")


@query("producer_reject", sql(FSM + " SELECT stream_id, rn, decision, decision IN ('accepted', 'duplicate') AS success, decision = 'accepted' AS applied, count(*) FILTER (decision = 'accepted') OVER (PARTITION BY stream_id ORDER BY rn) AS tail FROM f", "records", "attempts", recursive=True))
def producer_reject(spark: SparkSession, d: str) -> DataFrame:
    """The answers to attempts: a duplicate is a success that applies nothing and tells the current tail; the others are errors."""
    w = Window.partitionBy("stream_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    r = producer_fsm(spark, d)
    return r.select("stream_id", "rn", "decision", F.col("decision").isin("accepted", "duplicate").alias("success"), (F.col("decision") == "accepted").alias("applied"), F.count_if(F.col("decision") == "accepted").over(w).alias("tail"))


def match_step(state: int, row: dict) -> tuple[int, dict]:
    """Compare and append: the expected offset must be the next one; each failure carries the tail."""
    wanted = row["off"] - (1 if row["event_id"] % 13 == 5 else 0)
    ok = row["event_id"] % 7 == 2 or wanted == state
    return state + ok, {"stream_id": row["stream_id"], "off": row["off"], "ok": ok, "tail": state + ok}


@query("match_seq", sql("+ f AS (SELECT stream_id, off, event_id % 7 = 2 OR off - CASE WHEN event_id % 13 = 5 THEN 1 ELSE 0 END = 0 AS ok, CAST(event_id % 7 = 2 OR off - CASE WHEN event_id % 13 = 5 THEN 1 ELSE 0 END = 0 AS BIGINT) AS tail FROM records WHERE off = 0 UNION ALL SELECT r.stream_id, r.off, r.event_id % 7 = 2 OR r.off - CASE WHEN r.event_id % 13 = 5 THEN 1 ELSE 0 END = tail, tail + CAST(r.event_id % 7 = 2 OR r.off - CASE WHEN r.event_id % 13 = 5 THEN 1 ELSE 0 END = tail AS BIGINT) FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1) SELECT * FROM f", "records", recursive=True))
def match_seq(spark: SparkSession, d: str) -> DataFrame:
    """Appends that expect an offset."""
    rows = records(spark, d).select("stream_id", "off", "event_id")
    return fold(rows, "stream_id", ["off"], lambda: 0, match_step, "stream_id long, off long, ok boolean, tail long")


@query("stream_seq", sql("SELECT stream_id, off, header_type > coalesce(max(header_type) OVER (PARTITION BY stream_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS accepted FROM records", "records"))
def stream_seq(spark: SparkSession, d: str) -> DataFrame:
    """A text sequence is accepted if it is beyond all before it; what is refused is never the greatest, so a running maximum does."""
    w = Window.partitionBy("stream_id").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    return records(spark, d).select("stream_id", "off", (F.col("header_type") > F.coalesce(F.max("header_type").over(w), F.lit(""))).alias("accepted"))


SHUT = "c AS (SELECT stream_id, min(off) AS shut, arg_min(event_id % 3, off) AS who, arg_min(off // 10, off) AS part FROM records WHERE event_id % 29 = 7 GROUP BY stream_id)"


def closings(spark: SparkSession, d: str) -> DataFrame:
    """Every record as an attempt, with its stream's first close: where, by whom, and in which of the producer's epochs."""
    r = records(spark, d).select("stream_id", "off", "event_id")
    c = r.where("event_id % 29 = 7").groupBy("stream_id").agg(F.min(F.struct("off", (F.col("event_id") % 3).alias("who"), F.expr("off div 10").alias("part"))).alias("c"))
    return r.join(c, "stream_id", "left")


@query("closed_replay", sql(f"+ {SHUT} SELECT r.stream_id, off, CASE WHEN shut IS NULL OR off < shut THEN 'appended' WHEN off = shut THEN 'closed_now' WHEN event_id % 3 = who AND off // 10 = part THEN 'replay' ELSE 'closed' END AS outcome FROM records r LEFT JOIN c USING (stream_id)", "records"))
def closed_replay(spark: SparkSession, d: str) -> DataFrame:
    """Appends around a close: behind it, only the closing producer's own attempt is answered again. A stream's first close decides, so nothing is folded."""
    shut = F.col("c.off")
    again = (F.col("event_id") % 3 == F.col("c.who")) & (F.expr("off div 10") == F.col("c.part"))
    outcome = F.when(shut.isNull() | (F.col("off") < shut), "appended").when(F.col("off") == shut, "closed_now").when(again, "replay").otherwise("closed")
    return closings(spark, d).select("stream_id", "off", outcome.alias("outcome"))


@query("close", sql(f"+ {SHUT} SELECT r.stream_id, off, CASE WHEN off = shut THEN 'closed' ELSE 'already' END AS outcome, shut + who AS tail, off = shut AND who > 0 AS with_records FROM records r JOIN c USING (stream_id) WHERE event_id % 29 = 7", "records"))
def close(spark: SparkSession, d: str) -> DataFrame:
    """Requests to close: the first seals its stream, behind the last records that it may bring, and any other finds it done, at the same tail."""
    first = F.col("off") == F.col("c.off")
    return closings(spark, d).where("event_id % 29 = 7").select("stream_id", "off", F.when(first, "closed").otherwise("already").alias("outcome"), (F.col("c.off") + F.col("c.who")).alias("tail"), (first & (F.col("c.who") > 0)).alias("with_records"))


TTL = 86_400_000


def ttl_step(state: int | None, row: dict) -> tuple[int, dict]:
    """Every access moves the deadline to now + ttl, if it gains at least a tenth of the ttl (or a second)."""
    wanted = row["ts_ms"] + TTL
    moved = state is None or wanted - state >= max(1000, TTL // 10)
    state = wanted if moved else state
    return state, {"stream_id": row["stream_id"], "off": row["off"], "deadline": state}


@query("ttl_touch", sql(f"+ f AS (SELECT stream_id, off, ts_ms + {TTL} AS deadline FROM records WHERE off = 0 UNION ALL SELECT r.stream_id, r.off, CASE WHEN r.ts_ms + {TTL} - deadline >= {TTL // 10} THEN r.ts_ms + {TTL} ELSE deadline END FROM f JOIN records r ON r.stream_id = f.stream_id AND r.off = f.off + 1) SELECT * FROM f", "records", recursive=True))
def ttl_touch(spark: SparkSession, d: str) -> DataFrame:
    """The deadline behind every access."""
    return fold(records(spark, d).select("stream_id", "off", "ts_ms"), "stream_id", ["off"], lambda: None, ttl_step, "stream_id long, off long, deadline long")


@query("monotonic_ts", sql("SELECT stream_id, off, max(ts_ms // 7200000 - off) OVER (PARTITION BY stream_id ORDER BY off) + off AS ts FROM records", "records"))
def monotonic_ts(spark: SparkSession, d: str) -> DataFrame:
    """max(now, last + 1), in closed form: a running maximum of now - place."""
    w = Window.partitionBy("stream_id").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    return records(spark, d).select("stream_id", "off", (F.max(F.expr("ts_ms div 7200000") - F.col("off")).over(w) + F.col("off")).alias("ts"))


@query("put_if_absent", sql("SELECT user_id AS key, arg_min(props, event_id) AS value FROM events GROUP BY 1"))
def put_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """The first writer wins."""
    return read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.min_by("props", "event_id").alias("value"))


LAST = "SELECT user_id AS key, arg_max(props, event_id) AS value, arg_max(event_type, event_id) AS op FROM events GROUP BY 1"


@query("put_kv", sql(f"SELECT key, value FROM ({LAST}) WHERE op <> 'error'"))
def put_kv(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each key, if it isn't a delete."""
    last = F.max_by(F.struct("props", "event_type"), "event_id")
    return read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(last.alias("l")).where("l.event_type <> 'error'").select("key", F.col("l.props").alias("value"))


@query("delete_kv", sql(f"SELECT key FROM ({LAST}) WHERE op = 'error'"))
def delete_kv(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose last write is a delete."""
    return read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("op")).where("op = 'error'").select("key")


@query("create_race", sql("SELECT user_id, min(event_id) AS winner, count(*) - 1 AS losers, count(*) FILTER (event_type = first_type) - 1 AS adopted FROM (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_type FROM events) GROUP BY 1"))
def create_race(spark: SparkSession, d: str) -> DataFrame:
    """The first creator wins; a loser of the same configuration adopts the winner's stream."""
    e = read(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("winner"), F.min_by("event_type", "event_id").alias("t"))
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(first, "user_id")
    return g.groupBy("user_id").agg(F.first("winner").alias("winner"), (F.sum("n") - 1).alias("losers"), (F.sum(F.when(F.col("event_type") == F.col("t"), F.col("n")).otherwise(0)) - 1).alias("adopted"))


def recover_step(state: int | None, row: dict) -> tuple[int, dict | None]:
    """In the order of the log, a record is kept if its base is the expected one, which then is its end."""
    state = row["first"] if state is None else state
    if row["base"] != state:
        return state, None
    return state + 1, {"stream_id": row["stream_id"], "place": row["place"], "base": row["base"]}


@query("recovery_filter", sql("+ w AS MATERIALIZED (SELECT r.stream_id, row_number() OVER (PARTITION BY r.stream_id ORDER BY (off + 3 * (off % 2)), off) - 1 AS place, off AS base, start_off AS first FROM records r JOIN streams USING (stream_id) WHERE NOT closed), f AS (SELECT stream_id, place, base, base = first AS kept, CASE WHEN base = first THEN first + 1 ELSE first END AS e FROM w WHERE place = 0 UNION ALL SELECT w.stream_id, w.place, w.base, w.base = e, CASE WHEN w.base = e THEN e + 1 ELSE e END FROM f JOIN w ON w.stream_id = f.stream_id AND w.place = f.place + 1) SELECT stream_id, place, base FROM f WHERE kept", "records", "streams", recursive=True))
def recovery_filter(spark: SparkSession, d: str) -> DataFrame:
    """What the log of each open stream gives back, in the order of the log."""
    s = streams(spark, d).where("NOT closed").select("stream_id", F.col("start_off").alias("first"))
    w = Window.partitionBy("stream_id").orderBy(F.col("off") + 3 * (F.col("off") % 2), "off")
    rows = records(spark, d).join(s, "stream_id").select("stream_id", (F.row_number().over(w) - 1).cast("long").alias("place"), F.col("off").alias("base"), "first")
    return fold(rows, "stream_id", ["place"], lambda: None, recover_step, "stream_id long, place long, base long")


WAL_FOLD = "+ w AS MATERIALIZED (SELECT r.stream_id, row_number() OVER (PARTITION BY r.stream_id ORDER BY (off + 3 * (off % 2)), off) - 1 AS place, off AS base, start_off AS first FROM records r JOIN streams USING (stream_id) WHERE NOT closed), f AS (SELECT stream_id, place, base, base = first AS kept, CASE WHEN base = first THEN first + 1 ELSE first END AS e FROM w WHERE place = 0 UNION ALL SELECT w.stream_id, w.place, w.base, w.base = e, CASE WHEN w.base = e THEN e + 1 ELSE e END FROM f JOIN w ON w.stream_id = f.stream_id AND w.place = f.place + 1)"


@query("failover", sql(WAL_FOLD + ", k AS (SELECT stream_id, max(base) + 1 AS new_end, count(*) AS n FROM f WHERE kept GROUP BY 1), q AS (SELECT stream_id, start_off, closed, CASE WHEN stream_id % 7 = 2 THEN 'node_mismatch' WHEN stream_id % 5 = 1 THEN 'epoch_mismatch' ELSE 'ok' END AS result FROM streams) SELECT q.stream_id, result, CASE WHEN result = 'ok' THEN coalesce(n, 0) END AS recovered, CASE WHEN result = 'ok' THEN coalesce(new_end, start_off) END AS end_off, closed OR result = 'ok' AS closed FROM q LEFT JOIN k USING (stream_id)", "records", "streams", recursive=True))
def failover(spark: SparkSession, d: str) -> DataFrame:
    """The logs of lost nodes taken over, one for each stream here: the request must name the log's node, and an epoch that isn't below the log's; then what the log holds is recovered behind the committed end, and the stream is closed at its new one."""
    i = F.col("stream_id")
    asked_node, asked_epoch = i + F.when(i % 7 == 2, 1).otherwise(0), F.col("epoch") - F.when(i % 5 == 1, 1).otherwise(0)
    result = F.when(asked_node != i, "node_mismatch").when(asked_epoch < F.col("epoch"), "epoch_mismatch").otherwise("ok")
    k = recovery_filter(spark, d).groupBy("stream_id").agg((F.max("base") + 1).alias("new_end"), F.count("*").alias("n"))
    q = streams(spark, d).select("stream_id", "start_off", "closed", result.alias("result")).join(k, "stream_id", "left")
    ok = F.col("result") == "ok"
    return q.select("stream_id", "result", F.when(ok, F.coalesce("n", F.lit(0))).alias("recovered"), F.when(ok, F.coalesce("new_end", "start_off")).alias("end_off"), (F.col("closed") | ok).alias("closed"))


ORDERED = """+ a AS MATERIALIZED (SELECT * FROM attempts), f AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS rn, '' AS result, CAST(NULL AS BIGINT) AS e, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS tail, false AS closed FROM a UNION ALL
SELECT stream_id, rn, result, CASE WHEN result = 'appended' THEN ae ELSE e END, CASE WHEN result = 'appended' THEN aseq ELSE s END, CASE WHEN result = 'appended' AND rn % 17 <> 16 THEN tail + 1 ELSE tail END, closed OR (result = 'appended' AND rn % 34 = 16)
FROM (SELECT *, CASE WHEN decision <> 'accepted' THEN decision WHEN closed THEN 'closed' WHEN rn % 9 = 4 AND tail <> rn - 2 THEN 'match_failed' WHEN rn % 17 = 16 AND rn % 34 <> 16 THEN 'empty' ELSE 'appended' END AS result FROM (SELECT a.stream_id, a.rn, a.epoch AS ae, a.seq AS aseq, f.e, f.s, f.tail, f.closed, """ + NEXT + """ AS decision FROM f JOIN a ON a.stream_id = f.stream_id AND a.rn = f.rn + 1)))
SELECT stream_id, rn, result, tail, closed FROM f WHERE rn > 0"""


def append_step(state: tuple, row: dict) -> tuple[tuple, dict]:
    """The checks in their order: the producer, a closed stream, the expected tail, an empty payload. Only an append that passes all of them changes the state; one without a payload that closes applies no record."""
    producer, tail, closed = state
    after, result = decide(producer, row["epoch"], row["seq"])
    if result == "accepted":
        if closed:
            result = "closed"
        elif row["expected"] is not None and row["expected"] != tail:
            result = "match_failed"
        elif row["empty"] and not row["close"]:
            result = "empty"
        else:
            result = "appended"
            producer, tail, closed = after, tail + (not row["empty"]), row["close"]
    return (producer, tail, closed), {"stream_id": row["stream_id"], "rn": row["rn"], "result": result, "tail": tail, "closed": closed}


@query("append", sql(ORDERED, "records", "attempts", recursive=True))
def append(spark: SparkSession, d: str) -> DataFrame:
    """Whole appends: some expect a tail, some have no payload, some close the stream."""
    n = F.col("rn")
    rows = attempts(spark, d).select("*", F.when(n % 9 == 4, n - 2).alias("expected"), (n % 17 == 16).alias("empty"), (n % 34 == 16).alias("close"))
    return fold(rows, "stream_id", ["rn"], lambda: (None, 0, False), append_step, "stream_id long, rn long, result string, tail long, closed boolean")


def session_step(state: tuple, row: dict, most: int) -> tuple[tuple, dict]:
    """A producer's session numbers its batches in the order in which they are given; one beyond the greatest size is refused and takes no number. The first hard failure poisons it: all that follows fails without being sent. A duplicate is a success."""
    poisoned, producer, seq = state
    out = {"stream_id": row["stream_id"], "off": row["off"], "seq": None}
    if poisoned:
        return state, {**out, "result": "poisoned"}
    if row["len"] > most:
        return state, {**out, "result": "too_large"}
    sent = seq + (1 if row["event_id"] % 53 == 17 else 0)  # a number lost on the way
    after, result = decide(producer, 1, sent)
    if row["event_id"] % 10 == 3 and result == "accepted":  # tried again, as its answer was lost
        after, result = decide(after, 1, sent)
    return (result not in ("accepted", "duplicate"), after, sent + 1), {**out, "seq": sent, "result": result}


SESSION = """+ s AS (SELECT *, len > 22 AS large, event_id % 53 = 17 AS lost FROM records), b AS (SELECT *, min(off) FILTER (lost AND NOT large) OVER (PARTITION BY stream_id) AS broken, count(*) FILTER (NOT large) OVER (PARTITION BY stream_id ORDER BY off) - 1 AS place FROM s),
p AS (SELECT *, broken IS NOT NULL AND off > broken AS dead FROM b)
SELECT stream_id, off, CASE WHEN NOT dead AND NOT large THEN place + CASE WHEN lost THEN 1 ELSE 0 END END AS seq, CASE WHEN dead THEN 'poisoned' WHEN large THEN 'too_large' WHEN lost THEN CASE WHEN place = 0 THEN 'invalid_epoch_seq' ELSE 'sequence_gap' END WHEN event_id % 10 = 3 THEN 'duplicate' ELSE 'accepted' END AS result FROM p"""


@query("producer_session", sql(SESSION, "records"))
def producer_session(spark: SparkSession, d: str, most: int = 22) -> DataFrame:
    """Every stream's records through a producer's session."""
    rows = records(spark, d).select("stream_id", "off", "event_id", "len")
    return fold(rows, "stream_id", ["off"], lambda: (False, None, 0), lambda s, r: session_step(s, r, most), "stream_id long, off long, seq long, result string")
