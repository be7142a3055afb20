"""The command log: a deterministic fold into state, snapshots, leases, slots and catalogues.

The commands are synthesised from the events, a fixed mixture for each stream.
Streams don't share state, so that the fold is by stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.wire import be, number, part
from ..registry import query
from ..sources.tables import nodes, objects, read, records, sql, streams
from .fold import fold

OPS = ("open", "commit", "close", "trim", "open", "commit", "transfer", "complete", "create", "delete")
NODES = 4
#: Offsets that a commit adds.
STEP = 10


def commands(spark: SparkSession, d: str) -> DataFrame:
    """stream_id, off, idx, and what the record's command asks: op, epoch, node_id and node_epoch of the proposer, how far beyond the tail a commit begins, the new start of a trim, and the nodes of a transfer."""
    e = F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, OPS)), (e % 10 + 1).cast("int"))
    node = F.when(e % 31 == 7, F.lit(9)).otherwise(F.expr("event_id div 8") % NODES).cast("int")
    return records(spark, d).select(
        "stream_id", "off", e.alias("idx"), op.alias("op"), F.expr("off div 6").alias("epoch"), node.alias("node_id"), (node + 10 - F.when(e % 23 == 5, 1).otherwise(0)).cast("long").alias("node_epoch"),
        F.when(e % 13 == 4, 1).otherwise(0).cast("long").alias("gap"), (F.col("off") - 3).alias("new_start"), (F.expr("event_id div 16") % NODES).cast("int").alias("from_node"), (F.expr("event_id div 3") % 5).cast("int").alias("to_node"),
    )


#: (epoch, open, start, end, node, pending source, pending target, whether it is there) of a stream that was never opened, and of none.
EMPTY = (-1, False, 0, 0, -1, None, None, True)
ABSENT = (*EMPTY[:-1], False)


def apply(state: tuple, op: str, epoch: int, node_id: int = 0, node_epoch: int | None = None, gap: int = 0, new_start: int = 0, from_node: int = 0, to_node: int = 0) -> tuple[tuple, str]:
    """The state after a command, and its result. A failed command leaves the state as it was."""
    at, is_open, start, end, node, source, target, there = state
    if op == "transfer":
        if not there:
            return state, "not_exist"
        if source is not None:
            return state, "ok" if (source, target) == (from_node, to_node) else "pending"
        if from_node == to_node:
            return state, "same_node"
        if to_node >= NODES:
            return state, "no_target"
        if not is_open or node != from_node:
            return state, "not_owner"
        return (*state[:5], from_node, to_node, True), "ok"
    if op == "complete":
        if source is None:
            return state, "redundant"
        if is_open:
            return state, "not_closed"
        return ((*state[:4], target, None, None, True), "ok") if epoch == at else (state, "expired_epoch")
    if node_id >= NODES:
        return state, "not_registered"
    if node_epoch is not None and node_epoch != node_id + 10:
        return state, "node_epoch"
    if op == "create":
        return (state, "exists") if there else (EMPTY, "ok")
    if op == "delete":
        if not there:
            return state, "ok"
        if is_open:
            return state, "not_closed"
        return (ABSENT, "ok") if epoch == at else (state, "expired_epoch")
    if not there:
        return state, "not_exist"
    rest = (node, source, target, True)
    if op == "open":
        if epoch < at:
            return state, "fenced"
        if epoch == at:
            return state, "ok" if is_open and node == node_id else "fenced"
        return (state, "not_closed") if is_open else ((epoch, True, start, end, node_id, source, target, True), "ok")
    if op == "commit":
        return (state, "offset") if gap else ((at, is_open, start, end + STEP, *rest), "ok")
    if op == "close" and not is_open and epoch == at:
        return state, "ok"
    if not is_open:
        return state, "not_open"
    if epoch != at:
        return state, "expired_epoch"
    if op == "close":
        return (at, False, start, end, *rest), "ok"
    if new_start < start:
        return state, "below_start"
    if new_start > end:
        return state, "beyond_end"
    return (at, is_open, new_start, end, *rest), "ok"


ASKS = ("op", "epoch", "node_id", "node_epoch", "gap", "new_start", "from_node", "to_node")


def apply_step(state: tuple, row: dict) -> tuple[tuple, dict]:
    state, result = apply(state, *(row[k] for k in ASKS))
    return state, {"stream_id": row["stream_id"], "off": row["off"], "op": row["op"], "result": result, "epoch": state[0], "is_open": state[1], "start_off": state[2], "end_off": state[3], "node_id": state[4], "to_node": state[6], "there": state[7]}


SCHEMA = "stream_id long, off long, op string, result string, epoch long, is_open boolean, start_off long, end_off long, node_id int, to_node int, there boolean"

CHECKED = "CASE WHEN cn >= 4 THEN 'not_registered' WHEN ne <> cn + 10 THEN 'node_epoch' {0} END"
GONE = "WHEN NOT x THEN 'not_exist' "
OPENED = CHECKED.format(GONE + "WHEN ce < e THEN 'fenced' WHEN ce = e THEN CASE WHEN o AND node = cn THEN 'ok' ELSE 'fenced' END WHEN o THEN 'not_closed' ELSE 'ok'")
COMMITTED = CHECKED.format(GONE + "WHEN gap = 1 THEN 'offset' ELSE 'ok'")
SHUT = CHECKED.format(GONE + "WHEN NOT o AND ce = e THEN 'ok' WHEN NOT o THEN 'not_open' WHEN ce <> e THEN 'expired_epoch' ELSE 'ok'")
TRIMMED = CHECKED.format(GONE + "WHEN NOT o THEN 'not_open' WHEN ce <> e THEN 'expired_epoch' WHEN ns < s THEN 'below_start' WHEN ns > n THEN 'beyond_end' ELSE 'ok'")
MOVED = "CASE WHEN NOT x THEN 'not_exist' WHEN pf IS NOT NULL THEN CASE WHEN pf = cf AND pt = ct THEN 'ok' ELSE 'pending' END WHEN cf = ct THEN 'same_node' WHEN ct >= 4 THEN 'no_target' WHEN NOT o OR node <> cf THEN 'not_owner' ELSE 'ok' END"
DONE = "CASE WHEN pf IS NULL THEN 'redundant' WHEN o THEN 'not_closed' WHEN ce <> e THEN 'expired_epoch' ELSE 'ok' END"
CREATED = CHECKED.format("WHEN x THEN 'exists' ELSE 'ok'")
DELETED = CHECKED.format("WHEN NOT x THEN 'ok' WHEN o THEN 'not_closed' WHEN ce <> e THEN 'expired_epoch' ELSE 'ok'")
RESULT = f"CASE c.op WHEN 'open' THEN {OPENED} WHEN 'commit' THEN {COMMITTED} WHEN 'close' THEN {SHUT} WHEN 'trim' THEN {TRIMMED} WHEN 'transfer' THEN {MOVED} WHEN 'complete' THEN {DONE} WHEN 'create' THEN {CREATED} ELSE {DELETED} END"
OP = "CASE event_id % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'commit' WHEN 2 THEN 'close' WHEN 3 THEN 'trim' WHEN 4 THEN 'open' WHEN 5 THEN 'commit' WHEN 6 THEN 'transfer' WHEN 7 THEN 'complete' WHEN 8 THEN 'create' ELSE 'delete' END"
COMMANDS = f"c AS MATERIALIZED (SELECT stream_id, off, event_id AS idx, {OP} AS op, off // 6 AS ce, CASE WHEN event_id % 31 = 7 THEN 9 ELSE event_id // 8 % 4 END AS cn, CASE WHEN event_id % 31 = 7 THEN 9 ELSE event_id // 8 % 4 END + 10 - CASE WHEN event_id % 23 = 5 THEN 1 ELSE 0 END AS ne, CASE WHEN event_id % 13 = 4 THEN 1 ELSE 0 END AS gap, off - 3 AS ns, event_id // 16 % 4 AS cf, event_id // 3 % 5 AS ct FROM records)"
RESET = "fine AND op IN ('create', 'delete')"
APPLY = f"""+ {COMMANDS},
f AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS off, '' AS op, CAST('' AS VARCHAR) AS result, CAST(-1 AS BIGINT) AS e, false AS o, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS pf, CAST(NULL AS BIGINT) AS pt, true AS x FROM c UNION ALL
SELECT stream_id, off, op, result, CASE WHEN {RESET} THEN -1 WHEN fine AND op = 'open' THEN ce ELSE e END, CASE WHEN {RESET} THEN false WHEN fine AND op = 'open' THEN true WHEN fine AND op = 'close' THEN false ELSE o END, CASE WHEN {RESET} THEN 0 WHEN fine AND op = 'trim' THEN ns ELSE s END, CASE WHEN {RESET} THEN 0 WHEN fine AND op = 'commit' THEN n + {STEP} ELSE n END, CASE WHEN {RESET} THEN -1 WHEN fine AND op = 'open' THEN cn WHEN fine AND op = 'complete' THEN pt ELSE node END, CASE WHEN {RESET} THEN NULL WHEN fine AND op = 'transfer' THEN cf WHEN fine AND op = 'complete' THEN NULL ELSE pf END, CASE WHEN {RESET} THEN NULL WHEN fine AND op = 'transfer' THEN ct WHEN fine AND op = 'complete' THEN NULL ELSE pt END, CASE WHEN {RESET} THEN op = 'create' ELSE x END
FROM (SELECT *, result = 'ok' AS fine FROM (SELECT c.*, e, o, s, n, node, pf, pt, x, {RESULT} AS result FROM f JOIN c ON c.stream_id = f.stream_id AND c.off = f.off + 1)))"""
STATE = "e AS epoch, o AS is_open, s AS start_off, n AS end_off, CAST(node AS INTEGER) AS node_id, CAST(pt AS INTEGER) AS to_node, x AS there"


def applied(spark: SparkSession, d: str) -> DataFrame:
    """Every command of the log applied in its order."""
    return fold(commands(spark, d), "stream_id", ["off"], lambda: EMPTY, apply_step, SCHEMA)


@query("apply", sql(APPLY + f" SELECT stream_id, off, op, result, {STATE} FROM f WHERE off >= 0", "records", recursive=True))
def apply_log(spark: SparkSession, d: str) -> DataFrame:
    """Every command's result and the stream's state behind it."""
    return applied(spark, d)


@query("open_stream", sql(APPLY + " SELECT stream_id, off, result, e AS epoch, CAST(node AS INTEGER) AS node_id FROM f WHERE op = 'open'", "records", recursive=True))
def open_stream(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of openings: an epoch below the stream's is fenced, its own is good for the same node alone, and a higher one needs the stream closed."""
    return applied(spark, d).where("op = 'open'").select("stream_id", "off", "result", "epoch", "node_id")


@query("close_stream", sql(APPLY + " SELECT stream_id, off, result, o AS is_open FROM f WHERE op = 'close'", "records", recursive=True))
def close_stream(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of closings: closed at the same epoch is a success again."""
    return applied(spark, d).where("op = 'close'").select("stream_id", "off", "result", "is_open")


@query("transfer_stream", sql(APPLY + " SELECT stream_id, off, result, CAST(node AS INTEGER) AS node_id, CAST(pt AS INTEGER) AS to_node FROM f WHERE op = 'transfer'", "records", recursive=True))
def transfer_stream(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of moves: of a stream that is open on its source to another registered node, one at a time."""
    return applied(spark, d).where("op = 'transfer'").select("stream_id", "off", "result", "node_id", "to_node")


@query("complete_transfer", sql(APPLY + " SELECT stream_id, off, result, CAST(node AS INTEGER) AS node_id FROM f WHERE op = 'complete'", "records", recursive=True))
def complete_transfer(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of completions: the stream must be closed at the exact epoch, and then is its target's; without a move there is nothing to complete."""
    return applied(spark, d).where("op = 'complete'").select("stream_id", "off", "result", "node_id")


LAST_STATE = " SELECT stream_id, max(off) AS off, arg_max(e, off) AS epoch, arg_max(o, off) AS is_open, arg_max(s, off) AS start_off, arg_max(n, off) AS end_off, CAST(arg_max(node, off) AS INTEGER) AS node_id FROM f GROUP BY stream_id"


@query("replay", sql(APPLY + LAST_STATE, "records", recursive=True))
def replay(spark: SparkSession, d: str, at: int = 25) -> DataFrame:
    """A snapshot of each stream's state and the fold of the tail behind it: the same as the fold of everything."""
    c = commands(spark, d)
    names = ("epoch", "is_open", "start_off", "end_off", "node_id", "from_node", "to_node", "there")
    schema = "stream_id long, off long, epoch long, is_open boolean, start_off long, end_off long, node_id int, from_node int, to_node int, there boolean"

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        state = tuple(row["s"][k] for k in names) if row["s"] else apply(state, *(row[k] for k in ASKS))[0]
        return state, {"stream_id": row["stream_id"], "off": row["off"], **dict(zip(names, state, strict=True))}

    kind = "struct<epoch:bigint,is_open:boolean,start_off:bigint,end_off:bigint,node_id:int,from_node:int,to_node:int,there:boolean>"
    none = F.lit(None).cast(kind).alias("s")
    last = F.max_by(F.struct(*names), "off").alias("s")
    head = fold(c.where(F.col("off") < at).select("*", none), "stream_id", ["off"], lambda: EMPTY, step, schema)
    snapshot = head.groupBy("stream_id").agg(F.max("off").alias("off"), last)
    rows = c.where(F.col("off") >= at).select("*", none).unionByName(snapshot, allowMissingColumns=True)
    tail = fold(rows, "stream_id", ["off"], lambda: EMPTY, step, schema).groupBy("stream_id").agg(F.max("off").alias("off"), last)
    return tail.select("stream_id", "off", "s.epoch", "s.is_open", "s.start_off", "s.end_off", "s.node_id")


VERSION = 1
# The commands' type codes.
CODES = {"create": 1, "open": 2, "trim": 3, "close": 4, "delete": 5, "commit": 7, "transfer": 15, "complete": 16}


CODE_SQL = f"CASE op {' '.join(f'WHEN {k!r} THEN {chr(39)}{v:02X}{chr(39)}' for k, v in CODES.items())} END"


@query("command_codec", sql(f"+ c AS (SELECT *, {OP} AS op FROM records) SELECT stream_id, off, '01' || {CODE_SQL} || lpad(upper(to_hex(stream_id)), 16, '0') || lpad(upper(to_hex(off // 6)), 16, '0') AS wire, op, off // 6 AS epoch, 2 AS refused FROM c", "records"))
def command_codec(spark: SparkSession, d: str) -> DataFrame:
    """Commands in their versioned form and back; another version and a length that isn't the form's are refused."""
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, v)]), F.col("op"))
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (v, k)]), number(part(F.col("data"), F.lit(1), 1)).cast("int"))
    c = commands(spark, d).select("stream_id", "off", F.concat(be(F.lit(VERSION), 1), be(code, 1), be(F.col("stream_id"), 8), be(F.col("epoch"), 8)).alias("data"))
    data = F.col("data")
    fine = lambda x: (F.octet_length(x) == 18) & (number(part(x, F.lit(0), 1)) == VERSION)
    broken = [part(data, F.lit(0), 17), F.concat(be(F.lit(7), 1), part(data, F.lit(1), 17))]
    return c.where(fine(data)).select(number(part(data, F.lit(2), 8)).alias("stream_id"), "off", F.hex(data).alias("wire"), name.alias("op"), number(part(data, F.lit(10), 8)).alias("epoch"), sum((~fine(x)).cast("int") for x in broken).alias("refused"))


@query("snapshot_codec", sql(APPLY + f", l AS ({LAST_STATE}) SELECT stream_id, '01' || lpad(upper(to_hex(stream_id)), 16, '0') || lpad(upper(to_hex(epoch)), 16, '0') || CASE WHEN is_open THEN '01' ELSE '00' END || lpad(upper(to_hex(start_off)), 16, '0') || lpad(upper(to_hex(end_off)), 16, '0') AS wire, epoch, is_open, start_off, end_off FROM l", "records", recursive=True))
def snapshot_codec(spark: SparkSession, d: str) -> DataFrame:
    """Each stream's state in the versioned form of a snapshot and back."""
    r = replay(spark, d)
    data = F.col("data")
    r = r.select(F.concat(be(F.lit(VERSION), 1), *(be(F.col(c), 8) for c in ("stream_id", "epoch")), be(F.col("is_open").cast("long"), 1), *(be(F.col(c), 8) for c in ("start_off", "end_off"))).alias("data"))
    at = lambda i, n=8: number(part(data, F.lit(i), n))
    return r.where(at(0, 1) == VERSION).select(at(1).alias("stream_id"), F.hex(data).alias("wire"), at(9).alias("epoch"), (at(17, 1) == 1).alias("is_open"), at(18).alias("start_off"), at(26).alias("end_off"))


REGISTRATIONS = "SELECT user_id AS node_id, event_id, event_id * 31 % 997 AS epoch, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'http://n' || event_id END AS address FROM events"


@query("register_node", f"WITH r AS ({REGISTRATIONS}), a AS (SELECT *, max(epoch) OVER (PARTITION BY node_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), k AS (SELECT * FROM a WHERE m IS NULL OR epoch >= m) SELECT node_id, event_id, epoch, coalesce(last_value(nullif(address, '') IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY event_id), '') AS address FROM k")
def register_node(spark: SparkSession, d: str) -> DataFrame:
    """Registrations of an epoch below the node's are refused; an empty address keeps the one before."""
    order = Window.partitionBy("node_id").orderBy("event_id")
    address = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("http://n"), F.col("event_id").cast("string")))
    e = read(spark, d, "events").select(F.col("user_id").alias("node_id"), "event_id", (F.col("event_id") * 31 % 997).alias("epoch"), address.alias("given"))
    e = e.withColumn("m", F.max("epoch").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("m IS NULL OR epoch >= m")
    return e.select("node_id", "event_id", "epoch", F.coalesce(F.last("given", ignorenulls=True).over(order), F.lit("")).alias("address"))


@query("node_epoch_check", sql("SELECT event_id, CASE WHEN n.node_id IS NULL THEN 'not_registered' WHEN n.epoch <> r.epoch THEN 'mismatch' ELSE 'ok' END AS result FROM (SELECT event_id, user_id % 6 AS node, 10 + user_id % 6 - CASE WHEN event_id % 5 = 2 THEN 1 ELSE 0 END AS epoch FROM events) r LEFT JOIN nodes n ON n.node_id = r.node", "nodes"))
def node_epoch_check(spark: SparkSession, d: str) -> DataFrame:
    """A command's node must be registered, at exactly the epoch that the command names."""
    node = F.col("user_id") % 6
    asked = read(spark, d, "events").select("event_id", node.cast("int").alias("node_id"), (node + 10 - F.when(F.col("event_id") % 5 == 2, 1).otherwise(0)).alias("asked"))
    found = asked.join(F.broadcast(nodes(spark, d).select("node_id", "epoch")), "node_id", "left")  # four rows
    return found.select("event_id", F.when(F.col("epoch").isNull(), "not_registered").when(F.col("epoch") != F.col("asked"), "mismatch").otherwise("ok").alias("result"))


COUNT = "CASE WHEN event_id % 41 = 0 THEN 0 WHEN event_id % 97 = 5 THEN 5000 WHEN event_id % 59 = 3 THEN 4096 ELSE 1 + event_id % 5 END"


@query("create_stream", f"WITH r AS (SELECT event_id, {COUNT} AS n FROM events) SELECT event_id, CASE WHEN n = 0 THEN 'not_positive' WHEN n > 4096 THEN 'too_many' ELSE 'ok' END AS result, CASE WHEN n BETWEEN 1 AND 4096 THEN CAST(sum(CASE WHEN n BETWEEN 1 AND 4096 THEN n ELSE 0 END) OVER (ORDER BY event_id) - n AS BIGINT) END AS first_id FROM r")
def create_stream(spark: SparkSession, d: str, most: int = 4096) -> DataFrame:
    """Batches of new streams get consecutive ids from one counter; none and too many are refused. The counter is a sum by blocks of 4,096 commands, whose totals alone meet in one window, and a running sum within each."""
    n = F.expr(COUNT)
    fine = (n >= 1) & (n <= most)
    r = read(spark, d, "events").select("event_id", F.expr("event_id div 4096").alias("block"), n.alias("n"), fine.alias("fine"), F.when(fine, n).otherwise(0).cast("long").alias("used"))
    totals = r.groupBy("block").agg(F.sum("used").alias("all"))
    before = totals.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))
    r = r.join(before, "block").withColumn("inside", F.sum("used").over(Window.partitionBy("block").orderBy("event_id")) - F.col("used"))
    result = F.when(F.col("n") == 0, "not_positive").when(F.col("n") > most, "too_many").otherwise("ok")
    return r.select("event_id", result.alias("result"), F.when(F.col("fine"), F.col("before") + F.col("inside")).alias("first_id"))


@query("prepare_object", sql("SELECT user_id, event_id, CAST(sum(1 + event_id % 4) OVER (PARTITION BY user_id ORDER BY event_id) - (1 + event_id % 4) AS BIGINT) AS first_id, event_id * 10 + 600 AS deadline FROM events"))
def prepare_object(spark: SparkSession, d: str) -> DataFrame:
    """Ids leased until a deadline, from a running sum."""
    n = 1 + F.col("event_id") % 4
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select("user_id", "event_id", (F.sum(n).over(w) - n).alias("first_id"), (F.col("event_id") * 10 + 600).alias("deadline"))


COMMITS = """+ s AS (SELECT object_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, max(data_ts_ms) AS data_ts_ms FROM objects GROUP BY object_id),
g AS (SELECT object_id // 4 AS grp, count(*) FILTER (object_id % 4 < 3) = 3 AND bool_or(object_id % 4 = 3) AS whole, max(data_ts_ms) FILTER (object_id % 4 = 3) AS now, min(data_ts_ms) FILTER (object_id % 4 < 3) AS least, CAST(sum(size) FILTER (object_id % 4 < 3) AS BIGINT) AS size FROM s GROUP BY 1),
m AS (SELECT o.object_id // 4 AS grp, count(DISTINCT stream_id) AS n FROM objects o WHERE object_id % 4 < 3 GROUP BY 1)
SELECT s.object_id, CASE WHEN whole AND object_id % 4 < 3 THEN 'destroyed' ELSE 'live' END AS state, n, s.size, s.data_ts_ms FROM s JOIN g ON g.grp = s.object_id // 4 UNION ALL
SELECT 1000000 + grp, 'live', m.n, g.size, least(least, now) FROM g JOIN m USING (grp) WHERE whole"""


@query("commit_stream_set", sql(COMMITS, "objects"))
def commit_stream_set(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after all commits of stream-set objects: an object with the ranges of its streams each, and a compaction behind every fourth, which removes the three before it, marks them destroyed, and adds one object in their place; its data is as old as the oldest of theirs."""
    o = objects(spark, d)
    s = o.groupBy("object_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("data_ts_ms").alias("data_ts_ms")).withColumn("grp", F.expr("object_id div 4")).withColumn("source", F.col("object_id") % 4 < 3)
    g = s.groupBy("grp").agg((F.count("*") == 4).alias("whole"), F.max(F.when(~F.col("source"), F.col("data_ts_ms"))).alias("now"), F.min(F.when(F.col("source"), F.col("data_ts_ms"))).alias("least"), F.sum(F.when(F.col("source"), F.col("size"))).alias("all"))
    m = o.where("object_id % 4 < 3").groupBy(F.expr("object_id div 4").alias("grp")).agg(F.countDistinct("stream_id").alias("n"))
    old = s.join(g, "grp").select("object_id", F.when(F.col("whole") & F.col("source"), "destroyed").otherwise("live").alias("state"), "n", "size", "data_ts_ms")
    new = g.where("whole").join(m, "grp").select((F.col("grp") + 1000000).alias("object_id"), F.lit("live").alias("state"), "n", F.col("all").alias("size"), F.least("least", "now").alias("data_ts_ms"))
    return old.unionByName(new)


SOURCES = "b AS (SELECT stream_id, off // 20 AS id, min(off) AS a, max(off) + 1 AS b, CAST(sum(len) AS BIGINT) AS size FROM records GROUP BY ALL), g AS (SELECT stream_id, id // 3 AS object_id, min(a) AS start_off, max(b) AS end_off, CAST(sum(size) AS BIGINT) AS size, string_agg(id || CASE WHEN id % 2 = 0 THEN ':delete' ELSE ':keep_data' END, ',' ORDER BY id) AS marked FROM b GROUP BY ALL)"


@query("compact_stream_object", sql(f"+ {SOURCES}, r AS (SELECT g.*, CASE WHEN g.stream_id % 5 = 3 THEN 'expired_epoch' WHEN s.end_off < g.end_off THEN 'beyond_end' WHEN s.start_off > g.start_off THEN 'below_start' ELSE 'ok' END AS result FROM g JOIN streams s USING (stream_id)) SELECT stream_id, object_id, start_off, end_off, size, result, CASE WHEN result = 'ok' THEN marked ELSE '' END AS marked FROM r", "records", "streams"))
def compact_stream_object(spark: SparkSession, d: str) -> DataFrame:
    """Three objects of a stream replaced by one, its sources marked destroyed with their operations; the request needs the stream's epoch and a range within the stream's."""
    b = records(spark, d).groupBy("stream_id", F.expr("off div 20").alias("id")).agg(F.min("off").alias("a"), (F.max("off") + 1).alias("b"), F.sum("len").alias("size"))
    marked = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(i.cast("string"), F.when(i % 2 == 0, ":delete").otherwise(":keep_data"))), ",")
    g = b.groupBy("stream_id", F.expr("id div 3").alias("object_id")).agg(F.min("a").alias("start_off"), F.max("b").alias("end_off"), F.sum("size").alias("size"), marked.alias("marked"))
    s = streams(spark, d).select("stream_id", F.col("start_off").alias("low"), F.col("end_off").alias("high"), "epoch").withColumn("asked", F.col("epoch") - F.when(F.col("stream_id") % 5 == 3, 1).otherwise(0))
    result = F.when(F.col("epoch") != F.col("asked"), "expired_epoch").when(F.col("high") < F.col("end_off"), "beyond_end").when(F.col("low") > F.col("start_off"), "below_start").otherwise("ok")
    r = g.join(s, "stream_id").withColumn("result", result)
    return r.select("stream_id", "object_id", "start_off", "end_off", "size", "result", F.when(F.col("result") == "ok", F.col("marked")).otherwise("").alias("marked"))


@query("log_append_cas", sql("SELECT stream_id, off, off // 3 AS wanted, max(off // 3 - off) OVER (PARTITION BY stream_id ORDER BY off) + off AS idx, max(off // 3 - off) OVER (PARTITION BY stream_id ORDER BY off) + off - off // 3 AS lost FROM records", "records"))
def log_append_cas(spark: SparkSession, d: str) -> DataFrame:
    """Three writers at a time see one next slot of their log: the first wins it, the others try the slots above until one is free. In closed form, as each slot is the wanted one or the one behind the last taken."""
    w = Window.partitionBy("stream_id").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.expr("off div 3")
    r = records(spark, d).select("stream_id", "off", wanted.alias("wanted"), (F.max(wanted - F.col("off")).over(w) + F.col("off")).alias("idx"))
    return r.withColumn("lost", F.col("idx") - F.col("wanted"))


@query("snapshot_store", sql("+ k AS (SELECT stream_id, CASE WHEN event_id % 7 = 3 THEN off - 30 ELSE off END AS applied, off AS seen, body FROM records WHERE off % 10 = 9), b AS (SELECT stream_id, max(applied) AS applied_idx, arg_min(body, seen) FILTER (applied = m) AS payload FROM (SELECT *, max(applied) OVER (PARTITION BY stream_id) AS m FROM k) GROUP BY stream_id) SELECT r.stream_id, applied_idx, payload, count(*) FILTER (off > coalesce(applied_idx, -1)) AS log_rows, min(off) FILTER (off > coalesce(applied_idx, -1)) AS first_idx FROM records r LEFT JOIN b USING (stream_id) GROUP BY ALL", "records"))
def snapshot_store(spark: SparkSession, d: str) -> DataFrame:
    """Only a newer snapshot replaces one, and the log behind it is cut off: what is left of each stream's log."""
    applied = F.when(F.col("event_id") % 7 == 3, F.col("off") - 30).otherwise(F.col("off"))  # some come late, from an older state
    r = records(spark, d)
    k = r.where("off % 10 = 9").select("stream_id", applied.alias("applied"), "off", "body")
    best = k.groupBy("stream_id").agg(F.max(F.struct("applied", -F.col("off"), "body")).alias("b")).select("stream_id", F.col("b.applied").alias("applied_idx"), F.col("b.body").alias("payload"))
    left = F.col("off") > F.coalesce("applied_idx", F.lit(-1))
    return r.join(best, "stream_id", "left").groupBy("stream_id", "applied_idx", "payload").agg(F.count_if(left).alias("log_rows"), F.min(F.when(left, F.col("off"))).alias("first_idx"))


TTL = 36_000_000


def lease(state: tuple[str | None, int, int], holder: str, now: int, ttl: int) -> tuple[tuple[str | None, int, int], bool]:
    """(holder, epoch, expiry): renewed by its holder until it ends, taken with the next epoch after."""
    owner, epoch, expires = state
    if owner == holder and now <= expires:
        return (owner, epoch, now + ttl), True
    if owner is None or now > expires or owner == holder:
        return (holder, epoch + 1, now + ttl), True
    return state, False


def release(state: tuple[str | None, int, int], holder: str, epoch: int) -> tuple[tuple[str | None, int, int], bool]:
    """Given up by its holder, at the epoch that it holds; a fenced holder of the same name gives up nothing."""
    held = state[0] == holder and state[1] == epoch
    return ((None, state[1], 0) if held else state), held


def lease_step(state: tuple, row: dict) -> tuple[tuple, dict]:
    freed = row["header_type"] == "error"
    if freed:
        state, won = release(state, row["holder"], state[1] - row["behind"])
    else:
        state, won = lease(state, row["holder"], row["ts_ms"], TTL)
    return state, {"stream_id": row["stream_id"], "off": row["off"], "release": freed, "won": won, "epoch": state[1]}


LEASE = f"""+ r AS MATERIALIZED (SELECT stream_id, off, ts_ms, header_type = 'error' AS release, 'n' || event_id % 3 AS holder, event_id % 4 = 1 AS behind FROM records),
f AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS off, false AS release, false AS won, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS x FROM r UNION ALL
SELECT stream_id, off, release, won, CASE WHEN NOT won THEN owner WHEN NOT release THEN holder END, CASE WHEN won AND NOT release AND NOT (own AND ts_ms <= x) THEN e + 1 ELSE e END, CASE WHEN NOT won THEN x WHEN release THEN 0 ELSE ts_ms + {TTL} END
FROM (SELECT *, CASE WHEN release THEN own AND NOT behind ELSE own OR owner IS NULL OR ts_ms > x END AS won FROM (SELECT r.*, f.owner, f.e, f.x, coalesce(f.owner = r.holder, false) AS own FROM f JOIN r ON r.stream_id = f.stream_id AND r.off = f.off + 1)))"""


def leases(spark: SparkSession, d: str) -> DataFrame:
    """Every request for or release of the lease, in its order."""
    rows = records(spark, d).select("stream_id", "off", "ts_ms", "header_type", F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("holder"), F.when(F.col("event_id") % 4 == 1, 1).otherwise(0).alias("behind"))
    return fold(rows, "stream_id", ["off"], lambda: (None, 0, 0), lease_step, "stream_id long, off long, release boolean, won boolean, epoch long")


@query("lease_cas", sql(LEASE + " SELECT stream_id, off, won, e AS epoch FROM f WHERE off >= 0 AND NOT release", "records", recursive=True))
def lease_cas(spark: SparkSession, d: str) -> DataFrame:
    """Who gets the lease: its holder until it ends, then whoever comes, with the next epoch."""
    return leases(spark, d).where("NOT release").select("stream_id", "off", "won", "epoch")


@query("lease_release", sql(LEASE + " SELECT stream_id, off, won AS released, e AS epoch FROM f WHERE off >= 0 AND release", "records", recursive=True))
def lease_release(spark: SparkSession, d: str) -> DataFrame:
    """Which releases count: those of the holder at its own epoch."""
    return leases(spark, d).where("release").select("stream_id", "off", F.col("won").alias("released"), "epoch")


@query("next_epoch", sql("SELECT stream_id, CASE WHEN stream_id % 2 = 0 THEN max(off) ELSE 0 END + 1 AS epoch FROM records GROUP BY stream_id", "records"))
def next_epoch(spark: SparkSession, d: str) -> DataFrame:
    """One more than the local epoch, or else than that of the metadata."""
    local = F.when(F.col("stream_id") % 2 == 0, F.col("m"))
    return records(spark, d).groupBy("stream_id").agg(F.max("off").alias("m")).select("stream_id", (F.coalesce(local, F.lit(0).cast("long")) + 1).alias("epoch"))


@query("wait_applied", sql("SELECT stream_id, off, off + 2 AS wanted, lead(ts_ms, 2) OVER (PARTITION BY stream_id ORDER BY off) AS seen_ms, lead(ts_ms, 2) OVER (PARTITION BY stream_id ORDER BY off) - ts_ms > 86400000 OR lead(ts_ms, 2) OVER (PARTITION BY stream_id ORDER BY off) IS NULL AS timed_out FROM records", "records"))
def wait_applied(spark: SparkSession, d: str, ahead: int = 2, most: int = 86_400_000) -> DataFrame:
    """When the index that a proposer waits for is applied, and whether that takes longer than it waits."""
    w = Window.partitionBy("stream_id").orderBy("off")
    r = records(spark, d).select("stream_id", "off", (F.col("off") + ahead).alias("wanted"), F.lead("ts_ms", ahead).over(w).alias("seen_ms"), "ts_ms")
    return r.select("stream_id", "off", "wanted", "seen_ms", (F.col("seen_ms").isNull() | (F.col("seen_ms") - F.col("ts_ms") > most)).alias("timed_out"))


@query("reservation", sql("+ r AS (SELECT stream_id, off, off // 4 - CASE WHEN event_id % 6 = 1 THEN 1 ELSE 0 END AS epoch, header_type = 'error' AS failover FROM records) SELECT stream_id, off, upper(lpad(to_hex(stream_id), 16, '0')) || upper(lpad(to_hex(greatest(epoch, 0)), 16, '0')) || CASE WHEN failover THEN '01' ELSE '00' END AS bytes, greatest(epoch, 0) = arg_max(greatest(epoch, 0), off) OVER w AND failover = arg_max(failover, off) OVER w AS holds FROM r WINDOW w AS (PARTITION BY stream_id)", "records"))
def reservation(spark: SparkSession, d: str) -> DataFrame:
    """The object by which a writer reserves its log: node, epoch and mode as bytes. Whoever wrote last holds it; a writer's own bytes verify only while they stand there."""
    epoch = F.greatest(F.expr("off div 4") - F.when(F.col("event_id") % 6 == 1, 1).otherwise(0), F.lit(0))
    written = F.concat(be(F.col("stream_id"), 8), be(epoch, 8), be((F.col("header_type") == "error").cast("long"), 1))
    r = records(spark, d).select("stream_id", "off", F.hex(written).alias("bytes"))
    last = r.groupBy("stream_id").agg(F.max_by("bytes", "off").alias("stands"))
    return r.join(last, "stream_id").select("stream_id", "off", "bytes", (F.col("bytes") == F.col("stands")).alias("holds"))
