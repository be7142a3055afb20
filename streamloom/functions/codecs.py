"""Codecs, keys and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import objects, read, records, sql, streams


def offset_token(c: Column) -> Column:
    """20 digits, so that text order is number order."""
    return F.lpad(c.cast("string"), 20, "0")


def parse_token(c: Column) -> Column:
    """NULL and negatives are the beginning; anything else that isn't a number gives NULL, an error."""
    n = c.try_cast("long")
    return F.when(c.isNull(), F.lit(0).cast("long")).when(n.isNotNull(), F.greatest(n, F.lit(0)))


@query("offset_token", sql("SELECT stream_id, off, lpad(CAST(off AS VARCHAR), 20, '0') AS token, off AS parsed FROM records", "records"))
def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Offset tokens and what they parse to."""
    r = records(spark, d).select("stream_id", "off", offset_token(F.col("off")).alias("token"))
    return r.withColumn("parsed", parse_token(F.col("token")))


@query("assign_offsets", sql("SELECT user_id AS stream_id, event_id, CAST(sum(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) - (1 + event_id % 3) AS BIGINT) AS base FROM events"))
def assign_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 1 to 3 records in arrival order: each base is the sum of the counts before it."""
    n = 1 + F.col("event_id") % 3
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "events").select(F.col("user_id").alias("stream_id"), "event_id", (F.sum(n).over(w) - n).alias("base"))


@query("batch_explode", sql("SELECT object_id, stream_id, off FROM (SELECT object_id, stream_id, s.start_off + 10 AS since, CAST(unnest(range(o.start_off, o.end_off)) AS BIGINT) AS off FROM objects o JOIN streams s USING (stream_id)) WHERE off >= since", "objects", "streams"))
def batch_explode(spark: SparkSession, d: str) -> DataFrame:
    """A batch's records, at base + i; a batch that straddles the start of the read gives those from there on."""
    s = streams(spark, d).select("stream_id", (F.col("start_off") + 10).alias("since"))
    o = objects(spark, d).join(s, "stream_id").where("end_off > since")
    return o.select("object_id", "stream_id", F.explode(F.sequence(F.greatest("start_off", "since"), F.col("end_off") - 1)).alias("off"))


@query("append_atomic", sql("SELECT stream_id, off // 5 AS batch, min(off) AS base, count(*) AS n, '01' || lpad(upper(to_hex(count(*))), 8, '0') || string_agg(lpad(upper(to_hex(CAST(strlen(body) AS BIGINT))), 8, '0') || hex(body), '' ORDER BY off) AS payload FROM records GROUP BY ALL", "records"))
def append_atomic(spark: SparkSession, d: str) -> DataFrame:
    """The messages of one append as one batch: all of them in one frame list, behind one base offset."""
    from .wire import encode_frames

    bodies = F.transform(F.array_sort(F.collect_list(F.struct("off", "body"))), lambda x: x["body"])
    g = records(spark, d).groupBy("stream_id", F.expr("off div 5").alias("batch")).agg(F.min("off").alias("base"), F.count("*").alias("n"), bodies.alias("b"))
    return g.select("stream_id", "batch", "base", "n", F.hex(encode_frames(F.col("b"))).alias("payload"))


#: Bodies of appends: an array, an object behind a blank, an empty array, bad JSON, a text, and a body of another type.
BODIES = ("'[' || props || ', ' || event_id || ', \"x\", [1, 2]]'", "' {\"b\": ' || event_id || '} '", "'[]'", "'{oops'", "'\"t' || event_id || '\"'", "'[' || props || ']'")


def messages(body: Column, is_json: Column, create: Column) -> Column:
    """(records, error): a JSON array gives a record for each element, any other JSON one, as JSON's own text; an empty array is good for a creation alone, and other types aren't looked into."""
    v = F.try_parse_json(body)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x))
    array = F.schema_of_variant(v).startswith("ARRAY")
    none = F.array().cast("array<string>")
    records_ = F.when(~is_json, F.array(body)).when(v.isNull(), none).when(array, F.coalesce(items, none)).otherwise(F.array(F.to_json(v)))
    error = F.when(is_json & v.isNull(), "invalid JSON").when(is_json & array & (F.size(items) == 0) & ~create, "empty JSON array not allowed")
    return F.struct(records_.alias("records"), error.alias("error"))


BODY_SQL = f"b AS (SELECT event_id, event_id % 12 >= 6 AS creates, event_id % 6 <> 5 AS is_json, CASE event_id % 6 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(BODIES))} END AS body FROM events)"


@query("json_split", f"WITH {BODY_SQL}, v AS (SELECT *, is_json AND json_valid(body) AS good, CASE WHEN is_json AND json_valid(body) THEN json_type(body) END AS kind FROM b), x AS (SELECT event_id, unnest(CASE WHEN NOT is_json THEN [body] WHEN kind = 'ARRAY' AND json_array_length(body) > 0 THEN list_transform(from_json(body, '[\"JSON\"]'), lambda j: CAST(json(j) AS VARCHAR)) WHEN NOT good OR kind = 'ARRAY' THEN [NULL] ELSE [CAST(json(body) AS VARCHAR)] END) AS record, unnest(range(0, CASE WHEN is_json AND kind = 'ARRAY' THEN CAST(greatest(json_array_length(body), 1) AS BIGINT) ELSE 1 END)) AS pos, CASE WHEN is_json AND NOT good THEN 'invalid JSON' WHEN kind = 'ARRAY' AND json_array_length(body) = 0 AND NOT creates THEN 'empty JSON array not allowed' END AS error FROM v) SELECT event_id, CASE WHEN record IS NOT NULL THEN pos END AS pos, record, error FROM x")
def json_split(spark: SparkSession, d: str) -> DataFrame:
    """The records of every append's body, or its error; a creation with an empty array has neither."""
    i = F.col("event_id")
    body = F.element_at(F.array(*map(F.expr, BODIES)), (i % 6 + 1).cast("int"))
    e = read(spark, d, "events").select("event_id", messages(body, i % 6 != 5, i % 12 >= 6).alias("m"))
    return e.select("event_id", "m.error", F.posexplode_outer("m.records").alias("pos", "record")).select("event_id", F.col("pos").cast("long").alias("pos"), "record", "error")


def in_order(c: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", c))), lambda x: x[c]), sep)


@query("json_array_out", sql("SELECT stream_id, off // 10 AS page, '[' || string_agg(body, ',' ORDER BY off) || ']' AS body FROM records GROUP BY ALL", "records"))
def json_array_out(spark: SparkSession, d: str) -> DataFrame:
    """A page of ten records as one JSON array."""
    return records(spark, d).groupBy("stream_id", F.expr("off div 10").alias("page")).agg(F.concat(F.lit("["), in_order("body", ","), F.lit("]")).alias("body"))


@query("raw_concat", sql("SELECT stream_id, off // 10 AS page, string_agg(body, '' ORDER BY off) AS body FROM records GROUP BY ALL", "records"))
def raw_concat(spark: SparkSession, d: str) -> DataFrame:
    """Pages of ten records as one body."""
    return records(spark, d).groupBy("stream_id", F.expr("off div 10").alias("page")).agg(in_order("body", "").alias("body"))


def json_record(off: Column, ts_ms: Column, headers: Column, body: Column) -> Column:
    """A record as the JSON of the read protocol: headers unless there are none, and the body as text, or in base64 where it isn't UTF-8."""
    text = body.cast("string")
    valid = F.is_valid_utf8(text)
    coded = F.regexp_replace(F.base64(body), "\r\n", "")
    return F.to_json(F.struct(off.alias("seq"), ts_ms.alias("timestamp"), F.when(F.size(headers) > 0, headers).alias("headers"), F.when(valid, text).alias("body"), F.when(~valid, coded).alias("body_b64")))


@query("json_codec_read", sql("SELECT stream_id, off, '{\"seq\":' || off || ',\"timestamp\":' || ts_ms || CASE WHEN event_id % 4 = 1 THEN '' ELSE ',\"headers\":{\"type\":\"' || header_type || '\"}' END || CASE WHEN event_id % 5 = 2 THEN ',\"body_b64\":\"' || base64('\\xFF'::BLOB || encode(body)) || '\"' ELSE ',\"body\":' || CAST(to_json(body) AS VARCHAR) END || '}' AS line FROM records", "records"))
def json_codec_read(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON; some have no header, some a body that isn't text."""
    e = F.col("event_id")
    headers = F.when(e % 4 == 1, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("type"), F.col("header_type")))
    raw = F.col("body").cast("binary")
    body = F.when(e % 5 == 2, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw)
    return records(spark, d).select("stream_id", "off", json_record(F.col("off"), F.col("ts_ms"), headers, body).alias("line"))


REQUESTS = ("'{\"records\":[{}]}'", "'{\"records\":[{\"body\":\"p' || event_id || '\",\"headers\":{\"type\":\"' || event_type || '\"}},{\"body\":\"q\"}]}'", "'{\"records\":[{\"body\":\"no\",\"body_b64\":\"eWVz\"}]}'", "'{\"records\":[{\"body_b64\":\"***\"}]}'", "'{\"records\":[{\"body\":' || event_id || ',\"headers\":{\"type\":' || event_id || '}}]}'", "'{\"records\":[]}'", "'{\"records\":'")
REQUEST_SQL = f"q AS (SELECT event_id, CASE event_id % 7 {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(REQUESTS))} END AS request FROM events)"


def append_request(request: Column) -> Column:
    """(records, error) of an append request: body_b64 wins over body, what isn't text or is missing is empty, and header values that aren't text stay JSON."""
    v = F.try_parse_json(request)
    rows = F.try_variant_get(v, "$.records", "array<variant>")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    text = lambda x, at: F.when(is_text(F.try_variant_get(x, at, "variant")), F.try_variant_get(x, at, "string"))

    def one(x: Column) -> Column:
        coded = text(x, "$.body_b64")
        kind = F.try_variant_get(x, "$.headers.type", "variant")
        header = F.when(is_text(kind), F.try_variant_get(x, "$.headers.type", "string")).otherwise(F.to_json(kind))
        body = F.when(coded.isNotNull(), F.try_to_binary(coded, F.lit("base64")).cast("string")).otherwise(F.coalesce(text(x, "$.body"), F.lit("")))
        return F.struct(body.alias("body"), header.alias("header"), (coded.isNotNull() & F.try_to_binary(coded, F.lit("base64")).isNull()).alias("bad"))

    got = F.transform(rows, one)
    error = F.when(v.isNull(), "invalid JSON").when(F.coalesce(F.size(rows), F.lit(0)) < 1, "records must be a non-empty array").when(F.exists(got, lambda x: x["bad"]), "invalid body_b64")
    return F.struct(F.when(error.isNull(), got).alias("records"), error.alias("error"))


@query("json_codec_append", f"WITH {REQUEST_SQL}, v AS (SELECT *, json_valid(request) AS good FROM q), x AS (SELECT event_id, unnest(CASE WHEN good AND json_array_length(request, '$.records') > 0 THEN from_json(json_extract(request, '$.records'), '[\"JSON\"]') ELSE [NULL] END) AS r, unnest(range(0, CASE WHEN good THEN CAST(greatest(json_array_length(request, '$.records'), 1) AS BIGINT) ELSE 1 END)) AS pos, CASE WHEN NOT good THEN 'invalid JSON' WHEN json_array_length(request, '$.records') = 0 THEN 'records must be a non-empty array' END AS e FROM v), y AS (SELECT *, json_type(r, '$.body_b64') = 'VARCHAR' AS coded, CASE WHEN json_type(r, '$.body_b64') = 'VARCHAR' AND regexp_full_match(r ->> '$.body_b64', '[A-Za-z0-9+/]*=*') THEN decode(from_base64(r ->> '$.body_b64')) END AS plain FROM x) SELECT event_id, CASE WHEN e IS NULL AND NOT (coalesce(coded, false) AND plain IS NULL) THEN pos END AS pos, CASE WHEN e IS NULL THEN CASE WHEN coded THEN plain WHEN json_type(r, '$.body') = 'VARCHAR' THEN r ->> '$.body' ELSE '' END END AS body, r ->> '$.headers.type' AS header, coalesce(e, CASE WHEN coded AND plain IS NULL THEN 'invalid body_b64' END) AS error FROM y")
def json_codec_append(spark: SparkSession, d: str) -> DataFrame:
    """The records of append requests, or the request's error."""
    request = F.element_at(F.array(*map(F.expr, REQUESTS)), (F.col("event_id") % 7 + 1).cast("int"))
    e = read(spark, d, "events").select("event_id", append_request(request).alias("m"))
    out = e.select("event_id", "m.error", F.posexplode_outer("m.records").alias("pos", "r"))
    return out.select("event_id", F.col("pos").cast("long").alias("pos"), "r.body", "r.header", "error")


def object_key(i: Column, namespace: str = "DEFAULT") -> Column:
    h = F.lower(F.hex(i))
    return F.concat(F.reverse(F.when(F.length(h) < 8, F.lpad(h, 8, "0")).otherwise(h)), F.lit(f"/{namespace}/"), i.cast("string"))


@query("object_key", sql("SELECT event_id, reverse(CASE WHEN length(lower(to_hex(event_id * 7919))) < 8 THEN lpad(lower(to_hex(event_id * 7919)), 8, '0') ELSE lower(to_hex(event_id * 7919)) END) || '/DEFAULT/' || event_id * 7919 AS key FROM events"))
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of objects."""
    return read(spark, d, "events").select("event_id", object_key(F.col("event_id") * 7919).alias("key"))


@query("index_key", "SELECT i AS node_id, lpad(lower(to_hex(list_reduce(list_transform(string_split('sparse-index' || i, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (a * 31 + c) & 4294967295))), 8, '0') || '/DEFAULT/node-' || i AS key FROM (SELECT DISTINCT user_id AS i FROM events)")
def index_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of each node's index: a 31-polynomial string hash, wrapped to 32 bits, as hex. Every user stands for a node."""
    codes = F.transform(F.split(F.concat(F.lit("sparse-index"), F.col("id").cast("string")), ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    ids = read(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return ids.select(F.col("id").alias("node_id"), F.concat(F.lpad(F.lower(F.hex(h)), 8, "0"), F.lit("/DEFAULT/node-"), F.col("id").cast("string")).alias("key"))


@query("wal_key", sql("SELECT stream_id, upper(md5(CAST(node_id AS VARCHAR))) || '/_kafka_c/' || node_id || '/' || epoch || '/wal/' || start_off || '-' || end_off AS key FROM streams", "streams"))
def wal_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of each stream's log object."""
    n = F.col("node_id").cast("string")
    return streams(spark, d).select("stream_id", F.concat(F.upper(F.md5(n.cast("binary"))), F.lit("/_kafka_c/"), n, F.lit("/"), F.col("epoch").cast("string"), F.lit("/wal/"), F.col("start_off").cast("string"), F.lit("-"), F.col("end_off").cast("string")).alias("key"))


@query("mime_match", sql("SELECT event_id, true AS matches FROM events WHERE event_id % 3 <> 1"))
def mime_match(spark: SparkSession, d: str) -> DataFrame:
    """Content types are equal by what stands before the parameters, whatever the case."""
    ct = F.element_at(F.array(*map(F.lit, ("Application/JSON; charset=utf-8", "text/plain", " application/json "))), (F.col("event_id") % 3 + 1).cast("int"))
    mime = F.lower(F.trim(F.split(F.coalesce(ct, F.lit("")), ";")[0]))
    return read(spark, d, "events").select("event_id", (mime == "application/json").alias("matches")).where("matches")


@query("strict_u64", sql("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS value FROM events"))
def strict_u64(spark: SparkSession, d: str) -> DataFrame:
    """Digits without a leading zero, else no value."""
    e = F.col("event_id").cast("string")
    text = F.element_at(F.array(e, F.concat(F.lit("0"), e), F.concat(F.lit("-"), e), F.concat(e, F.lit("x"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", F.when(text.rlike("^(0|[1-9][0-9]*)$"), text.try_cast("long")).alias("value"))


@query("producer_digits", sql("SELECT event_id, event_id AS value FROM events WHERE event_id % 2 = 0"))
def producer_digits(spark: SparkSession, d: str) -> DataFrame:
    """Digits with or without leading zeros; all else is no value."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("00"), F.col("event_id").cast("string"))).otherwise("1.5")
    return read(spark, d, "events").select("event_id", F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).alias("value")).where("value IS NOT NULL")


@query("percent_decode", sql("SELECT event_id, 'a b&' || event_id AS text FROM events"))
def percent_decode(spark: SparkSession, d: str) -> DataFrame:
    """Query strings decoded; a plus is a blank."""
    return read(spark, d, "events").select("event_id", F.url_decode(F.concat(F.lit("a+b%26"), F.col("event_id").cast("string"))).alias("text"))


@query("parse_seq", sql("SELECT stream_id, off, CASE off % 6 WHEN 0 THEN off WHEN 1 THEN end_off WHEN 2 THEN off + 1 WHEN 3 THEN 0 WHEN 4 THEN 0 END AS start, off % 6 = 5 AS error FROM records JOIN streams USING (stream_id)", "records", "streams"))
def parse_seq(spark: SparkSession, d: str) -> DataFrame:
    """Where a read begins: the given number, ``now`` in any case for the next offset, without it the last event's id, and else 0; negatives are the beginning, what is no number is an error."""
    r = records(spark, d).join(streams(spark, d).select("stream_id", "end_off"), "stream_id")
    kind = F.col("off") % 6
    given = F.when(kind == 0, F.col("off").cast("string")).when(kind == 1, "NOW").when(kind == 3, "-7").when(kind == 5, "nope")
    event = F.when(kind == 2, (F.col("off") + 1).cast("string")).when(kind == 4, "")
    start = F.when(F.lower(given) == "now", F.col("end_off")).otherwise(parse_token(F.coalesce(given, F.when(event != "", event))))
    return r.select("stream_id", "off", start.alias("start"), start.isNull().alias("error"))


@query("etag", sql("SELECT stream_id, '\"' || base64(encode(name)) || ':' || start_off || ':' || end_off || CASE WHEN closed THEN ':c' ELSE '' END || '\"' AS etag, CASE WHEN stream_id % 3 = 1 THEN 304 ELSE 200 END AS status FROM streams", "streams"))
def etag(spark: SparkSession, d: str) -> DataFrame:
    """The tag of a whole read, and what a client with a tag of its own gets: nothing new, unless the stream has moved on."""
    s = streams(spark, d)
    tag = lambda end: F.concat(F.lit('"'), F.base64(F.col("name").cast("binary")), F.lit(":"), F.col("start_off").cast("string"), F.lit(":"), end.cast("string"), F.when(F.col("closed"), ":c").otherwise(""), F.lit('"'))
    client = F.when(F.col("stream_id") % 3 == 1, tag(F.col("end_off"))).when(F.col("stream_id") % 3 == 2, tag(F.col("end_off") - 1))
    return s.select("stream_id", tag(F.col("end_off")).alias("etag"), F.when(client == tag(F.col("end_off")), 304).otherwise(200).alias("status"))


@query("user_ct", sql("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'application/octet-stream' END AS ct FROM events"))
def user_ct(spark: SparkSession, d: str) -> DataFrame:
    """The user's type, unwrapped from the stored parameter."""
    stored = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("application/x-log; ct="), "event_type")).otherwise("application/x-log")
    ct = F.regexp_extract(stored, "; ct=(.*)$", 1)
    return read(spark, d, "events").select("event_id", F.when(ct != "", ct).otherwise("application/octet-stream").alias("ct"))


@query("resume_cursor", sql("SELECT stream_id, off, CASE WHEN client IS NULL OR ts_ms // 20000 > client THEN ts_ms // 20000 ELSE client + 1 + ts_ms % 1000 * 1000000 % 60 END AS cursor FROM (SELECT *, CASE WHEN off % 3 > 0 THEN ts_ms // 20000 + off % 5 - 2 END AS client FROM records)", "records"))
def resume_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The interval of 20 seconds that now is in, or beyond the client's value, with a jitter from the clock, so that no cache answers twice."""
    interval = F.expr("ts_ms div 20000")
    r = records(spark, d).select("stream_id", "off", "ts_ms", interval.alias("interval"), F.when(F.col("off") % 3 > 0, interval + F.col("off") % 5 - 2).alias("client"))
    later = F.col("client") + 1 + F.col("ts_ms") % 1000 * 1000000 % 60
    return r.select("stream_id", "off", F.when(F.col("client").isNull() | (F.col("interval") > F.col("client")), F.col("interval")).otherwise(later).alias("cursor"))
