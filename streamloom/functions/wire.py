"""Binary codecs as column expressions: frames, envelopes, batches, record and log headers, each with its inverse.

Bytes are put together and taken apart by the JVM's own functions. All numbers
are big-endian. Decoding gives NULL for bytes that the format refuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import objects, records, sql

# Fixed values of the formats: versions, magics, header sizes and the checksum's mask.
FRAMES_VERSION, ENVELOPE_VERSION, BATCH_VERSION = 1, 1, 1
RECORD_MAGIC, RECORD_HEADER = 0x22, 33
LOG_DATA_MAGIC, LOG_EMPTY_MAGIC, LOG_HEADER = 0x87654321, 0x76543210, 24
MASK = 0x7FFFFFFF


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def digits(c: Column, n: int) -> Column:
    """A whole number in n bytes, as hex."""
    return F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * n))


def be(c: Column, n: int) -> Column:
    """A whole number in n bytes."""
    return F.unhex(digits(c, n))


def part(data: Column, at: Column, size: Column | int) -> Column:
    """Bytes from a place counted from 0."""
    return F.substring(data, (at + 1).cast("int"), size.cast("int") if isinstance(size, Column) else F.lit(size))


def number(data: Column) -> Column:
    """The signed number of 8 bytes, or the unsigned one of fewer; NULL of none."""
    return F.conv(F.hex(data), 16, -10).cast("long")


def sized_digits(c: Column) -> Column:
    """The bytes behind their length, as hex."""
    return F.concat(digits(F.octet_length(c), 4), F.hex(c.cast("binary")))


def sized(c: Column) -> Column:
    """The bytes behind their length."""
    return F.unhex(sized_digits(c))


def behind(data: Column, at: Column) -> Column:
    """Where the bytes end whose length stands at a place; NULL if the data ends before."""
    return let(at + 4 + number(part(data, at, 4)), lambda end: F.when(end <= F.octet_length(data), end))


def loops(data: Column, at: Column, least: int) -> Column:
    """An element for each of the items whose count stands at a place; NULL for more than the bytes behind it can hold, of ``least`` bytes each."""
    return let(number(part(data, at, 4)), lambda n: F.when(n * least <= F.octet_length(data) - at - 4, F.array_repeat(F.lit(0), n.cast("int"))))


def joined(parts: Column) -> Column:
    """An array of binaries as one."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def crc(c: Column) -> Column:
    """CRC-32 masked to 31 bits."""
    return F.crc32(c).bitwiseAND(F.lit(MASK))


def times(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


# frames: a version byte, a count, and length-prefixed bodies


def encode_frames(bodies: Column) -> Column:
    return F.unhex(F.concat(digits(F.lit(FRAMES_VERSION), 1), digits(F.size(bodies), 4), F.array_join(F.transform(bodies, sized_digits), "")))


def decode_frames(data: Column) -> Column:
    """The bodies, or NULL: another version, a body cut short, bytes left over."""

    def decode(data: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            return let(behind(data, s["at"]), lambda end: F.struct(end.alias("at"), F.concat(s["out"], F.array(part(data, s["at"] + 4, end - s["at"] - 4))).alias("out")))

        start = F.struct(F.lit(5).cast("long").alias("at"), F.array().cast("array<binary>").alias("out"))
        each = F.when(number(part(data, F.lit(0), 1)) == FRAMES_VERSION, loops(data, F.lit(1), 4))
        return F.aggregate(each, start, step, lambda s: F.when(s["at"] == F.octet_length(data), s["out"]))

    return let(data, decode)


# headers: a count, and length-prefixed names and values in the order of the names


def headers_digits(headers: Column) -> Column:
    pairs = F.transform(F.sort_array(F.map_entries(headers)), lambda e: F.concat(sized_digits(e["key"]), sized_digits(e["value"])))
    return F.concat(digits(F.size(headers), 4), F.array_join(pairs, ""))


def encode_headers(headers: Column) -> Column:
    return F.unhex(headers_digits(headers))


def decode_headers(data: Column, at: Column) -> Column:
    """(at, pairs) behind the headers that begin at a place; NULL where they are cut short."""

    def step(s: Column, _: Column) -> Column:
        def pair(name: Column, end: Column) -> Column:
            one = F.struct(part(data, s["at"] + 4, name - s["at"] - 4).cast("string").alias("name"), part(data, name + 4, end - name - 4).cast("string").alias("value"))
            return F.struct(end.alias("at"), F.concat(s["pairs"], F.array(one)).alias("pairs"))

        return let(behind(data, s["at"]), lambda name: let(behind(data, name), lambda end: pair(name, end)))

    start = F.struct((at + 4).cast("long").alias("at"), F.array().cast("array<struct<name:string,value:string>>").alias("pairs"))
    return F.aggregate(loops(data, at, 8), start, step, lambda s: F.when(s["at"].isNotNull(), s))


def shown(headers: Column) -> Column:
    """Names and values as text, for reports."""
    return F.array_join(F.transform(headers["pairs"], lambda e: F.concat(e["name"], F.lit("="), e["value"])), "&")


# envelopes: a version byte, the time, headers and the body


def encode_envelope(ts_ms: Column, headers: Column, body: Column) -> Column:
    return F.concat(be(F.lit(ENVELOPE_VERSION), 1), be(ts_ms, 8), encode_headers(headers), body.cast("binary"))


def envelope_version(data: Column) -> Column:
    return (F.octet_length(data) >= 13) & (number(part(data, F.lit(0), 1)) == ENVELOPE_VERSION)


# batches: a version byte, a count, and records: (sequence and time when read,) headers, and a length-prefixed body


def encode_batch(rows: Column, read: bool) -> Column:
    """``rows``: an array of structs (off, ts_ms, headers, body)."""

    def one(r: Column) -> Column:
        front = [digits(r["off"], 8), digits(r["ts_ms"], 8)] if read else []
        return F.concat(*front, headers_digits(r["headers"]), sized_digits(r["body"]))

    return F.unhex(F.concat(digits(F.lit(BATCH_VERSION), 1), digits(F.size(rows), 4), F.array_join(F.transform(rows, one), "")))


def decode_batch(data: Column, read: bool) -> Column:
    """An array of structs (off, ts_ms, headers, body), with no offset and time where a batch is appended; NULL for another version and where a record is cut short."""
    front = 16 if read else 0
    record = "array<struct<off:bigint,ts_ms:bigint,headers:string,body:string>>"
    none = F.lit(None).cast("long")

    def decode(data: Column) -> Column:
        def one(s: Column, h: Column, end: Column) -> Column:
            off, ts = (number(part(data, s["at"], 8)), number(part(data, s["at"] + 8, 8))) if read else (none, none)
            body = part(data, h["at"] + 4, end - h["at"] - 4).cast("string")
            row = F.struct(off.alias("off"), ts.alias("ts_ms"), shown(h).alias("headers"), body.alias("body"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(row)).alias("out"))

        def step(s: Column, _: Column) -> Column:
            return let(decode_headers(data, s["at"] + front), lambda h: let(behind(data, h["at"]), lambda end: one(s, h, end)))

        start = F.struct(F.lit(5).cast("long").alias("at"), F.array().cast(record).alias("out"))
        each = F.when(number(part(data, F.lit(0), 1)) == BATCH_VERSION, loops(data, F.lit(1), front + 8))
        return F.aggregate(each, start, step, lambda s: F.when(s["at"].isNotNull(), s["out"]))

    return let(data, decode)


# record batches: magic, stream, epoch, base, count (negative for a link), size and payload


def encode_record(stream_id: Column, epoch: Column, base: Column, count: Column, payload: Column) -> Column:
    return F.concat(be(F.lit(RECORD_MAGIC), 1), be(stream_id, 8), be(epoch, 8), be(base, 8), be(count, 4), sized(payload))


def record_field(data: Column, name: str) -> Column:
    at, size = {"magic": (0, 1), "stream_id": (1, 8), "epoch": (9, 8), "base": (17, 8), "count": (25, 4), "size": (29, 4)}[name]
    n = number(part(data, F.lit(at), size))
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) if name == "count" else n


def is_record(data: Column) -> Column:
    return (record_field(data, "magic") == RECORD_MAGIC) & (F.octet_length(data) == RECORD_HEADER + record_field(data, "size"))


def end_offset(base: Column, count: Column) -> Column:
    """Exclusive end; a negative count marks a link."""
    return F.when(count > 0, base + count).otherwise(base - count)


# log records: magic, body size, the body's offset (the header's own and 24), the body's checksum, and the header's


def log_header(offset: Column, size: Column, body_crc: Column, magic: Column | int = LOG_DATA_MAGIC) -> Column:
    head = F.concat(be(magic if isinstance(magic, Column) else F.lit(magic), 4), be(size, 4), be(offset + LOG_HEADER, 8), be(body_crc, 4))
    return F.concat(head, be(crc(head), 4))


def log_field(data: Column, name: str) -> Column:
    at, size = {"magic": (0, 4), "size": (4, 4), "body_offset": (8, 8), "body_crc": (16, 4), "header_crc": (20, 4)}[name]
    return number(part(data, F.lit(at), size))


def is_log_header(data: Column) -> Column:
    """Whole, with its own checksum and a known magic."""
    known = log_field(data, "magic").isin(LOG_DATA_MAGIC, LOG_EMPTY_MAGIC)
    return (F.octet_length(data) >= LOG_HEADER) & (crc(part(data, F.lit(0), LOG_HEADER - 4)) == log_field(data, "header_crc")) & known


def hx(e: str, n: int) -> str:
    """SQL: a whole number in n bytes, as hex."""
    return f"lpad(upper(to_hex({e})), {2 * n}, '0')"


def ht(e: str) -> str:
    """SQL: a text behind its length, as hex."""
    return f"{hx(f'CAST(strlen({e}) AS BIGINT)', 4)} || hex({e})"


def with_headers(r: DataFrame) -> DataFrame:
    """No header, one, or two."""
    e = F.col("event_id") % 4
    kind, user = (F.lit("type"), F.col("header_type")), (F.lit("user"), F.col("stream_id").cast("string"))
    return r.withColumn("headers", F.when(e == 1, F.create_map().cast("map<string,string>")).when(e == 3, F.create_map(*user, *kind)).otherwise(F.create_map(*kind)))


H_HEX = f"CASE event_id % 4 WHEN 1 THEN '00000000' WHEN 3 THEN '00000002' || {ht(chr(39) + 'type' + chr(39))} || {ht('header_type')} || {ht(chr(39) + 'user' + chr(39))} || {ht('CAST(stream_id AS VARCHAR)')} ELSE '00000001' || {ht(chr(39) + 'type' + chr(39))} || {ht('header_type')} END"
H_TEXT = "CASE event_id % 4 WHEN 1 THEN '' WHEN 3 THEN 'type=' || header_type || '&user=' || stream_id ELSE 'type=' || header_type END"


@query("envelope_codec", sql(f"SELECT stream_id, off, '01' || {hx('ts_ms', 8)} || {H_HEX} || hex(body) AS wire, ts_ms, {H_TEXT} AS headers, body, true AS refused FROM records", "records"))
def envelope_codec(spark: SparkSession, d: str) -> DataFrame:
    """Records in their envelope, what the envelope gives back, and whether another version is refused."""
    r = with_headers(records(spark, d)).select("stream_id", "off", encode_envelope(F.col("ts_ms"), F.col("headers"), F.col("body")).alias("data"))
    data = F.col("data")
    r = r.withColumn("h", decode_headers(data, F.lit(9)))
    other = F.concat(be(F.lit(9), 1), part(data, F.lit(1), F.octet_length(data) - 1))
    return r.where(envelope_version(data)).select("stream_id", "off", F.hex(data).alias("wire"), number(part(data, F.lit(1), 8)).alias("ts_ms"), shown(F.col("h")).alias("headers"), part(data, F.col("h.at"), F.octet_length(data) - F.col("h.at")).cast("string").alias("body"), (~envelope_version(other)).alias("refused"))


def five(spark: SparkSession, d: str) -> DataFrame:
    """Five records of a stream in each batch, in order."""
    r = with_headers(records(spark, d))
    g = r.groupBy("stream_id", F.expr("off div 5").alias("batch")).agg(F.min("off").alias("base"), F.array_sort(F.collect_list(F.struct("off", "event_id", "ts_ms", "body", F.array_sort(F.map_entries("headers")).alias("h")))).alias("r"))
    rows = F.transform("r", lambda x: F.struct(x["off"].alias("off"), x["ts_ms"].alias("ts_ms"), F.map_from_entries(x["h"]).alias("headers"), x["body"].alias("body")))
    return g.select("stream_id", "batch", "base", rows.alias("rows"), F.transform("r", lambda x: x["body"]).alias("bodies"))


FRAMES = f"'01' || {hx('count(*)', 4)} || string_agg({ht('body')}, '' ORDER BY off)"


@query("frames_encode", sql(f"SELECT stream_id, off // 5 AS batch, {FRAMES} AS wire FROM records GROUP BY ALL", "records"))
def frames_encode(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as one frame list."""
    return five(spark, d).select("stream_id", "batch", F.hex(encode_frames(F.col("bodies"))).alias("wire"))


@query("frames_decode", sql("SELECT stream_id, off // 5 AS batch, count(*) AS n, string_agg(body, '|' ORDER BY off) AS bodies, 3 AS refused FROM records GROUP BY ALL", "records"))
def frames_decode(spark: SparkSession, d: str) -> DataFrame:
    """Frame lists taken apart; of a cut one, a longer one and another version none is read."""
    data = F.col("data")
    broken = [part(data, F.lit(0), F.octet_length(data) - 1), F.concat(data, be(F.lit(0), 1)), F.concat(be(F.lit(2), 1), part(data, F.lit(1), F.octet_length(data) - 1))]
    r = five(spark, d).select("stream_id", "batch", encode_frames(F.col("bodies")).alias("data"))
    r = r.select("stream_id", "batch", F.transform(decode_frames(data), lambda b: b.cast("string")).alias("b"), sum(decode_frames(x).isNull().cast("int") for x in broken).alias("refused"))
    return r.select("stream_id", "batch", F.size("b").cast("long").alias("n"), F.array_join("b", "|").alias("bodies"), "refused")


@query("batch_codec", sql(f"SELECT stream_id, off // 5 AS batch, '01' || {hx('count(*)', 4)} || string_agg({H_HEX} || {ht('body')}, '' ORDER BY off) AS append_wire, '01' || {hx('count(*)', 4)} || string_agg({hx('off', 8)} || {hx('ts_ms', 8)} || {H_HEX} || {ht('body')}, '' ORDER BY off) AS read_wire, string_agg({H_TEXT} || ':' || body, '|' ORDER BY off) AS appended, string_agg(off || ':' || ts_ms || ':' || {H_TEXT} || ':' || body, '|' ORDER BY off) AS got, true AS refused FROM records GROUP BY ALL", "records"))
def batch_codec(spark: SparkSession, d: str) -> DataFrame:
    """Batches in the form that is appended and in the one that is read, and what each gives back."""
    a, b = F.col("a"), F.col("b")
    r = five(spark, d).select("stream_id", "batch", encode_batch(F.col("rows"), False).alias("a"), encode_batch(F.col("rows"), True).alias("b"))
    text = lambda x, *front: F.concat_ws(":", *front, x["headers"], x["body"])
    appended = F.array_join(F.transform(decode_batch(a, False), lambda x: text(x)), "|")
    got = F.array_join(F.transform(decode_batch(b, True), lambda x: text(x, x["off"].cast("string"), x["ts_ms"].cast("string"))), "|")
    other = F.concat(be(F.lit(2), 1), part(a, F.lit(1), F.octet_length(a) - 1))
    return r.select("stream_id", "batch", F.hex(a).alias("append_wire"), F.hex(b).alias("read_wire"), appended.alias("appended"), got.alias("got"), decode_batch(other, False).isNull().alias("refused"))


@query("record_codec", sql(f"+ b AS (SELECT stream_id, off // 5 AS batch, min(off) AS base, count(*) AS k, {FRAMES} AS payload FROM records GROUP BY ALL) SELECT stream_id, batch, '22' || {hx('stream_id', 8)} || {hx('batch', 8)} || {hx('base', 8)} || {hx('CASE WHEN batch % 3 = 2 THEN 4294967296 - k ELSE k END', 4)} || {hx('length(payload) // 2', 4)} || payload AS wire, batch AS epoch, CASE WHEN batch % 3 = 2 THEN -k ELSE k END AS n, base + k AS end_off, 2 AS refused FROM b", "records"))
def record_codec(spark: SparkSession, d: str) -> DataFrame:
    """Record batches and their fields; every third is a link, of a negative count. Another magic and a payload cut short are refused."""
    n = F.size("bodies")
    data = F.col("data")
    r = five(spark, d).select(encode_record(F.col("stream_id"), F.col("batch"), F.col("base"), F.when(F.col("batch") % 3 == 2, -n).otherwise(n), encode_frames(F.col("bodies"))).alias("data"))
    broken = [F.concat(be(F.lit(0x23), 1), part(data, F.lit(1), F.octet_length(data) - 1)), part(data, F.lit(0), F.octet_length(data) - 1)]
    r = r.where(is_record(data))
    count = record_field(data, "count")
    return r.select(record_field(data, "stream_id").alias("stream_id"), record_field(data, "epoch").alias("batch"), F.hex(data).alias("wire"), record_field(data, "epoch").alias("epoch"), count.alias("n"), end_offset(record_field(data, "base"), count).alias("end_off"), sum((~is_record(x)).cast("int") for x in broken).alias("refused"))


def log_records(spark: SparkSession, d: str) -> DataFrame:
    """Records framed for the log, each behind the ones before it; every tenth event is padding."""
    r = records(spark, d)
    pad = F.col("event_id") % 10 == 9
    size = F.octet_length("body").cast("long")
    w = Window.partitionBy("stream_id").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(size + LOG_HEADER).over(w), F.lit(0).cast("long"))
    r = r.select("stream_id", "off", "event_id", "body", pad.alias("pad"), size.alias("size"), place.alias("place"))
    head = log_header(F.col("place"), F.col("size"), F.when(pad, F.lit(0).cast("long")).otherwise(crc(F.col("body").cast("binary"))), F.when(pad, F.lit(LOG_EMPTY_MAGIC)).otherwise(F.lit(LOG_DATA_MAGIC)))
    return r.withColumn("head", head)


@query("wal_record_header", sql(f"SELECT stream_id, off, CASE WHEN event_id % 10 = 9 THEN '76543210' ELSE '87654321' END || {hx('CAST(strlen(body) AS BIGINT)', 4)} || {hx('place + 24', 8)} AS front, CAST(strlen(body) AS BIGINT) AS size, place + 24 AS body_offset, event_id % 10 = 9 AS padding, true AS body_fits, true AS valid, 2 AS refused FROM (SELECT *, CAST(coalesce(sum(strlen(body) + 24) OVER (PARTITION BY stream_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM records)", "records"))
def wal_record_header(spark: SparkSession, d: str) -> DataFrame:
    """The 24 bytes before each body of the log: a changed byte is refused, and an unknown magic too, though its checksum is right."""
    head = F.col("head")
    r = log_records(spark, d)
    at = F.col("off") % LOG_HEADER
    flipped = F.concat(part(head, F.lit(0), at), be(number(part(head, at, 1)).bitwiseXOR(F.lit(0x40)), 1), part(head, at + 1, LOG_HEADER - 1 - at))
    foreign = log_header(F.col("place"), F.col("size"), F.lit(0).cast("long"), 0x57414C31)
    fits = F.col("pad") | (log_field(head, "body_crc") == crc(F.col("body").cast("binary")))
    return r.select("stream_id", "off", F.hex(part(head, F.lit(0), 16)).alias("front"), log_field(head, "size").alias("size"), log_field(head, "body_offset").alias("body_offset"), (log_field(head, "magic") == LOG_EMPTY_MAGIC).alias("padding"), fits.alias("body_fits"), is_log_header(head).alias("valid"), ((~is_log_header(flipped)).cast("int") + (~is_log_header(foreign)).cast("int")).alias("refused"))


@query("wal_crc")
def wal_crc(spark: SparkSession, d: str) -> DataFrame:
    """CRC-32 masked to 31 bits."""
    return records(spark, d).select("stream_id", "off", crc(F.col("body").cast("binary")).alias("crc"))


@query("wal_recover_iter", sql("SELECT stream_id, off, place, body FROM (SELECT *, CAST(coalesce(sum(strlen(body) + 24) OVER (PARTITION BY stream_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, coalesce(min(off) FILTER (event_id % 10 = 9 OR event_id % 37 = 11) OVER (PARTITION BY stream_id), 1000000000) AS stop FROM records) WHERE off < stop AND place > 300 AND event_id % 19 <> 3", "records"))
def wal_recover_iter(spark: SparkSession, d: str, trim: int = 300) -> DataFrame:
    """Records of the log decoded one after another: it ends at the first one that isn't whole (another magic than data's, a checksum that doesn't fit its header or body); trim marks and what lies at or before the trim point are left out."""
    r = log_records(spark, d)
    data = F.when(F.col("event_id") % 37 == 11, F.concat(F.col("body"), F.lit("!"))).otherwise(F.col("body")).cast("binary")  # written wrongly
    head = F.col("head")
    whole = is_log_header(head) & (log_field(head, "magic") == LOG_DATA_MAGIC) & (log_field(head, "size") == F.octet_length(data)) & (log_field(head, "body_crc") == crc(data))
    stop = F.min(F.when(~whole, F.col("off"))).over(Window.partitionBy("stream_id"))
    r = r.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("off") < F.col("stop")))
    return r.where((F.col("place") > trim) & (F.col("event_id") % 19 != 3)).select("stream_id", "off", "place", "body")


@query("link_decode", sql("SELECT stream_id, off, CASE WHEN off % 4 = 0 THEN off + 3 ELSE off + 1 END AS end_off, CASE WHEN off % 4 <> 0 THEN body WHEN stream_id % 3 <> 0 THEN 'decoded:' || body END AS body, off % 4 = 0 AND stream_id % 3 = 0 AS error FROM records", "records"))
def link_decode(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a negative count are links, replaced through the stream's decoder; a stream without one gives an error."""
    r = records(spark, d).withColumn("n", F.when(F.col("off") % 4 == 0, F.lit(-3)).otherwise(F.lit(1)))
    decoder = F.when(F.col("stream_id") % 3 != 0, F.lit("decoded:"))
    link = F.col("n") < 0
    return r.select("stream_id", "off", end_offset(F.col("off"), F.col("n")).alias("end_off"), F.when(link, F.concat(decoder, "body")).otherwise(F.col("body")).alias("body"), (link & decoder.isNull()).alias("error"))


def base64(c: Column) -> Column:
    """Without the line breaks that Spark puts in."""
    return F.regexp_replace(F.base64(c.cast("binary")), "\r\n", "")


def sse_lines(text: Column) -> Column:
    """The text's lines, each as a line of data; any line break separates."""
    return F.array_join(F.transform(F.split(text, "\r\n|\r|\n", -1), lambda x: F.concat(F.lit("data:"), x, F.lit("\n"))), "")


def sse_data(mime: Column, bodies: Column) -> Column:
    """The data event of a page: a JSON array, lines of text, or else base64."""
    as_json, plain = F.concat(F.lit("["), F.array_join(bodies, ","), F.lit("]")), F.array_join(bodies, "")
    json, text = mime == "application/json", mime.startswith("text/")
    lines = F.when(json, sse_lines(as_json)).when(text, sse_lines(plain)).otherwise(F.concat(F.lit("data:"), base64(plain), F.lit("\n")))
    return F.concat(F.lit("event: data\n"), lines, F.lit("\n"))


def sse_control(next_off: Column, up_to_date: Column, closed: Column) -> Column:
    """Where to go on, whether that is the tail, and whether the stream ends there."""
    body = F.concat(F.lit('{"streamNextOffset":"'), F.lpad(next_off.cast("string"), 20, "0"), F.lit('","upToDate":'), up_to_date.cast("string"), F.when(closed, F.lit(',"streamClosed":true')).otherwise(F.lit("")), F.lit("}"))
    return F.concat(F.lit("event: control\ndata:"), body, F.lit("\n\n"))


MIMES = ("application/json", "text/plain", "application/octet-stream")
PAGE_SQL = "p AS (SELECT r.stream_id, off // 7 AS page, min(r.stream_id % 3) AS m, string_agg(body, ',' ORDER BY off) AS js, string_agg(body || CASE WHEN off % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END, '' ORDER BY off) AS txt, max(off) + 1 AS next_off, max(off) + 1 = max(end_off) AS tail, bool_or(closed) AND max(off) + 1 = max(end_off) AS shut FROM records r JOIN streams USING (stream_id) GROUP BY ALL)"
EVENT_SQL = "'event: data' || chr(10) || CASE m WHEN 0 THEN 'data:[' || js || ']' || chr(10) WHEN 1 THEN 'data:' || replace(replace(txt, chr(13) || chr(10), chr(10)), chr(10), chr(10) || 'data:') || chr(10) ELSE 'data:' || base64(encode(txt)) || chr(10) END || chr(10)"
CONTROL_SQL = "'event: control' || chr(10) || 'data:{\"streamNextOffset\":\"' || lpad(CAST(next_off AS VARCHAR), 20, '0') || '\",\"upToDate\":' || CAST(tail AS VARCHAR) || CASE WHEN shut THEN ',\"streamClosed\":true' ELSE '' END || '}' || chr(10) || chr(10)"


def sse_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of seven records as events, in the stream's own mode."""
    from ..sources.tables import streams

    s = streams(spark, d).select("stream_id", "end_off", "closed")
    line = F.when(F.col("off") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    body = F.when(F.col("stream_id") % 3 == 0, F.col("body")).otherwise(F.concat("body", line))
    r = records(spark, d).select("stream_id", "off", F.expr("off div 7").alias("page"), body.alias("b"))
    g = r.groupBy("stream_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "b"))), lambda x: x["b"]).alias("bodies"), (F.max("off") + 1).alias("next_off")).join(s, "stream_id")
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("stream_id") % 3 + 1).cast("int"))
    tail = F.col("next_off") == F.col("end_off")
    return g.select("stream_id", "page", "next_off", sse_data(mime, F.col("bodies")).alias("event"), sse_control(F.col("next_off"), tail, F.col("closed") & tail).alias("control"), tail.alias("tail"), (F.col("closed") & tail).alias("shut"))


@query("sse_encode", sql(f"+ {PAGE_SQL} SELECT stream_id, page, {EVENT_SQL} AS event, {CONTROL_SQL} AS control FROM p", "records", "streams"))
def sse_encode(spark: SparkSession, d: str) -> DataFrame:
    """A data event in the mode of the stream's type, and the control event behind it."""
    return sse_pages(spark, d).select("stream_id", "page", "event", "control")


@query("sse_live", sql(f"+ {PAGE_SQL}, e AS (SELECT stream_id, page * 2 AS k, {EVENT_SQL} AS event FROM p UNION ALL SELECT stream_id, page * 2 + 1, {CONTROL_SQL} FROM p) SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY k) AS place, event FROM e", "records", "streams"))
def sse_live(spark: SparkSession, d: str) -> DataFrame:
    """A live connection from the beginning: each page's data and control events in order, until one says that the stream is closed at its tail, or up to date."""
    p = sse_pages(spark, d)
    e = p.select("stream_id", F.posexplode(F.array("event", "control")).alias("i", "event"), "page")
    return e.select("stream_id", (F.col("page") * 2 + F.col("i") + 1).cast("long").alias("place"), "event")


@query("block_writer", sql("+ b AS (SELECT object_id, stream_id, start_off, end_off, size, CAST(sum(size) OVER w - size AS BIGINT) AS pos, lag(end_off) OVER w IS DISTINCT FROM start_off AS cut FROM objects WINDOW w AS (PARTITION BY stream_id ORDER BY start_off)), g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY stream_id ORDER BY start_off) AS grp FROM b) SELECT stream_id, min(start_off) AS start_off, max(end_off) AS end_off, min(pos) AS pos, CAST(sum(size) AS BIGINT) AS size, CAST(sum(end_off - start_off) AS BIGINT) AS n FROM g GROUP BY stream_id, grp", "objects"))
def block_writer(spark: SparkSession, d: str) -> DataFrame:
    """Blocks rewritten one after another in the order of stream and offset, and the regrouped index: an entry for each contiguous run, with its place and size."""
    w = Window.partitionBy("stream_id").orderBy("start_off")
    b = objects(spark, d).select("stream_id", "start_off", "end_off", "size").withColumn("pos", F.sum("size").over(w) - F.col("size"))
    b = b.withColumn("cut", (~F.col("start_off").eqNullSafe(F.lag("end_off").over(w))).cast("int"))
    b = b.withColumn("grp", F.sum("cut").over(w))
    return b.groupBy("stream_id", "grp").agg(F.min("start_off").alias("start_off"), F.max("end_off").alias("end_off"), F.min("pos").alias("pos"), F.sum("size").alias("size"), F.sum(F.col("end_off") - F.col("start_off")).alias("n")).drop("grp")
