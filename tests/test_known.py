"""Known answers and properties."""

import random

import pytest
from pyspark.sql import functions as F

from streamloom.functions.codecs import object_key, offset_token, parse_token
from streamloom.operators.cache import MERGE_FROM, coalesce_step, merge_step
from streamloom.operators.compaction import evict_once, plan_blocks
from streamloom.operators.reads import page
from streamloom.operators.state import append_step, decide, recover_step, session_step, ttl_step
from streamloom.plans.metadata import EMPTY, OPS, apply, lease, release


def test_tokens(spark):
    df = spark.createDataFrame([("7",), (None,), ("-1",), ("-7",), ("42",), ("nope",), ("",)], "t string")
    got = [r.x for r in df.select(parse_token(F.col("t")).alias("x")).collect()]
    assert got == [7, 0, 0, 0, 42, None, None]
    assert spark.range(7, 8).select(offset_token(F.col("id"))).first()[0] == "00000000000000000007"


def test_object_keys(spark):
    df = spark.createDataFrame([(0,), (255,), (123456789,), (2**63 - 1,)], "i long")
    got = [r.k for r in df.select(object_key(F.col("i")).alias("k")).collect()]
    assert got == ["00000000/DEFAULT/0", "ff000000/DEFAULT/255", "51dcb570/DEFAULT/123456789", "fffffffffffffff7/DEFAULT/9223372036854775807"]


def test_crc(spark):
    assert spark.sql("SELECT crc32(CAST('123456789' AS BINARY)) & 2147483647").first()[0] == 1274296614


def test_producer_table():
    state, seen = None, []
    for epoch, seq in ((1, 0), (1, 0), (1, 2), (2, 0), (1, 1), (3, 4), (2, 1)):
        state, decision = decide(state, epoch, seq)
        seen.append(decision)
    assert seen == ["accepted", "duplicate", "sequence_gap", "accepted", "stale_epoch", "invalid_epoch_seq", "accepted"]
    assert decide(None, 9, 1) == (None, "invalid_epoch_seq")


def test_page_with_empty_records(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 50), (1, 3, 1), (2, 0, 5), (2, 1, 5), (2, 2, 6)], "stream_id long, off long, len long")
    got = sorted((r.stream_id, r.off) for r in page(df, 10, 0).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert page(df.limit(0), 10, 3).count() == 0


def test_recovery():
    state, kept = None, []
    for place, base in enumerate((1, 2, 3, 4, 6, 5)):
        state, out = recover_step(state, {"stream_id": 1, "place": place, "base": base, "first": 3})
        kept += [out["base"]] if out else []
    assert kept == [3, 4, 5] and state == 6


def test_plan_aborts_on_overlap():
    assert plan_blocks([(0, 0, 20, 20), (0, 20, 25, 5), (1, 30, 60, 30), (1, 60, 120, 60), (1, 230, 270, 40), (1, 400, 500, 100)], 80) == [(0, 0, 25, "compact"), (1, 30, 120, "split"), (1, 230, 270, "split"), (1, 400, 500, "split")]
    with pytest.raises(ValueError):
        plan_blocks([(0, 0, 20, 20), (0, 10, 25, 5)], 80)


def test_eviction_goes_round_and_keeps_first_and_last():
    left, at, seen = [0, 1, 2, 3, 4, 5], 0, []
    while left:
        _, left, at = evict_once(left, at, 2)
        seen.append(left)
    assert seen == [[0, 2, 3, 4, 5], [0, 2, 4, 5], [0, 4, 5], [0, 5], [0], []]


def test_ttl_is_coarse():
    state, first = ttl_step(None, {"stream_id": 1, "off": 0, "ts_ms": 0})
    assert ttl_step(state, {"stream_id": 1, "off": 1, "ts_ms": 1000})[0] == state
    assert ttl_step(state, {"stream_id": 1, "off": 1, "ts_ms": 9_000_000})[0] > state


def test_failed_commands_change_nothing_and_replay_is_deterministic():
    rng = random.Random(5)
    for _ in range(200):
        log = [(rng.choice(OPS), rng.randrange(4), rng.randrange(5), None, rng.randrange(2), rng.randrange(30), rng.randrange(4), rng.randrange(5)) for _ in range(rng.randrange(60))]
        state = EMPTY
        for command in log:
            after, result = apply(state, *command)
            assert result == "ok" or after == state
            assert after[2] <= after[3] and (after[5] is None) == (after[6] is None)
            state = after
        cut = rng.randrange(len(log) + 1)
        middle = EMPTY
        for c in log[:cut]:
            middle = apply(middle, *c)[0]
        for c in log[cut:]:
            middle = apply(middle, *c)[0]
        assert middle == state


def test_lease():
    state, won = lease((None, 0, 0), "a", 10, 5)
    assert won and state == ("a", 1, 15)
    assert lease(state, "b", 12, 5) == (state, False)
    assert lease(state, "a", 12, 5) == (("a", 1, 17), True)
    assert lease(state, "b", 15, 5) == (state, False) and lease(state, "a", 15, 5) == (("a", 1, 20), True)
    assert lease(state, "b", 16, 5) == (("b", 2, 21), True)
    assert release(("a", 3, 9), "a", 2) == (("a", 3, 9), False) and release(("a", 3, 9), "b", 3)[1] is False
    assert release(("a", 3, 9), "a", 3) == ((None, 3, 0), True)


def test_commands_of_a_move():
    state, seen = EMPTY, []
    for command in (("transfer", 0, 0, None, 0, 0, 1, 2), ("open", 3, 1, 11), ("open", 3, 2, 12), ("open", 3, 1, 11), ("open", 2, 1, 11), ("open", 4, 1, 11), ("commit", 3, 1, 11), ("commit", 3, 1, 11, 1), ("commit", 3, 1, 10), ("commit", 3, 9, 19), ("trim", 3, 1, 11, 0, 11), ("trim", 3, 1, 11, 0, 7), ("trim", 3, 1, 11, 0, 6), ("transfer", 3, 0, None, 0, 0, 1, 1), ("transfer", 3, 0, None, 0, 0, 1, 4), ("transfer", 3, 0, None, 0, 0, 0, 2), ("transfer", 3, 0, None, 0, 0, 1, 2), ("transfer", 3, 0, None, 0, 0, 1, 2), ("transfer", 3, 0, None, 0, 0, 1, 3), ("complete", 3), ("close", 2, 1, 11), ("close", 3, 1, 11), ("close", 3, 1, 11), ("commit", 3, 1, 11), ("complete", 2), ("complete", 3), ("complete", 3), ("open", 4, 2, 12)):
        state, result = apply(state, *command)
        seen.append(result)
    assert seen == ["not_owner", "ok", "fenced", "ok", "fenced", "not_closed", "ok", "offset", "node_epoch", "not_registered", "beyond_end", "ok", "below_start", "same_node", "no_target", "not_owner", "ok", "ok", "pending", "not_closed", "expired_epoch", "ok", "ok", "ok", "expired_epoch", "ok", "redundant", "ok"]
    assert state == (4, True, 7, 20, 2, None, None, True)
    seen = []
    for command in (("create", 0, 1, 11), ("delete", 4, 1, 11), ("close", 4, 2, 12), ("delete", 3, 1, 11), ("delete", 4, 1, 11), ("delete", 9, 1, 11), ("open", 5, 1, 11), ("transfer", 4, 0, None, 0, 0, 1, 2), ("create", 0, 1, 11), ("open", 0, 1, 11)):
        state, result = apply(state, *command)
        seen.append(result)
    assert seen == ["exists", "not_closed", "ok", "expired_epoch", "ok", "ok", "not_exist", "not_exist", "ok", "ok"] and state == (0, True, 0, 0, 1, None, None, True)


def test_stateful_stream_decides_as_the_batch_fold(spark):
    from streamloom.operators.state import producer_fsm
    from streamloom.streaming.tail import dedup_stream

    d = "/root/testdata/sf0.001"
    assert sorted(map(tuple, dedup_stream(spark, d).collect())) == sorted(map(tuple, producer_fsm(spark, d).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_formats_byte_by_byte(spark):
    from streamloom.functions import wire

    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    hexed = lambda c: get(F.lower(F.hex(c)))
    raw = lambda h: F.unhex(F.lit(h))
    ends = [(3, 2), (1000, -8), (7, 0)]
    assert [get(wire.end_offset(F.lit(a), F.lit(b))) for a, b in ends] == [5, 1008, 7]
    frames = F.array(*[F.lit(x).cast("binary") for x in ("a", "", "ccc")])
    data = "01" + "00000003" + "0000000161" + "00000000" + "00000003636363"
    assert hexed(wire.encode_frames(frames)) == data
    assert [bytes(x) for x in get(wire.decode_frames(raw(data)))] == [b"a", b"", b"ccc"]
    for broken in (data[:-2], data + "00", "02" + data[2:], "", "01", "017fffffff"):
        assert get(wire.decode_frames(raw(broken))) is None
    headers = F.create_map(F.lit("k"), F.lit("v"), F.lit("a"), F.lit("é"))
    envelope = "01" + "0000018bcfe56800" + "00000002" + "0000000161" + "00000002c3a9" + "000000016b" + "0000000176" + "6869"
    assert hexed(wire.encode_envelope(F.lit(1700000000000), headers, F.lit("hi"))) == envelope
    assert get(wire.shown(wire.decode_headers(raw(envelope), F.lit(9)))) == "a=é&k=v"
    record = "22" + "0000000000000005" + "ffffffffffffffff" + "00000000000003e8" + "fffffff8" + "00000002" + "6162"
    assert hexed(wire.encode_record(F.lit(5), F.lit(-1), F.lit(1000), F.lit(-8), F.lit("ab"))) == record
    assert [get(wire.record_field(raw(record), n)) for n in ("stream_id", "epoch", "base", "count", "size")] == [5, -1, 1000, -8, 2] and get(wire.is_record(raw(record)))
    crc = lambda t: wire.crc(F.lit(t).cast("binary"))
    assert get(crc("123456789")) == 1274296614 and get(crc("")) == 0
    head = "876543210000000400000000000000655ba80bb235ff23b4"
    assert hexed(wire.log_header(F.lit(77), F.lit(4), crc("body"))) == head
    assert hexed(wire.log_header(F.lit(100), F.lit(8), F.lit(0), wire.LOG_EMPTY_MAGIC)) == "7654321000000008000000000000007c0000000074574fd5"
    assert get(wire.is_log_header(raw(head))) and get(wire.log_field(raw(head), "body_offset")) == 101
    flips = [head[: 2 * i] + f"{int(head[2 * i : 2 * i + 2], 16) ^ 1:02x}" + head[2 * i + 2 :] for i in range(24)]
    foreign = wire.log_header(F.lit(77), F.lit(4), crc("body"), 0x11111111)
    assert not any(one.select(*[wire.is_log_header(raw(x)).alias(f"x{i}") for i, x in enumerate(flips)], wire.is_log_header(foreign).alias("y")).first())


def test_batches_byte_by_byte(spark):
    from streamloom.functions import wire

    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    raw = lambda h: F.unhex(F.lit(h))
    none, two = F.create_map().cast("map<string,string>"), F.create_map(F.lit("k"), F.lit("v"), F.lit("a"), F.lit("é"))
    row = lambda off, ts, headers, body: F.struct(F.lit(off).alias("off"), F.lit(ts).alias("ts_ms"), headers.alias("headers"), F.lit(body).alias("body"))
    rows = F.array(row(-1, 1700000000000, two, "hi"), row(8, 5, none, ""))
    one = "00000002" + "0000000161" + "00000002c3a9" + "000000016b" + "0000000176" + "00000002" + "6869"
    append = "01" + "00000002" + one + "00000000" + "00000000"
    read = "01" + "00000002" + "ffffffffffffffff" + "0000018bcfe56800" + one + "0000000000000008" + "0000000000000005" + "00000000" + "00000000"
    assert get(F.lower(F.hex(wire.encode_batch(rows, False)))) == append
    assert get(F.lower(F.hex(wire.encode_batch(rows, True)))) == read
    assert [tuple(r) for r in get(wire.decode_batch(raw(append), False))] == [(None, None, "a=é&k=v", "hi"), (None, None, "", "")]
    assert [tuple(r) for r in get(wire.decode_batch(raw(read), True))] == [(-1, 1700000000000, "a=é&k=v", "hi"), (8, 5, "", "")]
    assert get(wire.decode_batch(raw("0100000000"), True)) == []
    cut = [x[: 2 * i] for x in (append, read) for i in range(len(x) // 2)]
    other = ["02" + append[2:], "01ffffffff" + append[10:], "0100000001" + "ffffffff" + append[18:], "0100000001" + "00000000" + "ffffffff", "0100000001" + "00000001" + "ffffffff" + append[26:]]
    seen = spark.createDataFrame([(x,) for x in cut + other], "h string").select(wire.decode_batch(F.unhex("h"), False).alias("a"), wire.decode_batch(F.unhex("h"), True).alias("b")).collect()
    assert all(r.a is None for r in seen[: len(append) // 2]) and all(r.b is None for r in seen[len(append) // 2 : len(cut)])
    assert all(r.a is None for r in seen[len(cut) :])
    headers = wire.decode_headers(raw("00000001" + "0000000161" + "0000000962"), F.lit(0))
    assert get(wire.shown(headers)) is None


def test_decoding_names_each_step_once(spark):
    """A value that is named in several places is written out in each, and with nested loops the work multiplies."""
    from streamloom.queries import QUERIES

    for name, most in (("batch_codec", 6), ("frames_decode", 4), ("envelope_codec", 1)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("aggregate(") <= most, name


def test_json_bodies(spark):
    from streamloom.functions.codecs import append_request, json_record, messages

    rows = [('[{"a":1}, 2, "x"]', True, False), (' {"b": 2} ', True, False), ("[]", True, False), ("[]", True, True), ("{oops", True, False), ('"t"', True, False), ("[1", False, False)]
    df = spark.createDataFrame(rows, "body string, js boolean, mk boolean")
    got = [(r.m.records, r.m.error) for r in df.select(messages(F.col("body"), F.col("js"), F.col("mk")).alias("m")).collect()]
    assert got == [(['{"a":1}', "2", '"x"'], None), (['{"b":2}'], None), ([], "empty JSON array not allowed"), ([], None), ([], "invalid JSON"), (['"t"'], None), (["[1"], None)]
    asked = ['{"records":[{"body":"a","headers":{"type":"t"}},{}]}', '{"records":[{"body":"a","body_b64":"Yg=="}]}', '{"records":[{"body_b64":"*"}]}', '{"records":[{"body":7,"headers":{"type":7}}]}', '{"records":[]}', "{}", "x"]
    got = [r.m for r in spark.createDataFrame([(a,) for a in asked], "q string").select(append_request(F.col("q")).alias("m")).collect()]
    assert [None if m.records is None else [(x.body, x.header) for x in m.records] for m in got] == [[("a", "t"), ("", None)], [("b", None)], None, [("", "7")], None, None, None]
    assert [m.error for m in got] == [None, None, "invalid body_b64", None, "records must be a non-empty array", "records must be a non-empty array", "invalid JSON"]
    none = F.create_map().cast("map<string,string>")
    line = lambda body: spark.range(1).select(json_record(F.lit(1), F.lit(2), none, body)).first()[0]
    assert line(F.lit("é").cast("binary")) == '{"seq":1,"timestamp":2,"body":"é"}' and line(F.unhex(F.lit("FF00"))) == '{"seq":1,"timestamp":2,"body_b64":"/wA="}'


def test_tail_window(spark):
    from streamloom.operators.reads import tail_window

    offs = [0, 1, 2, 1, 5, 6, 7, 6, 8]  # 1 and 6 come again, 3 and 4 are missing
    df = spark.createDataFrame([(1, i, off, 10) for i, off in enumerate(offs)], "stream_id long, event_id long, off long, len long")
    held = lambda n, size: sorted(r.off for r in tail_window(df, n, size).collect())
    assert held(4096, 4 << 20) == [5, 6, 7, 8] and held(2, 1000) == [7, 8] and held(9, 35) == [6, 7, 8] and held(9, 5) == [8]


def test_log_keys(spark):
    from streamloom.operators.reads import wal_objects

    keys = ["P/_kafka_c/7/3/wal/100-250", "P/_kafka_c/7/3/wal/100", "x/y", "a/b/c/9", "P/_kafka_c/7/3/wal/1-x"]
    got = wal_objects(spark.createDataFrame([(k, 140) for k in keys], "key string, size long")).collect()
    assert sorted((r.epoch, r.start_off, r.end_off) for r in got) == [(3, 100, 200), (3, 100, 250)]


def merged(blocks, most):
    """Cache blocks merged pair by pair in a list, as lists of block ids."""
    held = [{"ids": [b["block_id"]], "size": b["size"], "free": b["free"], "at": {s["stream_id"]: (s["start_off"], s["end_off"]) for s in b["streams"]}} for b in blocks]
    i = 0
    while len(held) > MERGE_FROM and i + 1 < len(held):
        a, b = held[i], held[i + 1]
        if not a["free"] or not b["free"]:
            break
        if a["size"] + b["size"] >= most or any(k in b["at"] and b["at"][k][0] != v[1] for k, v in a["at"].items()):
            i += 1
            continue
        at = dict(a["at"])
        for k, v in b["at"].items():
            at[k] = (at.get(k, v)[0], v[1])
        held[i : i + 2] = [{"ids": a["ids"] + b["ids"], "size": a["size"] + b["size"], "free": True, "at": at}]
    return [h["ids"] for h in held]


def test_cache_merge_is_the_merging_of_a_list():
    rng = random.Random(9)
    for _ in range(300):
        blocks, end, n = [], {}, rng.randrange(1, 40)
        for i in range(n):
            streams = []
            for s in rng.sample(range(6), rng.randrange(1, 4)):
                first = end.get(s, 0) + (rng.random() < 0.1)
                end[s] = first + rng.randrange(1, 5)
                streams.append({"stream_id": s, "start_off": first, "end_off": end[s]})
            blocks.append({"node_id": 1, "block_id": i, "size": rng.randrange(1, 30), "free": rng.random() < 0.97, "blocks": n, "streams": streams})
        state, groups = None, {}
        for b in blocks:
            state, out = merge_step(state, b, 60)
            groups.setdefault(out["grp"], []).append(out["block_id"])
        assert list(groups.values()) == merged(blocks, 60)


def test_reads_coalesce_and_large_blocks_stay_alone():
    state, runs, pos = (0, 0, None), [], 0
    for size in (10, 20, 200, 5, 5):
        state, out = coalesce_step(state, {"object_id": 1, "stream_id": 1, "pos": pos, "size": size}, 100)
        runs.append(out["run"])
        pos += size
    assert runs == [0, 0, 1, 2, 2]
    assert coalesce_step(state, {"object_id": 1, "stream_id": 1, "pos": pos + 1, "size": 1}, 100)[1]["run"] == 3


def test_append_checks_in_order():
    row = {"stream_id": 1, "rn": 1, "epoch": 1, "seq": 0, "expected": None, "empty": False, "close": False}
    state, seen = (None, 0, False), []
    for change in ({}, {"expected": 9}, {"seq": 1, "expected": 0}, {"seq": 1, "empty": True}, {"seq": 1, "empty": True, "close": True}, {"seq": 1}, {"seq": 2}):
        state, out = append_step(state, {**row, **change})
        seen.append((out["result"], out["tail"], out["closed"]))
    assert seen == [("appended", 1, False), ("duplicate", 1, False), ("match_failed", 1, False), ("empty", 1, False), ("appended", 1, True), ("duplicate", 1, True), ("closed", 1, True)]


def test_a_session_is_poisoned_once():
    state, seen = (False, None, 0), []
    for off, (size, event) in enumerate(((5, 0), (99, 0), (5, 3), (5, 17), (5, 0))):
        state, out = session_step(state, {"stream_id": 1, "off": off, "event_id": event, "len": size}, 20)
        seen.append((out["result"], out["seq"]))
    assert seen == [("accepted", 0), ("too_large", None), ("duplicate", 1), ("sequence_gap", 3), ("poisoned", None)]


def test_bulks_begin_at_the_alignment():
    from streamloom.operators.segments import bulk_step

    state, seen = (0, 0, 0), []
    for size in (30, 40, 60, 1):
        state, out = bulk_step(state, {"stream_id": 1, "off": 0, "len": size - 24}, 60, 100)
        seen.append((out["bulk"], out["place"]))
    assert seen == [(0, 0), (0, 30), (1, 100), (1, 160)]
