"""Filters, ids, statistics, validation and workloads on tiny fixtures with known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import functions as fn
from ledgerloom.errors import DecodeError, InvalidParams, QueryTooBroad
from ledgerloom.operators import postings, stats, workload
from ledgerloom.operators.clause import Clause, LogFilter, TraceFilter, TxFilter, page
from ledgerloom.operators.ids import assign_ids, block_windows, contiguous_runs, id_window, resolve_ids
from ledgerloom.sources import rlp
from ledgerloom.streaming import StreamValidator, event_source, first_error, run_stream, validate_stream, verdict

LOGS = "block_num long, address string, topic0 string, topic1 string, topic2 string, topic3 string"


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(1, "a1", "t1", None, None, None), (1, "a1", "t2", "x", None, None), (2, "a1", "t1", None, None, None), (2, "a2", "t1", "x", None, None), (2, "a3", None, None, None, None)]
    return spark.createDataFrame(rows, LOGS)


def one(df):
    return df.first().asDict()


def test_key_stats(logs):
    got = {(r["key_type"], r["key_value"]): r for r in stats.key_stats(logs).collect()}
    r = got["address", "a1"]
    assert (r["count_total"], r["first_block"], r["last_block"], r["active_block_count"], r["distinct_partner_estimate"]) == (3, 1, 2, 2, 2.0)
    assert got["address", "a3"]["distinct_partner_estimate"] is None and got["topic1", "x"]["distinct_partner_estimate"] is None
    assert got["topic0", "t1"]["distinct_partner_estimate"] == 2.0 and ("address_topic0", "a3") not in got


def test_top_pairs(logs):
    got = [(r["pair_type"], r["left_key"], r["right_key"], r["count_total"]) for r in stats.top_pairs(stats.cooccurrence(logs), 1).orderBy("pair_type").collect()]
    assert got == [("address_topic0", "a1", "t1", 2), ("topic0_topic1", "t1", "x", 1)]


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, "block_number long, n_logs long, timestamp long")


def test_histograms(spark):
    blocks = blocks_of(spark, [(1, 0, 100), (2, 1, 110), (3, 3, 150)])
    hist = lambda df: {(r["bucket_lower"], r["bucket_upper"]): r["count"] for r in df.collect()}
    assert hist(stats.logs_per_block(blocks)) == {(0, 1): 1, (1, 2): 1, (2, 4): 1}
    assert hist(stats.logs_per_window(blocks, 2)) == {(1, 2): 1, (2, 4): 1}
    assert hist(stats.interarrival(blocks)) == {(8, 16): 1, (32, 64): 1}
    back = blocks_of(spark, [(1, 0, 100), (2, 0, 0), (3, 0, 90), (4, 0, 95)])
    assert hist(stats.interarrival(back)) == {(4, 8): 1}
    assert hist(stats.logs_per_window(blocks_of(spark, [(10, 4, 1), (31, 1, 2)]), 10)) == {(4, 8): 1, (0, 1): 1, (1, 2): 1}


@pytest.mark.parametrize("span", [2, 1 << 16])
def test_gaps(spark, span):
    rows = stats.with_previous(blocks_of(spark, [(n, 0, 1) for n in (1, 2, 5, 6, 10)]), "block_number", "block_number", span=span)
    assert {(r["block_number"], r["_prev_block_number"]) for r in rows.collect()} == {(1, None), (2, 1), (5, 2), (6, 5), (10, 6)}
    got = stats.gaps(blocks_of(spark, [(n, 0, 1) for n in (1, 2, 5, 6, 10)])).orderBy("start").collect()
    assert [tuple(r) for r in got] == [(3, 4), (7, 9)]


def test_percentiles_halves_round_up(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v long")
    assert {r["share"]: r["value"] for r in stats.percentiles(df, "v", [0.0, 0.5, 0.95, 1.0]).collect()} == {0.0: 10, 0.5: 30, 0.95: 40, 1.0: 40}
    assert stats.percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_ids(spark):
    rows = spark.createDataFrame([(b, p) for b, n in ((1, 2), (3, 3), (4, 1)) for p in range(n)], "block_num long, pos long")
    got = assign_ids(rows, "pos", "row_id", next_id=10)
    assert [tuple(r) for r in got.orderBy("block_num", "pos").select("row_id").collect()] == [(n,) for n in range(10, 16)]
    windows = block_windows(rows, spark.range(1, 6).withColumnRenamed("id", "block_num"), 10)
    assert [tuple(r) for r in windows.orderBy("block_num").collect()] == [(1, 10, 2), (2, 12, 0), (3, 12, 3), (4, 15, 1), (5, 16, 0)]
    assert one(id_window(windows, 2, 3)) == {"first_id": 12, "last_id": 14} and one(id_window(windows, 2, 2)) == {"first_id": None, "last_id": None}
    probes = spark.range(9, 17).withColumnRenamed("id", "row_id")
    assert sorted((r["row_id"], r["block_num"], r["ordinal"]) for r in resolve_ids(probes, windows, span=2).collect()) == [(10, 1, 0), (11, 1, 1), (12, 3, 0), (13, 3, 1), (14, 3, 2), (15, 4, 0)]
    some = got.where("row_id <> 13")
    assert sorted((r["first_id"], r["last_id"], r["length"]) for r in contiguous_runs(some, "row_id").collect()) == [(10, 11, 2), (12, 12, 1), (14, 14, 1), (15, 15, 1)]


def test_id_algebra(spark):
    big = (5 << 24) + 4097
    r = spark.range(1).select(*[c.alias(n) for n, c in {"s": fn.shard_of(fn.long(big)), "l": fn.local_of(fn.long(big)), "p": fn.page_of(fn.long(big)), "b": fn.compose_id(fn.long(5), fn.long(4097))}.items()], fn.stream_id(F.lit("addr"), F.lit("AB"), fn.long(5)).alias("stream")).first()
    assert (r["s"], r["l"], r["p"], r["b"], r["stream"]) == (5, 4097, 4096, big, "addr/ab/0000000005")
    v = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, (1 << 53) + 1, (1 << 63) - 1)], "v long")
    got = [tuple(r) for r in v.select(fn.log2_lower(F.col("v")), fn.log2_upper(F.col("v"))).collect()]
    assert got == [(0, 1), (1, 2), (2, 4), (2, 4), (4, 8), (1 << 53, 1 << 54), (1 << 62, (1 << 63) - 1)]
    h = spark.createDataFrame([("00",), ("0000",), ("",), ("0100",), (None,)], "h string").select(fn.has_value(F.col("h"))).collect()
    assert [r[0] for r in h] == [False, False, False, True, False]


def test_clauses(logs):
    n = lambda f: f.apply(logs).count()
    assert n(LogFilter()) == n(LogFilter(topic1=Clause.any())) == 5
    assert n(LogFilter(topic1=Clause.one("x"))) == 2 and n(LogFilter(topic0=Clause.any_of([]))) == 0
    assert n(LogFilter(address=Clause.one("a1"), topic0=Clause.any_of(["t1", "t9"]))) == 2
    wide = LogFilter(address=Clause.any_of(map(str, range(129))))
    with pytest.raises(QueryTooBroad) as e:
        wide.check_width()
    assert (e.value.actual, e.value.maximum) == (129, 128)
    assert not TraceFilter(is_top_level=True).indexed() and not TraceFilter(has_value=False).indexed() and TraceFilter(has_value=True).indexed()
    assert not TxFilter().indexed() and TxFilter(selector=Clause.any_of([])).indexed()


@pytest.mark.parametrize("clauses", [{"addr": ["a1"]}, {"addr": ["a1", "a2"], "topic0": ["t1"]}, {"addr": ["a3"], "topic0": ["t1"]}, {"addr": ["none"]}])
def test_postings_agree_with_the_filter(logs, clauses):
    rows = assign_ids(logs.withColumn("pos", F.monotonically_increasing_id()), "pos", "log_id", next_id=32_760)
    index = postings.build(postings.log_streams(rows))
    names = {"addr": "address"}
    want = LogFilter(**{names.get(k, k): Clause.any_of(v) for k, v in clauses.items()}).apply(rows)
    assert {r[0] for r in postings.candidates(index, clauses).collect()} == {r[0] for r in want.select("log_id").collect()}
    got = postings.executed(rows, "log_id", index, {}, 32_761, 32_763, LogFilter(topic0=Clause.one("t1")), 2)
    assert [r[0] for r in got.select("log_id").collect()] == [r[0] for r in rows.where("log_id between 32761 and 32763 and topic0 = 't1'").orderBy("log_id").limit(2).select("log_id").collect()]
    assert postings.executed(rows, "log_id", index, clauses, 0, 99_999).count() == want.count()
    again = postings.compact(index.union(index))
    assert again.agg(F.sum("count")).first() == index.agg(F.sum("count")).first()


def test_full_bitmap(spark):
    entries = spark.range(40_000).select(F.lit("k").alias("kind"), F.lit("v").alias("value"), F.col("id").alias("row_id"))
    index = postings.build(entries)
    assert sorted((r["bucket"], r["count"]) for r in index.collect()) == [(0, 32_768), (1, 7_232)]
    assert postings.ids_of(index).agg(F.count("*"), F.min("row_id"), F.max("row_id")).first() == (40_000, 0, 39_999)


def test_pages_make_up_the_whole(logs):
    rows = assign_ids(logs.withColumn("pos", F.monotonically_increasing_id()), "pos", "log_id")
    seen, after = [], None
    while True:
        got = [r["log_id"] for r in page(rows, LogFilter(), "log_id", 2, after=after).collect()]
        if not got:
            break
        seen, after = seen + got, got[-1]
    assert seen == list(range(5))


EVENTS = "seq long, chain_id long, block_number long, block_hash string, timestamp long"


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(1, 1, 5, "a"), (2, 1, 6, "b"), (3, 1, 8, "c")], (True, None, 3)),
        ([(1, 1, 5, "a"), (2, 1, 6, "b"), (3, 1, 5, "a"), (4, 1, 7, "c")], (True, None, 3)),
        ([(1, 1, 5, "a"), (2, 1, 6, "b"), (3, 1, 5, "z"), (4, 1, 7, "c")], (False, "block_hash_mismatch", 2)),
        ([(1, 1, 5, "a"), (2, 1, 9, "b"), (3, 1, 7, "c")], (False, "non_monotonic_block_number", 2)),
        ([(1, 2, 5, "a")], (False, "chain_id_mismatch", 0)),
        ([(1, 1, 5, "a"), (2, 1, 9, "b"), (3, 1, 5, "a"), (4, 1, 6, "c")], (False, "non_monotonic_block_number", 2)),
        ([], (True, None, 0)),
    ],
)
def test_validation(spark, events, want):
    df = spark.createDataFrame([(*e, 0) for e in events], EVENTS)
    got = verdict(df, 1, None)
    assert (got["valid"], got["error"], got["blocks_observed"]) == want
    assert first_error(df, 1).count() == int(not want[0])


def test_end_of_stream(spark):
    df = spark.createDataFrame([(1, 1, 5, "a", 0)], EVENTS)
    assert verdict(df, 1, 6)["error"] == "end_of_stream_mismatch" and verdict(df, 1, 5)["valid"]
    assert verdict(df, 1, None, closed=False)["error"] == "channel_closed_unexpectedly"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, 1, k, str(k), k) for k in range(1, 40)], EVENTS)
    for k in range(3):
        df.where(F.col("seq") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    kept = []
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run_stream(source, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}") or kept.append(epoch), f"{tmp_path}/state")
    assert len(kept) == 3 and verdict(spark.read.parquet(f"{tmp_path}/out"), 1, 39) == verdict(df, 1, 39)


def faulty(spark, events, cuts, folder):
    """The events in files cut behind the given places, an epoch each, validated as a stream."""
    edges = [0, *cuts, len(events)]
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        spark.createDataFrame([(*e, 0) for e in events[a:b]], EVENTS).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return validate_stream(event_source(spark, f"{folder}/in/*", EVENTS), f"{folder}/out", 1)


@pytest.mark.parametrize(
    "events",
    [
        [(1, 1, 5, "a"), (2, 1, 6, "b"), (3, 1, 8, "c")],
        [(1, 1, 5, "a"), (2, 1, 6, "b"), (3, 1, 5, "a"), (4, 1, 7, "c")],
        [(1, 1, 5, "a"), (2, 1, 6, "b"), (3, 1, 5, "z"), (4, 1, 7, "c")],
        [(1, 1, 5, "a"), (2, 1, 9, "b"), (3, 1, 7, "c"), (4, 2, 10, "d")],
        [(1, 1, 5, "a"), (2, 1, 9, "b"), (3, 1, 5, "a"), (4, 1, 6, "c")],
        [(1, 1, 5, "a"), (2, 2, 6, "b"), (3, 1, 5, "z")],
    ],
)
def test_faults_across_epochs(spark, events, tmp_path):
    """State is carried over epochs: however the stream is cut, the outcome is that of one batch."""
    want = verdict(spark.createDataFrame([(*e, 0) for e in events], EVENTS), 1, None)
    got = faulty(spark, events, list(range(1, len(events))), tmp_path)
    assert got == want
    kept = StreamValidator(spark, f"{tmp_path}/out", 1)
    assert kept.accepted().count() == want["blocks_observed"]
    before = kept.state()
    kept(spark.createDataFrame([(*events[-1], 0)], EVENTS), len(events) - 1)  # the last epoch comes again
    assert kept.state() == before and kept.accepted().count() == want["blocks_observed"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = [(k, 1, k, str(k)) for k in range(1, 7)]
    assert faulty(spark, rows[:3], [1], tmp_path)["end_block"] == 3
    spark.createDataFrame([(*e, 0) for e in rows[3:]], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/009")
    source = event_source(spark, f"{tmp_path}/in/*", EVENTS)
    assert validate_stream(source, f"{tmp_path}/out", 1, expected_end=6) == {"valid": True, "error": None, "blocks_observed": 6, "start_block": 1, "end_block": 6}
    sink = StreamValidator(spark, f"{tmp_path}/out", 1)
    assert sink.finish(7)["error"] == "end_of_stream_mismatch" and sink.finish(None, closed=False)["error"] == "channel_closed_unexpectedly"


def test_percentiles_of_real_values(spark):
    own = random.Random(2)
    for values in ([own.uniform(-5, 5) for _ in range(500)], [3.5] * 40, [own.choice([0.0, 1e9, 1e-9]) for _ in range(90)], [7.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        shares = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
        want = {s: sorted(values)[int((len(values) - 1) * s + 0.5)] for s in shares}
        assert dict(stats.percentiles(df, "v", shares).collect()) == want
    assert stats.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_config_hash():
    """The canonical settings: names, whole floats as integers, nothing of the seed."""
    own = workload.Config(seed=3, trace_size_per_profile=100_000)
    text = json.dumps(own.document(), sort_keys=True)
    assert '"address_or_width": {"max": 4, "min": 1}' in text and '"empty_result_target_share": 0.1' in text and '"max": "full_range"' in text and '"max_threads": "num_cpus"' in text
    assert own.digest() == workload.Config(seed=4, trace_size_per_profile=100_000).digest() != workload.Config(max_threads=4).digest()
    assert workload.derived_seed(7, "expected") != workload.derived_seed(7, "stress")
    with pytest.raises(InvalidParams):
        workload.Config(event_queue_capacity=0).validate()


def test_workload(spark):
    pools = spark.createDataFrame([("address", k) for k in "abc"] + [("topic0", "t"), ("topic0", "u"), ("topic0", "u"), ("topic1", "x")], "key_type string, key_value string")
    assert sorted(tuple(r) for r in workload.indexed_keys(pools).groupBy("kind").agg(F.sort_array(F.collect_list("at")).cast("string")).collect()) == [("address", "[0, 1, 2]"), ("topic0", "[0, 1]")]
    config = workload.Config(seed=3, trace_size_per_profile=50)
    made = lambda df: sorted(map(str, df.collect()))
    one_part = workload.traces(spark, pools, 100, 500, [(250, 300)], config)
    assert made(one_part) == made(workload.traces(spark, pools.repartition(3), 100, 500, [(250, 300)], config).repartition(5))
    for r in one_part.collect():
        assert 100 <= r["from_block"] <= r["to_block"] <= 500 and 0 <= r["observed_block_coverage_ratio"] <= 1
        assert {*r["address_or"]} <= {"a", "b", "c"} and {*r["topic0_or"]} <= {"t", "u"}
        assert (r["template"] == "single_address") <= (len(r["address_or"]) == 1 and not r["topic0_or"])
    assert made(one_part) != made(workload.traces(spark, pools, 100, 500, [(250, 300)], workload.Config(seed=4, trace_size_per_profile=50)))
    with pytest.raises(InvalidParams):
        workload.Config(trace_size_per_profile=0).validate()
    assert len(config.digest()) == 64 and config.digest() == workload.Config(seed=3, trace_size_per_profile=50).digest()


def test_replay(spark, logs):
    t = "id string, from_block long, to_block long, address_or array<string>, topic0_or array<string>"
    rows = [("a", 1, 2, ["a1", "a1"], []), ("b", 2, 2, ["a1", "a2"], ["t1"]), ("c", 1, 1, [], ["t1", "t2"]), ("d", 1, 2, ["zz"], []), ("e", 1, 2, ["a1"], ["t2"])]
    assert dict(workload.replay_counts(spark.createDataFrame(rows, t), logs).collect()) == {"a": 3, "b": 2, "c": 2, "d": 0, "e": 1}


def test_rlp():
    tree = [b"", b"\x01", b"\x80", b"x" * 60, [[b"a"], []], [b"y" * 30, b"z" * 40]]
    assert rlp.decode(rlp.encode(tree)) == tree
    for bad in (b"", b"\x81\x01", b"\xb8\x01x", b"\x83ab", rlp.encode(tree) + b"\0", b"\xc2\x83ab"):
        with pytest.raises(DecodeError):
            rlp.decode(bad)
    to = b"\x11" * 20
    legacy = [b"", b"", b"", to, b"", b"\xaa\xbb\xcc\xdd\xee", b"", b"", b""]
    assert rlp.transaction(rlp.encode(legacy)) == (to, b"\xaa\xbb\xcc\xdd\xee", b"\xaa\xbb\xcc\xdd")
    assert rlp.transaction(rlp.encode([*legacy[:3], b"", *legacy[4:]]))[::2] == (None, None)
    assert rlp.transaction(rlp.encode([*legacy[:5], b"abc", *legacy[6:]]))[2] is None
    for kind, (count, to_at, input_at) in rlp.TX_LAYOUT.items():
        fields = [b""] * count
        fields[to_at], fields[input_at] = to, b"12345"
        assert rlp.transaction((bytes([kind]) if kind else b"") + rlp.encode(fields)) == (to, b"12345", b"1234")
    with pytest.raises(DecodeError):
        rlp.transaction(b"\x04" + rlp.encode(legacy))


def test_frames(spark):
    a, b = b"\x01" * 20, b"\x02" * 20
    frame = lambda typ, to, value: [typ, b"", a, to, value, b"\x05", b"\x04", b"abcdef", b"", b"\x01", b""]
    raw = rlp.encode([[], [frame(b"", b, b"\x07"), frame(b"\x03", b"", b"")]])
    got = rlp.decode_frames(spark.createDataFrame([(9, bytearray(raw)), (10, None)], "block_num long, trace_rlp binary")).collect()
    assert [(r["block_num"], r["tx_idx"], r["trace_idx"], r["typ"], r["to_addr"], r["value_hex"]) for r in got] == [(9, 1, 0, 0, b.hex(), "07"), (9, 1, 1, 3, None, "")]
