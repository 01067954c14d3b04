"""Datasets written, published, reopened and drawn from; events flattened; traces replayed; the publication record."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import BackendError, CasConflict, InvalidParams, NotFound
from ledgerloom.ingest import HadoopPublicationStore, Publication
from ledgerloom.operators import workload
from ledgerloom.replay import latency_report, nearest_rank, replay, request_of
from ledgerloom.service import HistoryService
from ledgerloom.sources import artifacts
from ledgerloom.sources.events import flattened_logs, rebased

EVENTS = "seq long, chain_id long, block_number long, block_hash string, timestamp long"
LOGS = "block_number long, address string, topic0 string, topic1 string, topic2 string, topic3 string"
CONFIG = workload.Config(trace_size_per_profile=20, logs_per_window_size_blocks=10)


def stream(spark, faulty=False):
    rows = [(k, 1, n, f"h{n}", n * 12) for k, n in enumerate([*range(100, 120), *range(130, 140)])]
    rows += [(50, 1, 105, "h105", 0)] + ([(51, 1, 110, "other", 0), (52, 1, 141, "h141", 0)] if faulty else [])
    logs = [(n, f"a{n % 3}", f"t{n % 2}", None, None, None) for n in [*range(100, 120), *range(130, 140), 141] if n != 104]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame(logs, LOGS)


def test_dataset(spark, tmp_path):
    target = f"{tmp_path}/set"
    counts = artifacts.collect_and_generate(spark, *stream(spark), target, seed=9, expected_end=139, config=CONFIG)
    assert counts == {"expected": 20, "stress": 20, "adversarial": 20}
    m = json.load(open(f"{target}/dataset_manifest.json"))
    assert (m["valid"], m["blocks_observed"], m["log_count"], m["gap_count"], m["missing_block_ranges"], m["seed"]) == (True, 30, 29, 1, [[120, 129]], 9)
    got = artifacts.read_stats(spark, target)
    top = got["key_stats"].where("key_type = 'topic0' and key_value = 't0'").first()
    assert (top["count_total"], top["first_block"], top["last_block"], top["distinct_partner_estimate"]) == (14, 100, 138, 3.0)
    hist = {(r["metric"], r["bucket_lower"]): r["count"] for r in got["range_stats"].collect()}
    assert hist["logs_per_block", 0] == 1 and hist["logs_per_block", 1] == 29 and sum(n for (k, _), n in hist.items() if k == "logs_per_window") == 4
    traces = artifacts.load_traces(spark, target, ["stress"]).collect()
    assert [r["id"] for r in traces] == list(range(20)) and {r["profile"] for r in traces} == {"stress"}
    assert json.load(open(f"{target}/run_summary.json"))["trace_queries_generated"] == counts
    with pytest.raises(BackendError):  # never over a dataset that is there
        artifacts.collect(spark, *stream(spark), target, config=CONFIG)
    with pytest.raises(InvalidParams):
        artifacts.load_traces(spark, target, ["nobody"])
    assert artifacts.generate(spark, target, 9, CONFIG) == counts  # drawn again in place


def test_invalid_dataset_is_kept_and_not_drawn_from(spark, tmp_path):
    target = f"{tmp_path}/set"
    with pytest.raises(InvalidParams):
        artifacts.collect_and_generate(spark, *stream(spark, faulty=True), target, seed=1, config=CONFIG)
    m = json.load(open(f"{target}/dataset_manifest.json"))
    assert (m["valid"], m["invalid_reason"], m["blocks_observed"], m["end_block"]) == (False, "block_hash_mismatch", 30, 139)
    with pytest.raises(NotFound):
        artifacts.generate(spark, f"{tmp_path}/none", 1)
    empty = spark.createDataFrame([], LOGS)
    artifacts.collect(spark, stream(spark)[0], empty, f"{tmp_path}/bare", config=CONFIG)
    with pytest.raises(InvalidParams):
        artifacts.generate(spark, f"{tmp_path}/bare", 1, CONFIG)


def test_blank_lines_are_skipped(spark, tmp_path):
    os.mkdir(f"{tmp_path}/trace_stress.jsonl")
    with open(f"{tmp_path}/trace_stress.jsonl/part-0.json", "w") as f:
        f.write('\n{"id":3,"profile":"stress","from_block":1,"to_block":2}\n\n')
    rows = artifacts.load_traces(spark, str(tmp_path), ["stress"]).collect()
    assert [(r["id"], r["notes"]) for r in rows] == [(3, None)]


def test_events(spark):
    kind = "block_number long, receipts array<struct<starting_log_index long, logs array<struct<address string, topics array<string>>>>>"
    rows = [(7, [(0, [("a", ["t", "u"]), ("b", [])]), (2, []), (2, [("c", ["v"])])]), (8, [])]
    got = sorted(tuple(r)[:6] for r in flattened_logs(spark.createDataFrame(rows, kind)).collect())
    assert got == [(7, 0, 0, "a", "t", "u"), (7, 0, 1, "b", None, None), (7, 2, 2, "c", "v", None)]
    blocks = spark.createDataFrame([(n, f"h{n}", f"h{n - 1}") for n in (4, 5, 6)], "block_num long, block_hash string, parent_hash string")
    assert sorted(map(tuple, rebased(blocks, 5).collect())) == [(1, "h5", "0" * 64), (2, "h6", "h5")]


def test_replay(spark):
    blocks = spark.createDataFrame([(n, f"h{n}", f"h{n - 1}", n) for n in (1, 2)], "block_num long, block_hash string, parent_hash string, timestamp long")
    logs = spark.createDataFrame([(0, 1, "a", "t"), (1, 2, "a", "u"), (2, 2, "b", "t")], "log_id long, block_num long, address string, topic0 string")
    logs = logs.withColumns({f"topic{k}": F.lit(None).cast("string") for k in (1, 2, 3)})
    windows = spark.createDataFrame([(1, 0, 1), (2, 1, 2)], "block_num long, first_id long, count long")
    service = HistoryService({"blocks": blocks, "logs": logs, "logs_windows": windows}, 2)
    rows = [(0, "expected", 1, 2, ["a"], []), (1, "expected", 1, 2, [], ["t", "u"]), (2, "expected", 2, 1, [], []), (3, "stress", 1, 2, [], [])]
    traces = spark.createDataFrame(rows, "id long, profile string, from_block long, to_block long, address_or array<string>, topic0_or array<string>")
    traces = traces.withColumns({f"topic{k}_or": F.array().cast("array<string>") for k in (1, 2, 3)})
    first = request_of(traces.sort("id").first(), 5)
    assert first.filter.address.values == ("a",) and first.filter.topic0.values is None
    report = replay(service, traces, limit=2)
    assert (report["queries"], report["items"], report["failed"]) == (3, 6, 1)  # two rows of each page
    assert replay(service, traces, trace_limit=1)["items"] == 2
    assert latency_report([], 0)["qps"] == 0 and latency_report([1, 2, 3, 4], 2)["p50"] == 3 and nearest_rank([1, 2, 3], 0.99) == 3
    with pytest.raises(InvalidParams):
        replay(service, traces, limit=0)


def test_publication_on_a_hadoop_path(spark, tmp_path):
    one, two = (HadoopPublicationStore(spark, f"file://{tmp_path}/p") for _ in range(2))
    assert one.load() is None and one.compare_and_set(0, Publication(owner="a")).version == 1
    with pytest.raises(CasConflict):
        two.compare_and_set(0, Publication(owner="b"))
    assert two.compare_and_set(1, Publication(head=4, owner="b")) == one.load()
    two.load = lambda: Publication(version=1)  # saw the record before the other writer moved it
    with pytest.raises(CasConflict):
        two.compare_and_set(1, Publication(owner="c"))
    assert one.load().head == 4
