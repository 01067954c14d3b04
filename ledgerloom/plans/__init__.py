"""The registered chain queries: each applies one operator to the whole test tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CasConflict
from ..functions import compose_id, coverage, local_of, long, page_of, selectivity_bucket, shard_of, stream_id
from ..ingest import HadoopPublicationStore, Ingestor, LeaseAuthority, Publication
from ..operators import postings, stats, workload
from ..operators.clause import Clause, LogFilter, TraceFilter, TxFilter, page, prefix_page
from ..operators.ids import assign_ids, block_windows, bucket_starts, contiguous_runs, id_window, resolve_ids
from ..scratch import discard, materialized, release, scratch_path
from ..service import HistoryService, Request, blocks_with_txs, related, transfers, with_block_refs
from ..sources import artifacts, rlp, testdata
from ..sources.events import flattened_logs, rebased
from ..streaming import accepted, event_source, first_error, validate_stream

ADDRS = [f"{i:040x}" for i in (1, 2, 3)]
LOG = ["log_id", "block_num", "tx_idx", "log_idx", "address", "topic0", "topic1", "topic2", "topic3"]
TX = ["tx_id", "block_num", "tx_idx", "tx_hash", "from_addr", "to_addr", "input_len", "selector"]
TRACE = ["trace_id", "block_num", "tx_idx", "trace_idx", "depth", "typ", "flags", "from_addr", "to_addr", "value_hex", "selector"]
THREE = LogFilter(address=Clause.any_of(ADDRS))
Query = Callable[[SparkSession, str], DataFrame]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _logs(s: SparkSession, d: str) -> DataFrame:
    return testdata.logs(s, d).select(*LOG)


def _log(where: LogFilter) -> Query:
    return lambda s, d: where.apply(_logs(s, d))


def _tx(where: TxFilter) -> Query:
    return lambda s, d: where.apply(testdata.txs(s, d)).select(*TX)


def _trace(where: TraceFilter) -> Query:
    return lambda s, d: where.apply(testdata.traces(s, d)).select(*TRACE)


def log_filter_page(s: SparkSession, d: str) -> DataFrame:
    where = LogFilter(address=Clause.any_of(ADDRS), topic0=Clause.any_of(["NO", "RF"]))
    return page(_logs(s, d).where("topic2 is not null"), where, "log_id", 200, 100, 900)


def _windows(s: SparkSession, d: str) -> DataFrame:
    return block_windows(testdata.logs(s, d), testdata.blocks(s, d))


def _any_vs_value(s: SparkSession, d: str) -> DataFrame:
    count = lambda name, where: where.apply(_logs(s, d)).agg(F.count("*").alias("n")).select(F.lit(name).alias("clause"), "n")
    return count("any", LogFilter(topic2=Clause.any())).union(count("value", LogFilter(topic2=Clause.any_of(["1", "2"]))))


def _page_walk(s: SparkSession, d: str) -> DataFrame:
    """Pages of 100 over one filter: places in the result by a count per block and a place inside it, not by one window."""
    ranked = assign_ids(THREE.apply(_logs(s, d)), "log_id", "place")
    return ranked.select("log_id", (F.floor(F.col("place") / 100) + 1).cast("long").alias("page"))


def _block_with_txs(s: SparkSession, d: str) -> DataFrame:
    both = blocks_with_txs(testdata.blocks(s, d), testdata.txs(s, d))
    return both.select("block_num", F.size("txs").cast("long").alias("n_txs"), F.array_join("txs.tx_hash", ",").alias("tx_hashes"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return stats.key_stats(_logs(s, d))


def _postings(s: SparkSession, d: str) -> DataFrame:
    return postings.build(postings.log_streams(_logs(s, d)))


def _kinds(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind", "value").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def _faulty_events(s: SparkSession, d: str) -> DataFrame:
    own = testdata.event_blocks(s, d)
    seq = F.row_number().over(Window.orderBy("block_number")).cast("long")
    good = own.select(seq.alias("seq"), long(1).alias("chain_id"), "block_number", "block_hash")
    bad = own.agg(F.min("block_number").alias("block_number")).select(long(1_000_000), long(1), "block_number", F.lit("other"))
    return good.union(bad).union(s.range(1).select(long(1_000_001), long(2), long(0), F.lit("x")))


def _twice(s: SparkSession, d: str) -> DataFrame:
    good = _faulty_events(s, d).where("seq < 1000000")
    return accepted(good.union(good.withColumn("seq", F.col("seq") + 500_000)), 1).select("block_number", "block_hash")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    """Ranges of 500 blocks, each 100 on, up to the last block, against the gaps that a manifest records (at most 100)."""
    blocks = testdata.event_blocks(s, d)
    first = stats.first_gaps(blocks).agg(F.collect_list(F.struct("start", "end")).alias("missing"))
    q = s.range(blocks.agg(F.max("block_number")).first()[0] // 100 + 1).join(F.broadcast(first))
    return q.select("id", coverage(F.col("id") * 100, F.col("id") * 100 + 499, F.col("missing")).alias("ratio"))


def _shards(s: SparkSession, d: str) -> DataFrame:
    wide = _logs(s, d).withColumn("wide", F.col("log_id") * 5000)
    w = compose_id(shard_of(F.col("wide")), local_of(F.col("wide")))
    return wide.select("log_id", shard_of(w).alias("shard"), local_of(w).alias("local"), page_of(w).alias("page"), stream_id(F.lit("addr"), F.col("address"), shard_of(w)).alias("stream"))


def _workload_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Traces of the usual number, drawn from the statistics of all keys."""
    logs = materialized(_logs(s, d))
    ends = logs.agg(F.min("block_num"), F.max("block_num")).first()
    return workload.traces(s, materialized(stats.key_stats(logs)), ends[0], ends[1], config=workload.Config(seed=7)), logs


def _workload(s: SparkSession, d: str) -> DataFrame:
    rows, _ = _workload_rows(s, d)
    return rows.select("id", "profile", "template", "from_block", "to_block", F.size("address_or").cast("long").alias("n_addresses"), F.size("topic0_or").cast("long").alias("n_topics"), "expected_selectivity_bucket")


def _replay(s: SparkSession, d: str) -> DataFrame:
    traces, logs = _workload_rows(s, d)
    return workload.replay_counts(materialized(traces), logs)


def _ingested(s: SparkSession, d: str, bucket: int = postings.BUCKET) -> tuple[Ingestor, list[dict]]:
    """The chain ingested in two batches, and what each of them wrote."""
    root = scratch_path(s)
    writer = Ingestor(s, root, LeaseAuthority(HadoopPublicationStore(s, f"{root}/publication"), "me", lambda: 1), bucket)
    tables = {"logs": testdata.log_rows(s, d), "traces": testdata.trace_rows(s, d), "txs": testdata.tx_rows(s, d), "blocks": testdata.blocks(s, d)}
    half, made = tables["blocks"].count() // 2, []
    for part in (F.col("block_num") <= half, F.col("block_num") > half):
        own = {}  # a batch is read several times; only one of them stands on disk
        for k, v in tables.items():
            own[k] = materialized(v.where(part))
            release(s)
        made.append(writer.ingest(own))
        discard(*own.values())
    return writer, made


def _outcome(s: SparkSession, d: str) -> DataFrame:
    _, made = _ingested(s, d)
    return s.createDataFrame([(made[-1]["head"], *[sum(m[f"written_{f}"] for m in made) for f in ("logs", "txs", "traces")])], "head long, written_logs long, written_txs long, written_traces long")


def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Logs as the ingested history has them, ids and all."""
    return _ingested(s, d)[0].tables()["logs"].select(*LOG, "data")


def _index(s: SparkSession, d: str) -> DataFrame:
    """Postings of an ingested history: pages of the buckets that its batches have filled, fragments of the last."""
    return _ingested(s, d)[0].postings("logs").select("kind", "value", "bucket", "count", "first_id", "last_id")


def _recovered(s: SparkSession, d: str) -> DataFrame:
    """The same after a crash that left a batch beyond the head, a fragment that is lost and a page that isn't complete."""
    writer, made = _ingested(s, d)
    beyond = f"batch={made[-1]['head'] + 1:020d}"
    own = s.read.parquet(f"{writer.root}/logs").drop("batch")
    own.write.parquet(f"{writer.root}/logs/{beyond}")
    writer.index.add("logs", own, beyond)
    name = writer.index._names(f"{writer.root}/logs_index")[0]
    writer.index._delete(f"{writer.root}/logs_index/{name}")
    s.range(1).write.parquet(f"{writer.root}/logs_pages/000000000000-000000000009")
    writer.index._delete(f"{writer.root}/logs_pages/000000000000-000000000009/_SUCCESS")
    writer.recover()
    return writer.postings("logs").select("kind", "value", "bucket", "count", "first_id", "last_id")


def _indexed_page(s: SparkSession, d: str) -> DataFrame:
    """A page that the service finds through the index: has_more and the place to go on from beside the rows."""
    writer, made = _ingested(s, d)
    service = HistoryService(writer.tables(), made[-1]["head"], writer=writer, use_index=True)
    found = service.query_logs(Request(50, LogFilter(address=Clause.any_of(ADDRS), topic0=Clause.one("NO")), from_block_hash=_sha("block:10"), to_block=900))
    rows = [(r["log_id"], r["block_num"], r["address"], found.has_more, found.next_resume_id, found.to_block.hash) for r in found.items]
    return s.createDataFrame(rows, "log_id long, block_num long, address string, has_more boolean, next_resume_id long, to_hash string")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Faulty events in files of a third of the stream each, an epoch for each file."""
    folder, events = scratch_path(s), materialized(_faulty_events(s, d))
    n = events.where("seq < 1000000").count()
    for k, part in enumerate((f"seq <= {n // 3}", f"seq > {n // 3} and seq <= {2 * n // 3}", f"seq > {2 * n // 3}")):
        events.where(part).coalesce(1).write.parquet(f"{folder}/in/{k}")
    source = event_source(s, f"{folder}/in/*", "seq long, chain_id long, block_number long, block_hash string")
    return s.createDataFrame([tuple(validate_stream(source, f"{folder}/validated", 1).values())], "valid boolean, error string, blocks_observed long, start_block long, end_block long")


def _linkage(s: SparkSession, d: str) -> DataFrame:
    linked = stats.with_previous(testdata.blocks(s, d), "block_num", "block_hash")
    return linked.agg(F.count("*").alias("blocks"), F.sum(F.coalesce((F.col("_prev_block_hash") != F.col("parent_hash")).cast("long"), long(0))).alias("broken"))


def _sealed(s: SparkSession, d: str) -> DataFrame:
    last = _windows(s, d).agg(F.max(F.col("first_id") + F.col("count"))).first()[0]
    return bucket_starts(0, last, 10_000, s)


def _artifacts(s: SparkSession, d: str) -> DataFrame:
    """Statistics written in their fixed schemas and read back."""
    logs, blocks, folder = _logs(s, d), testdata.event_blocks(s, d), scratch_path(s)
    tables = {"key_stats": stats.key_stats(logs), "cooccurrence": stats.top_pairs(stats.cooccurrence(logs), workload.Config().cooccurrence_top_k_per_type), "range_stats": stats.logs_per_block(blocks)}
    artifacts.write_stats(tables, folder)
    n = lambda name, df, first, count: df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.sum(count).alias("total"), F.min(first).alias("first"))
    got = artifacts.read_stats(s, folder)
    return n("key_stats", got["key_stats"], "key_value", "count_total").union(n("cooccurrence", got["cooccurrence"], "left_key", "count_total")).union(n("range_stats", got["range_stats"], "metric", "count"))


def _trace_files(s: SparkSession, d: str) -> DataFrame:
    """Traces written as JSON lines and loaded again: traces and blocks of each profile."""
    made, folder = _workload_rows(s, d)[0], scratch_path(s)
    artifacts.write_traces(made, folder)
    got = artifacts.load_traces(s, folder)
    return got.groupBy("profile").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.col("to_block") - F.col("from_block") + 1).alias("blocks"))


def _flattened(s: SparkSession, d: str) -> DataFrame:
    """Logs nested into receipts and flattened again."""
    logs = _logs(s, d)
    entry = F.struct("address", F.filter(F.array("topic0", "topic1", "topic2", "topic3"), lambda t: t.isNotNull()).alias("topics"))
    per_tx = logs.groupBy("block_num", "tx_idx").agg(F.min("log_idx").alias("starting_log_index"), F.sort_array(F.collect_list(F.struct("log_idx", entry.alias("log")))).alias("logs"))
    receipts = per_tx.groupBy("block_num").agg(F.sort_array(F.collect_list(F.struct("tx_idx", "starting_log_index", F.col("logs.log").alias("logs")))).alias("receipts"))
    return flattened_logs(receipts.withColumnRenamed("block_num", "block_number"))


def _cas(s: SparkSession, d: str) -> DataFrame:
    """Two writers that saw the same version of the publication record: one wins."""
    store = HadoopPublicationStore(s, f"{scratch_path(s)}/publication")
    head = testdata.blocks(s, d).agg(F.max("block_num")).first()[0]
    rows = []
    for who, seen in (("a", 0), ("b", 0), ("b", 1)):
        try:
            rows.append((who, seen, store.compare_and_set(seen, Publication(head=head, owner=who)).version))
        except CasConflict:
            rows.append((who, seen, None))
    return s.createDataFrame(rows, "writer string, seen long, published long").withColumn("head", long(store.load().head))


def _rlp(s: SparkSession, d: str) -> DataFrame:
    """Legacy transactions made of the orders, encoded and decoded again."""

    def signed(parts):
        for p in parts:
            to = [b"" if t is None else bytes.fromhex(t) for t in p["to_addr"]]
            raw = [rlp.encode([b"\1", b"\1", b"\1", t, b"", bytes(int(n)), b"\1", b"\1", b"\1"]) for t, n in zip(to, p["input_len"], strict=True)]
            yield p[["block_num", "tx_idx"]].assign(tx_hash=[bytes.fromhex(h) for h in p["tx_hash"]], sender=[bytes.fromhex(a) for a in p["from_addr"]], signed=raw)

    own = testdata.txs(s, d).select("block_num", "tx_idx", "tx_hash", "from_addr", "to_addr", "input_len")
    raw = own.mapInPandas(signed, "block_num long, tx_idx long, tx_hash binary, sender binary, signed binary")
    return rlp.decode_transactions(raw).select("block_num", "tx_idx", "tx_hash", "from_addr", "to_addr", F.length("input").cast("long").alias("input_len"), "selector")


def queries() -> dict[str, Query]:
    t = testdata
    both = {"addr": ADDRS, "topic0": ["NO", "RF"]}
    return {
        "chain_blocks": t.blocks,
        "chain_txs": lambda s, d: t.txs(s, d).select(*TX),
        "chain_logs": lambda s, d: t.logs(s, d).select(*LOG, "data"),
        "chain_traces": lambda s, d: t.traces(s, d).select(*TRACE, "input_len", "is_top_level", "has_value", "is_call"),
        "block_windows": _windows,
        "log_filter_page": log_filter_page,
        "log_filter_address_one": _log(LogFilter(address=Clause.one(ADDRS[0]))),
        "log_filter_address_or": _log(THREE),
        "log_filter_topic_any_vs_value": _any_vs_value,
        "log_filter_empty_or": _log(LogFilter(topic0=Clause.any_of([]))),
        "log_filter_compound": _log(LogFilter(address=Clause.any_of(ADDRS), topic0=Clause.one("NO"), topic2=Clause.any_of(["1", "2", "3"]))),
        "log_resume_page": lambda s, d: page(_logs(s, d), THREE, "log_id", 50, after=500),
        "log_page_walk": _page_walk,
        "log_unfiltered_scan": _log(LogFilter()),
        "log_id_window": lambda s, d: id_window(_windows(s, d), 100, 900),
        "log_desc_page": lambda s, d: page(_logs(s, d), THREE, "log_id", 100, descending=True),
        "log_block_refs": lambda s, d: with_block_refs(THREE.apply(_logs(s, d)), t.blocks(s, d)).select("log_id", "block_num", "block_hash", "parent_hash"),
        "log_join_tx_block": lambda s, d: related(THREE.apply(_logs(s, d)), t.txs(s, d), t.blocks(s, d)).select("log_id", "tx_hash", "from_addr", "to_addr", "block_hash", "timestamp"),
        "tx_filter_from": _tx(TxFilter(from_addr=Clause.any_of(ADDRS))),
        "tx_filter_to": _tx(TxFilter(to_addr=Clause.any_of(ADDRS))),
        "tx_filter_selector": _tx(TxFilter(selector=Clause.one(_sha("sel:1-URGENT")[:8]))),
        "tx_by_hash": lambda s, d: t.txs(s, d).where(F.col("tx_hash") == _sha("tx:7")).select(*TX),
        "trace_filter_selector": _trace(TraceFilter(selector=Clause.any_of([_sha("sel:1")[:8], _sha("sel:2")[:8]]))),
        "trace_filter_top_level": _trace(TraceFilter(to_addr=Clause.any_of(ADDRS), is_top_level=True)),
        "trace_filter_has_value": _trace(TraceFilter(from_addr=Clause.any_of(ADDRS), has_value=True)),
        "trace_transfers": lambda s, d: transfers(TraceFilter(to_addr=Clause.any_of(ADDRS)).apply(t.traces(s, d))),
        "blocks_page": lambda s, d: t.blocks(s, d).where("block_num between 5 and 500").orderBy("block_num").limit(100),
        "block_with_txs": _block_with_txs,
        "key_stats_address": lambda s, d: _stats(s, d).where("key_type = 'address'").drop("key_type"),
        "key_stats_all": _stats,
        "key_stats_address_topic0": lambda s, d: _stats(s, d).where("key_type = 'address_topic0'").select("key_value", "count_total", "active_block_count"),
        "cooccurrence_topk": lambda s, d: stats.top_pairs(stats.cooccurrence(_logs(s, d)), 50),
        "hist_logs_per_block": lambda s, d: stats.logs_per_block(t.event_blocks(s, d)),
        "hist_logs_per_window": lambda s, d: stats.logs_per_window(t.event_blocks(s, d), 60),
        "hist_interarrival": lambda s, d: stats.interarrival(t.event_blocks(s, d)),
        "dataset_summary": lambda s, d: stats.summary(t.event_blocks(s, d)),
        "gap_ranges": lambda s, d: stats.first_gaps(t.event_blocks(s, d)),
        "gap_count": lambda s, d: stats.gaps(t.event_blocks(s, d)).agg(F.count("*").alias("gap_count"), F.sum(F.col("end") - F.col("start") + 1).alias("missing")),
        "validate_events_first_error": lambda s, d: first_error(_faulty_events(s, d), 1),
        "event_dedup": _twice,
        "postings_build": lambda s, d: _postings(s, d).select("kind", "value", "bucket", "count", "first_id", "last_id"),
        "postings_or": lambda s, d: postings.candidates(_postings(s, d), {"addr": ADDRS}),
        "postings_and": lambda s, d: postings.candidates(_postings(s, d), both),
        "postings_semi_join": lambda s, d: postings.matching(_logs(s, d), "log_id", postings.candidates(_postings(s, d), both | {"topic2": ["1"]})),
        "candidate_page": lambda s, d: postings.executed(_logs(s, d), "log_id", _postings(s, d), {"addr": ADDRS}, 100, 5000, LogFilter(topic0=Clause.one("NO")), 20),
        "page_cardinality_estimate": lambda s, d: postings.estimate(_postings(s, d), "addr", ADDRS, 100, 5000),
        "tx_streams": lambda s, d: _kinds(postings.tx_streams(t.txs(s, d))),
        "trace_streams": lambda s, d: _kinds(postings.trace_streams(t.traces(s, d))),
        "directory_resolve": lambda s, d: resolve_ids(t.logs(s, d).select(F.col("log_id").alias("row_id")), _windows(s, d)),
        "contiguous_runs": lambda s, d: contiguous_runs(LogFilter(topic0=Clause.any_of(["NO", "RF"])).apply(_logs(s, d)), "log_id"),
        "shard_local_page": _shards,
        "density_scan": lambda s, d: stats.density(t.event_blocks(s, d), 10),
        "density_topk": lambda s, d: stats.densest(t.event_blocks(s, d), 20).select("block_number", "n_logs"),
        "coverage_ratio": _coverage,
        "selectivity_buckets": lambda s, d: _stats(s, d).select((F.col("count_total") * F.col("count_total")).alias("v")).distinct().select("v", selectivity_bucket(F.col("v")).alias("bucket")),
        "latency_percentiles": lambda s, d: stats.percentiles(t.event_blocks(s, d), "n_logs", [0.5, 0.95, 0.99, 1.0]),
        "count_by_key_type": lambda s, d: _stats(s, d).groupBy("key_type").agg(F.count("*").alias("n")),
        "ingest_outcome": _outcome,
        "ingest_roundtrip": _roundtrip,
        "index_after_ingest": _index,
        "recovered_index": _recovered,
        "indexed_page": _indexed_page,
        "stream_validation": _streamed,
        "key_prefix_listing": lambda s, d: prefix_page(_logs(s, d), "address", "0" * 39, ADDRS[1], 5),
        "linkage_check": _linkage,
        "sealed_buckets": _sealed,
        "workload_traces": _workload,
        "replay_counts": _replay,
        "stats_artifacts": _artifacts,
        "trace_artifacts": _trace_files,
        "event_flattening": _flattened,
        "renumbered_blocks": lambda s, d: rebased(t.blocks(s, d), 101).select("block_num", "block_hash", "parent_hash"),
        "publication_cas": _cas,
        "rlp_decode": _rlp,
    }
