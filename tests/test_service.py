"""Ingest, publication, leases and the paged query service, end to end."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import CasConflict, FinalityViolation, InvalidParams, InvalidParent, InvalidSequence, LeaseLost, LeaseObservationUnavailable, LeaseStillFresh, NotFound, QueryTooBroad, ReadOnlyMode
from ledgerloom import reports
from ledgerloom.ingest import ZEROS, Ingestor, LeaseAuthority, MemoryPublicationStore, Publication, PublicationStore
from ledgerloom.index import SCHEMA
from ledgerloom.operators import postings
from ledgerloom.operators.clause import Clause, LogFilter, TraceFilter
from ledgerloom.service import HistoryService, Request, effective_limit
from ledgerloom.sources.artifacts import read_json

BLOCKS = "block_num long, block_hash string, parent_hash string, timestamp long"
TXS = "block_num long, tx_idx long, tx_hash string, from_addr string, to_addr string, selector string"
LOGS = "block_num long, tx_idx long, log_idx long, address string, topic0 string, topic1 string, topic2 string, topic3 string"
TRACES = "block_num long, tx_idx long, trace_idx long, depth long, typ long, flags long, from_addr string, to_addr string, value_hex string, selector string"


def batch(spark, numbers, logs=2, parent=None):
    h = lambda n: f"{n:064x}" if n else ZEROS
    rows = [(n, h(n), parent if parent and n == numbers[0] else h(n - 1), 100 * n) for n in numbers]
    return {
        "blocks": spark.createDataFrame(rows, BLOCKS),
        "txs": spark.createDataFrame([(n, 0, f"tx{n}", "f", None if n % 2 else "t", "s") for n in numbers], TXS),
        "logs": spark.createDataFrame([(n, 0, k, f"a{k}", "t", None, None, None) for n in numbers if n != 3 for k in range(logs)], LOGS),
        "traces": spark.createDataFrame([(n, 0, k, k, 0, 0, "f", "t", "0" * (1 + k), None) for n in numbers for k in range(2)] + [(numbers[0], 0, 2, 1, 0, 0, "f", "t", "01", "s")], TRACES),
    }


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("history"))
    writer = Ingestor(spark, root, LeaseAuthority(PublicationStore(f"{root}/publication"), "me", lambda: 1))
    service = HistoryService({}, 0, reader_only=False, writer=writer)
    assert service.ingest_finalized_blocks(batch(spark, [1, 2])) == {"head": 2, "written_txs": 2, "written_logs": 4, "written_traces": 5}
    service.ingest_finalized_blocks(batch(spark, [3, 4]))
    return service


def test_status(service):
    assert service.status() == {"head": 4, "next_logs_id": 6, "next_txs_id": 4, "next_traces_id": 10} and service.indexed_finalized_head() == 4


def test_pages(service):
    first = service.query_logs(Request(limit=4, from_block=1, to_block=9))
    assert [r["log_id"] for r in first.items] == [0, 1, 2, 3] and first.has_more and first.next_resume_id == 3
    assert (first.from_block.number, first.to_block.number, first.cursor_block.number) == (1, 4, 2)
    rest = service.query_logs(Request(limit=4, from_block=1, to_block=4, resume_id=3))
    assert [r["log_id"] for r in rest.items] == [4, 5] and not rest.has_more and rest.next_resume_id is None
    assert service.query_logs(Request(limit=4, from_block=1, to_block=4, resume_id=5)).items == []
    down = service.query_logs(Request(limit=2, from_block=1, to_block=4, order="desc", filter=LogFilter(address=Clause.one("a1"))))
    assert [r["log_id"] for r in down.items] == [5, 3] and down.has_more
    assert service.query_logs(Request(limit=4, from_block=3, to_block=3)).items == []
    by_hash = service.query_logs(Request(limit=9, from_block_hash=f"{2:064x}", to_block=2))
    assert [r["block_num"] for r in by_hash.items] == [2, 2]
    assert [r["trace_idx"] for r in service.query_traces(Request(limit=9, from_block=1, to_block=4, filter=TraceFilter(has_value=True))).items] == [2, 2]


@pytest.mark.parametrize(
    ("request_", "error"),
    [
        (Request(limit=0, filter=LogFilter(address=Clause.any_of(map(str, range(200))))), QueryTooBroad),
        (Request(limit=0), InvalidParams),
        (Request(limit=1, from_block=1, from_block_hash="x", to_block=2), InvalidParams),
        (Request(limit=1, from_block_hash="unknown", to_block=2), InvalidParams),
        (Request(limit=0, from_block=90, to_block=99), InvalidParams),
        (Request(limit=1, from_block=2, to_block=1), InvalidParams),
        (Request(limit=1, from_block=1, to_block=4, resume_id=999_999), InvalidParams),
    ],
)
def test_errors(service, request_, error):
    with pytest.raises(error):
        service.query_logs(request_)


def test_empty_ranges(service):
    assert service.query_logs(Request(limit=1, from_block=9, to_block=12, resume_id=77)).cursor_block.number == 4
    assert service.query_blocks(Request(limit=1, from_block=0, to_block=2)).items == []
    with pytest.raises(InvalidParams):
        effective_limit(5, 0)
    assert effective_limit(5, 3) == 3 and effective_limit(5, None) == 5


def test_blocks_and_lookups(service):
    got = service.query_blocks(Request(limit=3, from_block=1, to_block=4))
    assert [r["block_num"] for r in got.items] == [1, 2, 3] and got.has_more and got.next_resume_id is None
    assert service.get_tx("tx3")["block_num"] == 3 and service.get_tx("none") is None
    header, txs = service.get_block(4)
    assert header["block_num"] == 4 and [t["tx_hash"] for t in txs] == ["tx4"] and service.get_block(7) is None
    holed = HistoryService(service.tables | {"blocks": service.tables["blocks"].where("block_num <> 2")}, 4)
    with pytest.raises(NotFound):
        holed.query_blocks(Request(limit=9, from_block=1, to_block=4))
    for call in (lambda: service.get_tx_receipt("x"), lambda: service.get_block_receipts(1)):
        with pytest.raises(InvalidParams):
            call()
    with pytest.raises(ReadOnlyMode):
        holed.ingest_finalized_blocks({})


def test_bad_batches(spark, service):
    with pytest.raises(InvalidSequence):
        service.ingest_finalized_blocks(batch(spark, [6]))
    with pytest.raises(InvalidSequence):
        service.ingest_finalized_blocks(batch(spark, [5, 7]))
    with pytest.raises(InvalidParent):
        service.ingest_finalized_blocks(batch(spark, [5], parent="f" * 64))
    with pytest.raises(InvalidParams):
        service.ingest_finalized_blocks({k: v.limit(0) for k, v in batch(spark, [5]).items()})
    odd = batch(spark, [5])
    with pytest.raises(InvalidParams):
        service.ingest_finalized_blocks(odd | {"logs": odd["logs"].withColumn("log_idx", F.col("log_idx") + 1)})


def test_crash_before_publication(spark, tmp_path):
    store = PublicationStore(f"{tmp_path}/publication")
    writer = Ingestor(spark, str(tmp_path), LeaseAuthority(store, "me", lambda: 1))
    writer.ingest(batch(spark, [1]))
    publish, writer.authority.publish = writer.authority.publish, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        writer.ingest(batch(spark, [2], logs=5))
    assert store.load().head == 1 and writer.tables()["logs"].count() == 2
    writer.authority.publish = publish
    assert writer.ingest(batch(spark, [2], logs=3))["written_logs"] == 3
    assert sorted(r[0] for r in writer.tables()["logs"].select("log_id").collect()) == [0, 1, 2, 3, 4]


def test_compare_and_set(tmp_path):
    store = PublicationStore(str(tmp_path))
    assert store.load() is None
    first = store.compare_and_set(0, Publication(head=1))
    assert first.version == 1
    with pytest.raises(CasConflict):
        store.compare_and_set(0, Publication(head=2))


def test_leases(tmp_path):
    now = [100]
    store = PublicationStore(str(tmp_path))
    a, b = (LeaseAuthority(store, n, lambda: now[0]) for n in "ab")
    state, kind = a.begin_write()
    assert kind == "fresh" and state.lease_end == 109
    assert a.begin_write()[1] == "continuous"
    with pytest.raises(LeaseStillFresh):
        b.begin_write()
    now[0] = 109
    assert a.begin_write()[0].lease_end == 118
    now[0] = 119
    assert b.begin_write()[1] == "reacquired"
    with pytest.raises(LeaseLost):
        a.begin_write()
    state, _ = b.begin_write()
    state = b.publish(state, 1, "h", {"logs": 1})
    with pytest.raises(FinalityViolation):
        b.publish(state, 1, "h", {})
    with pytest.raises(LeaseObservationUnavailable):
        LeaseAuthority(store, "c", lambda: None).begin_write()
    again = LeaseAuthority(store, "b", lambda: now[0])
    assert again.begin_write()[1] == "reacquired"
    with pytest.raises(InvalidParams):
        LeaseAuthority(store, "c", lambda: 1, lease_blocks=2, renew_threshold=2)


def index_rows(writer, family="logs"):
    return sorted(tuple(r) for r in writer.postings(family).select("kind", "value", "bucket", "count", "first_id", "last_id").collect())


def plain_index(rows, bucket):
    own = {}
    for r in rows.collect():
        for kind, column in (("addr", "address"), ("topic0", "topic0")):
            own.setdefault((kind, r[column], r["log_id"] // bucket), []).append(r["log_id"])
    return sorted((*k, len(v), min(v), max(v)) for k, v in own.items())


def test_index_follows_the_batches(spark, tmp_path):
    """Fragments of each batch, pages of the buckets that are full, the same index whichever they are."""
    store = MemoryPublicationStore()
    writer = Ingestor(spark, str(tmp_path), LeaseAuthority(store, "me", lambda: 1), bucket=8)
    for k, numbers in enumerate(([1, 2], [3, 4], [5, 6, 7])):
        writer.ingest(batch(spark, numbers, logs=3))
        assert index_rows(writer) == plain_index(writer.tables()["logs"], 8)
        assert writer.index.sealed("logs") == [0, 1, 2][k]
    assert sorted(r["bucket"] for r in writer.index.open_buckets("logs", 7).collect()) == [2]
    assert writer.index.seal("logs", 7, 18) == []
    scan, by_index = (HistoryService(writer.tables(), 7, writer=writer, use_index=u) for u in (False, True))
    for where in (LogFilter(address=Clause.one("a1")), LogFilter(address=Clause.any_of(["a0", "a2"]), topic0=Clause.one("t")), LogFilter(address=Clause.any_of([])), LogFilter(topic0=Clause.one("none"))):
        for q in (Request(4, where, 1, 7), Request(3, where, 2, 6, order="desc"), Request(4, where, 1, 7, resume_id=7), Request(4, where, 1, 7, resume_id=7, order="desc")):
            assert scan.query_logs(q) == by_index.query_logs(q)
    assert [r["trace_id"] for r in by_index.query_traces(Request(9, TraceFilter(has_value=True), 1, 7)).items] == [r["trace_id"] for r in scan.query_traces(Request(9, TraceFilter(has_value=True), 1, 7)).items]
    assert scan.list_keys("logs", "address", "a", limit=2) == ["a0", "a1"] and scan.list_keys("logs", "address", "a", after="a1") == ["a2"]


def test_recovery(spark, tmp_path):
    """Leftovers beyond the head and half-written pages go, lost fragments come back, due pages are sealed."""
    store = MemoryPublicationStore()
    writer = Ingestor(spark, str(tmp_path), LeaseAuthority(store, "me", lambda: 1), bucket=8)
    writer.ingest(batch(spark, [1, 2], logs=3))
    publish, writer.authority.publish = writer.authority.publish, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        writer.ingest(batch(spark, [3, 4], logs=3))
    writer.authority.publish = publish
    assert index_rows(writer) == plain_index(writer.tables()["logs"], 8)
    assert writer.recover()["removed_batches"] > 0
    seal, writer.index.seal = writer.index.seal, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        writer.ingest(batch(spark, [3, 4, 5], logs=4))
    writer.index.seal = seal
    assert store.load().head == 5 and index_rows(writer) == plain_index(writer.tables()["logs"], 8)
    spark.range(1).write.parquet(f"{tmp_path}/logs_pages/000000000000-000000000001")
    writer.index._delete(f"{tmp_path}/logs_pages/000000000000-000000000001/_SUCCESS")
    writer.index._delete(f"{tmp_path}/logs_index/{writer.index._names(f'{tmp_path}/logs_index')[0]}")
    done = writer.recover()
    assert done["removed_pages"] == 1 and done["rebuilt_fragments"] == 1 and done["sealed"] >= 1
    assert index_rows(writer) == plain_index(writer.tables()["logs"], 8)
    assert writer.recover() == {"removed_batches": 0, "removed_pages": 0, "rebuilt_fragments": 0, "sealed": 0}


def test_reports(spark, tmp_path):
    writer = Ingestor(spark, f"{tmp_path}/h", LeaseAuthority(MemoryPublicationStore(), "me", lambda: 1))
    made = reports.timed_ingest(writer, [batch(spark, [1, 2]), batch(spark, [3])])
    assert (made["from_block"], made["to_block"], made["blocks"], made["batches"], made["logs"]) == (1, 3, 3, 2, 4) and made["logs_per_second"] > 0
    blocks = spark.createDataFrame([(k, k % 5) for k in range(20)], "block_number long, n_logs long")
    report = reports.density_report(blocks, 10, densest=2)
    assert (report["sampled"], report["max_logs"], report["densest"]) == (2, 0, [{"block_number": 4, "n_logs": 4}, {"block_number": 9, "n_logs": 4}])
    reports.save(spark, f"{tmp_path}/r.json", report)
    assert read_json(spark, f"{tmp_path}/r.json") == report
    assert reports.rate(5, 0) == 0.0


def test_stored_bitmaps_are_trimmed_and_kept_once(spark, tmp_path):
    """Of a lone id one byte of its 4 KB is stored, a bucket inside a batch once; readers get whole bitmaps."""
    writer = Ingestor(spark, str(tmp_path), LeaseAuthority(MemoryPublicationStore(), "me", lambda: 1), bucket=8)
    writer.ingest(batch(spark, [1, 2], logs=10))  # ids 0 to 19: buckets 0 and 1 lie inside
    writer.ingest(batch(spark, [3, 4], logs=14))  # 20 to 33: bucket 2 is joined, 3 lies inside, 4 is open
    files = {k: spark.read.schema(SCHEMA).parquet(*[f"{tmp_path}/logs_{k}/{n}" for n in writer.index._names(f"{tmp_path}/logs_{k}")]) for k in ("whole", "index", "pages")}
    assert {k: sorted({r[0] for r in v.select("bucket").collect()}) for k, v in files.items()} == {"whole": [0, 1, 3], "index": [2, 4], "pages": [2]}
    assert {r[0] for v in files.values() for r in v.select(F.length("bits")).collect()} == {1}
    assert {r[0] for r in writer.postings("logs").select(F.length("bits")).collect()} == {4096}
    assert index_rows(writer) == plain_index(writer.tables()["logs"], 8)
    found = postings.candidates(writer.postings("logs"), {"addr": ["a3", "a5"]}, 8)
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in writer.tables()["logs"].where("address in ('a3', 'a5')").select("log_id").collect())
    writer.index._delete(f"{tmp_path}/logs_whole/{writer.index._names(f'{tmp_path}/logs_whole')[0]}")
    assert writer.recover()["rebuilt_fragments"] == 1
    assert index_rows(writer) == plain_index(writer.tables()["logs"], 8)


def test_wide_bitmaps_survive_trimming(spark):
    """Any span of bytes inside a bucket of full size, and joining two of them."""
    ids = [0, 7, 8, 32_767, 32_768, 40_001, 65_535, 70_000, 70_009, 98_000]
    entries = spark.createDataFrame([("k", str(i % 2), i) for i in ids], "kind string, value string, row_id long")
    made = postings.build(entries)
    stored = made.withColumn("bits", postings.trimmed())
    whole = stored.withColumn("bits", postings.whole())
    key = lambda df: sorted((r["value"], r["bucket"], bytes(r["bits"]), r["count"]) for r in df.collect())
    assert key(whole) == key(made) == key(postings.compact(stored.union(stored)))


def test_ids_without_broadcast(spark, monkeypatch):
    from ledgerloom.operators import ids

    blocks = spark.range(1, 9).select(F.col("id").alias("block_num"))
    rows = spark.createDataFrame([(n, k) for n in range(1, 9) if n != 4 for k in range(n)], "block_num long, idx long")
    windows, want = ids.block_windows(rows, blocks, 5), sorted(tuple(r) for r in ids.assign_ids(rows, "idx", "id", 5).select("block_num", "idx", "id").collect())
    for most in (500_000, 3):
        monkeypatch.setattr(ids, "BROADCAST_BLOCKS", most)
        got = [tuple(r) for r in ids.placed_ids(rows, windows, "idx", "id", 8).select("block_num", "idx", "id").collect()]
        assert got == want  # in order, too
