"""DuckDB SQL for the registered chain queries, over the same star-schema tables."""

BASE = """WITH days AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS block_num FROM (SELECT DISTINCT o_orderdate FROM orders)),
blocks AS (
  SELECT CAST(block_num AS BIGINT) AS block_num, sha256(concat('block:', block_num)) AS block_hash,
    CASE WHEN block_num = 1 THEN repeat('0', 64) ELSE sha256(concat('block:', block_num - 1)) END AS parent_hash, CAST(date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS BIGINT) AS timestamp FROM days),
txs0 AS (
  SELECT block_num, row_number() OVER (PARTITION BY block_num ORDER BY o_orderkey) - 1 AS tx_idx, o_orderkey AS order_key, sha256(concat('tx:', o_orderkey)) AS tx_hash,
    lpad(lower(to_hex(o_custkey)), 40, '0') AS from_addr, CASE WHEN o_orderstatus <> 'P' THEN lpad(lower(to_hex(o_orderkey % 25)), 40, '0') END AS to_addr, o_orderkey % 7 AS input_len, o_orderpriority
  FROM orders JOIN days USING (o_orderdate)),
txs AS (
  SELECT block_num, tx_idx, order_key, tx_hash, from_addr, to_addr, input_len,
    CASE WHEN to_addr IS NOT NULL AND input_len >= 4 THEN substr(sha256(concat('sel:', o_orderpriority)), 1, 8) END AS selector, row_number() OVER (ORDER BY block_num, tx_idx) - 1 AS tx_id FROM txs0),
items AS (SELECT t.block_num, t.tx_idx, t.from_addr AS tx_from, t.to_addr AS tx_to, l.* FROM lineitem l JOIN txs t ON l.l_orderkey = t.order_key),
logs0 AS (
  SELECT block_num, tx_idx, row_number() OVER (PARTITION BY block_num ORDER BY tx_idx, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS log_idx,
    lpad(lower(to_hex(l_suppkey)), 40, '0') AS address, concat(l_returnflag, l_linestatus) AS topic0, CAST(l_partkey AS VARCHAR) AS topic1,
    CASE WHEN l_discount > 0.03 THEN CAST(l_linenumber AS VARCHAR) END AS topic2, CASE WHEN l_discount > 0.03 AND l_tax > 0.04 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS topic3, lpad(lower(to_hex(l_partkey)), 64, '0') AS data FROM items),
logs AS (SELECT *, row_number() OVER (ORDER BY block_num, log_idx) - 1 AS log_id FROM logs0),
traces0 AS (
  SELECT block_num, tx_idx, 0::BIGINT AS trace_idx, 0::BIGINT AS depth, CASE WHEN to_addr IS NULL THEN 3 ELSE 0 END::BIGINT AS typ, 0::BIGINT AS flags, from_addr, to_addr, '00' AS value_hex, input_len, selector FROM txs
  UNION ALL
  SELECT block_num, tx_idx, row_number() OVER (PARTITION BY block_num, tx_idx ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate),
    1 + l_linenumber % 3, l_linenumber % 5, l_partkey % 3, coalesce(tx_to, tx_from), CASE WHEN l_linenumber % 5 <> 3 THEN lpad(lower(to_hex(l_suppkey)), 40, '0') END,
    CASE WHEN l_tax < 0.01 THEN '00' ELSE lpad(lower(to_hex(CAST(l_quantity AS BIGINT))), CAST(2 * ((length(to_hex(CAST(l_quantity AS BIGINT))) + 1) // 2) AS INTEGER), '0') END, l_partkey % 7,
    CASE WHEN ((l_linenumber % 5 = 0 AND l_partkey % 3 IN (0, 1)) OR l_linenumber % 5 IN (1, 2)) AND l_partkey % 7 >= 4 THEN substr(sha256(concat('sel:', l_partkey % 11)), 1, 8) END FROM items),
traces AS (
  SELECT *, depth = 0 AS is_top_level, ltrim(value_hex, '0') <> '' AS has_value, (typ = 0 AND flags IN (0, 1)) OR typ IN (1, 2) AS is_call, row_number() OVER (ORDER BY block_num, tx_idx, trace_idx) - 1 AS trace_id FROM traces0),
log_windows AS (
  SELECT block_num, CAST(sum(n) OVER (ORDER BY block_num) - n AS BIGINT) AS first_id, n AS count FROM (SELECT b.block_num, count(l.log_id) AS n FROM blocks b LEFT JOIN logs l USING (block_num) GROUP BY 1)),
event_logs AS (
  SELECT s // 60 AS block_number, event_id, s AS second, lpad(lower(to_hex(user_id)), 40, '0') AS address, event_type AS topic0, CASE WHEN value >= 50 THEN regexp_extract(props, '([0-9]+)', 1) END AS topic1
  FROM (SELECT *, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000) AS BIGINT) AS s FROM events)),
event_blocks AS (SELECT block_number, sha256(concat('ev:', block_number)) AS block_hash, min(second) + 1704067200 AS timestamp, count(*) AS n_logs FROM event_logs GROUP BY 1),
streams AS (
  SELECT 'addr' AS kind, address AS value, log_id AS row_id FROM logs UNION ALL SELECT 'topic0', topic0, log_id FROM logs UNION ALL SELECT 'topic1', topic1, log_id FROM logs
  UNION ALL SELECT 'topic2', topic2, log_id FROM logs WHERE topic2 IS NOT NULL UNION ALL SELECT 'topic3', topic3, log_id FROM logs WHERE topic3 IS NOT NULL),
postings AS (SELECT kind, value, row_id // 32768 AS bucket, count(*) AS count, min(row_id) AS first_id, max(row_id) AS last_id FROM streams GROUP BY 1, 2, 3),
keyed AS (
  SELECT 'address' AS key_type, address AS key_value, topic0 AS partner, block_num FROM logs UNION ALL SELECT 'topic0', topic0, address, block_num FROM logs UNION ALL SELECT 'topic1', topic1, NULL, block_num FROM logs
  UNION ALL SELECT 'topic2', topic2, NULL, block_num FROM logs UNION ALL SELECT 'topic3', topic3, NULL, block_num FROM logs UNION ALL SELECT 'address_topic0', concat(address, topic0), NULL, block_num FROM logs),
key_stats AS (
  SELECT key_type, key_value, count(*) AS count_total, min(block_num) AS first_block, max(block_num) AS last_block, count(DISTINCT block_num) AS active_block_count,
    CASE WHEN count(partner) > 0 THEN CAST(count(DISTINCT partner) AS DOUBLE) END AS distinct_partner_estimate FROM keyed WHERE key_value IS NOT NULL GROUP BY 1, 2),
gaps AS (SELECT prev + 1 AS start, block_number - 1 AS "end" FROM (SELECT block_number, lag(block_number) OVER (ORDER BY block_number) AS prev FROM event_blocks) WHERE block_number > prev + 1)
"""

ADDRS = "('0000000000000000000000000000000000000001', '0000000000000000000000000000000000000002', '0000000000000000000000000000000000000003')"
LOG = "log_id, block_num, tx_idx, log_idx, address, topic0, topic1, topic2, topic3"
TX = "tx_id, block_num, tx_idx, tx_hash, from_addr, to_addr, input_len, selector"
TRACE = "trace_id, block_num, tx_idx, trace_idx, depth, typ, flags, from_addr, to_addr, value_hex, selector"


def _histogram(metric: str, values: str, window: str = "CAST(NULL AS BIGINT)") -> str:
    low = "CASE WHEN v <= 0 THEN 0 ELSE CAST(1 AS BIGINT) << (length(bin(v)) - 1) END"
    return f"SELECT '{metric}' AS metric, CAST({low} AS BIGINT) AS bucket_lower, CAST(CASE WHEN v <= 0 THEN 1 ELSE 2 * {low} END AS BIGINT) AS bucket_upper, count(*) AS count, {window} AS window_size_blocks FROM ({values}) GROUP BY 2, 3"


QUERIES = {
    "chain_blocks": "SELECT * FROM blocks",
    "chain_txs": f"SELECT {TX} FROM txs",
    "chain_logs": f"SELECT {LOG}, data FROM logs",
    "chain_traces": f"SELECT {TRACE}, input_len, is_top_level, has_value, is_call FROM traces",
    "block_windows": "SELECT * FROM log_windows",
    "log_filter_page": f"SELECT {LOG} FROM logs WHERE block_num BETWEEN 100 AND 900 AND address IN {ADDRS} AND topic0 IN ('NO', 'RF') AND topic2 IS NOT NULL ORDER BY log_id LIMIT 200",
    "log_filter_address_one": f"SELECT {LOG} FROM logs WHERE address = '0000000000000000000000000000000000000001'",
    "log_filter_address_or": f"SELECT {LOG} FROM logs WHERE address IN {ADDRS}",
    "log_filter_topic_any_vs_value": "SELECT 'any' AS clause, count(*) AS n FROM logs UNION ALL SELECT 'value', count(*) FROM logs WHERE topic2 IN ('1', '2')",
    "log_filter_empty_or": f"SELECT {LOG} FROM logs WHERE FALSE",
    "log_filter_compound": f"SELECT {LOG} FROM logs WHERE address IN {ADDRS} AND topic0 = 'NO' AND topic2 IN ('1', '2', '3')",
    "log_resume_page": f"SELECT {LOG} FROM logs WHERE address IN {ADDRS} AND log_id > 500 ORDER BY log_id LIMIT 50",
    "log_page_walk": f"SELECT log_id, CAST(ceil(row_number() OVER (ORDER BY log_id) / 100.0) AS BIGINT) AS page FROM logs WHERE address IN {ADDRS}",
    "log_unfiltered_scan": f"SELECT {LOG} FROM logs",
    "log_id_window": "SELECT min(first_id) AS first_id, max(first_id + count - 1) AS last_id FROM log_windows WHERE count > 0 AND block_num BETWEEN 100 AND 900",
    "log_desc_page": f"SELECT {LOG} FROM logs WHERE address IN {ADDRS} ORDER BY log_id DESC LIMIT 100",
    "log_block_refs": f"SELECT log_id, block_num, block_hash, parent_hash FROM logs JOIN blocks USING (block_num) WHERE address IN {ADDRS}",
    "log_join_tx_block": f"SELECT log_id, tx_hash, from_addr, to_addr, block_hash, timestamp FROM logs JOIN txs USING (block_num, tx_idx) JOIN blocks USING (block_num) WHERE address IN {ADDRS}",
    "tx_filter_from": f"SELECT {TX} FROM txs WHERE from_addr IN {ADDRS}",
    "tx_filter_to": f"SELECT {TX} FROM txs WHERE to_addr IN {ADDRS}",
    "tx_filter_selector": f"SELECT {TX} FROM txs WHERE selector = substr(sha256('sel:1-URGENT'), 1, 8)",
    "tx_by_hash": f"SELECT {TX} FROM txs WHERE tx_hash = sha256('tx:7')",
    "trace_filter_selector": f"SELECT {TRACE} FROM traces WHERE selector IN (substr(sha256('sel:1'), 1, 8), substr(sha256('sel:2'), 1, 8))",
    "trace_filter_top_level": f"SELECT {TRACE} FROM traces WHERE is_top_level AND to_addr IN {ADDRS}",
    "trace_filter_has_value": f"SELECT {TRACE} FROM traces WHERE has_value AND from_addr IN {ADDRS}",
    "trace_transfers": f"SELECT trace_id, block_num, tx_idx, from_addr, to_addr, value_hex, is_top_level FROM traces WHERE has_value AND to_addr IN {ADDRS}",
    "blocks_page": "SELECT * FROM blocks WHERE block_num BETWEEN 5 AND 500 ORDER BY block_num LIMIT 100",
    "block_with_txs": "SELECT block_num, count(tx_idx) AS n_txs, coalesce(string_agg(tx_hash, ',' ORDER BY tx_idx), '') AS tx_hashes FROM blocks LEFT JOIN txs USING (block_num) GROUP BY 1",
    "key_stats_address": "SELECT key_value, count_total, first_block, last_block, active_block_count, distinct_partner_estimate FROM key_stats WHERE key_type = 'address'",
    "key_stats_all": "SELECT * FROM key_stats",
    "key_stats_address_topic0": "SELECT key_value, count_total, active_block_count FROM key_stats WHERE key_type = 'address_topic0'",
    "cooccurrence_topk": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_type ORDER BY count_total DESC, left_key, right_key) AS rank FROM (
  SELECT 'address_topic0' AS pair_type, address AS left_key, topic0 AS right_key, count(*) AS count_total, min(block_num) AS first_block, max(block_num) AS last_block FROM logs GROUP BY 2, 3
  UNION ALL SELECT 'topic0_topic1', topic0, topic1, count(*), min(block_num), max(block_num) FROM logs GROUP BY 2, 3)) WHERE rank <= 50""",
    "hist_logs_per_block": _histogram("logs_per_block", "SELECT n_logs AS v FROM event_blocks"),
    "hist_logs_per_window": _histogram("logs_per_window", "SELECT coalesce(n, 0) AS v FROM (SELECT unnest(generate_series(0, (max(block_number) - min(block_number)) // 60)) AS w FROM event_blocks) LEFT JOIN (SELECT (block_number - (SELECT min(block_number) FROM event_blocks)) // 60 AS w, CAST(sum(n_logs) AS BIGINT) AS n FROM event_blocks GROUP BY 1) USING (w)", "CAST(60 AS BIGINT)"),
    "hist_interarrival": _histogram("interarrival_seconds", "SELECT timestamp - prev AS v FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY block_number) AS prev FROM event_blocks WHERE timestamp > 0) WHERE timestamp >= prev"),
    "dataset_summary": "SELECT count(*) AS blocks_observed, CAST(sum(n_logs) AS BIGINT) AS log_count, min(block_number) AS start_block, max(block_number) AS end_block FROM event_blocks",
    "gap_ranges": "SELECT * FROM gaps ORDER BY start LIMIT 100",
    "gap_count": "SELECT count(*) AS gap_count, CAST(sum(\"end\" - start + 1) AS BIGINT) AS missing FROM gaps",
    "validate_events_first_error": """, e AS (
  SELECT row_number() OVER (ORDER BY block_number) AS seq, CAST(1 AS BIGINT) AS chain_id, block_number, block_hash FROM event_blocks UNION ALL
  SELECT 1000000, 1, min(block_number), 'other' FROM event_blocks UNION ALL SELECT 1000001, 2, 0, 'x')
SELECT seq, block_number, 'block_hash_mismatch' AS error FROM e WHERE seq = 1000000""",
    "event_dedup": "SELECT block_number, block_hash FROM event_blocks",
    "postings_build": "SELECT * FROM postings",
    "postings_or": f"SELECT DISTINCT row_id FROM streams WHERE kind = 'addr' AND value IN {ADDRS}",
    "postings_and": f"SELECT log_id AS row_id FROM logs WHERE address IN {ADDRS} AND topic0 IN ('NO', 'RF')",
    "postings_semi_join": f"SELECT {LOG} FROM logs WHERE address IN {ADDRS} AND topic0 IN ('NO', 'RF') AND topic2 = '1'",
    "candidate_page": f"SELECT {LOG} FROM logs WHERE address IN {ADDRS} AND topic0 = 'NO' AND log_id BETWEEN 100 AND 5000 ORDER BY log_id LIMIT 20",
    "page_cardinality_estimate": f"SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS estimate FROM postings WHERE kind = 'addr' AND value IN {ADDRS} AND first_id <= 5000 AND last_id >= 100",
    "tx_streams": "SELECT kind, count(*) AS n, count(DISTINCT value) AS kinds FROM (SELECT 'from' AS kind, from_addr AS value FROM txs UNION ALL SELECT 'to', to_addr FROM txs WHERE to_addr IS NOT NULL UNION ALL SELECT 'selector', selector FROM txs WHERE selector IS NOT NULL) GROUP BY 1",
    "trace_streams": "SELECT kind, count(*) AS n, count(DISTINCT value) AS kinds FROM (SELECT 'from' AS kind, from_addr AS value FROM traces UNION ALL SELECT 'to', to_addr FROM traces WHERE to_addr IS NOT NULL UNION ALL SELECT 'selector', selector FROM traces WHERE selector IS NOT NULL UNION ALL SELECT 'has_value', '01' FROM traces WHERE has_value) GROUP BY 1",
    "directory_resolve": "SELECT log_id AS row_id, block_num, log_idx AS ordinal FROM logs",
    "contiguous_runs": f"SELECT block_num, min(log_id) AS first_id, max(log_id) AS last_id, count(*) AS length FROM (SELECT block_num, log_id, log_id - row_number() OVER (PARTITION BY block_num ORDER BY log_id) AS island FROM logs WHERE topic0 IN ('NO', 'RF')) GROUP BY block_num, island",
    "shard_local_page": "SELECT log_id, (log_id * 5000) >> 24 AS shard, (log_id * 5000) & 16777215 AS local, ((log_id * 5000) & 16777215) // 4096 * 4096 AS page, concat('addr/', address, '/', lpad(lower(to_hex((log_id * 5000) >> 24)), 10, '0')) AS stream FROM logs",
    "density_scan": "SELECT count(*) AS sampled, avg(n_logs) AS avg_logs, max(n_logs) AS max_logs, CAST(sum(n_logs) AS BIGINT) AS sum_logs FROM event_blocks WHERE block_number % 10 = 0",
    "density_topk": "SELECT block_number, n_logs FROM event_blocks ORDER BY n_logs DESC, block_number LIMIT 20",
    "coverage_ratio": """, q AS (SELECT id, id * 100 AS a, id * 100 + 499 AS b FROM (SELECT unnest(generate_series(0, (SELECT max(block_number) FROM event_blocks) // 100)) AS id))
SELECT id, greatest(least((500 - coalesce((SELECT sum(greatest(least(b, "end") - greatest(a, start) + 1, 0)) FROM (SELECT * FROM gaps ORDER BY start LIMIT 100)), 0)) / 500.0::DOUBLE, 1.0), 0.0) AS ratio FROM q""",
    "selectivity_buckets": "SELECT v, CASE WHEN v <= 0 THEN 'empty' WHEN v <= 9 THEN 'tiny' WHEN v <= 99 THEN 'small' WHEN v <= 9999 THEN 'medium' WHEN v <= 999999 THEN 'large' ELSE 'huge' END AS bucket FROM (SELECT DISTINCT count_total * count_total AS v FROM key_stats)",
    "latency_percentiles": """, s AS (SELECT n_logs AS v, row_number() OVER (ORDER BY n_logs) - 1 AS k, count(*) OVER () AS n FROM event_blocks)
SELECT share, v AS value FROM (VALUES (0.5::DOUBLE), (0.95), (0.99), (1.0)) p(share) JOIN s ON k = CAST(floor((n - 1) * share + 0.5) AS BIGINT)""",
    "count_by_key_type": "SELECT key_type, count(*) AS n FROM key_stats GROUP BY 1",
    "ingest_roundtrip": f"SELECT {LOG}, data FROM logs",
    "index_after_ingest": "SELECT * FROM postings",
    "recovered_index": "SELECT * FROM postings",
    "indexed_page": f"""SELECT log_id, block_num, address, n > 50 AS has_more, CASE WHEN n > 50 THEN max(log_id) OVER () END AS next_resume_id, sha256(concat('block:', 900)) AS to_hash FROM (
  SELECT log_id, block_num, address, row_number() OVER (ORDER BY log_id) AS k, count(*) OVER () AS n FROM logs WHERE address IN {ADDRS} AND topic0 = 'NO' AND block_num BETWEEN 10 AND 900) WHERE k <= 50""",
    "stream_validation": "SELECT FALSE AS valid, 'block_hash_mismatch' AS error, count(*) AS blocks_observed, min(block_number) AS start_block, max(block_number) AS end_block FROM event_blocks",
    "rlp_decode": "SELECT block_num, tx_idx, tx_hash, from_addr, to_addr, input_len, CASE WHEN to_addr IS NOT NULL AND input_len >= 4 THEN '00000000' END AS selector FROM txs",
    "ingest_outcome": "SELECT (SELECT max(block_num) FROM blocks) AS head, (SELECT count(*) FROM logs) AS written_logs, (SELECT count(*) FROM txs) AS written_txs, (SELECT count(*) FROM traces) AS written_traces",
    "key_prefix_listing": "SELECT DISTINCT address AS key FROM logs WHERE starts_with(address, '000000000000000000000000000000000000000') AND address > '0000000000000000000000000000000000000002' ORDER BY 1 LIMIT 5",
    "linkage_check": "SELECT count(*) AS blocks, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> parent_hash THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM (SELECT parent_hash, lag(block_hash) OVER (ORDER BY block_num) AS prev FROM blocks)",
    "event_flattening": """SELECT block_num AS block_number, dense_rank() OVER (PARTITION BY block_num ORDER BY tx_idx) - 1 AS tx_index, log_idx AS log_index, address, topic0, topic1, topic2, topic3 FROM logs""",
    "renumbered_blocks": "SELECT block_num - 100 AS block_num, block_hash, CASE WHEN block_num = 101 THEN repeat('0', 64) ELSE parent_hash END AS parent_hash FROM blocks WHERE block_num > 100",
    "publication_cas": "SELECT writer, seen, published, (SELECT max(block_num) FROM blocks) AS head FROM (VALUES ('a', 0::BIGINT, 1::BIGINT), ('b', 0, NULL), ('b', 1, 2)) v(writer, seen, published)",
    "sealed_buckets": "SELECT unnest(generate_series(0, (SELECT max(log_id) + 1 FROM logs) // 10000 - 1)) * 10000 AS start",
}


def _draw(profile: str, name: str, k: str = "") -> str:
    from ..operators.workload import derived_seed

    return f"CAST('0x' || substr(sha256(concat_ws(':', '{derived_seed(7, profile)}', CAST(n AS VARCHAR), '{name}'{k})), 1, 12) AS BIGINT)"


def _workload() -> tuple[str, str, str]:
    """SQL of the traces, of what each profile's files hold, and of the size of each trace's result."""
    from ..operators.workload import PROFILES, TEMPLATES, Config, derived_seed

    parts = []
    for profile, p in PROFILES.items():
        unit, total, cases = "281474976710656.0", 0.0, []
        for name, share in zip(TEMPLATES, p["mix"], strict=True):
            total += share
            cases.append(f"WHEN ut / {unit} <= CAST('{total!r}' AS DOUBLE) THEN '{name}'")
        (low, high), (t_low, t_high) = p["widths"], p["topic_widths"]
        most = f"least({p['span'][1] or 9223372036854775807}, e - s + 1)"
        pick = lambda u, a, b: f"CAST({a} + floor({u} / CAST({unit} AS DOUBLE) * ({b} - {a} + 1)) AS BIGINT)"
        parts.append(f"""SELECT n, profile, template, a AS from_block, a + span - 1 AS to_block, span, aw, tw FROM (SELECT *, {pick("us", "s", "(e - span + 1)")} AS a FROM (
  SELECT *, CASE {" ".join(cases)} ELSE 'compound' END AS template FROM (
  SELECT n, '{profile}' AS profile, s, e, {_draw(profile, "template")} AS ut, {_draw(profile, "start")} AS us, {pick(_draw(profile, "span"), f"least({p['span'][0]}, {most})", most)} AS span,
    {pick(_draw(profile, "a_width"), low, high)} AS aw, {pick(_draw(profile, "t_width"), t_low, t_high)} AS tw FROM r, (SELECT unnest(generate_series(0, {Config().trace_size_per_profile - 1})) AS n))))""")
    drawn = ", r AS (SELECT min(block_num) AS s, max(block_num) AS e FROM logs), u AS (" + " UNION ALL ".join(parts) + ")\n"
    widths = """CASE WHEN template IN ('single_address', 'address_topic0') THEN 1 WHEN template IN ('multi_address', 'compound') THEN aw ELSE 0 END AS n_addresses,
  CASE WHEN template IN ('single_topic0', 'address_topic0') THEN 1 WHEN template IN ('multi_topic0', 'compound') THEN tw ELSE 0 END AS n_topics"""
    name = "concat(profile, '-', lpad(CAST(n AS VARCHAR), 8, '0')) AS id"
    seed = "CASE profile " + " ".join(f"WHEN '{p}' THEN '{derived_seed(7, p)}'" for p in PROFILES) + " END"
    replayed = f""", t AS (SELECT {name}, *, {widths} FROM u),
pool AS (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY substr(sha256(key), 1, 3), key) - 1 AS at, count(*) OVER (PARTITION BY kind) AS size
  FROM (SELECT key_type AS kind, key_value AS key FROM key_stats WHERE key_type IN ('address', 'topic0'))),
wanted AS (SELECT id, profile, n, 'address' AS kind, unnest(generate_series(1, n_addresses)) AS k FROM t UNION ALL SELECT id, profile, n, 'topic0', unnest(generate_series(1, n_topics)) FROM t),
drawn AS (SELECT DISTINCT id, w.kind, key FROM wanted w JOIN (SELECT DISTINCT kind, size FROM pool) s USING (kind)
  JOIN pool p ON p.kind = w.kind AND p.at = CAST('0x' || substr(sha256(concat_ws(':', {seed}, CAST(n AS VARCHAR), w.kind, CAST(k AS VARCHAR))), 1, 12) AS BIGINT) % s.size),
asked AS (
  SELECT t.id, from_block, to_block, 'a' || a.key AS key FROM t JOIN drawn a ON a.id = t.id AND a.kind = 'address' WHERE n_topics = 0
  UNION ALL SELECT t.id, from_block, to_block, 't' || b.key FROM t JOIN drawn b ON b.id = t.id AND b.kind = 'topic0' WHERE n_addresses = 0
  UNION ALL SELECT t.id, from_block, to_block, 'p' || a.key || '/' || b.key FROM t JOIN drawn a ON a.id = t.id AND a.kind = 'address' JOIN drawn b ON b.id = t.id AND b.kind = 'topic0'),
cum AS (
  SELECT key, block_num, sum(n) OVER (PARTITION BY key ORDER BY block_num) AS upto FROM (
    SELECT key, block_num, count(*) AS n FROM (SELECT unnest(['a' || address, 't' || topic0, 'p' || address || '/' || topic0]) AS key, block_num FROM logs) GROUP BY 1, 2)),
hits AS (
  SELECT q.id, coalesce(hi.upto, 0) - coalesce(lo.upto, 0) AS n FROM (SELECT *, from_block - 1 AS before FROM asked) q
  ASOF LEFT JOIN cum hi ON q.key = hi.key AND q.to_block >= hi.block_num ASOF LEFT JOIN cum lo ON q.key = lo.key AND q.before >= lo.block_num)
SELECT t.id, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS matches FROM t LEFT JOIN hits h ON h.id = t.id GROUP BY 1"""
    estimate = "greatest(n_addresses, 1) * greatest(n_topics, 1) * span"
    bucket = f"CASE WHEN {estimate} <= 0 THEN 'empty' WHEN {estimate} <= 9 THEN 'tiny' WHEN {estimate} <= 99 THEN 'small' WHEN {estimate} <= 9999 THEN 'medium' WHEN {estimate} <= 999999 THEN 'large' ELSE 'huge' END"
    listed = f"SELECT id, profile, template, from_block, to_block, n_addresses, n_topics, {bucket} AS expected_selectivity_bucket FROM (SELECT {name}, *, {widths} FROM u)"
    return drawn + listed, drawn + "SELECT profile, count(*) AS n, min(n) AS low, max(n) AS high, CAST(sum(to_block - from_block + 1) AS BIGINT) AS blocks FROM u GROUP BY 1", drawn + replayed


def oracle_sql() -> dict[str, str]:
    out = {k: BASE + v for k, v in QUERIES.items()}
    out["workload_traces"], out["trace_artifacts"], out["replay_counts"] = (BASE + q for q in _workload())
    part = lambda name, sql, first, n: f"SELECT '{name}' AS name, count(*) AS n_rows, CAST(sum({n}) AS BIGINT) AS total, min({first}) AS first FROM s{name}"
    tables = [("key_stats", QUERIES["key_stats_all"], "key_value", "count_total"), ("cooccurrence", QUERIES["cooccurrence_topk"].replace("rank <= 50", "rank <= 10000"), "left_key", "count_total"), ("range_stats", QUERIES["hist_logs_per_block"], "metric", "count")]
    out["stats_artifacts"] = BASE + "".join(f", s{n} AS ({sql})" for n, sql, _, _ in tables) + " UNION ALL ".join(part(*t) for t in tables)
    return out
