"""Datasets of stream statistics and query traces: Parquet and JSON lines with fixed schemas, published as a whole."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __name__ as package
from ..errors import BackendError, InvalidParams, NotFound
from ..operators import stats, workload
from ..scratch import discard, materialized
from ..streaming import accepted, verdict

#: Columns and row order (- for descending) of each statistics table: fixed formats.
SCHEMAS = {
    "key_stats": "key_type string, key_value string, count_total long, first_block long, last_block long, active_block_count long, distinct_partner_estimate double",
    "cooccurrence": "pair_type string, left_key string, right_key string, count_total long, first_block long, last_block long",
    "range_stats": "metric string, bucket_lower long, bucket_upper long, count long, window_size_blocks long",
}
ORDER = {"key_stats": ["key_type", "key_value"], "cooccurrence": ["pair_type", "-count_total", "left_key", "right_key"], "range_stats": ["metric", "bucket_lower"]}
TRACE = (
    "id long, profile string, template string, from_block long, to_block long, address_or array<string>, topic0_or array<string>, topic1_or array<string>, "
    "topic2_or array<string>, topic3_or array<string>, expected_selectivity_bucket string, observed_block_coverage_ratio double, notes array<string>"
)
VERSION = "1.0.0"


@dataclass(frozen=True)
class Manifest:
    schema_version: str
    package: str
    chain_id: int
    start_block: int
    end_block: int
    blocks_observed: int
    gap_count: int
    missing_block_ranges: list | None
    event_count: int
    log_count: int
    created_at: str
    config_hash: str
    seed: int | None
    valid: bool
    invalid_reason: str | None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One pretty JSON file, on any Hadoop file system."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=2).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()  # a manifest or a summary: of fixed size
    return json.loads(rows[0][0])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_stats(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table in its fixed schema; sorted over all files, so that a key's row group is found by its bounds."""
    for name, df in tables.items():
        typed = df.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in SCHEMAS[name].split(", "))])
        order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDER[name]]
        typed.sort(*order).write.parquet(f"{folder}/{name}.parquet")


def read_stats(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in SCHEMAS.items()}


def write_traces(traces: DataFrame, folder: str) -> None:
    """JSON lines in a folder per profile, in id order; fields that are null are left out."""
    number = F.substring_index("id", "-", -1).cast("long")
    rows = traces.select(number.alias("id"), *[c for c in traces.columns if c != "id"])
    for profile in workload.PROFILES:
        rows.where(F.col("profile") == profile).sort("id").write.mode("overwrite").json(f"{folder}/trace_{profile}.jsonl")


def load_traces(spark: SparkSession, folder: str, profiles: list[str] | None = None) -> DataFrame:
    """Trace entries of the profiles named; blank lines are skipped, a line that is no entry is an error."""
    wanted = list(profiles or workload.PROFILES)
    for p in wanted:
        if p not in workload.PROFILES:
            raise InvalidParams(f"no profile {p}")
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json([f"{folder}/trace_{p}.jsonl" for p in wanted])


def publish(spark: SparkSession, made: str, target: str) -> None:
    """Move a complete folder into place; the target must not be there, so readers see all of it or nothing."""
    fs, p = _fs(spark, target)
    if fs.exists(p) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(made), p):
        raise BackendError(f"{target} is there already or can't be made")


def collect(spark: SparkSession, events: DataFrame, logs: DataFrame, target: str, chain_id: int = 1, expected_end: int | None = None, closed: bool = True, config: workload.Config | None = None) -> Manifest:
    """Validate a stream, gather its statistics and publish them with a manifest; an invalid stream is kept up to its error.

    ``events(seq, chain_id, block_number, block_hash, timestamp)``, ``logs(block_number, address, topic0..3)``.
    """
    config = (config or workload.Config()).validate()
    began = time.perf_counter()
    kept = materialized(accepted(events, chain_id).select("block_number", "timestamp"))
    found = verdict(events, chain_id, expected_end, closed)
    own = logs.join(kept.select("block_number"), "block_number", "left_semi").withColumnRenamed("block_number", "block_num")
    own = materialized(own)
    counts = own.groupBy("block_num").agg(F.count("*").alias("n_logs"))
    blocks = kept.join(counts, F.col("block_number") == F.col("block_num"), "left").select("block_number", "timestamp", F.coalesce("n_logs", F.lit(0).cast("long")).alias("n_logs"))
    blocks = materialized(blocks)
    missing = [[r["start"], r["end"]] for r in stats.first_gaps(blocks).collect()]  # at most GAPS_KEPT
    sums = stats.summary(blocks).first()
    made = Manifest(
        VERSION, package.split(".")[0], chain_id, found["start_block"] or 0, found["end_block"] or 0, found["blocks_observed"], stats.gaps(blocks).count(), missing or None,
        found["blocks_observed"], sums["log_count"], str(int(time.time())), config.digest(), None, found["valid"], found["error"],
    )
    size = config.logs_per_window_size_blocks
    ranges = stats.logs_per_block(blocks).union(stats.logs_per_window(blocks, size)).union(stats.interarrival(blocks))
    folder = f"{target.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    write_stats({"key_stats": stats.key_stats(own), "cooccurrence": stats.top_pairs(stats.cooccurrence(own), config.cooccurrence_top_k_per_type), "range_stats": ranges}, folder)
    write_json(spark, f"{folder}/dataset_manifest.json", asdict(made))
    write_json(spark, f"{folder}/run_summary.json", _summary(made, write=time.perf_counter() - began))
    publish(spark, folder, target)
    discard(kept, own, blocks)
    return made


def _summary(m: Manifest, write: float = 0.0, generate: float = 0.0, counts: dict | None = None) -> dict:
    return {
        "blocks_seen": m.blocks_observed, "logs_seen": m.log_count, "artifact_write_seconds": write, "trace_generate_seconds": generate,
        "trace_queries_generated": dict.fromkeys(workload.PROFILES, 0) | (counts or {}), "dataset_valid": m.valid, "invalid_reason": m.invalid_reason,
    }


def generate(spark: SparkSession, dataset: str, seed: int, config: workload.Config | None = None) -> dict[str, int]:
    """Draw traces from a published dataset's statistics; {profile: traces}.  The seed goes into its manifest."""
    config = replace(config or workload.Config(), seed=seed).validate()
    began = time.perf_counter()
    if not exists(spark, f"{dataset}/dataset_manifest.json"):
        raise NotFound(f"no dataset at {dataset}")
    manifest = Manifest(**read_json(spark, f"{dataset}/dataset_manifest.json") | {"seed": seed})
    keys = read_stats(spark, dataset)["key_stats"]
    if keys.where("key_type in ('address', 'topic0')").select("key_type").distinct().count() < 2:
        raise InvalidParams("traces need statistics of addresses and of first topics")
    write_json(spark, f"{dataset}/dataset_manifest.json", asdict(manifest))
    made = workload.traces(spark, keys, manifest.start_block, manifest.end_block, [tuple(r) for r in manifest.missing_block_ranges or []], config)
    write_traces(made, dataset)
    counts = {r["profile"]: r["count"] for r in load_traces(spark, dataset).groupBy("profile").count().collect()}
    old = read_json(spark, f"{dataset}/run_summary.json") if exists(spark, f"{dataset}/run_summary.json") else {}
    write_json(spark, f"{dataset}/run_summary.json", _summary(manifest, old.get("artifact_write_seconds", 0.0), time.perf_counter() - began, counts))
    return dict.fromkeys(workload.PROFILES, 0) | counts


def collect_and_generate(spark: SparkSession, events: DataFrame, logs: DataFrame, target: str, seed: int, **how) -> dict[str, int]:
    """Both steps; an invalid stream leaves its dataset and is an error."""
    made = collect(spark, events, logs, target, **how)
    if not made.valid:
        raise InvalidParams(f"no traces are drawn from an invalid dataset: {made.invalid_reason}")
    return generate(spark, target, seed, how.get("config"))
