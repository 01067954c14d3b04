"""Reports of ingests, replays and densities, as plain dicts and as JSON files on any Hadoop file system."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .ingest import Ingestor
from .operators import stats
from .sources.artifacts import write_json


def rate(n: int, seconds: float) -> float:
    return n / seconds if seconds > 0 else 0.0


def timed_ingest(writer: Ingestor, batches: Iterable[dict[str, DataFrame]]) -> dict:
    """Ingests the batches one after another: what was written, how long it took, and the rates."""
    began, before = time.perf_counter(), (writer.authority.store.load() or None)
    first, sums, n = before.head if before else 0, {"logs": 0, "txs": 0, "traces": 0}, 0
    head = first
    for batch in batches:
        out = writer.ingest(batch)
        head, n = out["head"], n + 1
        for family in sums:
            sums[family] += out[f"written_{family}"]
    took = time.perf_counter() - began
    counts = {"batches": n, "blocks": head - first, **sums}
    return {"from_block": first + 1, "to_block": head, "seconds": took, **counts, **{f"{k}_per_second": rate(v, took) for k, v in counts.items() if k != "batches"}}


def density_report(blocks: DataFrame, step: int, start: int = 0, densest: int = 20) -> dict:
    """Averages over every ``step``-th block, and the ``densest`` blocks."""
    found = stats.density(blocks, step, start).first().asDict()
    top = [r.asDict() for r in stats.densest(blocks, densest).select("block_number", "n_logs").collect()]
    return {"step": step, "start": start, **found, "densest": top}


def save(spark: SparkSession, path: str, report: dict) -> None:
    write_json(spark, path, report)
