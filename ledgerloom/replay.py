"""Replay of query traces through the service, one at a time, with a latency report."""

from __future__ import annotations

import time
from itertools import islice

from pyspark.sql import DataFrame, Row

from .errors import HistoryError, InvalidParams
from .operators.clause import Clause, LogFilter
from .service import HistoryService, Request

KEYS = ("address", "topic0", "topic1", "topic2", "topic3")


def request_of(trace: Row, limit: int) -> Request:
    """A log query: no values leave a clause out, one is an equality, more are alternatives."""
    chosen = {k: list(trace[f"{k}_or"] or []) for k in KEYS}
    clauses = {k: Clause.one(v[0]) if len(v) == 1 else Clause.any_of(v) for k, v in chosen.items() if v}
    return Request(limit, LogFilter(**clauses), trace["from_block"], trace["to_block"])


def nearest_rank(ordered: list[float], share: float) -> float:
    """The value at round((n - 1) * share), halves up; 0 for none."""
    return ordered[int((len(ordered) - 1) * share + 0.5)] if ordered else 0.0


def latency_report(seconds: list[float], elapsed: float) -> dict:
    s = sorted(seconds)
    return {
        "queries": len(s), "qps": len(s) / elapsed if elapsed > 0 else 0.0, "mean": sum(s) / len(s) if s else 0.0,
        "p50": nearest_rank(s, 0.5), "p95": nearest_rank(s, 0.95), "p99": nearest_rank(s, 0.99), "max": s[-1] if s else 0.0,
    }


def replay(service: HistoryService, traces: DataFrame, limit: int = 100, trace_limit: int | None = None) -> dict:
    """Latencies and result sizes of the traces in id order; ``trace_limit`` stops after so many.

    Traces are fetched a partition at a time.  To count all results of many traces at once use
    :func:`ledgerloom.operators.workload.replay_counts`.
    """
    if limit <= 0 or (trace_limit is not None and trace_limit <= 0):
        raise InvalidParams("limits must be at least 1")
    took, items, failed, began = [], 0, 0, time.perf_counter()
    for trace in islice(traces.sort("profile", "id").toLocalIterator(), trace_limit):
        at = time.perf_counter()
        try:
            items += len(service.query_logs(request_of(trace, limit)).items)
            took.append(time.perf_counter() - at)
        except HistoryError:
            failed += 1
    return latency_report(took, time.perf_counter() - began) | {"items": items, "failed": failed}
