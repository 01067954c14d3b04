"""Queries over finalized history: validation on the driver, then one lazy plan, then a page of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .errors import InvalidParams, NotFound, ReadOnlyMode, Unsupported
from .operators import postings
from .operators.clause import MAX_OR_TERMS, LogFilter, TraceFilter, TxFilter, _Filter, page, prefix_page
from .operators.ids import id_window

FAMILIES = {"logs": "log_id", "txs": "tx_id", "traces": "trace_id"}


@dataclass
class Request:
    limit: int
    filter: _Filter | None = None
    from_block: int | None = None
    to_block: int | None = None
    from_block_hash: str | None = None
    to_block_hash: str | None = None
    resume_id: int | None = None
    order: str = "asc"


@dataclass
class BlockRef:
    number: int
    hash: str
    parent_hash: str


@dataclass
class Page:
    items: list[Row]
    has_more: bool
    next_resume_id: int | None
    from_block: BlockRef | None
    to_block: BlockRef | None
    cursor_block: BlockRef | None


def effective_limit(limit: int, budget: int | None) -> int:
    if limit <= 0:
        raise InvalidParams("limit must be at least 1")
    if budget is not None and budget <= 0:
        raise InvalidParams("max_results must be at least 1")
    return min(limit, budget) if budget is not None else limit


class HistoryService:
    """Readers see blocks up to ``head`` only.  ``tables``: blocks, logs, txs, traces and <family>_windows."""

    def __init__(self, tables: dict[str, DataFrame], head: int, reader_only: bool = True, max_or_terms: int = MAX_OR_TERMS, writer=None, use_index: bool = False):
        """``use_index``: queries with clauses go through the writer's postings; the same rows as by scanning."""
        self.tables, self.head, self.reader_only, self.max_or_terms, self.writer, self.use_index = tables, head, reader_only, max_or_terms, writer, use_index

    def indexed_finalized_head(self) -> int:
        return self.head

    def status(self) -> dict:
        """The head and the next id of each family."""
        out = {"head": self.head}
        for family in FAMILIES:
            w = self.tables[f"{family}_windows"].where(F.col("block_num") <= self.head)
            out[f"next_{family}_id"] = w.agg(F.coalesce(F.max(F.col("first_id") + F.col("count")), F.lit(0)).alias("n")).first()["n"]
        return out

    def _blocks(self) -> DataFrame:
        return self.tables["blocks"].where(F.col("block_num") <= self.head)

    def _ref(self, number: int) -> BlockRef | None:
        r = self._blocks().where(F.col("block_num") == number).select("block_num", "block_hash", "parent_hash").first()
        return BlockRef(*r) if r else None

    def _bound(self, number: int | None, digest: str | None, side: str) -> int:
        if (number is None) == (digest is None):
            raise InvalidParams(f"{side} needs exactly one of a number and a hash")
        if number is not None:
            return number
        r = self._blocks().where(F.col("block_hash") == digest).select("block_num").first()
        if r is None:
            raise InvalidParams(f"{side}: no block has this hash")
        return r[0]

    def _range(self, q: Request, budget: int | None) -> tuple[int, int, int, BlockRef | None, BlockRef | None]:
        """(limit, from, to, their blocks): both blocks None where the range is empty."""
        start, end = self._bound(q.from_block, q.from_block_hash, "from_block"), self._bound(q.to_block, q.to_block_hash, "to_block")
        limit = effective_limit(q.limit, budget)
        if start > end:
            raise InvalidParams("from_block is behind to_block")
        if self.head == 0 or start > self.head:
            return limit, start, end, None, None
        end = min(end, self.head)
        low, high = self._ref(start), self._ref(end)
        return limit, start, end, *((low, high) if low and high else (None, None))

    def _empty(self, low: BlockRef | None, high: BlockRef | None) -> Page:
        return Page([], False, None, low, high, high or (self._ref(self.head) if self.head else None))

    def _query(self, family: str, q: Request, budget: int | None) -> Page:
        where, id_col = q.filter or {"logs": LogFilter, "txs": TxFilter, "traces": TraceFilter}[family](), FAMILIES[family]
        if q.order not in ("asc", "desc"):
            raise Unsupported(f"order {q.order}")
        where.check_width(self.max_or_terms)
        limit, start, end, low, high = self._range(q, budget)
        if low is None:
            return self._empty(low, high)
        window = id_window(self.tables[f"{family}_windows"], start, end).first()
        inside = window["first_id"] is not None and q.resume_id is not None and window["first_id"] <= q.resume_id <= window["last_id"]
        if window["first_id"] is None:
            if q.resume_id is not None and not where.indexed():
                raise InvalidParams("resume_id lies outside the range")
            return self._empty(low, high)
        if q.resume_id is not None and not inside:
            raise InvalidParams("resume_id lies outside the range")
        rows = self.tables[family]
        if self.use_index and where.indexed():
            after, stop = window["first_id"] if q.resume_id is None or q.order == "desc" else q.resume_id, window["last_id"] if q.resume_id is None or q.order == "asc" else q.resume_id
            rows = postings.executed(rows, id_col, self.writer.postings(family), index_clauses(family, where), after, stop, bucket=self.writer.index.bucket)
        rows = page(rows, where, id_col, limit + 1, start, end, q.resume_id, q.order == "desc").collect()  # limit + 1 rows
        more, rows = len(rows) > limit, rows[:limit]
        cursor = self._ref(rows[-1]["block_num"]) if rows else high
        return Page(rows, more, rows[-1][id_col] if more else None, low, high, cursor)

    def query_logs(self, q: Request, budget: int | None = None) -> Page:
        return self._query("logs", q, budget)

    def query_transactions(self, q: Request, budget: int | None = None) -> Page:
        return self._query("txs", q, budget)

    def query_traces(self, q: Request, budget: int | None = None) -> Page:
        return self._query("traces", q, budget)

    def query_blocks(self, q: Request, budget: int | None = None) -> Page:
        """Headers in order; a hole inside the range is an error, a missing end an empty page; no resume id."""
        limit, start, end, low, high = self._range(q, budget)
        if low is None:
            return self._empty(low, high)
        rows = self._blocks().where(F.col("block_num").between(start, end)).orderBy("block_num").limit(limit + 1).collect()
        for k, r in enumerate(rows):
            if r["block_num"] != start + k:
                raise NotFound(f"block {start + k}")
        if len(rows) < min(limit + 1, end - start + 1):
            raise NotFound(f"block {start + len(rows)}")
        more, rows = len(rows) > limit, rows[:limit]
        return Page(rows, more, None, low, high, self._ref(rows[-1]["block_num"]))

    def list_keys(self, family: str, column: str, prefix: str, after: str | None = None, limit: int = 100) -> list[str]:
        """Distinct keys with a prefix, in order, behind ``after``: pass the last one on to go on."""
        rows = self.tables[family].where(F.col("block_num") <= self.head)
        return [r["key"] for r in prefix_page(rows, column, prefix, after, effective_limit(limit, None)).collect()]

    def get_tx(self, digest: str) -> Row | None:
        return self.tables["txs"].where((F.col("tx_hash") == digest) & (F.col("block_num") <= self.head)).first()

    def get_block_header(self, number: int) -> Row | None:
        return self._blocks().where(F.col("block_num") == number).first()

    def get_block(self, number: int) -> tuple[Row, list[Row]] | None:
        header = self.get_block_header(number)
        return (header, self.tables["txs"].where(F.col("block_num") == number).orderBy("tx_idx").collect()) if header else None

    def get_tx_receipt(self, digest: str):
        raise InvalidParams("receipts are not kept")

    def get_block_receipts(self, number: int):
        raise InvalidParams("receipts are not kept")

    def ingest_finalized_blocks(self, batch: dict[str, DataFrame]):
        if self.reader_only or self.writer is None:
            raise ReadOnlyMode("this service only reads")
        out = self.writer.ingest(batch)
        self.head, self.tables = out["head"], self.writer.tables()
        return out


def index_clauses(family: str, where: _Filter) -> dict[str, list[str]]:
    """{kind of posting: values} of a filter's clauses, and of a wanted value."""
    kinds = {"address": "addr", "from_addr": "from", "to_addr": "to"}
    out = {kinds.get(name, name): list(c.values) for name, c in where._clauses().items() if c.indexed}
    return out | ({"has_value": ["01"]} if family == "traces" and where.has_value is True else {})


def with_block_refs(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Many-to-one: each item's block hash and parent hash; Spark broadcasts the blocks where they are small."""
    return items.join(blocks.select("block_num", "block_hash", "parent_hash"), "block_num", "left")


def blocks_with_txs(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """Each header with its transactions in order; a block bounds its own list."""
    t = txs.groupBy("block_num").agg(F.sort_array(F.collect_list(F.struct("tx_idx", "tx_hash"))).alias("txs"))
    empty = F.array().cast(t.schema["txs"].dataType)
    return blocks.join(t, "block_num", "left").withColumn("txs", F.coalesce("txs", empty))


def related(logs: DataFrame, txs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Logs with their transaction's and block's fields; both joins are many to one."""
    t = txs.select("block_num", "tx_idx", "tx_hash", "from_addr", "to_addr")
    return logs.join(t, ["block_num", "tx_idx"], "left").join(blocks.select("block_num", "block_hash", "timestamp"), "block_num", "left")


def transfers(traces: DataFrame) -> DataFrame:
    """Frames that move value."""
    return traces.where("has_value").select("trace_id", "block_num", "tx_idx", "from_addr", "to_addr", "value_hex", "is_top_level")
