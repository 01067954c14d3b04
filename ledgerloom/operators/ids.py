"""Dense monotonic row ids, per-block windows, and the way back from an id to its block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import long

#: Ids of one bin of the range join.
BIN = 10_000
#: Windows (16 bytes each) that are broadcast at most.
BROADCAST_BLOCKS = 500_000


def block_windows(rows: DataFrame, blocks: DataFrame | None = None, next_id: int = 0) -> DataFrame:
    """(block_num, first_id, count), also for blocks without rows; ids go on from ``next_id``.

    The running sum is over one row per block, not over the rows.
    """
    counts = rows.groupBy("block_num").agg(F.count("*").alias("count"))
    if blocks is not None:
        counts = blocks.select("block_num").join(counts, "block_num", "left").select("block_num", F.coalesce("count", long(0)).alias("count"))
    total = F.sum("count").over(Window.orderBy("block_num").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("block_num", (total - F.col("count") + long(next_id)).alias("first_id"), "count")


def assign_ids(rows: DataFrame, order: str | tuple[str, ...], name: str, next_id: int = 0) -> DataFrame:
    """Adds dense ids in (block_num, ``order``) order without a global sort: first id of the block plus place in it."""
    place = F.row_number().over(Window.partitionBy("block_num").orderBy(*([order] if isinstance(order, str) else order))) - 1
    firsts = block_windows(rows, next_id=next_id).select("block_num", "first_id")
    return rows.join(firsts, "block_num").withColumn(name, (F.col("first_id") + place).cast("long")).drop("first_id")


def placed_ids(rows: DataFrame, windows: DataFrame, order: str | tuple[str, ...], name: str, blocks: int) -> DataFrame:
    """:func:`assign_ids` by the stored windows of ``blocks`` blocks, sorted by id over all tasks.

    Rows are dealt once, by ranges of blocks, in which their places are counted; the windows are broadcast
    up to BROADCAST_BLOCKS, beyond which ids are joined and sorted.
    """
    order = [order] if isinstance(order, str) else list(order)
    firsts = windows.select("block_num", "first_id")
    ranged = blocks <= BROADCAST_BLOCKS
    rows = rows.repartitionByRange("block_num") if ranged else rows
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("block_num").orderBy(*order)) - 1)
    out = rows.join(F.broadcast(firsts) if ranged else firsts, "block_num").withColumn(name, (F.col("first_id") + F.col("_place")).cast("long")).drop("first_id", "_place")
    return out.sortWithinPartitions(name) if ranged else out.sort(name)


def resolve_ids(probes: DataFrame, windows: DataFrame, id_col: str = "row_id", span: int = BIN) -> DataFrame:
    """``probes`` with block_num and ordinal: a range join made an equi-join on bins of ids; empty blocks own none."""
    w = windows.where("count > 0").select(F.col("block_num"), "first_id", (F.col("first_id") + F.col("count")).alias("end_id"))
    w = w.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first_id") / span), F.floor((F.col("end_id") - 1) / span))))
    p = probes.withColumn("_bin", F.floor(F.col(id_col) / span))
    out = p.join(w, "_bin").where((F.col(id_col) >= F.col("first_id")) & (F.col(id_col) < F.col("end_id")))
    return out.withColumn("ordinal", F.col(id_col) - F.col("first_id")).drop("_bin", "first_id", "end_id")


def id_window(windows: DataFrame, from_block: int, to_block: int) -> DataFrame:
    """(first_id, last_id) of the blocks from ``from_block`` to ``to_block``; nulls where all are empty."""
    return windows.where(F.col("block_num").between(from_block, to_block) & (F.col("count") > 0)).agg(F.min("first_id").alias("first_id"), F.max(F.col("first_id") + F.col("count") - 1).alias("last_id"))


def contiguous_runs(rows: DataFrame, id_col: str, block_col: str = "block_num") -> DataFrame:
    """Gaps and islands: (block_num, first_id, last_id, length) of runs of adjacent ids inside a block."""
    island = F.col(id_col) - F.row_number().over(Window.partitionBy(block_col).orderBy(id_col))
    runs = rows.select(block_col, id_col, island.alias("_island")).groupBy(block_col, "_island")
    return runs.agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), F.count("*").alias("length")).drop("_island")


def bucket_starts(from_next: int, to_next: int, span: int, spark) -> DataFrame:
    """Starts of the spans that are sealed by moving the frontier from ``from_next`` to ``to_next``."""
    return spark.range(from_next // span, max(from_next // span, to_next // span)).select((F.col("id") * span).alias("start"))
