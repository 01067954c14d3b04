"""Raw upstream blocks made into chain events and into batches that an empty history accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import long

ZEROS = "0" * 64


def flattened_logs(blocks: DataFrame) -> DataFrame:
    """``blocks(block_number, receipts array<struct<starting_log_index, logs array<struct<address, topics>>>>)`` -> a row per log.

    tx_index is the receipt's place, log_index its first index plus the log's place; blocks and receipts
    without logs give no rows, and topics beyond those present are null.
    """
    receipts = blocks.select("block_number", F.posexplode("receipts").alias("tx_index", "receipt"))
    logs = receipts.select("block_number", "tx_index", "receipt.starting_log_index", F.posexplode("receipt.logs").alias("inner", "log"))
    topic = lambda k: F.get("log.topics", F.lit(k)).alias(f"topic{k}")
    return logs.select("block_number", F.col("tx_index").cast("long").alias("tx_index"), (F.col("starting_log_index") + F.col("inner")).cast("long").alias("log_index"), F.col("log.address").alias("address"), *[topic(k) for k in range(4)])


def renumbered(raw: Column, start: int) -> Column:
    """Block numbers that count from 1 where the source's range begins at ``start``."""
    return raw - long(start) + 1


def rebased(blocks: DataFrame, start: int) -> DataFrame:
    """``blocks`` from ``start`` on as a history of their own: numbered from 1, the first without a parent."""
    own = blocks.where(F.col("block_num") >= start).withColumn("block_num", renumbered(F.col("block_num"), start))
    return own.withColumn("parent_hash", F.when(F.col("block_num") == 1, ZEROS).otherwise(F.col("parent_hash")))
