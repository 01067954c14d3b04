"""The star-schema test tables mapped onto the chain model: blocks, txs, logs, traces and a sparse event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import has_value, hex40, is_call, long, trace_selector, tx_selector
from ..operators.ids import assign_ids

EVENT_START = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp")).cast("long")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block: dates are few however many orders there are."""
    days = table(spark, sf_dir, "orders").select("o_orderdate").distinct()
    return days.select("o_orderdate", F.row_number().over(Window.orderBy("o_orderdate")).cast("long").alias("block_num"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("block_num")
    digest = lambda x: F.sha2(F.concat(F.lit("block:"), x.cast("string")), 256)
    return _dates(spark, sf_dir).select(n, digest(n).alias("block_hash"), F.when(n == 1, "0" * 64).otherwise(digest(n - 1)).alias("parent_hash"), seconds(F.col("o_orderdate")).alias("timestamp"))


def _selector(c: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("sel:"), c.cast("string")), 256), 1, 8)


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ids(tx_rows(spark, sf_dir), "tx_idx", "tx_id")


def tx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions without ids, which cost another pass."""
    o = table(spark, sf_dir, "orders").join(F.broadcast(_dates(spark, sf_dir)), "o_orderdate")  # a row per day
    key = F.col("o_orderkey")
    to = F.when(F.col("o_orderstatus") != "P", hex40(key % 25))
    return o.select(
        "block_num", (F.row_number().over(Window.partitionBy("block_num").orderBy("o_orderkey")) - 1).cast("long").alias("tx_idx"), key.alias("order_key"),
        F.sha2(F.concat(F.lit("tx:"), key.cast("string")), 256).alias("tx_hash"), hex40(F.col("o_custkey")).alias("from_addr"), to.alias("to_addr"),
        (key % 7).alias("input_len"), tx_selector(to, key % 7, _selector(F.col("o_orderpriority"))).alias("selector"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    own = [c for c in lines.columns if c != "l_orderkey"]
    t = tx_rows(spark, sf_dir).select("block_num", "tx_idx", "order_key", F.col("from_addr").alias("tx_from"), F.col("to_addr").alias("tx_to"))
    return lines.join(t, F.col("l_orderkey") == F.col("order_key")).select("order_key", "block_num", "tx_idx", "tx_from", "tx_to", *own)


#: A line item's own order: every column, as (order, line number) isn't unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ids(log_rows(spark, sf_dir), "log_idx", "log_id")


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.col("l_discount") > 0.03
    return _items(spark, sf_dir).select(
        "block_num", "tx_idx", (F.row_number().over(Window.partitionBy("block_num").orderBy("tx_idx", *LINE_ORDER)) - 1).cast("long").alias("log_idx"),
        hex40(F.col("l_suppkey")).alias("address"), F.concat("l_returnflag", "l_linestatus").alias("topic0"), F.col("l_partkey").cast("string").alias("topic1"),
        F.when(deep, F.col("l_linenumber").cast("string")).alias("topic2"), F.when(deep & (F.col("l_tax") > 0.04), F.col("l_quantity").cast("long").cast("string")).alias("topic3"),
        F.lpad(F.lower(F.hex("l_partkey")), 64, "0").alias("data"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_ids(trace_rows(spark, sf_dir), ("tx_idx", "trace_idx"), "trace_id")


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    root = tx_rows(spark, sf_dir).select(
        "block_num", "tx_idx", long(0).alias("trace_idx"), long(0).alias("depth"), F.when(F.col("to_addr").isNull(), long(3)).otherwise(long(0)).alias("typ"), long(0).alias("flags"),
        "from_addr", "to_addr", F.lit("00").alias("value_hex"), "input_len", "selector",
    )
    typ, flags, n = (F.col("l_linenumber") % 5).cast("long"), F.col("l_partkey") % 3, F.col("l_partkey") % 7
    raw = F.lower(F.hex(F.col("l_quantity").cast("long")))
    # (block_num, tx_idx) has one order_key, by which the join has dealt the lines out already
    child = _items(spark, sf_dir).select(
        "block_num", "tx_idx", F.row_number().over(Window.partitionBy("order_key", "block_num", "tx_idx").orderBy(*LINE_ORDER)).cast("long").alias("trace_idx"),
        (1 + F.col("l_linenumber") % 3).cast("long").alias("depth"), typ.alias("typ"), flags.alias("flags"), F.coalesce("tx_to", "tx_from").alias("from_addr"),
        F.when(typ == 3, none("string")).otherwise(hex40(F.col("l_suppkey"))).alias("to_addr"),
        F.when(F.col("l_tax") < 0.01, "00").otherwise(F.when(F.length(raw) % 2 == 1, F.concat(F.lit("0"), raw)).otherwise(raw)).alias("value_hex"), n.alias("input_len"),
        trace_selector(typ, flags, n, _selector(F.col("l_partkey") % 11)).alias("selector"),
    )
    rows = root.unionByName(child)
    return rows.withColumns({"is_top_level": F.col("depth") == 0, "has_value": has_value(F.col("value_hex")), "is_call": is_call(F.col("typ"), F.col("flags"))})


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per log of the sparse stream: block_number, event_id, second, address, topic0, topic1."""
    s = seconds(F.col("ts")) - EVENT_START
    return table(spark, sf_dir, "events").select(
        F.floor(s / 60).cast("long").alias("block_number"), "event_id", s.alias("second"), hex40(F.col("user_id")).alias("address"), F.col("event_type").alias("topic0"),
        F.when(F.col("value") >= 50, F.regexp_extract("props", "([0-9]+)", 1)).alias("topic1"),
    )


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_number, block_hash, timestamp, n_logs, in block order."""
    g = event_logs(spark, sf_dir).groupBy("block_number").agg((F.min("second") + EVENT_START).alias("timestamp"), F.count("*").alias("n_logs"))
    return g.select("block_number", F.sha2(F.concat(F.lit("ev:"), F.col("block_number").cast("string")), 256).alias("block_hash"), "timestamp", "n_logs")
