"""Stream statistics: key stats, co-occurrence, log2 histograms, gaps, densities and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align, log2_lower, log2_upper, long

KEY_TYPES = ["address", "topic0", "topic1", "topic2", "topic3", "address_topic0"]
GAPS_KEPT = 100


def keyed(logs: DataFrame) -> DataFrame:
    """(key_type, key_value, partner, block_num): a row for each present key of a log."""
    topic = lambda i: F.col(f"topic{i}") if f"topic{i}" in logs.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    kinds = [("address", F.col("address"), topic(0)), ("topic0", topic(0), F.col("address")), *[(f"topic{i}", topic(i), none) for i in (1, 2, 3)], ("address_topic0", F.concat("address", topic(0)), none)]
    rows = F.array(*[F.struct(F.lit(k).alias("key_type"), v.alias("key_value"), p.alias("partner")) for k, v, p in kinds])
    return logs.select("block_num", F.inline(rows)).where("key_value is not null")


def key_stats(logs: DataFrame) -> DataFrame:
    """Exact counts, block span, active blocks and distinct partners of each key.

    Distinct counts go by two plain aggregations (first per block and partner), so that a hot key is
    spread over tasks by its blocks and partners before it is counted.
    """
    rows = keyed(logs)
    by_block = rows.groupBy("key_type", "key_value", "block_num").agg(F.count("*").alias("n"))
    counts = by_block.groupBy("key_type", "key_value").agg(F.sum("n").alias("count_total"), F.min("block_num").alias("first_block"), F.max("block_num").alias("last_block"), F.count("*").alias("active_block_count"))
    pairs = rows.where("partner is not null").select("key_type", "key_value", "partner").distinct()
    partners = pairs.groupBy("key_type", "key_value").agg(F.count("*").cast("double").alias("distinct_partner_estimate"))
    return counts.join(partners, ["key_type", "key_value"], "left")


def approximate_partners(logs: DataFrame) -> DataFrame:
    """The same by HyperLogLog, in one aggregation."""
    return keyed(logs).where("partner is not null").groupBy("key_type", "key_value").agg(F.approx_count_distinct("partner").cast("double").alias("distinct_partner_estimate"))


def cooccurrence(logs: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("pair_type"), F.col(a).alias("left_key"), F.col(b).alias("right_key")) for t, a, b in (("address_topic0", "address", "topic0"), ("topic0_topic1", "topic0", "topic1"))])
    rows = logs.select("block_num", F.inline(pairs)).where("left_key is not null and right_key is not null")
    return rows.groupBy("pair_type", "left_key", "right_key").agg(F.count("*").alias("count_total"), F.min("block_num").alias("first_block"), F.max("block_num").alias("last_block"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent pairs of each type; ties by left, then right key.  Tasks keep k rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("pair_type").orderBy(F.desc("count_total"), "left_key", "right_key"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def histogram(values: DataFrame, metric: str, window: int | None = None) -> DataFrame:
    """(metric, bucket_lower, bucket_upper, count, window_size_blocks) of column ``v``."""
    v = F.col("v")
    out = values.groupBy(log2_lower(v).alias("bucket_lower"), log2_upper(v).alias("bucket_upper")).agg(F.count("*").alias("count"))
    return out.select(F.lit(metric).alias("metric"), "bucket_lower", "bucket_upper", "count", F.lit(window).cast("long").alias("window_size_blocks"))


def logs_per_block(blocks: DataFrame) -> DataFrame:
    return histogram(blocks.select(F.col("n_logs").alias("v")), "logs_per_block")


def logs_per_window(blocks: DataFrame, size: int, start: int | None = None) -> DataFrame:
    """Tumbling windows of ``size`` block numbers from the first block on; empty ones count as zero."""
    ends = blocks.agg(F.min("block_number").alias("low"), F.max("block_number").alias("high")).first()
    first = ends["low"] if start is None else start
    windows = blocks.sparkSession.range(0 if ends["high"] is None else (ends["high"] - first) // size + 1).withColumnRenamed("id", "w")
    sums = blocks.groupBy(F.floor((F.col("block_number") - F.lit(first)) / size).alias("w")).agg(F.sum("n_logs").alias("n"))
    return histogram(windows.join(sums, "w", "left").select(F.coalesce("n", long(0)).alias("v")), "logs_per_window", size)


def with_previous(rows: DataFrame, order: str, *columns: str, span: int = 1 << 16) -> DataFrame:
    """``_prev_<c>``: values of the row before in ``order``, without one task for all rows.

    Rows are dealt by blocks of ``span`` order values; each block's first row looks up the last row of
    the blocks before, of which there is one row per block.
    """
    cut = align(F.col(order), span)
    own = Window.partitionBy("_cut").orderBy(order)
    rows = rows.withColumn("_cut", cut)
    lasts = rows.groupBy("_cut").agg(*[F.max_by(c, order).alias(f"_last_{c}") for c in columns])
    carried = lasts.select(F.col("_cut").alias("_of"), *[F.lag(f"_last_{c}").over(Window.orderBy("_cut")).alias(f"_carry_{c}") for c in columns])
    first = F.row_number().over(own) == 1
    out = rows.withColumn("_first", first).withColumns({f"_prev_{c}": F.lag(c).over(own) for c in columns})
    out = out.join(carried, F.col("_cut") == F.col("_of"), "left")
    return out.withColumns({f"_prev_{c}": F.when(F.col("_first"), F.col(f"_carry_{c}")).otherwise(F.col(f"_prev_{c}")) for c in columns}).drop("_cut", "_of", "_first", *[f"_carry_{c}" for c in columns])


def interarrival(blocks: DataFrame) -> DataFrame:
    """Seconds since the block before with a timestamp; steps back don't count but move on."""
    timed = with_previous(blocks.where("timestamp > 0"), "block_number", "timestamp")
    return histogram(timed.where("timestamp >= _prev_timestamp").select((F.col("timestamp") - F.col("_prev_timestamp")).alias("v")), "interarrival_seconds")


def gaps(blocks: DataFrame) -> DataFrame:
    """(start, end) of the block numbers missing between blocks that follow each other."""
    pairs = with_previous(blocks, "block_number", "block_number")
    return pairs.where(F.col("block_number") > F.col("_prev_block_number") + 1).select((F.col("_prev_block_number") + 1).alias("start"), (F.col("block_number") - 1).alias("end"))


def first_gaps(blocks: DataFrame, kept: int = GAPS_KEPT) -> DataFrame:
    return gaps(blocks).orderBy("start").limit(kept)


def summary(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks_observed"), F.coalesce(F.sum("n_logs"), long(0)).alias("log_count"), F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"))


def density(blocks: DataFrame, step: int, start: int = 0) -> DataFrame:
    s = blocks.where((F.col("block_number") - start) % step == 0)
    return s.agg(F.count("*").alias("sampled"), F.avg("n_logs").alias("avg_logs"), F.max("n_logs").alias("max_logs"), F.sum("n_logs").alias("sum_logs"))


def densest(blocks: DataFrame, n: int) -> DataFrame:
    return blocks.orderBy(F.desc("n_logs"), "block_number").limit(n)


#: Ranges of values that percentiles are first looked for in.
RANGES = 1_024


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the sorted value at round((n - 1) * share), halves up; values are counted before they are ranked.

    Values are dealt to RANGES equal ranges, one row each; the ranges say which of them holds a share's
    place, and only values of those are ranked, each range for itself.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    cut = F.when(F.col("high") > F.col("low"), F.least(F.lit(RANGES - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES))).otherwise(F.lit(0))
    counts = counts.join(F.broadcast(ends)).select("value", "n", cut.cast("long").alias("cut"))  # one row of ends
    ranges = counts.groupBy("cut").agg(F.sum("n").alias("own"))
    upto = F.sum("own").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.select("cut", (upto - F.col("own")).alias("before"), upto.alias("upto"))  # RANGES rows at most
    total = ranges.agg(F.max("upto").alias("total"))
    wanted = total.select("total", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).select("share", F.floor((F.col("total") - 1) * F.col("share") + 0.5).alias("at"))
    held = ranges.join(F.broadcast(wanted), (F.col("at") >= F.col("before")) & (F.col("at") < F.col("upto"))).select(F.col("cut").alias("of"), "before", "share", "at")
    ranked = counts.withColumn("behind", F.sum("n").over(Window.partitionBy("cut").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.join(F.broadcast(held), F.col("cut") == F.col("of"))  # a row for each share
    place = F.col("at") - F.col("before")
    return found.where((place < F.col("behind")) & (place >= F.col("behind") - F.col("n"))).select("share", "value")
