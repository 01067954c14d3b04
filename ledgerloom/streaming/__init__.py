"""Fail-closed validation of a chain-event stream, in batch and under Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import align

#: Arrival numbers of one window task.
SPAN = 1 << 16


def running_max_before(rows: DataFrame, order: str, value: str, span: int = SPAN) -> DataFrame:
    """``_before``: the largest ``value`` at any smaller ``order``, by blocks of order values and one row per block."""
    rows = rows.withColumn("_cut", align(F.col(order), span))
    own = Window.partitionBy("_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_cut").agg(F.max(value).alias("_high"))
    carried = blocks.select(F.col("_cut").alias("_of"), F.max("_high").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = rows.withColumn("_own", F.max(value).over(own)).join(carried, F.col("_cut") == F.col("_of"), "left")
    return out.withColumn("_before", F.greatest("_own", "_carry")).drop("_cut", "_of", "_own", "_carry")


def judged(events: DataFrame, chain_id: int, seen: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """``events(seq, chain_id, block_number, block_hash, ...)`` with ``error`` and ``duplicate``.

    In the order of the checks: another chain, a block seen before with the same hash (ignored) or with
    another, a number below the last new block's.  Exact up to the first error, behind which nothing counts.
    ``seen(block_number, block_hash)`` and ``last``: the blocks accepted before these events, and the last of them.
    """
    first = Window.partitionBy("block_number").orderBy("seq")
    known = events.withColumn("_first_hash", F.first("block_hash").over(first)).withColumn("_again", F.row_number().over(first) > 1)
    if seen is not None:
        before = seen.select(F.col("block_number").alias("_seen"), F.col("block_hash").alias("_seen_hash"))
        known = known.join(before, F.col("block_number") == F.col("_seen"), "left")
        known = known.withColumn("_again", F.col("_again") | F.col("_seen").isNotNull()).withColumn("_first_hash", F.coalesce("_seen_hash", "_first_hash"))
    known = running_max_before(known.withColumn("_new", F.when(~F.col("_again"), F.col("block_number"))), "seq", "_new")
    if last is not None:
        known = known.withColumn("_before", F.greatest("_before", F.lit(last)))
    error = (
        F.when(F.col("chain_id") != chain_id, "chain_id_mismatch")
        .when(F.col("_again") & (F.col("block_hash") != F.col("_first_hash")), "block_hash_mismatch")
        .when(~F.col("_again") & (F.col("block_number") < F.col("_before")), "non_monotonic_block_number")
    )
    return known.select(*events.columns, error.alias("error"), F.col("_again").alias("duplicate"))


def first_error(events: DataFrame, chain_id: int) -> DataFrame:
    """(seq, block_number, error) of the first error, if any."""
    return judged(events, chain_id).where("error is not null").orderBy("seq").select("seq", "block_number", "error").limit(1)


def accepted(events: DataFrame, chain_id: int) -> DataFrame:
    """Events before the first error, each block once."""
    seen = judged(events, chain_id)
    stop = seen.where("error is not null").agg(F.min("seq").alias("_stop"))  # one row
    return seen.join(F.broadcast(stop)).where("(_stop is null or seq < _stop) and not duplicate").drop("_stop", "error", "duplicate")


def verdict(events: DataFrame, chain_id: int, expected_end: int | None, closed: bool = True) -> dict:
    """The validation summary: valid, error, blocks_observed, start and end; fixed size whatever the stream."""
    kept = accepted(events, chain_id).agg(F.count("*").alias("blocks_observed"), F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block")).first().asDict()
    wrong = first_error(events, chain_id).collect()
    error = wrong[0]["error"] if wrong else None
    if error is None and not closed:
        error = "channel_closed_unexpectedly"
    if error is None and expected_end is not None and kept["end_block"] is not None and kept["end_block"] != expected_end:
        error = "end_of_stream_mismatch"
    return {"valid": error is None, "error": error, **kept}


def event_source(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over Parquet files, at most ``files`` of them in an epoch: the bound on what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_stream(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """All that a streaming source has now, through ``sink(batch, epoch)``; an epoch may come twice, so sinks overwrite by epoch."""
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class StreamValidator:
    """A sink that carries the validation over epochs: fails closed, and accepts each block once.

    The blocks accepted in an epoch are a folder below ``root``, and with them goes one small record: the
    first error, the ends and the number of blocks so far.  An epoch is judged by the folders and the
    record of those before it and overwrites its own, so one that comes twice leaves the same state.
    """

    def __init__(self, spark: SparkSession, root: str, chain_id: int):
        self.spark, self.root, self.chain_id = spark, root.rstrip("/"), chain_id
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _epochs(self) -> list[int]:
        at = self._path(f"{self.root}/state")
        return sorted(int(x.getPath().getName().split(".")[0]) for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def state(self, before: int | None = None) -> dict:
        """The record of the last epoch, or of the last one before ``before``."""
        done = [e for e in self._epochs() if before is None or e < before]
        if not done:
            return {"error": None, "error_seq": None, "blocks_observed": 0, "start_block": None, "end_block": None}
        return json.loads(self.spark.read.text(f"{self.root}/state/{done[-1]:012d}.json", wholetext=True).first()[0])

    def accepted(self, before: int | None = None) -> DataFrame | None:
        """The blocks accepted so far, each once; None before the first epoch."""
        done = [f"{self.root}/blocks/epoch={e:012d}" for e in self._epochs() if before is None or e < before]
        return self.spark.read.parquet(*done) if done else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        now = self.state(epoch)
        rows = judged(batch, self.chain_id, self.accepted(epoch), now["end_block"])
        wrong = rows.where("error is not null").orderBy("seq").select("seq", "error").limit(1).collect() if now["error"] is None else []
        stop = F.lit(False) if now["error"] is not None else F.col("seq") < wrong[0]["seq"] if wrong else F.lit(True)
        folder = f"{self.root}/blocks/epoch={epoch:012d}"
        rows.where(stop & ~F.col("duplicate")).select(*batch.columns).write.mode("overwrite").parquet(folder)
        new = self.spark.read.schema(batch.schema).parquet(folder).agg(F.count("*").alias("n"), F.min("block_number").alias("low"), F.max("block_number").alias("high")).first()
        now["blocks_observed"] += new["n"]
        now["start_block"] = new["low"] if now["start_block"] is None else now["start_block"]
        now["end_block"] = now["end_block"] if new["high"] is None else new["high"]
        if wrong:
            now["error"], now["error_seq"] = wrong[0]["error"], wrong[0]["seq"]
        out = self.fs.create(self._path(f"{self.root}/state/{epoch:012d}.json"), True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()

    def finish(self, expected_end: int | None, closed: bool = True) -> dict:
        """The summary at the end of the stream, which a marker with ``expected_end`` has ``closed``; as :func:`verdict` has it."""
        now = self.state()
        error = now["error"]
        if error is None and not closed:
            error = "channel_closed_unexpectedly"
        if error is None and expected_end is not None and now["end_block"] is not None and now["end_block"] != expected_end:
            error = "end_of_stream_mismatch"
        return {"valid": error is None, "error": error, **{k: now[k] for k in ("blocks_observed", "start_block", "end_block")}}


def validate_stream(source: DataFrame, root: str, chain_id: int, expected_end: int | None = None, closed: bool = True) -> dict:
    """Everything that the source has now, validated epoch by epoch below ``root``; goes on there when called again."""
    sink = StreamValidator(source.sparkSession, root, chain_id)
    run_stream(source, sink, f"{sink.root}/checkpoint")
    return sink.finish(expected_end, closed)
