"""Inverted index: posting bitmaps for each (kind, value, bucket), and their OR, AND and semi-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of one bitmap: what Spark's fixed bitmaps of 4 KB hold.
BUCKET = 32_768
#: Bytes of a bitmap that are looked at together when its ids are listed.
CHUNK = 64
#: Name of the bucket in rows that :func:`dealt` has brought together.
DEALT = "_bucket"


def fan_out(rows: DataFrame, id_col: str, kinds: dict[str, Column]) -> DataFrame:
    """(kind, value, row_id): an entry for each present value; absent ones give none."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    own = [F.col(c) for c in rows.columns if c == DEALT]
    return rows.select(F.col(id_col).alias("row_id"), *own, F.inline(entries)).where("value is not null").select("kind", "value", "row_id", *own)


def log_streams(logs: DataFrame) -> DataFrame:
    return fan_out(logs, "log_id", {"addr": F.col("address"), **{f"topic{i}": F.col(f"topic{i}") for i in range(4)}})


def tx_streams(txs: DataFrame) -> DataFrame:
    return fan_out(txs, "tx_id", {"from": F.col("from_addr"), "to": F.col("to_addr"), "selector": F.col("selector")})


def trace_streams(traces: DataFrame) -> DataFrame:
    kinds = {"from": F.col("from_addr"), "to": F.col("to_addr"), "selector": F.col("selector"), "has_value": F.when(F.col("has_value"), "01")}
    return fan_out(traces, "trace_id", kinds)


def dealt(rows: DataFrame, id_col: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with the ids of a bucket, which are bounded, in one task: :func:`build` then shuffles no bitmaps."""
    return rows.withColumn(DEALT, F.floor(F.col(id_col) / bucket)).repartition(DEALT)


def build(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(kind, value, bucket, bits, count, first_id, last_id); sums are partial before the shuffle."""
    at = F.col(DEALT) if DEALT in entries.columns else F.floor(F.col("row_id") / bucket)
    rows = entries.select("kind", "value", "row_id", at.alias("bucket"), (F.col("row_id") % bucket).alias("bit"))
    made = rows.groupBy("kind", "value", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))
    return made.withColumn("count", F.expr("bitmap_count(bits)"))


def trimmed(bucket: int = BUCKET) -> Column:
    """``bits`` as stored: the bytes from the first id to the last, so that a lone id takes one byte of the 4 KB."""
    first, last = (F.floor((F.col(c) % bucket) / 8).cast("int") for c in ("first_id", "last_id"))
    return F.substring("bits", first + 1, last - first + 1).alias("bits")


def whole(bucket: int = BUCKET) -> Column:
    """The bitmap of :func:`trimmed` bits; one that was stored whole stays as it is."""
    full = F.lpad("bits", F.floor((F.col("last_id") % bucket) / 8).cast("int") + 1, F.unhex(F.lit("00")))
    return F.when(F.length("bits") == BUCKET // 8, F.col("bits")).otherwise(F.rpad(full, F.lit(BUCKET // 8), F.unhex(F.lit("00"))))


def compact(fragments: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One bitmap for each (kind, value, bucket): the OR of its stored fragments, which are dealt out by bucket as they are stored."""
    made = fragments.repartition("bucket").groupBy("kind", "value", "bucket").agg(F.bitmap_or_agg(whole(bucket)).alias("bits"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    return made.withColumn("count", F.expr("bitmap_count(bits)"))


def union_of(postings: DataFrame, kind: str, values: list[str]) -> DataFrame:
    """(bucket, bits): ids that carry one of ``values``."""
    return postings.where((F.col("kind") == kind) & F.col("value").isin(values)).groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def intersection_of(parts: list[DataFrame]) -> DataFrame:
    """(bucket, bits): ids in all parts; a bucket that one lacks is empty."""
    rows = reduce(DataFrame.unionByName, parts)
    both = rows.groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")
    return both.where("bitmap_count(bits) > 0")


def ids_of(bitmaps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(row_id) of the set bits, found in the JVM: chunks that aren't zero, then their bytes, then their bits."""
    size = BUCKET // 8 // CHUNK  # a bitmap has 4 KB whatever the bucket
    chunks = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.struct(c.alias("chunk"), F.substring(F.col("bits"), c * CHUNK + 1, F.lit(CHUNK)).alias("part")))
    rows = bitmaps.select("bucket", F.inline(chunks)).where(F.col("part") != F.unhex(F.lit("00" * CHUNK)))
    byte = F.conv(F.substring(F.hex("part"), 2 * F.col("at") + 1, F.lit(2)), 16, 10).cast("int")
    rows = rows.select("bucket", "chunk", "part", F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1))).alias("at")).select("bucket", (F.col("chunk") * CHUNK + F.col("at")).alias("at"), byte.alias("byte")).where("byte <> 0")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(F.col("byte"), b) == 1))
    return rows.select("bucket", "at", bit.alias("bit")).select((F.col("bucket") * bucket + F.col("at") * 8 + F.col("bit")).cast("long").alias("row_id"))


def candidates(postings: DataFrame, clauses: dict[str, list[str]], bucket: int = BUCKET) -> DataFrame:
    """(row_id) that satisfies every clause, by OR inside a clause and AND across; at least one clause."""
    return ids_of(intersection_of([union_of(postings, k, vs) for k, vs in clauses.items()]), bucket)


def matching(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids, F.col(id_col) == F.col("row_id"), "left_semi")


def estimate(postings: DataFrame, kind: str, values: list[str], first_id: int, last_id: int) -> DataFrame:
    """Entries of the pages that a range touches, not clipped to it."""
    hit = (F.col("kind") == kind) & F.col("value").isin(values) & (F.col("first_id") <= last_id) & (F.col("last_id") >= first_id)
    return postings.where(hit).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("estimate"))


def executed(rows: DataFrame, id_col: str, index: DataFrame, clauses: dict[str, list[str]], first_id: int, last_id: int, where=None, take: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Rows of an id range that the index names for every clause and ``where`` confirms, in id order, at most ``take``.

    No clauses: every id of the range is a candidate.  Only pages that touch the range are read.
    """
    out = rows.where(F.col(id_col).between(first_id, last_id))
    if clauses:
        touched = index.where((F.col("first_id") <= last_id) & (F.col("last_id") >= first_id))
        out = matching(out, id_col, candidates(touched, clauses, bucket))
    out = where.apply(out) if where is not None else out
    return out.orderBy(id_col) if take is None else out.orderBy(id_col).limit(take)
