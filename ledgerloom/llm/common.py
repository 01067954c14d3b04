"""Shared plumbing of the operators: scratch tables, row ids and byte level text helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard as drop_stored  # noqa: F401
from ..scratch import materialized as stored
from ..scratch import release, scope  # noqa: F401

#: Bytes of an Arrow batch handed to a Python worker.
BATCH_BYTES = 4 << 20
#: Bits for each id in a filter over hashed ids, and its largest size; a full filter costs time only.
FILTER_RATIO, FILTER_MOST = 16, 1 << 28
_BATCH_LIMIT, _SPARKS_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns every byte outside ``[0-9a-z\x80-\xff]`` into a blank.
WORDS = bytes(LOWER[b] if LOWER[b] >= 0x80 or chr(LOWER[b]).isalnum() else 32 for b in range(256))
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER_CASE, LOWER_CASE)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_BYTES, so that long texts don't pile up in workers and JVM.

    The limit is the session's own; it is lowered only where it still has Spark's default.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT) == _SPARKS_LIMIT:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def numbered(df: DataFrame) -> DataFrame:
    """:func:`wrapped`, written once to the shared folder, so that every later scan sees the same ids."""
    return stored(wrapped(df))


def wrapped(df: DataFrame) -> DataFrame:
    """(rest, row): each row whole in a struct, where its names clash with none, and an id new in each scan."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest"), F.monotonically_increasing_id().alias("row"))


def _bit(c: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(size))


def bitmap(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """((page, bits), size): a bitmap over the hashed ids, FILTER_RATIO bits for each, of at most FILTER_MOST bits (32 MB)."""
    size = min(FILTER_MOST, max(1 << 20, 1 << (FILTER_RATIO * ids.count()).bit_length()))
    bit = _bit(F.col(column), size)
    pages = ids.select((bit / 32768).cast("int").alias("page"), (bit % 32768).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    return pages, size


def likely(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """``df`` less most of the rows whose ``column`` is none of the stored ``ids``, before a join deals them out.

    The bitmap of the ids is broadcast, at most 32 MB; with more ids it lets more rows pass.
    """
    pages, size = bitmap(ids, id_column)
    pages = F.broadcast(pages.select(F.col("page").alias("_page"), F.col("bits").alias("_bits")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest"), _bit(F.col(column), size).alias("_at"))
    joined = rows.join(pages, (F.col("_at") / 32768).cast("int") == F.col("_page"))
    byte = F.conv(F.hex(F.substring("_bits", (F.pmod("_at", F.lit(32768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.call_function("getbit", byte, F.pmod("_at", F.lit(8)).cast("int")) == 1).select("rest.*")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 0, so it never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_column(batch: pa.RecordBatch, name: str, step: int = 256, limit: int = 1 << 20):
    """(first row, list of bytes or None) of a string column, whole values, in parts of few rows and bytes.

    A part has at most ``step`` rows and ``limit`` bytes, or a single longer value.
    """
    col = batch.column(batch.schema.get_field_index(name.split(".")[0]))
    if "." in name:  # of a struct
        col = pc.struct_field(col, name.split(".")[1])
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    upto = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "right"))
        stop = min(at + step, max(at + 1, full), batch.num_rows)
        yield at, col.slice(at, stop - at).cast(kind).to_pylist()
        at = stop
