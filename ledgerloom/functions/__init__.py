"""Column expressions: id algebra, hex, selectors, buckets and seeded draws.  All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_BITS, PAGE = 24, 4096


def long(x) -> Column:
    return F.lit(x).cast("long")


def shard_of(row_id: Column) -> Column:
    return F.shiftright(row_id, LOCAL_BITS)


def local_of(row_id: Column) -> Column:
    return row_id.bitwiseAND(long((1 << LOCAL_BITS) - 1))


def compose_id(shard: Column, local: Column) -> Column:
    return F.shiftleft(shard.cast("long"), LOCAL_BITS).bitwiseOR(local.cast("long"))


def align(x: Column, span: int) -> Column:
    """The start of the fixed span that holds ``x``."""
    return x - x % long(span)


def page_of(row_id: Column) -> Column:
    return align(local_of(row_id), PAGE)


def stream_id(kind: Column, value: Column, shard: Column) -> Column:
    """``kind/value/shard`` with the shard as ten hex digits; ``value`` is hex already."""
    return F.concat_ws("/", kind, F.lower(value), F.lpad(F.lower(F.hex(shard)), 10, "0"))


def shard_of_stream(stream: Column) -> Column:
    return F.conv(F.substring_index(stream, "/", -1), 16, 10).cast("long")


def log2_lower(v: Column) -> Column:
    """Largest power of two at most ``v``; 0 for 0.  Exact at every size, as no float is involved."""
    return F.when(v <= 0, long(0)).otherwise(F.call_function("shiftleft", long(1), F.length(F.bin(v)) - 1))


def log2_upper(v: Column) -> Column:
    """Exclusive end of the bucket, saturating at the largest long."""
    lower = log2_lower(v)
    return F.when(v <= 0, long(1)).when(lower >= long(1 << 62), long((1 << 63) - 1)).otherwise(lower * 2)


def hex40(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 40, "0")


def unhex_checked(text: Column, size: int) -> Column:
    """Bytes of a hex string with or without 0x; null unless it has ``size`` bytes."""
    raw = F.unhex(F.regexp_replace(text, "^0x", ""))
    return F.when(F.length(raw) == size, raw)


def tx_selector(to: Column, input_len: Column, first4: Column) -> Column:
    """First four input bytes; null for a create or an input under four bytes."""
    return F.when(to.isNotNull() & (input_len >= 4), first4)


def is_call(typ: Column, flags: Column) -> Column:
    return ((typ == 0) & flags.isin(0, 1)) | typ.isin(1, 2)


def trace_selector(typ: Column, flags: Column, input_len: Column, first4: Column) -> Column:
    return F.when(is_call(typ, flags) & (input_len >= 4), first4)


def has_value(value_hex: Column) -> Column:
    """Any byte of a big-endian number is not zero; works at any width."""
    return F.coalesce(F.ltrim(value_hex, F.lit("0")) != "", F.lit(False))


def overlaps(low: Column, high: Column, start, end) -> Column:
    return (low <= end) & (high >= start)


def selectivity_bucket(estimate: Column) -> Column:
    steps = [(0, "empty"), (9, "tiny"), (99, "small"), (9_999, "medium"), (999_999, "large")]
    return reduce(lambda c, s: c.when(estimate <= s[0], s[1]), steps[1:], F.when(estimate <= 0, "empty")).otherwise("huge")


def estimated_selectivity(addresses: Column, topics: Column, span: Column) -> Column:
    return F.greatest(F.size(addresses), F.lit(1)).cast("long") * F.greatest(F.size(topics), F.lit(1)).cast("long") * span


def draw(seed: Column, *parts: Column) -> Column:
    """48 uniform bits from a seed and named parts: the same on any number of partitions."""
    text = F.concat_ws(":", seed, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def coverage(start: Column, end: Column, missing: Column) -> Column:
    """Share of [start, end] outside the missing (start, end) ranges, within 0 and 1."""
    total = end - start + 1
    lost = F.aggregate(missing, long(0), lambda s, r: s + F.greatest(F.least(end, r["end"]) - F.greatest(start, r["start"]) + 1, long(0)))
    return F.when(total <= 0, 0.0).otherwise(F.greatest(F.least((total - lost) / total, F.lit(1.0)), F.lit(0.0)))
