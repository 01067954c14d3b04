"""Chat formatting by quotation linking: quotes are parsed, hashed, joined to their originals and taken out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_column, drop_stored, in_arrow, stored

_MARK = re.compile(rb"^((?:[ \t]*>)+)[ \t]?")


def quote_level(line: bytes) -> tuple[int, bytes]:
    """(number of leading ``>`` marks, the rest of the line)."""
    m = _MARK.match(line)
    return (m[1].count(b">"), line[m.end() :]) if m else (0, line)


def normal(passage: bytes) -> bytes:
    """A-Z lower-cased, runs of ASCII blanks one blank, none at the ends."""
    return b" ".join(passage.translate(LOWER).split())


def passage_hash(passage: bytes) -> str | None:
    """128-bit hash of the normalised passage as hex; None if nothing is left of it."""
    text = normal(passage)
    return xxhash.xxh3_128_hexdigest(text) if text else None


def parse(text: bytes | None) -> tuple[bytes | None, list[tuple[int, str, str]], list[str]]:
    """(body without quotes, [(level, hash, passage)] in order, hashes of what the body offers to quote).

    A passage is a run of lines of one quote level.  A body offers itself, its paragraphs and its lines.
    """
    if text is None:
        return None, [], []
    own, quoted, run = [], [], None
    for line in text.split(b"\n"):
        level, rest = quote_level(line)
        if level == 0:
            own.append(rest)
            run = None
        elif run is not None and run[0] == level:
            run[1].append(rest)
        else:
            run = (level, [rest])
            quoted.append(run)
    body = b"\n".join(own).strip(b" \t\r\n") if quoted else text
    passages = [(level, h, normal(b" ".join(lines)).decode("utf-8", "replace")) for level, lines in quoted if (h := passage_hash(b" ".join(lines)))]
    offers = {passage_hash(body), *map(passage_hash, re.split(rb"\n[ \t\r]*\n", body)), *map(passage_hash, body.split(b"\n"))} - {None}
    return body, passages, sorted(offers)


PARSED = "conv_id long, turn long, role string, body string, quotes array<struct<place:int,level:int,hash:string,passage:string>>, offers array<string>"


def parsed(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body, quotes, offers."""
    quote = pa.struct([("place", pa.int32()), ("level", pa.int32()), ("hash", pa.string()), ("passage", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(t) for _, part in byte_column(batch, "text") for t in part]
            bodies = pa.array([r[0].decode("utf-8", "replace") if r[0] is not None else None for r in rows], pa.string())
            quotes = pa.array([[{"place": k, "level": n, "hash": h, "passage": p} for k, (n, h, p) in enumerate(r[1])] for r in rows], pa.list_(quote))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], bodies, quotes, pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["conv_id", "turn", "role", "body", "quotes", "offers"])

    chosen = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string").alias("text"))
    return in_arrow(chosen, run, PARSED)


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) -> (of_conv, of_turn, root, depth) of each linked message, by pointer doubling.

    A parent's turn is smaller, so links form trees; each round doubles the hops that a message has
    climbed, and a message holds one pointer whatever the depth.
    """
    cur = stored(links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        step = cur.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        joined = cur.join(step, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        new = stored(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        drop_stored(cur)
        moved = new.where("moved").limit(1).count()
        cur, path = new.drop("moved"), new._ledgerloom_path
        cur._ledgerloom_path = path
        if not moved:
            return cur.select(F.col("conv_id").alias("of_conv"), F.col("turn").alias("of_turn"), F.col("up").alias("root"), "depth")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, parent, root, depth, position, n_quotes, linked: one row per message.

    ``>`` marks give each line its quote level; runs of a level are passages, normalised (A-Z lowered,
    blanks squeezed) and hashed.  A passage's original is the earliest message of the conversation whose
    own text is, or has as a paragraph or line, that passage, if it stands before the quoting message;
    ``linked`` lists (place, level, passage, original).  ``parent`` is the original of the first linked passage of the
    lowest quote level, null where none is linked; ``root`` and ``depth`` come from the chain of
    parents (a message without one is its own root at depth 0).  ``position`` numbers each conversation
    from 0 by (root, depth, turn), so every reply follows what it answers.

    Null conv_ids or turns link to nothing; such messages are roots, and messages with a null conv_id
    are numbered as one conversation.  A null text has a null body, an empty one an empty body.  Repeated
    rows stay, tied in order by role and body; (conv_id, turn) rows that disagree share the smallest parent.
    A conversation of any size is sorted across tasks; originals are one row per passage and
    conversation before they are joined, so a passage repeated in many messages stays one.
    """
    rows = stored(parsed(messages))
    quoting = rows.where("conv_id is not null and turn is not null and size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q"))
    offered = rows.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("oc"), F.col("turn").alias("ot"), F.explode("offers").alias("oh"))
    wanted = quoting.select(F.col("conv_id").alias("wc"), F.col("q.hash").alias("wh")).distinct()
    originals = offered.join(wanted, (F.col("oc") == F.col("wc")) & (F.col("oh") == F.col("wh")), "left_semi").groupBy("oc", "oh").agg(F.min("ot").alias("original"))
    found = quoting.join(originals, (F.col("conv_id") == F.col("oc")) & (F.col("q.hash") == F.col("oh"))).where("original < turn")
    linked = stored(found.select("conv_id", "turn", F.struct("q.level", "q.place", "original", "q.passage").alias("link")).distinct())
    parents = linked.groupBy("conv_id", "turn").agg(F.min("link").alias("first"), F.sort_array(F.collect_set("link")).alias("linked"))
    parents = stored(parents.select(F.col("conv_id"), F.col("turn"), F.col("first.original").alias("parent"), "linked"))
    climbed = threads(parents)
    known = parents.join(climbed, (F.col("conv_id") == F.col("of_conv")) & (F.col("turn") == F.col("of_turn"))).select("of_conv", "of_turn", "parent", "root", "depth", "linked")
    out = rows.join(known, (F.col("conv_id") == F.col("of_conv")) & (F.col("turn") == F.col("of_turn")), "left")
    kind = "array<struct<level:int,place:int,original:bigint,passage:string>>"
    out = out.select(
        "conv_id", "turn", "role", "body", "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("linked", F.array().cast(kind)).alias("linked"),
    )
    return numbered(out)


def numbered(rows: DataFrame) -> DataFrame:
    """``position`` in the conversation by (root, depth, turn), counted over a range sort, not in one task a conversation."""
    order = ["conv_id", "root", "depth", "turn", "role", F.xxhash64("body")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.xxhash64("conv_id", "turn", "role", "body")
    ranged = rows.withColumn("_salt", salt).repartitionByRange(parts, *order[:-1], "_salt").sortWithinPartitions(*order[:-1], "_salt")
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)).drop("_salt"))
    # partitions are in order; how many rows of a conversation each holds is a row per pair, and few pairs
    counts = ranged.groupBy("conv_id", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("n")
    starts = counts.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), (before - F.col("first")).alias("_shift"))
    out = ranged.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("position", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_c", "_p", "_shift")
