"""Seeded synthetic query traces from stream statistics, and their replay as one join."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidParams
from ..functions import coverage, draw, estimated_selectivity, long, selectivity_bucket

TEMPLATES = ["single_address", "single_topic0", "address_topic0", "multi_address", "multi_topic0", "compound"]
#: Shares of each template, OR widths of addresses and topics, where block spans come from and their bounds (None: all
#: blocks), and the share of empty results aimed at, for each profile: fixed values.
PROFILES = {
    "expected": {"mix": [0.30, 0.25, 0.25, 0.10, 0.08, 0.02], "widths": (1, 4), "topic_widths": (1, 4), "source": "empirical", "span": (1, 50_000), "empty": 0.0},
    "stress": {"mix": [0.10, 0.20, 0.20, 0.20, 0.20, 0.10], "widths": (2, 32), "topic_widths": (2, 32), "source": "empirical_upper_tail", "span": (1_000, 500_000), "empty": 0.0},
    "adversarial": {"mix": [0.05, 0.15, 0.15, 0.25, 0.25, 0.15], "widths": (8, 128), "topic_widths": (8, 128), "source": "heavy_near_full_range", "span": (10_000, None), "empty": 0.10},
}
UNIT = float(1 << 48)
#: Traces of a profile where nothing else is said.
TRACES = 100_000


@dataclass
class Config:
    """Settings of a dataset and its traces.

    Threads, queue sizes, the spans' source and the share of empty results say nothing to Spark; they are
    kept because the hash of the settings covers them.  The seed is not among those.
    """

    seed: int = 0
    trace_size_per_profile: int = field(default_factory=lambda: TRACES)
    scale_factor: float = 1.0
    max_threads: int | None = None
    event_queue_capacity: int = 8_192
    task_queue_capacity: int = 4_096
    cooccurrence_top_k_per_type: int = 10_000
    logs_per_window_size_blocks: int = 1_000
    profiles: dict = field(default_factory=lambda: {k: dict(v) for k, v in PROFILES.items()})

    def validate(self) -> Config:
        sizes = [self.trace_size_per_profile, self.cooccurrence_top_k_per_type, self.logs_per_window_size_blocks, self.event_queue_capacity, self.task_queue_capacity, self.max_threads or 1]
        if min(sizes) < 1 or self.scale_factor <= 0 or self.max_threads == 0:
            raise InvalidParams("sizes must be positive")
        for name, p in self.profiles.items():
            if abs(sum(p["mix"]) - 1) > 1e-9 or min(p["mix"]) < 0:
                raise InvalidParams(f"{name}: the template mix must be shares that sum to 1")
            if not 0 <= p["empty"] <= 1:
                raise InvalidParams(f"{name}: the share of empty results must be from 0 to 1")
            for low, high in (p["widths"], p["topic_widths"], p["span"]):
                if low < 1 or (high is not None and high < low):
                    raise InvalidParams(f"{name}: bounds must be 1 <= min <= max")
        return self

    def document(self) -> dict:
        """The settings under their names in the canonical JSON."""
        width = lambda w: {"min": w[0], "max": w[1]}
        profiles = {
            name: {
                "template_mix": dict(zip(TEMPLATES, p["mix"], strict=True)), "address_or_width": width(p["widths"]), "topic0_or_width": width(p["topic_widths"]),
                "block_range_blocks": {"source": p["source"], "min": p["span"][0], "max": "full_range" if p["span"][1] is None else p["span"][1]}, "empty_result_target_share": p["empty"],
            }
            for name, p in self.profiles.items()
        }
        own = {k: v for k, v in self.__dict__.items() if k not in ("seed", "profiles")}
        return own | {"max_threads": "num_cpus" if self.max_threads is None else self.max_threads, "profiles": profiles}

    def digest(self) -> str:
        """sha256 of the canonical JSON: keys sorted, no blanks, whole floats as integers."""
        plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
        return hashlib.sha256(json.dumps(plain(self.document()), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def derived_seed(seed: int, domain: str) -> str:
    return hashlib.sha256(seed.to_bytes(8, "little") + domain.encode()).hexdigest()


#: Keys are numbered in the order of so many hex digits of their sha256, then by key: 4,096 buckets to count.
DIGITS = 3


def indexed_keys(stats: DataFrame, kinds: tuple[str, ...] = ("address", "topic0")) -> DataFrame:
    """(kind, key, at): the distinct keys of each type, numbered from 0; any number of keys, as none is collected."""
    bucket = F.substring(F.sha2("key", 256), 1, DIGITS)
    keys = stats.where(F.col("key_type").isin(*kinds)).select(F.col("key_type").alias("kind"), F.col("key_value").alias("key")).distinct().withColumn("bucket", bucket)
    counts = keys.groupBy("kind", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    firsts = counts.select("kind", "bucket", (upto - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("key")) - 1
    return keys.withColumn("place", place).join(F.broadcast(firsts), ["kind", "bucket"]).select("kind", "key", (F.col("first") + F.col("place")).alias("at"))  # 16 ** DIGITS rows a type at most


def pick(u: Column, low: Column, high: Column) -> Column:
    """Uniform whole number in [low, high] from 48 bits."""
    return low + F.floor(u / UNIT * (high - low + 1)).cast("long")


def template_of(u: Column, mix: list[float]) -> Column:
    total, out = 0.0, None
    for name, share in zip(TEMPLATES, mix, strict=True):
        total += share
        test = u / UNIT <= total
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(TEMPLATES[-1])


def traces(spark: SparkSession, stats: DataFrame, start: int, end: int, missing: list[tuple[int, int]] = (), config: Config | None = None) -> DataFrame:
    """Trace entries of all profiles; ``stats(key_type, key_value)`` names the addresses and topics to draw from.

    Draws are hashes of (seed derived for the profile, id, name): the same traces on any number of
    partitions.  A drawn number finds its key by a join, so the keys need not fit in one place.
    """
    config = (config or Config()).validate()
    n = int(config.trace_size_per_profile * config.scale_factor + 0.5)
    plans = [_plan(spark, profile, p, n, start, end, config.seed) for profile, p in config.profiles.items()]
    rows = reduce(DataFrame.unionByName, plans)
    keys = indexed_keys(stats)
    total = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("at"))) + 1, long(0))
    sizes = keys.agg(total("address").alias("address"), total("topic0").alias("topic0"))
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(w).alias("width"), F.col(k).alias("size")) for k, w in (("address", "aw"), ("topic0", "tw"))])
    draws = rows.join(F.broadcast(sizes)).select("profile", "n", F.inline(wanted)).where("width > 0 and size > 0")  # one row of sizes
    own = F.create_map(*[F.lit(x) for p in config.profiles for x in (p, derived_seed(config.seed, p))])
    draws = draws.select("profile", "n", "kind", "size", own[F.col("profile")].alias("seed"), F.explode(F.sequence(long(1), F.col("width"))).alias("k"))
    draws = draws.select("profile", "n", "kind", "k", (draw(F.col("seed"), F.col("n"), F.col("kind"), F.col("k")) % F.col("size")).alias("at"))
    found = draws.join(keys, ["kind", "at"]).groupBy("profile", "n")
    in_order = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("k", "key")))), lambda x: x["key"])
    lists = found.agg(in_order("address").alias("address_or"), in_order("topic0").alias("topic0_or"))  # at most as long as the OR widths
    gone = F.array(*[F.struct(long(a).alias("start"), long(b).alias("end")) for a, b in missing]) if missing else F.array().cast("array<struct<start:bigint,end:bigint>>")
    empty = F.array().cast("array<string>")
    rows = rows.join(lists, ["profile", "n"], "left").withColumns({c: F.coalesce(c, empty) for c in ("address_or", "topic0_or")})
    return rows.select(
        F.concat("profile", F.lit("-"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("id"), "profile", "template", "from_block", "to_block", "address_or", "topic0_or",
        empty.alias("topic1_or"), empty.alias("topic2_or"), empty.alias("topic3_or"), selectivity_bucket(estimated_selectivity(F.col("address_or"), F.col("topic0_or"), F.col("span"))).alias("expected_selectivity_bucket"),
        coverage(F.col("from_block"), F.col("to_block"), gone).alias("observed_block_coverage_ratio"),
    )


def _plan(spark: SparkSession, profile: str, p: dict, n: int, start: int, end: int, seed: int) -> DataFrame:
    """(profile, n, template, from_block, to_block, span, aw, tw): all of a profile's traces but their keys."""
    own = F.lit(derived_seed(seed, profile))
    d = lambda what: draw(own, F.col("n"), F.lit(what))
    low, high = p["widths"]
    t_low, t_high = p["topic_widths"]
    total = end - start + 1
    most = min(p["span"][1] or total, total)
    span = pick(d("span"), long(min(p["span"][0], most)), long(most))
    rows = spark.range(n).withColumnRenamed("id", "n").select("n", template_of(d("template"), p["mix"]).alias("template"), span.alias("span"), pick(d("a_width"), long(low), long(high)).alias("aw"), pick(d("t_width"), long(t_low), long(t_high)).alias("tw"))
    first = pick(d("start"), long(start), long(end) - F.col("span") + 1)
    width = lambda one, many, c: F.when(F.col("template").isin(one), long(1)).when(F.col("template").isin(many), F.col(c)).otherwise(long(0))
    return rows.select(
        F.lit(profile).alias("profile"), "n", "template", first.alias("from_block"), (first + F.col("span") - 1).alias("to_block"), "span",
        width(["single_address", "address_topic0"], ["multi_address", "compound"], "aw").alias("aw"), width(["single_topic0", "address_topic0"], ["multi_topic0", "compound"], "tw").alias("tw"),
    )


#: Block numbers of one window task of a replay.
SPAN = 256


def replay_counts(traces: DataFrame, logs: DataFrame, block_col: str = "block_num", span: int = SPAN) -> DataFrame:
    """(id, matches): every trace's result size from running counts, rather than a query each.

    A key is an address, a topic or a pair of both, as the trace names them; its logs up to the trace's last
    block, less those before its first, are its part of the result.  Counts and the traces' two ends are
    sorted together by (key, span of blocks, block) and summed up once, with one carried row per key and
    span, so neither a hot key nor a wide range meets the logs themselves.
    """
    name = lambda kind, *parts: F.concat(F.lit(kind), *parts)
    pair = lambda a, t: name("p", F.length(a).cast("string"), F.lit(":"), a, t)
    kinds = F.array(name("a", F.col("address")), name("t", F.col("topic0")), pair(F.col("address"), F.col("topic0")))
    hashed = lambda key: [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]  # noqa: E731  128 bits stand for a key
    cells = logs.select(F.col(block_col).alias("block"), F.explode(kinds).alias("key")).where("key is not null").select(*hashed(F.col("key")), "block")
    cells = cells.groupBy("k1", "k2", "block").agg(F.count("*").alias("n"))
    t = traces.select("id", "from_block", "to_block", F.array_distinct("address_or").alias("a"), F.array_distinct("topic0_or").alias("t"))
    both = F.flatten(F.transform("a", lambda a: F.transform("t", lambda t: pair(a, t))))
    keys = F.when(F.size("t") == 0, F.transform("a", lambda a: name("a", a))).when(F.size("a") == 0, F.transform("t", lambda t: name("t", t))).otherwise(both)
    asked = t.select("id", "from_block", "to_block", F.explode(keys).alias("key")).select("id", *hashed(F.col("key")), "from_block", "to_block")
    ends = F.array(F.struct(F.col("to_block").alias("block"), long(1).alias("sign")), F.struct((F.col("from_block") - 1).alias("block"), long(-1).alias("sign")))
    asked = asked.select("k1", "k2", "id", F.inline(ends))
    rows = cells.select("k1", "k2", "block", "n", F.lit(None).cast("string").alias("id"), long(0).alias("sign")).unionByName(asked.withColumn("n", long(0)))
    rows = rows.withColumn("cut", F.floor(F.col("block") / span))
    # at a block its count comes before the ends that stand there
    own = Window.partitionBy("k1", "k2", "cut").orderBy("block", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("k1", "k2", "cut").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k1", "k2").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = sums.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("cut").alias("c"), before.alias("before"))
    seen = rows.withColumn("upto", F.sum("n").over(own)).where("sign <> 0")
    seen = seen.join(before, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("cut") == F.col("c")))
    counts = seen.groupBy("id").agg(F.sum(F.col("sign") * (F.col("upto") + F.col("before"))).alias("matches"))
    return traces.select("id").join(counts, "id", "left").select("id", F.coalesce("matches", long(0)).alias("matches"))
