"""URL filters: a sort-merge range join of reversed-host keys against nested rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (host, path, verdict) of the crawl policy: fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first ``://`` (A-Z lower-cased) and path; both empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(text, URL, 1)), F.regexp_extract(text, URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """Reversed labels, a slash that no host holds, and the path: a rule's keys are those with its key as prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("/"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule the rules whose intervals hold its key, itself first, the innermost before the outer.

    A rule is the interval of keys from its own key on that begin with it, so intervals nest.  Enclosing
    rules are found by an equi-join on the prefixes of each key that are as long as some rule's.
    """
    rules = rules.select(canonical(lower_ascii(F.col("host")), F.col("path")).alias("key"), lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    # rules repeated with other verdicts: the smallest verdict by name (allow before block) stands
    rules = rules.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.min("verdict").alias("verdict"))
    prefixes = rules.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", 1, n))).alias("outer"))
    held = rules.select(F.col("key").alias("outer"), F.struct(F.length("key").alias("size"), F.col("key").alias("prefix"), "host", "path", "verdict").alias("rule"))
    joined = prefixes.join(held, "outer").groupBy("key").agg(F.collect_list("rule").alias("rules"))
    return joined.select("key", F.sort_array("rules", asc=False).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` (url, ...) with ``_host``, ``_path``, ``_rule`` and ``_verdict``, one row per page.

    A rule (host, path) fits its host and all subdomains where the path starts with the rule's; the
    longest host plus path wins (then the longer host).  Every suffix of a host gives one key.  Keys
    and rules are sorted together and swept once: the last rule at or before a key carries the stack of
    rules still open there, and the innermost that the key begins with is the one in force.  Equal
    (host, path) pairs are judged once; keys are dealt out by a hash of their pair, and the rules (a
    policy, not data: rows times partitions) to each part, so no host is swept in one task.  Null,
    empty and malformed urls have an empty host and path and no rule; empty rules judge by ``default``;
    repeated pages stay; other columns pass through (those named as the four added ones are replaced).
    """
    spark = pages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_and_path(F.col("url"))
    added = ("_host", "_path", "_rule", "_verdict")
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in added]).alias("rest"), host.alias("_host"), path.alias("_path"))
    pairs = pages.select("_host", "_path").distinct().withColumn("_part", F.pmod(F.xxhash64("_host", "_path"), F.lit(parts)).cast("int"))
    labels = F.split("_host", r"\.", -1)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.slice(labels, F.size(labels) - n + 1, n)))
    keys = pairs.where("_host <> ''").select("_part", "_host", "_path", suffix.alias("suffix"))
    keys = keys.select("_part", F.concat(F.array_join(F.reverse("suffix"), "."), F.lit("/"), F.col("_path")).alias("key"), F.lit(1).alias("kind"), "_host", "_path")
    stacks = rule_stacks(rules).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    events = keys.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)).unionByName(stacks.select("_part", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path"), "stack"))
    sweep = Window.partitionBy("_part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    rule = F.get(F.filter("open", lambda r: F.startswith("key", r["prefix"])), F.lit(0))
    rule = F.struct((F.length(rule["host"]) + F.length(rule["path"])).alias("size"), F.length(rule["host"]).alias("host_size"), F.concat(rule["host"], rule["path"]).alias("name"), rule["verdict"].alias("verdict"))
    # the sweep is dealt by _part, which is a function of the pair: no other shuffle
    best = swept.withColumn("rule", F.when(F.size(F.filter("open", lambda r: F.startswith("key", r["prefix"]))) > 0, rule)).groupBy("_part", "_host", "_path").agg(F.max("rule").alias("rule"))
    best = best.where("rule is not null").select(F.col("_host").alias("_of_host"), F.col("_path").alias("_of_path"), F.col("rule.name").alias("_rule"), F.col("rule.verdict").alias("_found"))
    out = pages.join(best, (F.col("_host") == F.col("_of_host")) & (F.col("_path") == F.col("_of_path")), "left")
    return out.select("rest.*", "_host", "_path", "_rule", F.coalesce("_found", F.lit(default)).alias("_verdict"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The policy as a DataFrame of literal rows, without a Python worker."""
    schema = "array<struct<host:string,path:string,verdict:string>>"
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in (RULES if rules is None else rules)])
    return spark.range(1).select(F.inline(rows.cast(schema)))


ORACLE = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT page_id, p.host AS host, p.path AS path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) = 1
"""
