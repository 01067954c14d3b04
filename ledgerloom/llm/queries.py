"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_dedup, mtree, packing, quality, quotes, simhash, sql, toxicity, urls
from .common import table


def op1_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.reply_ordered(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "body", "parent", "root", "depth", "position", "n_quotes", F.size("linked").cast("long").alias("n_linked"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules_table(spark))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents")).withColumn("n_notices", F.size("notices").cast("long")).drop("notices")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; removed_lines and kept_in are aligned: the doc_id is the class of the line."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "_lines.n_lines", "_lines.n_kept", F.transform("_lines.removed", lambda r: r["line"]).alias("removed_lines"),
        F.transform("_lines.removed", lambda r: r["kept_in"]).alias("kept_in"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quote_threads, op2_url_rules, op3_simhash, op4_decontaminate, op5_pack, op6_toxicity, op7_licenses, op8_topk, op9_quality, op10_line_dedup, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_quote_threads": sql.QUOTES, "op2_url_rules": urls.ORACLE, "op4_decontaminate": sql.DECONTAMINATE, "op8_topk": sql.TOP_K}
