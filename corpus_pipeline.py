"""A training corpus from raw documents: quality, line dedup, near-dedup, decontamination, packing.

Every stage takes any table with ``doc_id`` and ``text``: other columns pass through it, whatever their names.
Null and empty texts are judged by the classifier like any other (the score of no indicators), have no
lines to lose, share fingerprint zero (so one of them stays), hold no benchmark passage and are packed as
their end id alone.  Null doc_ids are kept, but give way to numbered ones as keepers.  Repeated rows and
ties are settled by (doc_id, position): one row stays.  Very long texts are read whole.  An empty table
gives an empty table, empty labels reject nothing, an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_dedup, packing, quality, simhash
from ledgerloom.llm.common import drop_stored, scope, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each fuzzy component stays; a document whose last line goes, goes with it."""
    out = line_dedup.line_dedup(docs)
    gone = (F.size("_lines.removed") > 0) & (F.trim(F.col("text"), F.lit(" \t\r\n")) == "")
    out = out.where(~F.coalesce(gone, F.lit(False))).drop("_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.simhash_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and their places in training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier, a tokenizer and MinHash banding are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and reread by the next, its scratch tables deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope(spark):
            after = stored(stage(spark, docs, sf_dir), scoped=False)
        if hasattr(docs, "_ledgerloom_path"):
            drop_stored(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
