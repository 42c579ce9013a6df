"""From raw documents to packed training sequences: quality rules, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir), reads all rows of ``docs`` and returns a
DataFrame; all but the last return the columns of ``docs``. Null and empty texts
fail the quality rules; of rows that repeat id and text near-dedup leaves one, other texts of one id are judged apart.
Columns of ``docs`` whose names an operator uses for its results are set aside
and put back. An empty table goes through every stage as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheet.llm import decontam, neardup, packing, quality_rules, secret_scan
from docsheet.llm.common import delete_table, materialise, scratch, set_aside

#: A document more than half of whose words are test items goes; below that the passages are cut out.
MAX_COVERAGE = 0.5
#: Near-duplicates share this percentage of their shingles of so many words.
SIMILAR, SHINGLE_WORDS = 80, 5


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with any columns called like one of ``names`` renamed, and what selects the columns as they were."""
    own, back = set_aside(docs, *names)
    return own, lambda df: back(df.select(own.columns))


def _rewritten(changed: Column) -> Column:
    return F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules of text or host go."""
    own, back = _aside(docs, "quality")
    return back(quality_rules.judge(own).where("quality.kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the least doc_id."""
    return neardup.deduplicate(docs, SIMILAR, width=SHINGLE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents over ``MAX_COVERAGE`` go."""
    own, back = _aside(docs, "contamination", "_hit")
    marked = decontam.mark(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    cut = decontam.remove(marked.withColumn("_hit", F.col("contamination.n_hit") > 0), MAX_COVERAGE)
    return back(cut.withColumn("n_chars", _rewritten(F.col("_hit"))))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    own, back = _aside(docs, "secret_spans", "_hit")
    scanned = secret_scan.scan(own, secret_scan.default_model(spark))
    clean = secret_scan.redact(scanned.withColumn("_hit", F.size("secret_spans") > 0))
    return back(clean.withColumn("n_chars", _rewritten(F.col("_hit"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece, with its ids."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secret_scan", redact_secrets), ("packing", pack)]

#: Hash signatures, the suffix automaton and the tokenizer have no SQL form: a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each writes Parquet that the next one reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):  # what a stage wrote on its way goes with it
            docs = materialise(stage(spark, docs, sf_dir), kept=True)
        if before is not None:
            delete_table(before)
        before = docs
    return docs
