"""The corpus pipeline: five operators, one after the other, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of ``documents``; the
last adds tokens, domain, posterior, rate and residual. ``run`` writes each stage to the session's shared folder and
reads it again, so that a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import decontamination, line_dedup, mixing, registry, simhash_dedup, toxicity
from headwater.llm.common import cut, fold_bucket

#: Documents that score so much or more are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the rows that op5 learns from."""
    labels = registry.table(spark, sf_dir, "labels").where(fold_bucket(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out_col="toxicity")
    return scored.where(F.col(scored.columns[-1]) < TOXIC).select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines; ``n_chars`` follows where a text is not null."""
    kept = line_dedup.drop_boilerplate(docs, count_cols=None)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return kept.withColumn("n_chars", length).select(docs.columns)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; op10's own contract (three words, 3 bits) is that query's alone."""
    return simhash_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = registry.table(spark, sf_dir, "labels")
    return mixing.mix(docs, registry.labelled_domains(docs, labels), registry.LANGUAGE_TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_near_duplicate),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_targets),
]

#: Fingerprints, fitted models and gradient rounds have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
