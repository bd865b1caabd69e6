"""The thin opN_ queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, filter_audit, importance, license_scan, line_dedup, mixing, ngram_lm, odd_sketch, quality, secret_scan, simhash, toxicity
from .common import fold_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.lm_scores(table(spark, sf_dir, "documents"), fold_bucket(F.col("doc_id"), 5) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.quality_scores(docs, labels, lambda i: fold_bucket(i, 5) != 0)
    return found.select("doc_id", (fold_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Target weights of the languages, by tokens.
LANGUAGE_TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op4_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = mixing.mix(docs.select("doc_id", "text"), labelled_domains(docs, labels), LANGUAGE_TARGETS)
    return found.select("doc_id", "tokens", "domain", "posterior", "rate", "residual")


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the rows of the labelled table: there the language is taken as known."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id")


def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold_bucket(F.col("doc_id"), 3) != 1))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def as_files(docs: DataFrame) -> DataFrame:
    """``documents`` laid out as a tree: source/lang/(50 ids)/id.txt.

    A document that opens with a notice stands for a licence file: with an even id it lies two levels up, in
    source/lang, else beside its neighbours.
    """
    opens = F.coalesce(F.regexp_extract("text", r"^[^\n]*", 0).rlike("(?i)^(licensed|released) under |^this work is licensed under "), F.lit(False))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    shelf = F.concat_ws("/", top, F.floor(F.col("doc_id") / 50).cast("string"))
    name = F.when(opens, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    place = F.when(opens & (F.col("doc_id") % 2 == 0), top).otherwise(shelf)
    return docs.select("doc_id", F.concat(place, F.lit("/"), name).alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(as_files(table(spark, sf_dir, "documents")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("windows").alias("windows"))
    return best.select("doc_id", "item_id", "similarity", "windows")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"), count("lexed"),
    )


def op9_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_elias_fano, op2_line_dedup, op3_quality_pu, op4_domain_mixing, op5_toxicity_ftrl, op6_license_scan, op7_benchmark_decontamination, op8_secret_scan, op9_ivfpq_search, op10_simhash_near_dedup, op11_filter_interaction_audit, op12_importance_resampling, op13_odd_sketch_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op11_filter_interaction_audit": filter_audit.SQL, "op12_importance_resampling": importance.SQL}
