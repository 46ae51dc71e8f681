"""Registered queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .decontaminate import contaminated_pairs
from .language_id import predict_language
from .line_dedup import drop_boilerplate_lines
from .lm_score import score_texts
from .mixing import mix_to_targets
from .near_dedup import near_duplicates
from .oracles import ORACLES
from .quality_classifier import score_quality
from .quality_rules import quality_verdicts
from .secret_scan import BASE_RULES, scan_in_increments, span_text
from .warc import read_archive, write_archive
from .work import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int = 5) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_to_targets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "mix.topic", "mix.n_tokens", F.round("mix.weight", 8).alias("weight"), F.round("mix.prob", 6).alias("prob"), "mix.kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold() == 1)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    uri = work.path("bundles")
    work.fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(uri))
    index = write_archive(table(spark, sf_dir, "pages"), uri, work=work)
    read = read_archive(index, uri)
    target = F.regexp_extract("refers_to_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", target.cast("long")).alias("refers_to"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"), fold() != 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan_in_increments(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    rules = F.transform("spans", lambda s: s["rule"])
    counts = [(F.size("spans") - F.size(F.array_remove(rules, k))).cast("long").alias(f"n_{r.name}") for k, r in enumerate(BASE_RULES)]
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text("spans").alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_quality_rules,
        op3_benchmark_decontamination,
        op4_source_mixing,
        op5_line_dedup,
        op6_lm_scoring,
        op7_quality_classifier,
        op8_warc,
        op9_language_id,
        op10_secret_scan,
    )
}


__all__ = ["ORACLES", "QUERIES"]
