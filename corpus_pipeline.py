"""The corpus pipeline: documents through five stages of ionlake.llm, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() applies them to the documents of sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionlake.llm.decontaminate import drop_contaminated
from ionlake.llm.line_dedup import drop_boilerplate_lines
from ionlake.llm.mixing import mix_to_targets
from ionlake.llm.near_dedup import near_duplicates
from ionlake.llm.quality_rules import quality_verdicts
from ionlake.llm.work import Workspace


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose id has a verdict that keeps it; rows without an id stay."""
    gone = verdicts.filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go.

    Rows that share an id stand or fall together; a row without an id stays; a
    null or empty text fails the base rules; an empty table gives no rows.
    """
    return _only(docs, quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text.

    All rows stay, also repeated ones and those that lose every line; a null
    text and its n_chars stay as they are; a null source is a source of its own.
    """
    out = drop_boilerplate_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more, the one with the least id stays.

    Rows that share an id are one document and go or stay together; rows without
    an id, and null or empty texts, stay.
    """
    return _only(docs, near_duplicates(docs, num=4, den=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item's shingles go.

    Null, empty and blank texts stay, and so do all rows where there are no items.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked weights, with topic, n_tokens, weight and prob, which replace columns of those names.

    Documents without words are not sampled; rows that share an id go or stay
    together; a null source or lang counts as ''; an empty table gives no rows.
    """
    added = ("topic", "n_tokens", "weight", "prob")
    out = mix_to_targets(docs)
    return out.filter("mix.kept").select(*(c for c in docs.columns if c not in (*added, "mix")), *(f"mix.{c}" for c in added))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: MinHash candidates and certified cutoffs aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.keep(docs, name)
    return docs
