"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import decontam, jaccard_join, langid, mixing, site_lines
from gaugeframe.llm._spark import fold, stored, table, text_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter ("und") or with an ambiguous language go; lang is what was found."""
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = langid.predict(docs, model, keep=docs.columns)
    kept = out.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; documents of nothing else go with them."""
    out = site_lines.drop_boilerplate(docs)
    changed = F.col("n_removed") > 0
    out = out.filter(~changed | (F.trim("kept_text") != ""))
    return out.withColumn("n_chars", F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))).withColumn("text", F.col("kept_text")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of the Jaccard join stays, once."""
    verdicts = jaccard_join.join(docs.select("doc_id", "text"), with_digest=True).filter("keep")
    chosen = verdicts.groupBy("doc_id", "_digest").agg(F.count("*").alias("_rows")).withColumnsRenamed({"doc_id": "_i", "_digest": "_d"})
    keyed = docs.withColumn("_digest", text_digest(F.col("text")))
    joined = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")))
    once = joined.filter("_rows = 1").select(*COLUMNS)
    return once.unionByName(joined.filter("_rows > 1").dropDuplicates(["doc_id", "_digest"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows go from contaminated documents; documents left empty go."""
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    out = out.filter(~F.col("contaminated") | (F.trim("clean_text") != ""))
    return out.withColumn("n_chars", F.when(F.col("contaminated"), F.length("clean_text").cast("bigint")).otherwise(F.col("n_chars"))).withColumn("text", F.col("clean_text")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their sizes, targets and the words the mix takes of each."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The classifier and the seeded block choice have no SQL form; tests/llm checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
