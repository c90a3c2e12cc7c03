"""Training-corpus pipeline: language, boilerplate lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, jaccard_join, lang_id, line_dedup, packing
from tideline.llm.common import stored, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the model learns from their own texts and lang."""
    model = lang_id.fit(docs)
    return lang_id.identify(docs, model).where("NOT rejected").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a tenth of their source's different documents hold; copies are left to the next stage. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, copies_once=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, of items without id too."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), null_ids=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences."""
    return packing.pack_documents(docs, added=True)


STAGES = [("language_id", keep_known_language), ("line_dedup", drop_boilerplate), ("jaccard_join", one_of_each_group), ("decontaminate", drop_leaks), ("packing", pack)]

#: compression, links and packing have no SQL form; tests/llm checks the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
