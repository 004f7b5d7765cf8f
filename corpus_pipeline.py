"""Corpus preparation: language ID, line dedup, near-dedup by shingles, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimiq.llm.common import fresh_name, materialize, read_table
from mimiq.llm.langid import UNKNOWN, held_out, identify, train
from mimiq.llm.lines import dedup_lines, row_key
from mimiq.llm.packing import pack_documents, vocabulary_text
from mimiq.llm.secrets import redact_secrets
from mimiq.llm.simhash import alike_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that language ID leaves undetermined go.

    So null and empty texts go, and texts without a letter. Null and repeated ids are no
    matter, but rows of null ids teach nothing. Without labelled text there is no language, and no row stays.
    """
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    judged = identify(docs, model, keep=tuple(docs.columns))
    return judged.filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur earlier.

    Every row stays, rows of null or repeated ids too; null texts stay null. An empty table gives an empty one.
    """
    return _counted(dedup_lines(docs, distance=None, exact_short=True)).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in 0.8 of its five-word shingles: the one of least doc_id (null ids last).

    Rows are told apart by id and text, not by id alone: rows of one id with different
    texts, and rows without id, are documents of their own. Of rows that repeat id and text
    one stays. Texts without words, null ones among them, are one group. An empty table gives an empty one.
    """
    key, copy = fresh_name(docs, "row_key"), fresh_name(docs, "copy")
    found = alike_documents(docs)
    kept = found.filter("first").groupBy("row_key").agg(F.count("*").alias("n_rows")).withColumnRenamed("row_key", key)
    some = docs.withColumn(key, row_key("doc_id", "text")).join(kept.select(key, F.col("n_rows").alias(copy)), key)
    # rows that repeat id and text: one of them stays
    once = some.filter(F.col(copy) == 1).select(*docs.columns)
    return once.unionByName(some.filter(F.col(copy) > 1).dropDuplicates([key]).select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; nulls, empty texts and repeated rows pass as they are."""
    return _counted(redact_secrets(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in packed sequences; null texts count as empty, repeated rows once each, and no rows give none."""
    return pack_documents(docs, vocabulary_text())


STAGES = [("language", language), ("lines", lines), ("near", near), ("secrets", secrets), ("packing", packing)]

#: No SQL: fingerprints, tokens and trained scores have no form in it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
