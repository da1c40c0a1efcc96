"""Corpus pipeline: toxicity, line dedup, near-dedup, secret scan, packing; each stage is written and read again.

Rows: documents judged toxic go; of repeated three-line windows the first stays, documents that lose all their lines
go; of near-duplicate documents the one of smallest doc_id stays; secrets are replaced by a mark; what is left is
packed. All stages but the last return the columns of documents, with n_chars kept in step with text. No stage can be
written as SQL end to end (a trained network, a similarity join and a packing heuristic), so there is no ORACLE_SQL;
the tests compare the stages with plain versions.

Defined cases: null and empty texts pass every stage and pack as their end id alone; rows without doc_id are never
dropped as near copies; rows that share doc_id and text share every decision; of equal texts under different doc_ids the
smallest stays; texts of any length are read whole; ties go to the smaller doc_id; empty tables give empty results;
other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import line_dedup, near_dedup, packing, secrets, toxicity
from chronolens.llm.common import drop_stored, free_name, store, table

ORACLE_SQL = None


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    [score] = free_name(docs, "score")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), result=score)
    return scored.filter(F.col(score) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines_in, lines_kept = free_name(docs, "lines_in", "lines_kept")
    left = line_dedup.dedup_lines(docs, (lines_in, lines_kept)).filter((F.col(lines_kept) > 0) | (F.col(lines_in) == 0))
    return _with_length(left, docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secrets.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, store(stage(spark, docs, sf_dir))
        if k:
            drop_stored(last)
    return STAGES[-1][1](spark, docs, sf_dir)
