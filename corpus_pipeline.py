"""Corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the last return
the columns of `documents`. Stages are written as Parquet to the shared folder and read again.

Decisions: a document without a recognised language (its text is null or has no letter) goes; repeated lines go; of
each near-duplicate group one row stays, that of the smallest doc_id (null last; among texts of one id, the smallest hash; exact
repeated rows are one); contaminated documents go.

Defined cases: an empty table stays empty through all stages; a null doc_id is one id, in fold 0 of the language fit; columns besides doc_id and text travel
packed, so they may have any name and come back unchanged, but n_chars, where there is one, follows the text; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm import decontaminate, jaccard_join, language_id, line_dedup, merge_dropout
from signalmesh.llm.common import settle, shared_dir
from signalmesh.llm.queries import fold_of, table, tokenizer_path

def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and one column `rest` that holds all others by position, so that no operator's own columns clash with theirs."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("row"), *others).alias("rest"))


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(_packed(docs), docs.where(fold_of("doc_id", 5) != 0), keep=["text", "rest"])
    return _unpacked(found.where(F.col("lang_pred") != "und"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _unpacked(line_dedup.dedup_lines(_packed(docs), keep=["rest"]), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _packed(docs).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = jaccard_join.near_duplicates(rows, "_row").select("_row", "component_id").distinct()
    members = rows.select("_row", "doc_id").distinct().join(found, "_row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    stays = members.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return _unpacked(rows.join(stays, "_row", "left_semi").dropDuplicates(["_row"]), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.scan(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["rest"]))
    return _unpacked(found.where(~F.col("contaminated")).withColumnRenamed("id", "doc_id"), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return merge_dropout.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("merge_dropout", encode_pieces),
]

#: Language ID and the encoder are no SQL; tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, uri = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), uri, name)
    return docs
