"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, and its decisions take effect: documents of no known language go; one
document of each group of near duplicates stays (the one with the least id); words of repeated passages go, and
documents of which nothing is left with them; secrets give way to ``<kind>``; the rest is packed into sequences.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import langid, near_dup, packing, secret_scan, substring_dedup
from foldloom.llm.common import documents, numbered, shared_dir, staged, unused
from foldloom.llm.queries import vocabulary_path

#: Some stages aren't SQL; tests/llm/test_pipeline.py holds ``run`` against a plain version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) go, and those that are of none of the languages learned
    from ``docs``; ``lang`` becomes the predicted language. Rows are judged one by one, so repeated rows fare alike.
    An empty table, or one without labels, has no network: then only letters count and ``lang`` stays."""
    network = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.keep_known(docs, network)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the least id stays; of rows that share that id one (the least text). Null ids
    count as the least. Texts without words (null, empty) are no duplicates of anything, and stay."""
    folder = shared_dir(spark)
    row = unused(docs, "row_number")
    rows, _ = numbered(docs, f"{folder}/numbered", name=row)
    classes = near_dup.near_duplicates(rows.select(row, "text"), folder, id_col=row)
    gone = classes.filter("doc_id != class_id").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start earlier too go, row by row (rows that share an id are documents of their own, null
    ids the earliest); rows that lose all their words go. Rows that lose nothing keep their text as it is, those
    without words too."""
    folder = shared_dir(spark)
    row, kept = unused(docs, "row_number"), unused(docs, "kept_text")
    rows, _ = numbered(docs, f"{folder}/numbered", name=row)
    done = substring_dedup.dedup(rows.select(row, "text"), folder, id_col=row).filter("n_removed > 0")
    cut = done.select(F.col("doc_id").alias(row), F.col("kept").alias(kept))
    joined = rows.join(cut, row, "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    text = F.coalesce(kept, "text")
    size = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long"))
    return joined.withColumns({"text": text, "n_chars": size}).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets of any layer give way to the name of their kind. Every row stays; null and empty texts stay as they are."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences of 2048 tokens; null and empty texts are one end id, repeated
    rows are packed each."""
    return packing.pack_documents(docs, vocabulary_path(), shared_dir(spark), capacity=2048, end_id=0)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
