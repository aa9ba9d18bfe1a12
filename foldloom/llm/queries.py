"""The registered queries of this subpackage: one for each operator, over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import bpe_codec, digests, langid, near_dup, packing, quality_rules, secret_scan, substring_dedup, token_files, toxicity
from foldloom.llm.common import documents, shared_dir


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(documents(spark, sf_dir), shared_dir(spark))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, secret_scan.KINDS), F.sha2(secret_scan.shown(base), 256).alias("base_sha256"), secret_scan.shown(F.col("spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), shared_dir(spark))
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), shared_dir(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.judge(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode_decode(documents(spark, sf_dir), vocabulary_path())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(documents(spark, sf_dir), vocabulary_path(), shared_dir(spark) + "/files", end_id=2)
    return token_files.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_neighbours(documents(spark, sf_dir), shared_dir(spark))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path(), shared_dir(spark), capacity=2048, end_id=0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, network).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_toxicity": op3_toxicity,
        "op4_near_dup": op4_near_dup,
        "op5_quality_rules": op5_quality_rules,
        "op6_bpe": op6_bpe,
        "op7_token_files": op7_token_files,
        "op8_quartile_digest": op8_quartile_digest,
        "op9_packing": op9_packing,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op5_quality_rules": quality_rules.ORACLE}
