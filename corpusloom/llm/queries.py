"""Queries of the training-data operators, and SQL for those that SQL can express.

Each query applies its operator to a whole table and derives the result's columns from the
operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, debruijn, exact_dedup, packing, quality, sharding, simhash, suffixes, toxicity, warc
from corpusloom.llm.common import documents, scratch
from corpusloom.llm.oracles import ORACLES


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = quality.quality_verdicts(documents(spark, sf_dir), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(documents(spark, sf_dir), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark_exact(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.mark_repeats(documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = warc.read_archives(spark, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) as bigint)")
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.mark_repeats(documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.col("__severity").alias("severity"), F.col("__grade").alias("grade"), F.col("__p_toxic").alias("p_toxic"), F.col("__rejected").alias("rejected"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_hilbert_sharding, op4_simhash, op5_packing, op6_exact_dedup, op7_substring_dedup, op8_warc, op9_suffix_array_dedup, op10_toxicity)}

__all__ = ["ORACLES", "QUERIES"]
