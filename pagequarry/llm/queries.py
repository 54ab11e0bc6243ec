"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, divergence, html_main, jaccard_join, lexical, license_scan, mixing, packing, quality_classifier, quality_rules, setsketch, shard
from .common import table
from .sql import SQL

#: The vocabulary that packing counts by; a path, so any other file of the tokenizers library will do.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=("doc_id",), budget_share=1.5)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_text(table(spark, sf_dir, "pages"))


#: Share of the texts that pass the classifier's guard which its query draws.
DRAWN = 0.98


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = quality_classifier.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), share=DRAWN)
    return drawn.withColumn("kept", F.lit(True))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_segments(rows.unionByName(more)))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.kept(quality_rules.BASE)).alias("base_failed"),
        quality_rules.kept(quality_rules.V2).alias("kept"),
        "failed_bits",
        "n_lines",
        "n_capitals",
        "n_bangs",
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=10)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_rows(table(spark, sf_dir, "documents"), n_shards=8)


def op11_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_df=10, top=10)


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sharding": op10_sharding,
    "op11_setsketch_near_dedup": op11_setsketch_near_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_divergence": op13_source_divergence,
}

__all__ = ["QUERIES", "SQL", "TOKENIZER"]
