"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .chat import CHAT_SQL, chat_digests
from .common import table
from .licenses import scan_licenses
from .mixing import mix_to_targets
from .ngrams import similarity_classes
from .quality import quality_report
from .secrets import secret_digests
from .substrings import strip_repeats
from .topk import TOP_K_SQL, exact_top_k
from .urls import judge_urls, judge_urls_sql

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_url_trust(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark, sf_dir):
    return strip_repeats(table(spark, sf_dir, "documents"), texts=False)


def op3_byte_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op4_secret_links(spark, sf_dir):
    return secret_digests(table(spark, sf_dir, "documents"))


def op5_quality_lines(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


def op6_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat_digests(turns.unionByName(extra))


def op7_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"))
    spelled = F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string")))
    return found.withColumn("spans", F.array_join(spelled, ","))


def op8_source_mix(spark, sf_dir):
    return mix_to_targets(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return similarity_classes(table(spark, sf_dir, "documents"), 3, 9, 10)


def op10_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {f.__name__: f for f in (op1_url_trust, op2_suffix_dedup, op3_byte_bpe, op4_secret_links, op5_quality_lines, op6_chat_format, op7_license_scan, op8_source_mix, op9_ngram_join, op10_exact_top_k)}
ORACLE = {"op1_url_trust": judge_urls_sql(), "op6_chat_format": CHAT_SQL, "op10_exact_top_k": TOP_K_SQL}
