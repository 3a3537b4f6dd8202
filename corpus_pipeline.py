"""The corpus pipeline: filter, dedupe, redact, mix, tokenise.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; all but the last keep the columns of documents. Null and
empty texts fail the quality rules and go; an empty table gives an empty table;
further columns are kept, whatever their names, but for names that begin with
two underscores.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from motifspark.llm.bpe import bpe_digests
from motifspark.llm.common import delete_folder, shared_folder
from motifspark.llm.mixing import mix_to_targets
from motifspark.llm.ngrams import near_duplicate_keepers
from motifspark.llm.quality import keep_good
from motifspark.llm.secrets import redact_secrets


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects failing and depleted documents, takes lines above the limits out of the others."""
    return keep_good(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8 or more; one document of each group stays."""
    return near_duplicate_keepers(docs, 5, 4, 5)


def secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every reported span by a mark."""
    return redact_secrets(docs)


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes. Rows of one id (null is one) get the copies of the one with most."""
    copies = mix_to_targets(docs).where("copies > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").cast("int").alias("__copies"))
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*docs.columns)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]
#: The rounding draws random numbers by hash; SQL cannot express it. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage is read back from the shared folder, and the one before it deleted once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{home}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete_folder(spark, last)
        last = path
    return docs
