"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing, token-ID output.

Defined cases. Null and empty texts fail the quality rules; where a stage gets them all the
same, they are linked with nothing, leak nothing, have size 0 and so are taken no times by the mix.
Rows with a null doc_id pass the Jaccard join and decontamination unjudged. Of equal rows, and of
linked texts, the Jaccard join keeps one, that of the least doc_id; rows that repeat a doc_id with
other, unlinked texts all stay. A null lang or source is a group of its own. Very long texts are
judged whole. Empty tables give empty results. Other columns are carried, whatever their names, by
all stages but the last, which returns doc_id, start, n_tokens and ids_crc32.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from kinegrain.llm import decontaminate, jaccard_join, mixing, quality, token_output
from kinegrain.llm.common import stored, table
from kinegrain.llm.queries import TOKENIZER_FILE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, size=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard files of token ids, and what is read back from them: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder, manifest = token_output.write_token_shards(docs, public_tokenizers.path(TOKENIZER_FILE))
    return token_output.token_digest(token_output.read_token_shards(spark, folder, manifest))


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
