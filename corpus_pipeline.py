"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``.

Defined results: null and empty texts pass the filters (nothing in them is
toxic, repeated or a near copy) and get no tokens; rows with a null doc_id
pass, and are never near copies of others; equal rows are one document for the
dedup stages and stay or go together; a document of which line dedup deletes
all lines goes; mixing may return a document several times or not at all; an
empty table gives an empty result; further columns of ``documents``, whatever
their names, stay up to the last stage, which returns doc_id, n_tokens, ids and
decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandworks.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from strandworks.llm.common import saved, table

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_copies(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.first_of_each(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, BPE_FILE)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_to_targets),
    ("bpe", encode),
]

#: Learned weights and iterated dedup are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
