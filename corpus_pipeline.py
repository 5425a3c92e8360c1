"""A corpus from documents: toxic ones go, near-duplicates go but for one each, repeated passages go, sources are mixed to
their target weights, and the texts become token ids. Every stage is written as Parquet and read again for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, common, mixing, neardup, repeats, toxicity


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of the decoded bytes, and ids."""
    common.tune(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


#: (name, function of the session, the stage's documents and the folder of the tables); all but the last return documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", neardup.stage),
    ("repeated_passages", repeats.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", encode),
]

#: The stages' models, signatures and tokenizer are not SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; without ids, which the written result of the last stage has."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")
