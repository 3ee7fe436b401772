"""A training-data pipeline: toxicity, near duplicates, secrets, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.  Each stage's result is
written to the shared folder and read again, which cuts the lineage: a lost
executor costs the stage that runs, at most.  A stage's files go when its successor's
are written.

Results for odd input: a null text passes as empty; of rows that repeat a doc_id the
stage of near duplicates keeps one (see :func:`ngram_join.keep_first`); rows without a
doc_id pass every stage but have no place in the mixture; an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import bpe_backtrack, ngram_join, pfair_mix, secret_ledger, weak_toxicity
from corpuscle.llm._spark import cleaning, forget, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go."""
    return weak_toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles, the one with the smallest id stays."""
    return ngram_join.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are marked out; no document goes."""
    return secret_ledger.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture; no document goes."""
    return pfair_mix.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, the hashes of ids and decoded text, and ``mix_slot`` and ``mix_position``.

    Files don't keep the order of rows, so the place in the mixture, which the ids
    and sources determine, becomes columns here and orders the output.
    """
    return pfair_mix.with_places(bpe_backtrack.encode_documents(docs, ids=True, digests=True), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Toxicity is a fitted model, so SQL can't give the rows; tests/llm/test_pipeline.py holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        rows = stage(spark, docs, sf_dir)
        with cleaning(spark):
            rows.write.parquet(path)
        if last:
            forget(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
