"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of ``documents``. ``run`` writes each stage's rows to the
shared folder and reads them back for the next.

Defined results: rows with null text pass the filters and count as empty; a mix
takes nothing of an empty text, so such rows end there; a document that the mix
takes twice is two rows from then on; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomshed.llm import bpe, mixing, neardup, pii, toxicity
from loomshed.llm.common import free, settings, stored
from loomshed.llm.registry import tokenizer
from loomshed.session import ship, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle near-duplicates."""
    return neardup.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact_documents(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row a copy, in training order."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of their decoding."""
    ranks, pattern = tokenizer(spark)
    return bpe.encode_documents(docs, ranks, pattern)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: Rows that go to Python at a time in the stages that are written; texts of thousands fill an executor's memory.
HELD = 1_000

#: Learned scores and a shingle hash are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(HELD)):
            kept = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if held is not None:
            free(held)
        docs = held = kept
    return STAGES[-1][1](spark, docs, sf_dir)
