"""The corpus pipeline: toxicity, near-dedup, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.  Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytewright.llm.common import discard, settle, table
from bytewright.llm.minhash import NearDupParams, first_of_each
from bytewright.llm.mixing import repeat_documents
from bytewright.llm.packing import PackParams, pack_documents
from bytewright.llm.queries import word_tokenizer
from bytewright.llm.secret_scan import scan_secrets
from bytewright.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies are documents at Jaccard 0.80 or more.  22 collections of 3 miss a pair there with probability 3.4e-6.
NEAR = NearDupParams(percent=80, collections=22)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model predicts as toxic; it learns from the labelled rows of ``docs``."""
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate group, and one row of each that is repeated.

    Rows without a doc_id stay, once per text; a text stays whatever becomes of another with its doc_id.
    """
    return first_of_each(docs.select(*COLUMNS), NEAR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret, also one found in a decoded layer, in the text."""
    return scan_secrets(docs.select(*COLUMNS), redact=True).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents until each source has its target words."""
    return repeat_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one row per piece."""
    return pack_documents(docs, PackParams(word_tokenizer()))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Learnt scores, minhashes, decoders and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
