"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm.common import materialise, table
from lakewright.llm.decontamination import decontaminated
from lakewright.llm.mixing import mixed
from lakewright.llm.ngram_jaccard import near_duplicates_removed
from lakewright.llm.token_binary import encoded
from lakewright.llm.toxicity import not_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity model, fitted on those labels that are not held out, does not reject."""
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of documents linked at 0.8 of five-word shingles."""
    return near_duplicates_removed(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the source weights ask for."""
    return mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what the files hold, by document."""
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: The toxicity model and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each writes Parquet that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
