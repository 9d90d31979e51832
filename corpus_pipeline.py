"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and rereads it as the next stage's documents. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import decontaminate, mixing, near_dup, token_files, toxicity
from sessionloom.llm.common import read, stored
from sessionloom.llm.queries import tokenizer_path

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE, SIMILARITY = 5, (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; each row is judged by its own whole text, however
    long. Rows with null or empty text stay, as do all rows where nothing is labelled; a null doc_id
    is never a training row; equal rows go or stay together; an empty table stays empty."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates, by all shingles of whole
    texts. Rows without words (null, empty, blanks) or with a null doc_id all stay; of equal rows one
    stays; rows that share a doc_id are judged by their own texts; an empty table stays empty."""
    return near_dup.keep_one(docs, SHINGLE, SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item in any passage of their whole text. Rows with null or
    empty text stay, as do all where the benchmark is empty; equal rows go or stay together."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to three times, or never. Rows without
    words stay as often as the whole part of their source's rate says; a null source is a source of
    its own, the last; of equal rows any may be taken more often; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix: doc_id, start, n_tokens, ids_crc32 as read back from them. A null or
    empty text is its end id alone; repeated rows are written once each; texts of any length are
    encoded whole."""
    return token_files.token_table(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the random rounding; tests hold each stage against cases
#: planted in its input, the mix against its operator and the token files against the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
