"""From raw documents to token files, in five stages.

Each stage gets what its predecessor kept and returns documents in all their
columns; the last returns the documents' places in the token files. Between
stages the documents are a Parquet table in the shared folder, so a lost
executor costs the tasks that it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontamination, mixing, similarity, token_files, toxicity
from granary.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model is fitted on these documents' labels."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group whose sets of five-word shingles are alike by 0.8 or more."""
    return similarity.one_of_each(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.without_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all documents, as read back."""
    import public_tokenizers

    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [("toxicity", without_toxic), ("jaccard_join", one_of_each), ("decontamination", without_benchmark), ("mixing", mixed), ("token_files", tokens)]
#: Two stages, the fitted model and the tokenizer, have no form in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"after-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
