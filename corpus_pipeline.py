"""The corpus pipeline: score, deduplicate, decontaminate, mix, and write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import dart_minhash, decontamination, mixing, token_files, toxicity
from quillforge.llm.common import stage_table, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, by a model fitted on the labelled ones.

    A null or empty text has the score of the model's bias alone; without labels every score is one half, and then all
    documents stay, as nothing is known against them. Repeated rows stay or go together."""
    at, weights, bias = model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not len(at) and bias == 0:
        return docs
    # the text travels once; other columns in one struct, so that no name of theirs meets a name used in scoring
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.lit(True).alias("_"), *others).alias("row"), F.col("text").cast("string").alias("text"))
    kept = toxicity.score(rows, model).where("score < 0.5")
    return kept.select(*[F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; rows with a null doc_id or text stay."""
    return dart_minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, nor does any text if there are no items."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; documents without a source are a source of their own."""
    return mixing.mixed(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and boundaries of every document, read back from the written files; a null text has only the end id."""
    return token_files.encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", to_target_weights),
    ("token_files", to_token_files),
]

#: A trained model and signatures are no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written in the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
