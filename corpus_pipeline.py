"""From raw documents to tokens: five stages, each a function of (spark, docs, sf_dir).

Each stage's result is written as Parquet and read again as the next one's documents. All but the last return the
columns of ``documents``; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontamination, linededup, minhash, toxicity
from corpusloom.session import persist_table

#: The tokenizer's vocabulary, in the folder of public tokenizers; a path works as well.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the labelled input rows, scores below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, docs, labels)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that keep one line of each group of near-equal lines; documents that lose all their lines go."""
    out = linededup.keep_first_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to a noticeable extent."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the ids decode to the text byte by byte."""
    import public_tokenizers

    path = VOCABULARY if "/" in VOCABULARY else public_tokenizers.path(VOCABULARY)
    ranks = bpe.read_ranks(path)
    return bpe.encode_checked(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = persist_table(docs, f"pipeline-{name}")
    return docs


#: The learnt lexicon, line groups and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
