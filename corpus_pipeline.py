"""A corpus pipeline of five stages: toxicity, language, near duplicates, secrets, packing.

Each stage takes all that its predecessor kept; its result is written as Parquet and read again as the next
one's documents. ``run`` does so in the session's shared folder.

Defined results: an empty table passes every stage empty; other columns pass unread; rows that repeat are one document for
the third stage and equal rows for the others; rows without an id pass the first four stages; texts without a letter, and
so null and empty ones, go in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import langid, neardup, packing, secrets, toxicity
from fieldloom.llm.queries import vocabulary
from fieldloom.llm.store import Scratch

#: Texts below this are in none of the languages. Of 10,000 documents in one of the learned languages none scored under 0.39;
#: random letters (three words or more) scored 0.13 to 0.30, sentences in four other languages 0.22 to 0.35.
LEAST_LANGUAGE_SCORE = 0.3


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 stay, null and empty ones too. The words' weights come from all labels, the characters' from all documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model, 0.3)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents' own marks teach stay; texts without a letter or far from all go."""
    return langid.kept(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays (five words, 0.75)."""
    return neardup.representatives(docs).select(docs.columns)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become ``[SECRET]``, and n_chars counts the new text."""
    from pyspark.sql import functions as F

    return secrets.redacted(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", not_toxic),
    ("language_id", in_a_language),
    ("ngram_jaccard_join", no_near_copies),
    ("secret_scans", no_secrets),
    ("best_fit_packing", packed),
]

#: Character models, profiles and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
