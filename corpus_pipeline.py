"""The corpus pipeline: each stage calls one training-data operator on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``. Stages drop or change only what their
operator decides; rows without an id are never dropped, as no operator can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.decontaminate import contamination
from tidemark.llm.ngram_jaccard import ngram_jaccard
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary
from tidemark.llm.scratch import Scratch
from tidemark.llm.substring_dedup import cut_texts, repeated_spans, without

#: A document goes when its likeliest language has less than this share of its words.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter, or no language with a fair share of their words."""
    model = language_id.fit(docs)
    found = language_id.language_id(docs, model)
    rejected = found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)) if model[2] else found.where("false")
    return without(docs, Scratch(spark, "languages").save(rejected.where("doc_id is not null").select("doc_id"), "rejected"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    groups = ngram_jaccard(docs)
    return without(docs, Scratch(spark, "copies").save(groups.where("doc_id <> component_id").select("doc_id"), "copies"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has; what is left of no text goes."""
    return cut_texts(docs, repeated_spans(docs), "n_chars", drop_empty=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    leaks = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, Scratch(spark, "leaks").save(leaks.select("doc_id").distinct(), "leaks"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token pieces placed in sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", join_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models, hashing and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
