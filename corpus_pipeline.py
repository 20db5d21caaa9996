"""A training corpus from raw documents: five stages, each one an operator of lakeloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the docs of the next one. All but the last return the
columns of documents.

Edge cases, for every stage: rows are told apart as rows, so null and repeated
doc_ids neither merge nor lose texts; a null text counts as an empty one (it has a
score, fingerprint zero, no personal data, size zero and one end token); very long
texts are worked on whole; an empty table gives an empty result; further columns
are carried along under any name. The first stage keeps a row or not by its text
alone; the second keeps one row of each group of near-copies (smallest doc_id,
nulls last); the third changes texts and n_chars only; the fourth leaves out,
keeps or repeats whole rows; the last gives a row for each piece of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import mixing, packing, pii, quality_classifier, simhash
from lakeloom.llm.common import id_and_text, materialise, spare_name, table
from lakeloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: one with the smallest doc_id."""
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    return pii.mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights: a document occurs as often as the mix takes it, those the classifier scores well first."""
    # Fitted on the raw documents: hardly a bad one is left among docs.
    model = quality_classifier.fit(id_and_text(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    score = spare_name(docs, "score")
    scored = quality_classifier.with_score(docs, model, score)
    return mixing.mixed_documents(scored, F.col(score)).drop(score)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents, packed into sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("pii", personal_data),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

#: zstandard dictionaries, SimHash and a tokenizer can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs)
    return docs
