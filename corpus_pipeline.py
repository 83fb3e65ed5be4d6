"""From raw documents to token digests: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footreach.llm import decontam, language_id, line_dedup, near_copies, queries, simhash
from footreach.llm.common import discard, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or unlike every language that was learned.

    Null and empty texts have no letters and go. Without a labelled row nothing can be learned and every document goes.
    Repeated rows are judged alike; a null id is never held out of training. Other columns pass through."""
    models = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.identify(docs, models).where("not rejected").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents repeat; n_chars is that of what is left.

    No document goes: one may be left empty. Rows that repeat an id are one document, as are all null ids; a null text
    becomes an empty one. Of documents that hold a repeated line, the one with the largest id keeps it."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op6's groups, by its own shingles and radius: one document of each stays, the one with the smallest id. Not a stage."""
    return simhash.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Groups are those of op6, by its fingerprints and radius,
    joined where texts of two of them are near copies (five-word shingles, Jaccard 0.8 or more).

    Texts without words, null ones too, are copies of each other. A null id stays only in a group of nothing else; of
    rows with equal ids and near copies one stays, while an id may stay twice with different texts."""
    return near_copies.keep_one(docs, radius=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other values in its slots, go.

    All rows of an id go together, and so do all null ids. Null or empty texts and items hold nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left, a row for each document; a null text counts as empty. This is no column of documents."""
    return queries.sentencepiece_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

#: Trained models and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote is removed once the next one has read it."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, before, sf_dir))
        if k:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
