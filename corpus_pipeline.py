"""A corpus pipeline: quality, exact copies, near copies, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
what it keeps. Every stage's rows are written as Parquet and read again as the next
one's documents. All stages but the last return the columns they were given; the last
returns the pieces of the packed windows.

Rows with a null ``doc_id`` pass through as the operators define it; the near-copy
stage keeps them all if any of them is its group's only row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transectra.llm import exact, jaccard, packing, quality, secrets
from transectra.llm.frames import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier, fitted on these documents, keeps."""
    return quality.keep_good(docs, quality.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the least id."""
    return exact.drop_copies(docs, exact.exact_duplicates(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least id."""
    found = jaccard.similarity_components(docs)
    kept = settle(found.filter("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct())
    # The documents' columns travel as one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by the name of its kind; ``n_chars``, if there, follows the text."""
    masked = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))
    return masked.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: The classifier and the packing cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
