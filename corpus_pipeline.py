"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewright.llm.common import discard, fresh, materialise, released, table, vocabulary
from phrasewright.llm.near_dedup import keep_first_of_each
from phrasewright.llm.packing import pack_documents
from phrasewright.llm.quality_rules import keep_good
from phrasewright.llm.secret_scan import redact
from phrasewright.llm.substring_dedup import remove_repeats

#: SQL cannot express MinHash, anchors or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a document of which nothing is left goes."""
    all_words, lost, _ = added = tuple(fresh(docs.columns, "n_words", "n_removed", "n_windows"))
    out = remove_repeats(docs, added=added).where(f"{lost} = 0 or {lost} < {all_words}")
    return _recount(out.select(*(F.col(f"`{c}`") for c in docs.columns)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    return _recount(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next one reads it; what a stage wrote on its way is then deleted."""
    docs = table(spark, sf_dir, "documents")
    with released(spark) as result:
        for _, stage in STAGES:
            with released(spark) as kept:
                after = materialise(stage(spark, docs, sf_dir), "stage")
                kept.append(after)
            discard(docs)
            docs = after
        result.append(docs)
    return docs
