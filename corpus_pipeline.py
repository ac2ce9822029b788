"""The training-data pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quirework.functions.common import materialize
from quirework.llm.decontaminate import drop_leaks
from quirework.llm.exact_dedup import exact_dedup, lower_ascii
from quirework.llm.near_dedup import near_dedup
from quirework.llm.packing import pack_documents
from quirework.llm.quality import score_quality

TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c in ("held_out", "score", "predicted")}
    scored = score_quality(docs.withColumnsRenamed(names), labels).where("predicted = 1")
    return scored.drop("held_out", "score", "predicted").withColumnsRenamed({v: k for k, v in names.items()})


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts, the one with the largest id.

    Documents are found again by id and text, since an id may stand for several texts; of rows that repeat
    both, one stays.
    """
    digest = unused(docs, "digest")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest")).distinct()
    named = docs.withColumn(digest, F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(digest) == F.col("kept_digest"))
    found, copy = named.join(kept, same, "left_semi"), unused(docs, "copy")
    first = Window.partitionBy("doc_id", digest).orderBy("doc_id")
    return found.withColumn(copy, F.row_number().over(first)).where(F.col(copy) == 1).drop(copy, digest)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id."""
    return with_ids(docs, near_dedup(docs).where("kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def with_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents whose id is in ``kept``; a null id matches a null id."""
    ids = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None  # the classifier, the tokenizer and the packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
