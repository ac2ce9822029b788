"""Texts with unmapped private-use codes, refused as rows and not in silence."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quirework.functions import text as T


def unmapped_codes(rows: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """(key, codes): sorted labels of the codes that no repair maps, over all rows of a key; keys without any are left out."""
    labels = (F.when(F.col(t).rlike(T.THAI_PUA), T.codepoint_labels(F.col(t), T.UNMAPPED_THAI_PUA)) for t in texts)
    found = F.flatten(F.array(*(F.coalesce(each, F.array().cast("array<string>")) for each in labels)))
    return (
        rows.select(key, F.explode(F.array_distinct(found)).alias("code"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("code")).alias("codes"))
    )


def split_unmapped(rows: DataFrame, key: str, texts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, violations): a key with an unmapped code in any row loses all its rows and gets a violation."""
    violations = unmapped_codes(rows, key, texts)
    return rows.join(violations.select(key), key, "left_anti"), violations


def block_unmapped(qa: DataFrame, violations: DataFrame) -> DataFrame:
    """Gate rows in which the codes found elsewhere than on pages (``document_id, codes``) count, too."""
    name = "unmapped_pua_codepoints"
    both = F.array_sort(F.array_union(F.from_json("measured", "array<string>"), F.col("codes")))
    hit = (F.col("check") == name) & F.col("codes").isNotNull()
    return (
        qa.join(violations, "document_id", "left")
        .withColumn("passed", F.when(hit, F.lit(False)).otherwise(F.col("passed")))
        .withColumn("measured", F.when(hit, F.to_json(both)).otherwise(F.col("measured")))
        .select(*qa.columns)
    )
