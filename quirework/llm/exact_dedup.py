"""Exact deduplication by a tree of partial aggregations over digest runs (DataFrame functions only).

Every document falls into one of ``runs`` runs by its id. A run holds its distinct digests, in no order,
with the retained id and the number of rows. In each round ``fan_in`` runs are aggregated into one;
the last round leaves one run whose entries name the retained row of every text.
The answer then skips the levels between: one join by digest takes it to the entries of the lowest level,
at most one per digest and run, and a second one to the documents of the run. A text that a third of all rows share therefore
occupies one entry per run on the way up, and its rows stay spread over all runs on the way down.

An entry is verified at every level: two rows merge only where SHA-256, byte length and a second,
unrelated hash of the text agree.

Cases: a null text counts as empty; a null id takes part, but is retained only where no row of the
text has an id; rows that repeat id and text are one document and are retained or dropped together;
an empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.common import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = 1024,
    fan_in: int = 32,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row; texts equal but for A-Z/a-z are one group."""
    retained = {"largest": F.max, "smallest": F.min}[keep]
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    entries = materialize(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
            F.struct(
                F.unhex(F.sha2("text", 256)).alias("sha"),
                F.octet_length("text").alias("bytes"),
                F.xxhash64("text").alias("second"),
            ).alias("digest"),
        ),
        "digests",
    )
    lowest = merge(entries.select("run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), retained)
    top, left = lowest, runs
    while left > 1:
        left = -(-left // fan_in)
        top = merge(top.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), retained)
    answers = lowest.select("run", "digest").join(top.drop("run"), "digest")
    return entries.join(answers, ["run", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest.sha")).alias("text_sha256"),
    )


def merge(runs: DataFrame, retained) -> DataFrame:
    """One round: entries of a run with the same digest become one."""
    return runs.groupBy("run", "digest").agg(retained("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


QUERY_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
