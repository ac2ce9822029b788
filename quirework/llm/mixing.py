"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, at most ``cap`` times its own size; what lies above
that is shared again by weight among the others. With sources in order of the share at which they are full,
running sums give the level of every one at once: a source is full where the level reached without it lies
above its own.

A source's words are taken in complete epochs first, each document once in each. The rest is a sample without
replacement: a document draws an exponential number, -ln(u) over its quality weight, with u from a hash of id
and text, so that reruns agree; documents are sorted by it inside their source, and the running sum of sizes
says which of them lie within the rest of the budget. The one on the border gives the words that still fit.

A source may hold any share of the rows: the order is cut into ranges, each summed alone and shifted by the
totals of those before it (``operators.ordered``).

Cases: a null text has no words; a null source is a source of its own, after the others; documents with a
null id, repeated ids and repeated rows are each drawn; a source without words gets nothing; an empty table
gives an empty result; other columns are not read.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.common import materialize
from quirework.operators.ordered import running_sums

WORD = r"[^\x20\x09-\x0D]+"
SIGNS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def quality_weight(text: Column) -> Column:
    """Share of characters other than ASCII digits and signs, to the power 4: 1 for plain prose, near 0 for lists of numbers."""
    text = F.coalesce(text, F.lit(""))
    share = (F.length(F.translate(text, SIGNS, "")) + 1) / (F.length(text) + 1).cast("double")
    return share * share * share * share


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the values."""
    named = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))
    digits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long")
    return (digits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float, share: float) -> DataFrame:
    """``source, source_size, target`` of rows ``source, source_size``; weights repeat in order of the sources."""
    ranked = running_sums(
        sizes.withColumn("one", F.lit(1)), {"place": "one"}, [F.col("source").asc_nulls_last()], name="mix-ranks"
    )
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    weighted = ranked.select(
        "source", "source_size", "place",
        F.element_at(pattern, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
    )
    by_level = running_sums(
        weighted, {"full_words": "most", "full_weight": "weight"}, [F.col("most") / F.col("weight"), F.col("place")], name="mix-levels"
    )
    all_of = by_level.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = float(all_of["words"] or 0) * share, float(all_of["weight"] or 0)
    level = (F.lit(words) - F.col("full_words")) / (F.lit(weight) - F.col("full_weight"))
    highest = by_level.agg(F.max(level).alias("level")).first()["level"] or 0.0  # the level at the first source that is not full
    return by_level.select(
        "source", "source_size", F.round(F.least(F.col("most"), F.col("weight") * F.lit(highest)), 6).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3,
    share: float = 1.0,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, epochs, draw``: ``taken`` words of ``size`` times
    ``epochs`` complete ones plus those drawn; ``draw`` is the exponential key. ``quality`` is a positive
    weight over the columns of ``docs``."""
    text = F.col(text_col)
    weight = quality_weight(text) if quality is None else quality
    drawn = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        (-F.ln(uniform(F.col(id_col), F.md5(F.coalesce(text, F.lit(""))))) / weight).alias("draw"),
    )
    rows = materialize(drawn, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap, share), "mix-targets")
    placed = running_sums(rows, {"before": "size"}, [F.col("draw"), F.col("doc_id")], group=["source"], name="mix-order")
    joined = placed.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("before")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), epochs.alias("epochs"), "draw"
    )


QUERY_SQL = f"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(t)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / (w * w * w * w) AS draw
  FROM (SELECT *, (length(translate(t, '{SIGNS.replace("'", "''")}', '')) + 1) / CAST(length(t) + 1 AS DOUBLE) AS w
        FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents))),
s AS (
  SELECT source, source_size, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, place
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source)),
l AS (
  SELECT *, 3.0 * source_size / weight AS level,
         coalesce(sum(3.0 * source_size) OVER w, 0) AS full_words, coalesce(sum(weight) OVER w, 0) AS full_weight,
         sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         round(CAST(least(3.0 * source_size, weight * max((words - full_words) / (weights - full_weight)) OVER ()) AS DOUBLE), 6) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(e * size + least(size, greatest(0, budget - e * source_size - before)) AS BIGINT) AS taken
FROM (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e FROM p)"""
