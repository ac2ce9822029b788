"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``text_statistics`` gives a fixed set of numbers per text (shares of byte classes, word and line
   shapes, repetition), from the text alone.
2. A small random forest over the labelled rows yields tree paths; every path from the root to an inner
   or outer node is a conjunctive rule such as ``upper_share > 0.4 AND words <= 120``.
3. A logistic regression with a lasso penalty over the rules' 0/1 values keeps few of them.
4. The kept rules and their weights are compiled into one Spark column expression over the statistics.

Learning reads at most ``max_rows`` labelled rows outside the held-out fold, those with the smallest hash
of the id; this is the documented bound of the sample. Everything else covers all rows and whole texts.

Cases: null and empty texts have zero statistics and a score like any other; rows without a label are
only scored; several labels of one id count as several rows; with labels of one class only the score is
that class's share everywhere, and 0.5 without labels; an empty table gives an empty result; other
columns pass through.
"""

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quirework.functions.common import materialize
from quirework.llm.text_bytes import BASES, NOT_SPACE, SPACES, Rolling, bounded, utf8, word_spans

STATISTICS = [
    "bytes", "words", "lines", "mean_word", "long_words", "upper_share", "lower_share", "digit_share", "other_ascii_share",
    "high_share", "space_share", "symbol_words", "pipe_share", "exclamation_share", "stop_share", "distinct_words",
    "distinct_pairs", "repeated_words", "sentence_words",
]


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode("latin-1"))] = True
    return out


UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = byte_class("abcdefghijklmnopqrstuvwxyz")
DIGIT = byte_class("0123456789")
HIGH = np.arange(256) >= 128
OTHER = ~(UPPER | LOWER | DIGIT | HIGH | SPACES)
STOP = byte_class(".?")


def statistics_of(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = np.diff(first).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(table[data], dtype=np.int64)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(values, dtype=np.float64)]
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(words, 1)

    hashes = rolling.spans(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])] if len(v) else np.zeros(0, bool)
        return np.bincount(o[new], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    inner = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pairs = rolling.windows(hashes, 2)[inner] if len(hashes) > 1 else np.zeros(0, np.uint64)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & inner] if len(hashes) else np.zeros(0, bool)
    newline = np.r_[0, np.cumsum(data == 10, dtype=np.int64)]
    lines = newline[offsets[1:]] - newline[offsets[:-1]] + 1.0
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    length = (ends - starts).astype(float)
    columns = [
        size, words, lines, per_word(length), per_word(length > 20), share(UPPER), share(LOWER), share(DIGIT), share(OTHER),
        share(HIGH), share(SPACES), per_word(OTHER[tail] & ~STOP[tail] & (tail != ord(","))), share(byte_class("|")), share(byte_class("!")),
        share(STOP), distinct(hashes, owner), distinct(pairs, owner[1:][inner]) if len(owner) else np.zeros(n), per_word(same),
        words / np.maximum(1, share(STOP) * size),
    ]
    return np.column_stack(columns)


def text_statistics(docs: DataFrame, keep: list[str], text_col: str, prefix: str = "") -> DataFrame:
    """The columns ``keep`` and one double column per statistic, its name after ``prefix``."""
    names = [prefix + s for s in STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for batch in bounded(batches, len(keep)):
            values = statistics_of(*utf8(batch.column(len(keep))), rolling)
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(np.ascontiguousarray(c)) for c in values.T]
            yield pa.RecordBatch.from_arrays(columns, keep + names)

    rows = docs.select(*keep, F.col(text_col).alias(f"{prefix}text"))
    schema = StructType(rows.schema.fields[:-1] + [StructField(n, DoubleType()) for n in names])
    return rows.mapInArrow(measure, schema)


def tree_paths(description: str) -> list[str]:
    """Conjunctive rules, as SQL over the statistics, from a forest's printed trees."""
    rules, path = [], []
    for line in description.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line)
        if not found:
            continue
        depth = len(found[1]) // 1
        path = [p for p in path if p[0] < depth] + [(depth, f"{STATISTICS[int(found[2])]} {found[3]} {found[4]}D")]
        rules.append(" AND ".join(p[1] for p in path))
    return sorted(set(rules))


def fit_rules(
    training: DataFrame, trees: int, depth: int, penalty: float, seed: int
) -> tuple[list[tuple[str, float]], float]:
    """``(rule, weight)`` with weights that are not 0, and the intercept."""
    classes = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        share = classes.get(1.0, 0) / max(1, sum(classes.values())) if classes else 0.5
        return [], float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(training)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=5
    ).fit(vectors)
    rules = tree_paths(forest.toDebugString)
    flags = [F.expr(f"CAST({rule} AS DOUBLE)").alias(f"r{i}") for i, rule in enumerate(rules)]
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(
        training.select("label", *flags)
    )
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    model = lasso.fit(table.select("label", "rules"))
    weights = model.coefficients.toArray()
    return [(r, float(w)) for r, w in zip(rules, weights) if w], float(model.intercept)


def compile_rules(rules: list[tuple[str, float]], intercept: float, prefix: str = "") -> Column:
    """The ensemble as one column expression: a probability from the sum of the weights of rules that hold."""
    terms = [F.when(F.expr(re.sub(r"\b([a-z_]+)\b", rf"`{prefix}\1`", rule)), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in rules]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(intercept))))


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    folds: int,
    held_fold: int,
    max_rows: int,
    trees: int,
    depth: int,
    penalty: float,
    seed: int,
) -> tuple[list[tuple[str, float]], float]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    usable = ~held_out("doc_id", folds, held_fold) & F.col("doc_id").isNotNull() & F.col("label").isin(0.0, 1.0)
    sample = marks.where(usable).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    training = materialize(text_statistics(rows.join(F.broadcast(sample), "doc_id"), ["label"], "text"), "labelled")
    return fit_rules(training, trees, depth, penalty, seed)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
    max_rows: int = 20_000,
    trees: int = 12,
    depth: int = 3,
    penalty: float = 0.002,
    seed: int = 7,
    prefix: str = "stat_",
) -> DataFrame:
    """All columns of ``docs`` with ``held_out, score, predicted``, which replace columns of these names."""
    rules = learn_rules(docs, labels, id_col, text_col, label_col, folds, held_fold, max_rows, trees, depth, penalty, seed)
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    scored = text_statistics(docs, docs.columns, text_col, prefix).withColumns(
        {"held_out": held_out(id_col, folds, held_fold), "score": compile_rules(*rules, prefix)}
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*[prefix + s for s in STATISTICS])
