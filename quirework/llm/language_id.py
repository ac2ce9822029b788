"""Language identification by prediction by partial matching over bytes.

Per language, the counts of byte strings up to ``order`` + 1 form a variable-order context tree. A byte
costs the code length of its probability after the longest known context; where the byte was never seen
after that context, the context's escape probability is paid and the context shortened (method C: the
number of distinct successors against the number of occurrences). Below the empty context all bytes are
equally likely. The statistics are frozen: scoring never updates them. The language with the shortest
code for the whole text wins, ties by name.

The trees of all languages are kept whole, as one table per string length that holds, for each string, only
the languages that know it. The code length of a text is a sum over its strings of 1 to ``order`` + 1 bytes,
looked up a batch at a time.

Learning reads at most ``per_language`` documents of each language, those with the smallest hash of the
id, and whole texts of at most ``max_bytes`` bytes each. This is the documented bound of the training
sample; every text of the table is scored whole.

Cases: null text or text without a letter gives ``und`` and score 0; rows without a language are never
learned from; with nothing to learn from every text is ``und``; repeated rows are scored each; an empty
table gives an empty result; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quirework.llm.text_bytes import bounded, utf8

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def count_strings(docs: DataFrame, order: int) -> DataFrame:
    """``lang, gram, n``: occurrences of every byte string of 1 to ``order`` + 1 bytes, summed per batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            langs = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for lang in sorted(set(langs)):
                parts = [data[offsets[i] : offsets[i + 1]] for i, value in enumerate(langs) if value == lang]
                for k in range(1, order + 2):
                    grams = [g for part in parts if len(g := packed(part, k))]
                    if grams:
                        values, n = np.unique(np.concatenate(grams), return_counts=True)
                        columns = [pa.array([lang] * len(values)), pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(n)]
                        yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def packed(data: np.ndarray, k: int) -> np.ndarray:
    """Every ``k`` consecutive bytes as one number."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = data[:n].astype(np.int64)
    for j in range(1, k):
        out = out << 8 | data[j : n + j]
    return out


class Level:
    """What a byte string of one length adds to the code length, for the languages that know it, string by string."""

    def __init__(self, gram: np.ndarray, lang: np.ndarray, change: np.ndarray, escape: np.ndarray) -> None:
        order = np.lexsort((lang, gram))
        self.grams, first = np.unique(gram[order], return_index=True)
        self.first, self.lang = np.r_[first, len(gram)], lang[order]
        self.both, self.escape = (change + escape)[order], escape[order]

    def add(self, out: np.ndarray, owner: np.ndarray, gram: np.ndarray, last: np.ndarray) -> None:
        """Sums per owner and language; the ``last`` string of a text is no context of a further byte."""
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[place] == gram)
        place, owner, last = place[known], owner[known], last[known]
        n = self.first[place + 1] - self.first[place]
        entry = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits = self.both[entry]
        ends = np.flatnonzero(np.repeat(last, n))
        bits[ends] -= self.escape[entry[ends]]
        wide = out.shape[1]
        out += np.bincount(np.repeat(owner * wide, n) + self.lang[entry], bits, out.size).reshape(out.shape)


class Model:
    """Context trees of all languages, every context of the sample.

    The code length of a text is a sum over its byte strings: each known context adds its escape, and each
    string seen after its context takes that escape and the cost after the shorter context back and adds its own.
    """

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], langs: list[str], order: int) -> None:
        """``counts``: per k the gram numbers, language numbers and occurrences of the strings a language has."""
        self.langs, self.order, self.levels = langs, order, []
        self.empty = np.zeros(len(langs))  # escapes of the empty context
        name = lambda lang, gram: lang.astype(np.int64) << 48 | gram
        costs, escapes = [], []
        for k in range(1, order + 2):
            gram, lang, n = counts[k]
            heads, head = np.unique(name(lang, gram >> 8), return_inverse=True)
            distinct = np.bincount(head, minlength=len(heads))
            scale = np.log2(np.bincount(head, n, len(heads)) + distinct)
            costs.append(scale[head] - np.log2(n))
            escapes.append((heads, scale - np.log2(distinct), head))
        for k in range(1, order + 2):
            gram, lang, _ = counts[k]
            heads, escape, head = escapes[k - 1]
            if k == 1:
                self.empty[heads >> 48] = escape
                shorter = np.full(len(gram), 8.0)
            else:  # what follows a context also follows its ends
                names = name(counts[k - 1][1], counts[k - 1][0])
                by_name = np.argsort(names)
                shorter = costs[k - 2][by_name[np.searchsorted(names[by_name], name(lang, gram & ((1 << 8 * (k - 1)) - 1)))]]
            own = np.zeros(len(gram))
            if k <= order and len(escapes[k][0]):
                heads, further, _ = escapes[k]
                at = np.minimum(np.searchsorted(heads, name(lang, gram)), len(heads) - 1)
                own = np.where(heads[at] == name(lang, gram), further[at], 0.0)
            self.levels.append(Level(gram, lang, costs[k - 1] - escape[head] - shorter, own))

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text per language."""
        out = np.diff(offsets)[:, None] * (8.0 + self.empty)
        step = 1 << 16
        padded = np.r_[np.zeros(self.order, np.uint8), data]
        for at in range(0, len(data), step):
            place = np.arange(at, min(at + step, len(data)))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, at, at + len(place))))
            before, last = place - offsets[owner], place == offsets[owner + 1] - 1
            low, high = owner[0], owner[-1] + 1
            owner = owner - low
            gram = np.zeros(len(place), np.int64)
            for k, level in enumerate(self.levels):
                gram |= padded[place + self.order - k].astype(np.int64) << 8 * k
                full = before >= k
                if len(level.grams):
                    level.add(out[low:high], owner[full], gram[full], last[full])
        return out


def learn(training: DataFrame, order: int) -> Model | None:
    """Sums of the bounded sample come to the driver: at most as many strings as the sample has bytes."""
    table = count_strings(training, order).toArrow()
    if not table.num_rows:
        return None
    names = sorted(set(table["lang"].unique().to_pylist()))
    lang = pc.index_in(table["lang"], pa.array(names)).to_numpy()
    k, gram, n = (table[c].to_numpy() for c in ("k", "gram", "n"))
    return Model({length: (gram[k == length], lang[k == length], n[k == length]) for length in range(1, order + 2)}, names, order)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    order: int = 3,
    per_language: int = 1000,
    max_bytes: int = 200_000,
) -> DataFrame:
    """Learn from the documents outside the held-out fold, score all."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(held_out("doc_id", folds, held_fold), F.lit(False)).alias("held_out")
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held & (F.octet_length("text") <= max_bytes))
    picked = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = usable.select("doc_id", "lang").withColumn("rank", picked).where(F.col("rank") <= per_language).select("doc_id").distinct()
    model = learn(usable.join(F.broadcast(chosen), "doc_id", "left_semi"), order)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches, 2):
            texts = batch.column(2)
            data, offsets = utf8(texts)
            lengths = np.diff(offsets)
            ascii_letter = np.r_[0, np.cumsum((((data | 32) >= 97) & ((data | 32) <= 122)), dtype=np.int64)]
            letters = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for i in np.flatnonzero(~letters & (lengths > 0)):
                letters[i] = has_letter(texts[int(i)].as_py())
            letters &= model is not None
            langs, values, per_byte = ["und"] * len(letters), np.zeros(len(letters)), np.zeros(len(letters))
            if letters.any():
                bits = model.costs(data, offsets)
                best = bits.argmin(1)
                gaps = np.minimum(bits - bits.min(1, keepdims=True), 1000.0)
                values = np.where(letters, 1.0 / np.exp2(-gaps).sum(1), 0.0)
                per_byte = np.where(letters, bits.min(1) / np.maximum(lengths, 1), 0.0)
                langs = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(langs, pa.string()), pa.array(values), pa.array(per_byte)],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return rows.select("doc_id", held, "text").mapInArrow(score, RESULT)
