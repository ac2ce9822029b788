"""Lexical retrieval: conjunctive token match, ranked by cover density or term frequency."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions import text as T
from quirework.functions.common import broadcast_within_bound, fits_broadcast, let, materialize

# Fixed value: weight of a token without a label in the cover-density rank.
COVER_WEIGHT = 0.1

# Most anchors that stand in a plan as literals.
ANCHOR_LITERALS = 20_000

# Postings that a task hands over at once.
POSTING_ROWS = 50_000

POSTINGS = "term string, chunk_id string, document_id string, positions array<int>"


def postings(chunks: DataFrame) -> DataFrame:
    """Inverted index rows: (token, chunk_id, tf, positions), positions from 1."""
    return (
        chunks.select("chunk_id", F.posexplode(T.tokenize(F.col("content"))).alias("pos", "token"))
        .groupBy("token", "chunk_id")
        .agg(
            F.count("*").alias("tf"),
            F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"),
        )
    )


def tokens_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tokens): the stored tokens where the chunk table has them; otherwise they are written once."""
    if "tokens" in chunks.columns:
        return chunks.select("chunk_id", "tokens")
    return materialize(chunks.select("chunk_id", T.tokenize(F.col("content")).alias("tokens")), "tokens")


def question_terms(questions: DataFrame, tokenized: DataFrame) -> DataFrame:
    """(question_id, terms, anchor): distinct tokens and the one in the fewest chunks.

    Frequencies are counted for the questions' own vocabulary only, partially in each task.
    Blank questions, and those with a term that no chunk has, are dropped.
    """
    terms = F.array_distinct(T.tokenize(T.normalize_query(F.col("question"))))
    asked = questions.select("question_id", terms.alias("terms")).filter(F.size("terms") > 0)
    words = asked.select("question_id", F.explode("terms").alias("term"))
    vocabulary = broadcast_within_bound(words.select("term").distinct())
    frequency = (
        tokenized.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .join(vocabulary, "term")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        words.join(frequency, "term", "left")
        .groupBy("question_id")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("term")).alias("l"), F.col("term").alias("anchor"))).alias("rarest")
        )
        .filter("rarest.n > 0")
        .select("question_id", "rarest.anchor")
    )
    return asked.join(rarest, "question_id")


def lexical_matches(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, terms, tokens) of chunks that hold every term of a question.

    Each question is looked up by its rarest term only and the other terms are verified on
    the chunk's own token array, so a frequent word is compared in place and never sent
    over the network. With a question set within the broadcast bound no shuffle happens;
    beyond it candidates are found by a shuffle join on the anchor and verified after
    joining the chunk back.
    """
    tokenized = tokens_of(chunks)
    terms = materialize(question_terms(questions, tokenized), "terms")
    holds_all = F.size(F.array_intersect("terms", "tokens")) == F.size("terms")
    if fits_broadcast(terms):
        anchors = terms.select("anchor").distinct()
        known = [r["anchor"] for r in anchors.limit(ANCHOR_LITERALS + 1).collect()]
        if len(known) <= ANCHOR_LITERALS:  # one hash set for all chunks
            held = tokenized.withColumn("anchor", F.array_distinct(F.filter("tokens", lambda t: t.isin(known))))
        else:
            one = anchors.agg(F.collect_set("anchor").alias("anchors"))  # one row, as bounded as the terms
            held = tokenized.join(F.broadcast(one)).withColumn("anchor", F.array_intersect("tokens", "anchors"))
        probe = held.filter(F.size("anchor") > 0).select("chunk_id", "tokens", F.explode("anchor").alias("anchor"))
        matched = probe.join(F.broadcast(terms), "anchor").filter(holds_all)
    else:
        anchors = tokenized.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("anchor"))
        candidates = anchors.join(terms, "anchor").select("question_id", "chunk_id", "terms")
        matched = candidates.join(tokenized, "chunk_id").filter(holds_all)
    return matched.select("question_id", "chunk_id", "terms", "tokens")


def term_frequency(tokens: Column, terms: Column) -> Column:
    hits = F.filter(tokens, lambda t: F.array_contains(terms, t))
    return F.size(hits).cast("double")


def cover_density(places: Column, n_terms: Column) -> Column:
    """Sum over minimal spans holding every term of weight / (1 + other words inside).

    ``places`` are structs (pos, term), in order of pos, with terms numbered from 1. One fold over them
    keeps the newest place of each term; the state is as long as the question.
    """
    nowhere = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("pos"))
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(-1).alias("covered"),
        F.array_repeat(nowhere, n_terms.cast("int")).alias("newest"),
        F.lit(0.0).alias("total"),
    )

    def step(state: Column, place: Column) -> Column:
        here = F.struct(state["at"].alias("at"), place["pos"].cast("int").alias("pos"))
        newest = F.transform(state["newest"], lambda old, i: F.when(i + 1 == place["term"], here).otherwise(old))

        def closed(newest: Column) -> Column:
            begin = F.array_min(newest)
            opens = begin["at"] > state["covered"]  # no term is missing, and the span begins later than the last one
            others = place["pos"] - begin["pos"] - (state["at"] - begin["at"])
            return F.struct(
                (state["at"] + 1).alias("at"),
                F.when(opens, begin["at"]).otherwise(state["covered"]).alias("covered"),
                newest.alias("newest"),
                F.when(opens, state["total"] + F.lit(COVER_WEIGHT) / (1 + others)).otherwise(state["total"]).alias("total"),
            )

        return let(newest, closed)

    return F.aggregate(places, start, step, lambda state: state["total"])


def places_of(tokens: Column, terms: Column) -> Column:
    """Where the terms stand among the tokens, as ``cover_density`` reads them."""
    at = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), F.array_position(terms, t).cast("int").alias("term")))
    return F.filter(at, lambda p: p["term"] > 0)


def cover_of_tokens(tokens: Column, terms: Column) -> Column:
    return cover_density(places_of(tokens, terms), F.size(terms))


def lexical_topk(
    questions: DataFrame, chunks: DataFrame, k: int, rank: str = "cover", digits: int = 6
) -> DataFrame:
    """(question_id, chunk_id, score, rank): best k chunks per question, ties by chunk id."""
    score = {"cover": cover_of_tokens, "tf": term_frequency}[rank]
    scored = lexical_matches(questions, chunks).select(
        "question_id", "chunk_id", F.round(score(F.col("tokens"), F.col("terms")), digits).alias("score")
    )
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Rank by score; the limit is applied inside each task before the shuffle."""
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def stored_postings(chunks: DataFrame) -> DataFrame:
    """The inverted index as it is stored (``POSTINGS``): one row per term of a chunk, its places from 1 in order.

    A chunk's tokens stand in one row, so the places of an Arrow batch are ordered by chunk and term in its task
    and cut into runs: nothing is shuffled.
    """
    types = dict(chunks.dtypes)
    schema = f"term string, chunk_id {types['chunk_id']}, document_id {types['document_id']}, positions array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            flat, rows = pc.list_flatten(tokens), pc.list_parent_indices(tokens).to_numpy()
            if len(flat) == 0:
                continue
            coded = flat.dictionary_encode()
            at = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            run = rows * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(run, kind="stable")
            begins = np.flatnonzero(np.diff(run[order], prepend=-1))
            first = order[begins]
            ends = np.append(begins, len(order)).astype(np.int32)
            columns = [
                flat.take(pa.array(first)),
                batch.column("chunk_id").take(pa.array(rows[first])),
                batch.column("document_id").take(pa.array(rows[first])),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32))),
            ]
            yield from pa.table(columns, ["term", "chunk_id", "document_id", "positions"]).to_batches(max_chunksize=POSTING_ROWS)

    return chunks.select("chunk_id", "document_id", "tokens").mapInArrow(cut, schema)


def postings_matches(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, chunk_id, n_terms, places) of chunks that hold every term of a question, from stored postings.

    The index is scanned, not shuffled: its rows meet the questions' vocabulary, then the rarest term of
    each question, within the broadcast bound; what is left are rows of the questions' own terms. A question of
    one term has its postings for an answer. Candidates of a longer one are the postings of its rarest term, each
    checked against the postings of the others.
    """
    terms = F.array_distinct(T.tokenize(T.normalize_query(F.col("question"))))
    asked = questions.select("question_id", terms.alias("terms")).filter(F.size("terms") > 0)
    every = materialize(
        asked.select("question_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("i", "term"))
        .withColumn("i", F.col("i") + 1),
        "question-terms",
    )
    alone, words = every.filter("n_terms = 1"), every.filter("n_terms > 1")
    place = lambda i: F.transform("positions", lambda p: F.struct(p.alias("pos"), i.alias("term")))
    single = index.join(broadcast_within_bound(alone), "term").select("question_id", "chunk_id", "n_terms", place(F.col("i")).alias("places"))

    vocabulary = broadcast_within_bound(words.select("term").distinct())
    own = index.join(vocabulary, "term", "left_semi")
    frequency = own.groupBy("term").agg(F.count("*").alias("n"))
    rarest = (
        words.join(frequency, "term", "left")
        .groupBy("question_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("term")).alias("l"), "term")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("question_id", F.col("rarest.term").alias("term"))
    )
    anchors = broadcast_within_bound(materialize(rarest, "anchors"))
    candidates = index.select("term", "chunk_id").join(anchors, "term").select("question_id", "chunk_id")
    wanted = materialize(candidates.join(broadcast_within_bound(words), "question_id"), "wanted")
    held = own.join(broadcast_within_bound(wanted), ["term", "chunk_id"])
    in_order = F.array_sort(F.flatten(F.collect_list(place(F.col("i")))))
    return (
        held.groupBy("question_id", "chunk_id")
        .agg(F.first("n_terms").alias("n_terms"), F.count("*").alias("n_held"), in_order.alias("places"))
        .filter("n_held = n_terms")
        .drop("n_held")
        .unionByName(single)
    )


def postings_topk(questions: DataFrame, index: DataFrame, k: int, rank: str = "cover", digits: int = 6) -> DataFrame:
    """``lexical_topk`` over stored postings."""
    n_places = F.size("places").cast("double")
    # every place of a lone term is a span of its own, without other words inside
    cover = F.when(F.col("n_terms") == 1, n_places * COVER_WEIGHT).otherwise(cover_density(F.col("places"), F.col("n_terms")))
    score = cover if rank == "cover" else n_places
    scored = postings_matches(questions, index).select("question_id", "chunk_id", F.round(score, digits).alias("score"))
    return top_k(scored, k)
