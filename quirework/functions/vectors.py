"""Vector expressions and the default embedder."""

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Fixed value: inputs that a model takes in one call.
MODEL_BATCH = 200


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def wrong_dimension(embedding: Column, dimension: int) -> Column:
    return embedding.isNull() | (F.size(embedding) != dimension)


def hashing_embedder(dimension: int = 64):
    """Column function from a token array to a token-count vector by hashed slot.

    It is the default where a model may stand (``model_embedder``). A distinct token of an Arrow batch is hashed
    once, and all vectors of the batch are counted in one pass over its tokens.
    """

    @F.arrow_udf("array<float>")
    def embed(tokens: pa.Array) -> pa.Array:
        flat, rows = pc.list_flatten(tokens), pc.list_parent_indices(tokens).to_numpy()
        coded = flat.dictionary_encode()
        slots = np.array([int(md5(t.encode()).hexdigest()[:6], 16) % dimension for t in coded.dictionary.to_pylist()], dtype=np.int64)
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        codes = coded.indices.drop_null().to_numpy()
        counts = np.bincount(rows[known] * dimension + slots[codes], minlength=len(tokens) * dimension)
        vectors = pa.array(counts.astype(np.float32))
        ends = pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dimension)
        return pa.ListArray.from_arrays(ends, vectors, mask=tokens.is_null())

    return embed


def model_embedder(open_client: Callable[[], Callable[[list], list]], dimension: int, most: int = MODEL_BATCH):
    """Column function from an input to a model's vector, at most ``most`` inputs per call.

    A task opens one client. Inputs are gathered across Arrow batches, so calls are full but for the
    last one; their order is kept, a null gets a null and no call, and a task without inputs makes none. An
    answer of another length, or with a vector of another dimension, fails the job.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client, waiting = None, []

        def answered(rows: list) -> pd.Series:
            nonlocal client
            asked = [r for r in rows if r is not None]
            found = []
            if asked:
                client = client or open_client()
                found = client(asked)
                if len(found) != len(asked):
                    raise ValueError(f"{len(found)} vectors for {len(asked)} inputs")
                wrong = [len(v) for v in found if len(v) != dimension]
                if wrong:
                    raise ValueError(f"expected {dimension} dimensions, got {wrong[0]}")
            vectors = iter(found)
            return pd.Series([None if r is None else next(vectors) for r in rows], dtype=object)

        for batch in batches:
            waiting.extend(batch)
            while len(waiting) >= most:
                yield answered(waiting[:most])
                del waiting[:most]
        if waiting:
            yield answered(waiting)

    return embed
