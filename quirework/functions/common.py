"""Small helpers shared by the operators: let-binding, checked broadcasts, durable scratch space."""

import atexit
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression.

    Adjacent projections get merged by the optimizer, which can move a costly
    expression into a lambda and evaluate it per element; a lambda variable cannot
    be moved.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _width(name: str, kind: str) -> Column:
    """About the bytes of a value, from its lengths alone."""
    value = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        size = F.octet_length(value)
    elif kind == "array<string>":
        size = F.size(value) * 16 + F.octet_length(F.array_join(value, ""))
    elif kind.startswith("array") and "<" not in kind[6:]:
        size = F.size(value) * 8
    elif "<" in kind:
        size = F.length(F.to_json(F.struct(value)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long") + 8


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """Measure a frame against the broadcast bound: counts and sums per task, nothing gathered."""
    probe = (
        df.select(sum((_width(name, kind) for name, kind in df.dtypes), F.lit(0)).alias("width"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes"))
        .first()
    )
    return probe["n"] <= max_rows and probe["bytes"] <= max_bytes


def broadcast_within_bound(df: DataFrame, **bounds: int) -> DataFrame:
    """Broadcast hint only when the measured size allows it; a shuffle join otherwise."""
    return F.broadcast(df) if fits_broadcast(df, **bounds) else df


_SCOPE: ContextVar[str | None] = ContextVar("scratch scope", default=None)


@cache
def _local_scratch() -> str:
    folder = tempfile.TemporaryDirectory(prefix="quirework-")
    atexit.register(folder.cleanup)
    return folder.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine, which is
    removed when the process ends. Inside ``temporary_tables`` the path lies in the scope's folder.
    """
    if scope := _SCOPE.get():
        return f"{scope}/{name}-{uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """A scope whose tables written by ``materialize`` are deleted at its end; frames read from
    them must have been written elsewhere or collected by then."""
    folder = scratch_path(spark, "scope")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps reuse the rows
    (a model is called once) and a lost executor does not recompute them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
