"""Tables kept as logs of deltas and published together.

A store is a folder with ``data``, one folder per write, and ``log``, one file per generation. A generation
names, for each of its tables, the deltas that make it up: new rows, and keys whose earlier rows are gone.
Nothing is visible before its log file is, and a log file appears whole, by a rename that fails where the
number is taken; so a job that dies before leaves the former generation, and two writers can't both win.
The file system needs an atomic rename that doesn't overwrite, as HDFS has.

Every row carries the generation that wrote it. A reader joins rows with the newest removal of their key
and keeps those that are not older; a batch so writes in proportion to itself, whatever the table holds.
``compact`` merges the newest deltas once they are many, older ones as soon as they are no longer much larger.
"""

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirework.functions.common import broadcast_within_bound

GENERATION = "generation"
FILE_BYTES = 128 << 20


class TakenError(RuntimeError):
    """Another writer published the generation first."""


@dataclass
class Change:
    """What a batch does to a table: ``removed`` (keys) lose all their earlier rows, then ``rows`` come in."""

    rows: DataFrame | None = None
    removed: DataFrame | None = None


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def _bytes(spark: SparkSession, path: str | None) -> int:
    if path is None:
        return 0
    files, where = _at(spark, path)
    return files.getContentSummary(where).getLength()


def _read_text(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """The file, whole or not at all, unless it is there already."""
    files, target = _at(spark, path)
    _, draft = _at(spark, f"{path.rpartition('/')[0]}/.draft-{uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise TakenError(path)


def generations(spark: SparkSession, root: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{root}/log") if n[:1] != "." and n.endswith(".json")]


def state(spark: SparkSession, root: str, generation: int | None = None) -> dict:
    """The newest generation, or the given one: number, progress of its sources, deltas of its tables."""
    if generation is None:
        generation = max(generations(spark, root), default=0)
    if generation == 0:
        return {"generation": 0, "progress": {}, "tables": {}}
    return json.loads(_read_text(spark, f"{root}/log/{generation:012d}.json"))


def _write(df: DataFrame | None, root: str, table: str) -> str | None:
    if df is None:
        return None
    path = f"{root}/data/{table}/{uuid4().hex}"
    df.write.parquet(path)
    return path


def publish(
    spark: SparkSession,
    root: str,
    changes: Mapping[str, Change],
    source: str | None = None,
    batch: int | None = None,
) -> int:
    """Publish the changes of all tables as one generation and return its number.

    With ``source`` and ``batch`` the generation also says that the source's batch is done; a batch that
    is done already changes nothing, so a replay is safe.
    """
    now = state(spark, root)
    if source is not None and now["progress"].get(source, -1) >= batch:
        return now["generation"]
    number = now["generation"] + 1
    stamp = F.lit(number).cast("long").alias(GENERATION)
    tables = {name: list(deltas) for name, deltas in now["tables"].items()}
    for name, change in changes.items():
        rows = _write(None if change.rows is None else change.rows.select("*", stamp), root, name)
        gone = _write(None if change.removed is None else change.removed.distinct().select("*", stamp), root, f"{name}-removed")
        delta = {"rows": rows, "removed": gone, "bytes": _bytes(spark, rows) + _bytes(spark, gone)}
        tables.setdefault(name, []).append(delta)
    progress = now["progress"] | ({source: batch} if source is not None else {})
    return _publish_state(spark, root, number, progress, tables)


def _publish_state(spark: SparkSession, root: str, number: int, progress: dict, tables: dict) -> int:
    log = {"generation": number, "progress": progress, "tables": tables}
    _create(spark, f"{root}/log/{number:012d}.json", json.dumps(log))
    return number


def done(spark: SparkSession, root: str, source: str) -> int:
    """The source's last published batch, -1 before the first."""
    return state(spark, root)["progress"].get(source, -1)


def _live(spark: SparkSession, deltas: Sequence[dict], schema: str, key: str) -> DataFrame:
    """Rows of the deltas, with their generation, that no later removal of the deltas takes away."""
    paths = [d["rows"] for d in deltas if d["rows"]]
    if not paths:
        return spark.createDataFrame([], f"{schema}, {GENERATION} long")
    rows = spark.read.schema(f"{schema}, {GENERATION} long").parquet(*paths)
    removed = _removals(spark, deltas, rows.select(key), key)
    if removed is None:
        return rows
    removed = broadcast_within_bound(removed)  # a batch removes little: the table is scanned in place
    kept = F.col("gone").isNull() | (F.col("gone") <= F.col(GENERATION))
    return rows.join(removed.withColumnRenamed(GENERATION, "gone"), key, "left").where(kept).select(*rows.columns)


def _removals(spark: SparkSession, deltas: Sequence[dict], like: DataFrame, key: str) -> DataFrame | None:
    paths = [d["removed"] for d in deltas if d["removed"]]
    if not paths:
        return None
    schema = f"{key} {like.schema[0].dataType.simpleString()}, {GENERATION} long"
    return spark.read.schema(schema).parquet(*paths).groupBy(key).agg(F.max(GENERATION).alias(GENERATION))


def read(
    spark: SparkSession, root: str, table: str, schema: str, key: str = "document_id", generation: int | None = None
) -> DataFrame:
    """The table as of a generation, the newest by default; empty where nothing was published."""
    deltas = state(spark, root, generation)["tables"].get(table, [])
    return _live(spark, deltas, schema, key).drop(GENERATION)


def due(sizes: Sequence[int], ratio: float, most: int) -> int | None:
    """Where the run of newest deltas to merge begins, None while they are at most ``most``.

    The run takes in the delta before it for as long as that one is at most ``ratio`` times the run's bytes,
    so a row is written again once per factor of ``ratio`` that the table grows.
    """
    if len(sizes) <= most:
        return None
    at, run = len(sizes) - 2, sum(sizes[-2:])
    while at > 0 and (sizes[at - 1] <= ratio * run or at >= most):
        at -= 1
        run += sizes[at]
    return at


def compact(
    spark: SparkSession,
    root: str,
    table: str,
    schema: str,
    key: str = "document_id",
    cluster: Sequence[Column] = (),
    ratio: float = 4,
    most: int = 8,
    file_bytes: int = FILE_BYTES,
) -> int | None:
    """Merge the newest deltas where they are more than ``most``; the generation it publishes, or None.

    Files follow the bytes of the merged rows and are ordered by ``cluster`` (the key by default), so scans
    skip row groups. Removals stay for as long as an older delta may hold their rows.
    """
    now = state(spark, root)
    deltas = now["tables"].get(table, [])
    first = due([d["bytes"] for d in deltas], ratio, most)
    if first is None:
        return None
    run = deltas[first:]
    merged = _live(spark, run, schema, key)
    order = list(cluster) or [F.col(key)]
    files = sum(_bytes(spark, d["rows"]) for d in run) // file_bytes + 1
    laid = merged.repartitionByRange(files, *order).sortWithinPartitions(*order)
    removed = _removals(spark, run, merged.select(key), key) if first else None
    rows, gone = _write(laid, root, table), _write(removed, root, f"{table}-removed")
    delta = {"rows": rows, "removed": gone, "bytes": _bytes(spark, rows) + _bytes(spark, gone)}
    tables = now["tables"] | {table: [*deltas[:first], delta]}
    return _publish_state(spark, root, now["generation"] + 1, now["progress"], tables)


def sweep(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete log files but the newest ``keep`` and the folders that none of these names; what was deleted.

    Run it where no reader holds an older generation and no writer is at work.
    """
    numbers = generations(spark, root)
    held = {p for n in numbers[-keep:] for deltas in state(spark, root, n)["tables"].values() for d in deltas for p in (d["rows"], d["removed"])}
    old = [f"{root}/log/{n:012d}.json" for n in numbers[:-keep]]
    folders = [f"{root}/data/{t}/{d}" for t in _names(spark, f"{root}/data") for d in _names(spark, f"{root}/data/{t}")]
    gone = old + [f for f in folders if f not in held]
    for path in gone:
        files, where = _at(spark, path)
        files.delete(where, True)
    return gone
