"""Readers: typed tables from parquet or JSON lines, and raw files with their content hash."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.operators.tables import cells_to_markdown, pad_rows
from quirework.sources import schemas
from quirework.sources.chained_hashes import hash_in_parts, lines_as_bytes

# Most bytes of a file that one task reads, and names that the reader of lines takes for compressed text.
PART_BYTES = 256 << 20
COMPRESSED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd|lzo|xz)$"


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.PAGES, fmt)


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.BLOCKS, fmt)


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Tables with ragged rows padded and ``markdown`` rendered where the source has none."""
    tables = read_table(spark, path, schemas.TABLES, fmt)
    padded = tables.withColumn("cells", pad_rows(F.col("cells"), F.col("col_count")))
    return padded.withColumn("markdown", F.coalesce("markdown", cells_to_markdown(F.col("cells"))))


def read_questions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, schemas.QUESTIONS, fmt)


def read_attacks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Attack cases; only an expected answer makes a question answerable."""
    return with_answerable(read_table(spark, path, schemas.ATTACKS, fmt))


def with_answerable(attacks: DataFrame) -> DataFrame:
    return attacks.withColumn("answerable", F.col("expect") == "answer")


def read_file_hashes(
    spark: SparkSession, path: str, glob: str | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(path, length, file_hash) of binary files, hashed where they are read.

    A file of more than ``part_bytes`` is no value of one row: it is read in parts, one after another. Names that a
    reader of lines would decompress are the exception, up to the 2 GB that a value may have.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    large = (F.col("_metadata.file_size") > part_bytes) & ~F.col("_metadata.file_name").rlike(COMPRESSED)
    whole = files.filter(~large).select("path", "length", F.sha2(F.col("content"), 256).alias("file_hash"))
    apart = files.filter(large).select(F.col("_metadata.file_path").alias("file"), "path", "length")
    if apart.isEmpty():
        return whole
    lines = lines_as_bytes(spark, path, glob).filter(large)
    return whole.unionByName(hash_in_parts(apart, lines, part_bytes))


def spread_small_input(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores, such as one small
    file; a scan with enough splits is returned as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
