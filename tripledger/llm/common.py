"""Reading tables, the shared scratch folder, and the text normalisations that operators share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key with more than 1/HOT of all rows is hot, if it has at least LEAST_HOT.
HOT, LEAST_HOT = 20_000, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether df is files read as they are, with columns or rows chosen: such a read gives the same rows in the same order again."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "LogicalRelation" or node.nodeName().startswith("Relation"):
            continue
        if node.nodeName() not in ("Project", "Filter") or not node.deterministic():
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return bool(df.inputFiles())


def rereadable(df: DataFrame, name: str) -> DataFrame:
    """df itself where a second read gives the same, else df written to the shared folder."""
    return df if is_scan(df) else written(df, name)


def size_in_bytes(df: DataFrame) -> int:
    """Spark's own estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread_join(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with values, which holds a key once at most. Keys that hold more than 1/HOT of the rows are salted.

    rows must be a table that was written or a plain read of one, as its order deals the salts. Rows with a null key are spread as
    well; how is inner or left. There are HOT hot keys at most, which bounds what is broadcast.
    """
    n = rows.count()
    if n <= 100 * LEAST_HOT:  # no task could have more
        return rows.join(values, key, how)
    limit = F.lit(max(LEAST_HOT, -(-n // HOT)))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("_salts"))
    place = F.monotonically_increasing_id()
    salt = F.when(F.col(key).isNull(), place % (1 << 20)).when(F.col("_salts").isNotNull(), place % F.col("_salts")).otherwise(0).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")
    right = values.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def ascii_lower(text: Column) -> Column:
    """Null counts as empty; only A-Z change."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back after each batch the memory that Arrow's pool would hold on to; a worker lives as long as its executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return wrapped
