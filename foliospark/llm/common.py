"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import durable, shared_dir  # noqa: F401  durable is used from here

#: Stands for a null id where ids are ordered: nulls come last.
NULL_ID = 2**63 - 1
#: Bytes of an Arrow batch between Spark and Python, about. Each side of a task holds a few of them.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as parquet in the shared folder and read back: columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """The shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to ``ARROW_BYTES``; a lower one stays.

    Plans run after the operator has returned, so the limit is the session's. No result
    depends on it: groups reach Python whole, in more batches.
    """
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ARROW_LIMIT))
    if not 0 < own <= ARROW_BYTES:
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(doc: Column, text: Column) -> Column:
    """128 bits that name a row by its id and its text, either of which may be null."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(doc.cast("string"), F.lit("=")), F.lit("-")), F.coalesce(F.concat(F.lit("="), text.cast("string")), F.lit("-"))).cast("binary")))


def only_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named in ``kept(key)``: one where rows agree in id and text.

    Keys are narrow and written first, so Spark knows their size when it picks the join; only
    rows whose key occurs twice or more are numbered.
    """
    key, number = "_row_key_", "_row_number_"
    named = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    kept = written(kept.select(F.col("key").alias(key)), "kept-keys")
    twice = written(named.groupBy(key).count().where(F.col("count") > 1).select(key), "repeated-keys")
    single = named.join(kept.join(twice, key, "left_anti"), key, "left_semi")
    repeated = named.join(kept.join(twice, key, "left_semi"), key, "left_semi")
    first = repeated.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(number) == 1)
    return single.unionByName(first.drop(number)).select(*docs.columns)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that ``column`` holds about ``most_bytes`` a piece (one row at least)."""
    array = batch.column(column)
    start, held = 0, 0
    for k, n in enumerate(pa.compute.binary_length(array).to_pylist()):
        if held and held + (n or 0) > most_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``each`` over every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
