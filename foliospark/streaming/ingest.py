"""Documents as they arrive: a file stream into the section index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sections import sectionise
from ..sources.documents import doc_key


def read_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """New ``folder/*/*.md`` files as ``(doc_key, doc_type, file, raw)``, a bounded number a batch."""
    files = spark.readStream.option("maxFilesPerTrigger", most_files).option("pathGlobFilter", "*.md").text(f"{folder.rstrip('/')}/*/", wholetext=True)
    # The path is a URI: a plus stands for itself there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    out = files.select(F.col("value").alias("raw"), F.element_at(parts, -2).alias("doc_type"), F.element_at(parts, -1).alias("file")).where(~F.col("file").startswith("._"))
    return out.withColumn("doc_key", doc_key(F.col("doc_type"), F.col("file")))


def write_sections(docs: DataFrame, target: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] = sectionise) -> StreamingQuery:
    """Sections of every micro-batch, once each: a batch is written under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
