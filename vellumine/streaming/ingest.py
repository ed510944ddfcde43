"""Incremental ingest of SAM files (ST1-ST4): new files of a folder become Parquet rows, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.sources.sam import TAGS, _sample, parse


def alignments(spark: SparkSession, folder: str, files_per_batch: int = 1000, tags: dict[str, str] = TAGS) -> DataFrame:
    """A stream of the folder's alignments; without ``aln_id``, as order across batches isn't known."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse(lines.select(_sample(F.col("_metadata.file_path")).alias("sample_id"), "value"), tags)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Append what is new in ``folder`` to the Parquet table, by sample, then stop. The checkpoint
    folder must be shared; a restart goes on after the last committed batch."""
    stream = alignments(spark, folder, files_per_batch).writeStream.format("parquet").partitionBy("sample_id")
    return stream.option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running number of primary and secondary records per sample, for a complete-mode sink."""
    return alignments(spark, folder).groupBy("sample_id").agg(F.count_if(F.col("is_secondary") == 0).alias("n_primary"), F.count_if(F.col("is_secondary") == 1).alias("n_secondary"))
