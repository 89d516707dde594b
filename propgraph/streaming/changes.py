"""A stream of log records applied batch by batch to an equality-delete table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators.changes import COMMIT, DELETE, PUT, EqualityDeleteTable

LOG = "seq bigint, record_type int, record_key string, record_value string, record_ts timestamp_ntz, tx_id bigint, record_version bigint"


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def apply_stream(stream: DataFrame, table: EqualityDeleteTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the records of each micro-batch; changes in a transaction wait until its commit arrives.

    Versions order them, so a batch that is applied again after a failure changes nothing.
    """
    records = stream.where(F.col("record_type").isin(PUT, DELETE, COMMIT))
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: table.append_log(batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records per type and tumbling window; records later than the watermark are left out."""
    at = stream.where(F.col("record_ts").isNotNull()).withColumn("at", F.col("record_ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", window).alias("w"), "record_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "record_type", "n")
