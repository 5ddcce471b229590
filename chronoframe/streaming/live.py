"""Incremental ingest of session CSV files and a live per-second sample rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from chronoframe.config import EVENT, GAME_VOCAB, TS, EventVocab
from chronoframe.functions.scalars import from_epoch_micros, parse_log_ts


def read_log_stream(
    spark: SparkSession,
    path_glob: str,
    columns: list[str],
    sep: str = ";",
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """New ``*_Event.csv`` / ``*_Sample.csv`` files as a stream of text rows.

    A file stream needs its schema up front: ``columns`` (all text) in the
    files' column order.  With ``enforceSchema=false`` Spark checks every
    file's header against it and fails on a file with another order instead
    of mapping values into the wrong columns (the batch source groups files by
    header instead).  Adds ``filename`` and parses Timestamp.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    stream = (
        spark.readStream.schema(schema)
        .options(header="true", sep=sep, enforceSchema="false", maxFilesPerTrigger=str(max_files_per_trigger))
        .csv(path_glob)
    )
    cols = [F.when(F.col(c) == "NULL", F.lit(None)).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns]
    out = stream.select(*cols, F.col("_metadata.file_path").alias("filename"))
    return out.withColumn(TS, parse_log_ts(TS))


def live_sample_rate(
    log_stream: DataFrame,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "1 second",
    watermark: str = "10 seconds",
) -> DataFrame:
    """W3 on a stream: samples per wall-clock bucket, final once the watermark passes."""
    # read as UTC: a plain cast would shift hours where the session's zone changes its clock
    ts = F.concat(F.col(TS).cast("string"), F.lit("Z")).cast("timestamp").alias("_event_time")
    return (
        log_stream.select(ts, EVENT)
        .withWatermark("_event_time", watermark)
        .groupBy(F.window("_event_time", bucket).alias("window"))
        .agg(F.count_if(F.col(EVENT) == vocab.sample).alias("Hz"))
        .select(from_epoch_micros(F.unix_micros("window.start")).alias("second"), "Hz")
    )


def ingest_stream(log_stream: DataFrame, table_path: str, checkpoint_path: str) -> StreamingQuery:
    """S6 incrementally: append the parsed rows to a Parquet table, exactly once.

    ``checkpoint_path`` belongs on shared storage (next to the table); the
    query processes what is available and stops (``availableNow``).
    """
    return (
        log_stream.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
