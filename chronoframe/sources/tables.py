"""Parquet persistence (S6-S8) and the driver's tables as session logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.config import EventVocab, checkpoint_dir

# ---------------------------------------------------------------------------
# How the driver's ``events`` table stands in for a game log.
# Event roles: start "signup", end "purchase", sample "view",
#   spawn "click", expire "error", hit "click".
# Session = (user_id, k % 4) with k the integer in props {"k": n};
#   Condition text is "C" followed by k % 4; object id is "m" followed by k % 8
#   on click and error rows.
# ---------------------------------------------------------------------------
EVENTS_VOCAB = EventVocab(
    start=("signup",), end=("purchase",), sample="view", spawn="click", expire="error", hit="click"
)
PROPS_K_PATTERN = r'"k"\s*:\s*(\d+)'


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Load a persisted log."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Persist a log as compressed Parquet (optionally partitioned)."""
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def events_as_log(events: DataFrame) -> DataFrame:
    """Map ``events`` rows to the raw game-log columns (before derivation).

    Typed columns stay typed (no text round trip); the gaze columns are text,
    as in the logs, and are parsed only where they are used.
    """
    k = F.regexp_extract("props", PROPS_K_PATTERN, 1).try_cast("int")
    kv = F.col("_k")
    is_object = F.col("event_type").isin("click", "error")
    return events.withColumn("_k", k).select(
        F.col("ts").cast("timestamp_ntz").alias("Timestamp"),
        F.col("event_type").alias("Event"),
        F.col("user_id").cast("double").alias("Participant"),
        F.concat(F.lit("C"), (kv % 4).cast("string")).alias("Condition"),
        F.col("user_id").cast("string").alias("SessionID"),
        F.when(is_object, F.concat(F.lit("m"), (kv % 8).cast("string"))).alias("MoleId"),
        F.col("value").alias("MolePositionWorldX"),
        kv.cast("double").alias("MolePositionWorldY"),
        F.col("value").alias("RightControllerLaserPosWorldX"),
        (kv % 10).cast("double").alias("RightControllerLaserPosWorldY"),
        F.col("value").cast("string").alias("WorldGazeHitPositionX"),
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .otherwise(kv.cast("string"))
        .alias("WorldGazeHitPositionY"),
        F.when(F.col("event_type") == "view", F.col("value").cast("string")).alias("WorldGazeHitPositionZ"),
        F.concat(kv.cast("string"), F.lit("e-2")).alias("GazeConfidence"),
        F.col("event_id").alias("_ord"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_log(load(spark, sf_dir, "events"))


def stage_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared ``spark.checkpoint.dir`` and read it back.

    Cuts lineage where several branches consume one expensive DataFrame: it is
    computed once, survives executor loss (files on shared storage), and every
    branch gets a column-pruned scan instead of a recomputation.  The shuffle
    files behind ``df`` go when it is written; the copy is removed by
    ``drop_staged`` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/chronoframe-stage/{name}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        write_table(df, path, partition_by)
    _delete_on_exit(spark, path)
    staged = spark.read.parquet(path)
    staged.staged_at = path
    return staged


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries inside delete their shuffle files as they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def drop_staged(*tables: DataFrame) -> None:
    """Delete copies made by ``stage_table`` whose last reader is done."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Staged copies live as long as the application (Hadoop deleteOnExit)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
