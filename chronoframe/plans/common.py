"""Shared plumbing for the registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators.derive import clean_log, derive_session_log
from chronoframe.sources.tables import EVENTS_VOCAB, events_log, stage_table

KEYS = ("Participant", "Condition")
VOCAB = EVENTS_VOCAB
# events are sparse (a few per user-hour), so frames use hourly buckets and
# the running scans chunk sessions by hour (a minute chunk would hold ~2 rows)
FRAME_BUCKET = "hour"
GRAINS = ("hour",)


def derived(spark: SparkSession, sf_dir: str, stage: Sequence[str] = ()) -> DataFrame:
    """The derived session log (C1) of the driver's events table.

    ``stage`` names the columns (besides the keys) that a query reads from
    several branches: these alone are written once to the checkpoint folder
    (see ``stage_table``).  Without ``Hz`` among them the sample rate is joined, not
    fused into the scan: Spark can drop a join that nothing reads.
    """
    fuse_rate = not stage or "Hz" in stage
    dlog = derive_session_log(events_log(spark, sf_dir), KEYS, VOCAB, grains=GRAINS, fuse_rate=fuse_rate)
    return stage_table(dlog.select(*KEYS, *stage), "derived-log") if stage else dlog


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed log without derived columns, for queries that need none of them."""
    return clean_log(events_log(spark, sf_dir))


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Round float results whose last bits depend on distributed summation order."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
